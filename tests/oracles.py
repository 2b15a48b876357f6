"""Compare a query's rows with its DuckDB SQL over the same tables."""

import datetime
import decimal
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def order(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def connect(folder):
    db = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def same(df, sql, folder):
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    answer = connect(folder).execute(sql)
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=order)
    assert got == expected
