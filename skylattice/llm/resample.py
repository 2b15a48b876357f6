"""Operator 11: importance resampling towards a target distribution, with hashed n-grams read off running CRCs.

A document is brought to lower-case words with one space between and scanned once: the CRC-32 of everything up to the end of
each word is kept. The CRC of any n-gram follows from two of these without looking at its bytes again: the CRC of a text A
followed by B is that of A, shifted by B's length, plus that of B over GF(2), so taking the shifted prefix away leaves the
n-gram's own. A shift by a number of bytes is a product of at most one matrix per bit of that number.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import slices_by_bytes

#: Bytes of a text as they are scanned: A-Z in lower case; a-z, 0-9 and all of other scripts as they are; else a space.
SCANNED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def byte_table() -> np.ndarray:
    """What one byte of zeros does to a CRC's low byte, by the reversed polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


@functools.cache
def shift_tables(bit: int) -> np.ndarray:
    """The shift by ``2**bit`` bytes of zeros, as four tables, one for each byte of a CRC."""
    spread = np.arange(256, dtype=np.uint32)
    whole = np.stack([spread << np.uint32(8 * i) for i in range(4)])
    if bit == 0:
        return byte_table()[whole & 255] ^ (whole >> 8)
    return apply(shift_tables(bit - 1), apply(shift_tables(bit - 1), whole))


def apply(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return tables[0][crcs & 255] ^ tables[1][(crcs >> 8) & 255] ^ tables[2][(crcs >> 16) & 255] ^ tables[3][crcs >> 24]


def shift(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of bytes."""
    out = crcs.astype(np.uint32)
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        some = np.flatnonzero((sizes >> bit) & 1)
        out[some] = apply(shift_tables(bit), out[some])
    return out


@dataclass
class Scan:
    """Words of a group of texts: the CRC of each text's normalised form up to the end of each word, where that is, and the
    words before each text."""

    crcs: np.ndarray
    places: np.ndarray
    offsets: np.ndarray


def scan(texts: Iterable[bytes]) -> Scan:
    """One pass over each text."""
    crcs, places, counts = [], [], [0]
    for text in texts:
        words = text.translate(SCANNED).split()
        counts.append(len(words))
        if words:
            crcs.append(np.fromiter(accumulate(words[1:], lambda crc, word: crc32(word, crc32(b" ", crc)), initial=crc32(words[0])), np.uint32, len(words)))
            places.append(np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1)
    return Scan(np.concatenate([np.zeros(0, np.uint32), *crcs]), np.concatenate([np.zeros(0, np.int64), *places]), np.cumsum(counts))


def gram_crcs(found: Scan, n: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC of every run of ``n`` words of a text, from the CRCs at its end and at the end of the space before it; and the text
    of each."""
    texts = np.repeat(np.arange(len(found.offsets) - 1), np.diff(found.offsets))
    starts = np.arange(max(0, len(texts) - n + 1))
    starts = starts[texts[starts] == texts[starts + n - 1]]
    first = starts == found.offsets[texts[starts]]
    low, before = np.uint32(0xFFFFFFFF), found.crcs[starts - 1] if len(starts) else found.crcs[:0]
    spaced = (byte_table()[((before ^ low) ^ np.uint32(0x20)) & 255] ^ ((before ^ low) >> 8)) ^ low
    prefix = np.where(first, np.uint32(0), spaced)
    sizes = found.places[starts + n - 1] - np.where(first, 0, found.places[starts - 1] + 1 if len(starts) else 0)
    return shift(prefix, sizes) ^ found.crcs[starts + n - 1], texts[starts]


def features(texts: Iterable[bytes], most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and all its runs of 1 to ``most`` of them: bucket and text of each run."""
    found = scan(texts)
    grams = [gram_crcs(found, n) for n in range(1, most + 1)]
    return np.diff(found.offsets), np.concatenate([x for x, _ in grams]).astype(np.int64) % buckets, np.concatenate([x for _, x in grams])


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())


def _n_bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")


def bucket_counts(df: DataFrame, text_col: str, most: int, buckets: int, group_bytes: int = 8 << 20) -> np.ndarray:
    """Features of all rows in each bucket. Each task adds its own up; at most ``buckets`` rows a task are shuffled, and as
    many reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices_by_bytes(batch.column(0).to_numpy(), group_bytes):
                total += np.bincount(features(_texts(batch.column(1)[part]), most, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in df.select(_n_bytes(text_col), text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: a thousand times the logarithm of the smoothed shares' ratio, rounded down."""
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(df: DataFrame, gains: np.ndarray, *, id_col: str, text_col: str, most: int, group_bytes: int = 8 << 20) -> DataFrame:
    """``id_col, n_words, n_features, weight`` of each row."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, texts = batch.columns
            for part in slices_by_bytes(sizes.to_numpy(), group_bytes):
                words, found, rows = features(_texts(texts[part]), most, buckets)
                counts = np.bincount(rows, minlength=len(words))
                totals = np.diff(np.concatenate([[0], np.cumsum(gains[found[np.argsort(rows, kind="stable")]])])[np.concatenate([[0], np.cumsum(counts)])])
                weights = np.where(counts > 0, totals // np.maximum(counts, 1), 0)
                yield pa.RecordBatch.from_arrays([keys[part], *(pa.array(x, pa.int64()) for x in (words, counts, weights))], [id_col, "n_words", "n_features", "weight"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, _n_bytes(text_col), text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """A thousand times a Gumbel variate drawn from the id's hash, rounded down."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((head.cast("double") + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, take: int, id_col: str) -> DataFrame:
    """``rows`` (with ``score`` and ``eligible``) and ``rank``: the place of the ``take`` best among the eligible, by score and
    then id, null for the others.

    Scores are whole numbers of a bounded range (differences of logarithms of counts), so how many rows have each is a small
    table; it gives the score at which the draw ends. Only rows from there on are dealt by ranges and sorted, and a row's place
    is the rows of the ranges before it and its place within its own. Rows alike in score and id are dealt by their own
    number too, so that no range holds a group of them.
    """
    spark = rows.sparkSession
    least, left = None, take
    for row in rows.where("eligible").groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect():
        if left <= 0:
            break
        least, left = row["score"], left - row["n"]
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    inside = F.col("eligible") & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_first(id_col), F.asc("_row")]
    dealt = rows.where(inside).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of this number are the partition's, the lower ones count its rows from 0.
    placed = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "drawn")
    parts = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    before = dict(zip([r["_part"] for r in parts], accumulate([r["n"] for r in parts], initial=0), strict=False))
    starts = spark.createDataFrame(list(before.items()), "_part long, _before long")  # a row a partition
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    best = placed.join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= take, rank))
    rest = rows.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return best.select(rest.columns).unionByName(rest)


def resample(df: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", grams: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` for each row of ``df``: a draw without replacement of ``percent`` of the
    rows of at least ``least_words`` words, in proportion to how much likelier ``target`` makes their features (runs of 1 to
    ``grams`` words in ``buckets`` hashed classes) than ``df`` does; ``rank`` is null for rows that are not drawn.

    A null or wordless text has no features, weight 0 and a score, and is never drawn where ``least_words`` is above 0. A null
    id draws as an empty one. Repeated rows count each time; rows that share an id share their chance, and such ties are
    ranked in any order. Empty tables give an empty result, an empty ``target`` weighs by rarity. Other columns are not read.
    Counts are over all rows of both tables; whole texts are scanned.
    """
    gains = gains_of(bucket_counts(df, text_col, grams, buckets), bucket_counts(target, target_text, grams, buckets))
    rows = weigh(df, gains, id_col=id_col, text_col=text_col, most=grams)
    rows = materialise(rows.withColumn("score", F.col("weight") + gumbel(id_col, seed)).withColumn("eligible", F.col("n_words") >= least_words), "weights")
    take = percent * rows.where("eligible").count() // 100
    return ranked(rows, take, id_col).select(id_col, "n_features", "weight", "score", "rank")


def oracle(table: str = "documents", target: str = "benchmark") -> str:
    """The draw over single words as DuckDB SQL: each distinct word's CRC is worked out byte by byte."""
    words = lambda t, key: f"select {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from {t}"
    step = "list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
    return f"""with steps as (select list({step} order by i) as t from range(256) r(i)),
d as ({words(table, "doc_id")}), b as ({words(target, "item_id")}),
w as (select word, {crc} % 10000 as bucket from (select word from d union select word from b), steps),
s as (select bucket, count(*) as n from d join w using (word) group by 1), t as (select bucket, count(*) as n from b join w using (word) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t.n, 0)::double + 1) * ((select count(*) from d)::double + 10000) / ((coalesce(s.n, 0)::double + 1) * ((select count(*) from b)::double + 10000))))::bigint as gain from s full join t using (bucket)),
f as (select doc_id, count(*) as n, floor(sum(gain) / count(*)::double)::bigint as weight from d join w using (word) join g using (bucket) group by 1),
x as (select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296))))::bigint as score from {table} left join f using (doc_id)),
y as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place from x)
select doc_id, n_features, weight, score, case when place <= (select count(*) from y where n_features >= 20) * 10 // 100 then place end as rank from y"""
