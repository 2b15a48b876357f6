"""Catalogues in versions, files left out by a search, and cubes in chunks."""

import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import geometry as G
from skylattice.operators import catalog, raster
from skylattice.operators.spatial import spatial_join
from skylattice.sources import snapshots

ROWS = "product_id long, collection string, start_ts string, x double, y double"


def products(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))
    x, y = F.col("x"), F.col("y")
    return df.withColumn("ring", G.ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))).drop("x", "y")


def ids(df):
    return sorted(r.product_id for r in df.select("product_id").collect())


def test_readers_see_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    one = products(spark, [(1, "a", "2020-01-01", 0.0, 0.0), (2, "b", "2020-01-02", 5.0, 5.0), (3, None, None, 9.0, 9.0)])
    assert snapshots.write(one, path, keys=("collection",), token="x").number == 1
    before = snapshots.read(spark, path)
    assert snapshots.write(products(spark, [(4, "b", "2020-02-02", 5.0, 5.0)]), path, keys=("collection",), replace=True).number == 2
    assert ids(before) == [1, 2, 3] and ids(snapshots.read(spark, path)) == [1, 3, 4] and ids(snapshots.read(spark, path, 1)) == [1, 2, 3]
    # The same write once more changes nothing; one that breaks off before its rename is not seen.
    assert snapshots.write(one, path, keys=("collection",), token="x").number == 1
    broken = products(spark, [(5, "c", "2020-01-01", 0.0, 0.0)]).withColumn("product_id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        snapshots.write(broken, path, keys=("collection",))
    assert [v.number for v in snapshots.versions(spark, path)] == [1, 2]
    assert snapshots.write(products(spark, [(6, None, "2020-01-01", 0.0, 0.0)]), path, keys=("collection",), replace=True).number == 3
    assert ids(snapshots.read(spark, path)) == [1, 4, 6]
    assert ids(snapshots.read(spark, path, keys={"collection": ["a"]})) == [1] and ids(snapshots.read(spark, path, first="2020-02-01")) == [4]
    assert snapshots.expire(spark, path, keep=1) > 0 and ids(snapshots.read(spark, path)) == [1, 4, 6]
    with pytest.raises(ValueError, match="no version 1"):
        snapshots.read(spark, path, 1)


def test_of_two_writers_one_builds_on_the_other(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.write(products(spark, [(1, "a", "2020-01-01", 0.0, 0.0)]), path)
    commit, late = snapshots._commit, []

    def slow(*args):
        if not late:
            late.append(True)
            snapshots.write(products(spark, [(2, "a", "2020-01-01", 0.0, 0.0)]), path)
        return commit(*args)

    monkeypatch.setattr(snapshots, "_commit", slow)
    assert snapshots.write(products(spark, [(3, "a", "2020-01-01", 0.0, 0.0)]), path).number == 3
    assert ids(snapshots.read(spark, path)) == [1, 2, 3] and ids(snapshots.read(spark, path, 2)) == [1, 2]
    assert snapshots.write(products(spark, [(4, "a", "2020-01-01", 0.0, 0.0)]), path, replace=True).number == 4
    assert ids(snapshots.read(spark, path)) == [4]


def test_a_search_reads_few_files(spark, tmp_path):
    """One area of 3000 products over the world in 64 files: fewer than a tenth are read, and nothing is lost."""
    path, rng = str(tmp_path / "t"), random.Random(2)
    rows = products(spark, [(i, "c", f"20{i % 20:02d}-01-01", rng.uniform(-179, 178), rng.uniform(-89, 88)) for i in range(3000)])
    version = snapshots.write(rows, path, files=64)
    areas = spark.createDataFrame([(7, 11.0, 44.0)], "aoi_id int, x double, y double").select("aoi_id", G.ring((F.col("x"), F.col("y")), (F.col("x") + 8, F.col("y")), (F.col("x") + 8, F.col("y") + 8), (F.col("x"), F.col("y"))).alias("ring"))
    few = snapshots.read(spark, path, areas=areas)
    assert len(few.inputFiles()) < 0.1 * snapshots.listing(spark, path)[1].count()
    found = catalog.search(few.drop("xmin", "ymin", "xmax", "ymax"), areas, key="product_id", levels=version.levels)
    want = spatial_join(rows, areas)
    assert ids(found) == ids(want) and len(ids(want)) > 0
    nowhere = spark.createDataFrame([(1,)], "aoi_id int").withColumn("ring", G.ring((500.0, 500.0), (501.0, 500.0), (501.0, 501.0), (500.0, 500.0)))
    assert snapshots.read(spark, path, areas=nowhere).count() == 0


def test_chunks_of_cubes(spark):
    """Any chunk shape gives back the cube; a subset flattens only chunks it touches, by filters that reach the scan."""
    rng = random.Random(3)
    nt, ny, nx = 5, 4, 7
    cubes = [(i, list(range(nt)), [60.0 - k for k in range(ny)], [k / 2 for k in range(nx)], [rng.random() for _ in range(nt * ny * nx)], [rng.random() for _ in range(nt * ny * nx)]) for i in (1, 2)] + [(3, [], [1.0], [1.0], [], [])]
    df = spark.createDataFrame(cubes, "cube int, time array<int>, lat array<double>, lon array<double>, a array<double>, b array<double>")
    want = {(c, t, 60.0 - i, j / 2): (a[(t * ny + i) * nx + j], b[(t * ny + i) * nx + j]) for c, _, _, _, a, b in cubes[:2] for t in range(nt) for i in range(ny) for j in range(nx)}
    for shape in ((1, 1, 1), (2, 3, 4), (9, 9, 9)):
        chunks = raster.to_chunks(df, ("a", "b"), shape)
        got = {(r.cube, r.time_value, r.lat_value, r.lon_value): (r.a, r.b) for r in raster.subset_chunks(chunks, ("a", "b")).collect()}
        assert got == want
    part = raster.subset_chunks(raster.to_chunks(df, ("a", "b"), (2, 2, 2)), ("b",), lat=(57.5, 58.5), time=(1, 2)).collect()
    assert {(r.cube, r.time_value, r.lat_value, r.lon_value): r.b for r in part} == {k: v[1] for k, v in want.items() if 57.5 <= k[2] <= 58.5 and k[1] in (1, 2)}


def test_chunk_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], [1.0, 2.0], [1.0], [1.0] * 4, [2.0] * 4)], "cube int, time array<int>, lat array<double>, lon array<double>, a array<double>, b array<double>")
    raster.to_chunks(df, ("a", "b"), (1, 1, 1)).write.parquet(str(tmp_path / "c"))
    found = raster.subset_chunks(spark.read.parquet(str(tmp_path / "c")), ("a",), lat=(2.0, 2.0))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = found._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lat_max,2.0)" in text and "LessThanOrEqual(lat_min,2.0)" in text
    schema = text[text.index("ReadSchema") :]
    assert "a:array<double>" in schema and "b:array<double>" not in schema
    assert [(r.time_value, r.lat_value, r.a) for r in found.orderBy("time_value").collect()] == [(1, 2.0, 1.0), (2, 2.0, 1.0)]
