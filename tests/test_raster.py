"""Crops by blocks against a walk over all cells, and projections against their inverses and known points."""

import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import geometry as G
from skylattice.functions import projections as P
from skylattice.operators import raster

RING = "array<struct<x:double,y:double>>"


def holds(rings, x, y):
    inside = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


AREAS = {1: [[(1.0, 1.0), (9.0, 2.0), (8.0, 8.5), (4.0, 5.0), (1.0, 9.0), (1.0, 1.0)]], 2: [[(-5.0, -5.0), (40.0, -5.0), (40.0, 40.0), (-5.0, 40.0), (-5.0, -5.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]], 3: [[(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0), (2.0, 2.0)]], 4: [[(50.0, 50.0), (51.0, 50.0), (51.0, 51.0), (50.0, 50.0)]]}
HEADERS = [(1, 0.03, 10.0, 0.5, 0.25, 19, 37), (2, 5.1, 7.0, 0.3, 0.3, 8, 5)]


def brute(headers, areas):
    out = {}
    for i, ox, oy, px, py, w, h in headers:
        for a, rings in areas.items():
            xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
            for row in range(h):
                for col in range(w):
                    if ox + (col + 1) * px > min(xs) and ox + col * px < max(xs) and oy - row * py > min(ys) and oy - (row + 1) * py < max(ys):
                        out[a, i, row, col] = holds(rings, ox + (col + 0.5) * px, oy - (row + 0.5) * py)
    return out


@pytest.mark.parametrize("block", [1, 4, 7, 64])
def test_blocks_are_brute_force(spark, block):
    heads = spark.createDataFrame(HEADERS, "raster_id int, origin_x double, origin_y double, px double, py double, width int, height int")
    cells = [(i, b, r, c, b * 1000 + r * 50 + c + 1) for i, *_, w, h in HEADERS for b in (1, 2) for r in range(h) for c in range(w)]
    random.Random(1).shuffle(cells)
    table = spark.createDataFrame(cells, "raster_id int, band int, row int, col int, value int")
    areas = spark.createDataFrame([(a, [rings]) for a, rings in AREAS.items()], f"aoi_id int, ring array<array<{RING}>>")
    cropped = raster.crop_blocks(raster.to_blocks(table, block), heads, areas, block=block, nodata=-9)
    want = brute(HEADERS, AREAS)
    got = raster.cells_of(cropped).collect()
    assert {(r.aoi_id, r.raster_id, r.band, r.row, r.col): (r.inside, r.value) for r in got} == {(a, i, b, r, c): (m, b * 1000 + r * 50 + c + 1 if m else -9) for (a, i, r, c), m in want.items() for b in (1, 2)}
    assert len(got) == 2 * len(want)


def test_only_edge_blocks_look_at_cells(spark):
    """A disc over a large raster: blocks on its rim are few."""
    import math

    disc = [(128 + 100 * math.cos(2 * math.pi * i / 500), 128 + 100 * math.sin(2 * math.pi * i / 500)) for i in range(500)]
    heads = spark.createDataFrame([(1, 0.0, 256.0, 1.0, 1.0, 256, 256)], "raster_id int, origin_x double, origin_y double, px double, py double, width int, height int")
    blocks = spark.range(1024).select(F.lit(1).alias("raster_id"), F.lit(1).alias("band"), F.expr("cast(id div 32 as int)").alias("block_row"), F.expr("cast(id % 32 as int)").alias("block_col"), F.expr("transform(sequence(1, 64), x -> 1)").alias("values"))
    cropped = raster.crop_blocks(blocks, heads, spark.createDataFrame([(7, [*disc, disc[0]])], f"aoi_id int, ring {RING}"), block=8)
    counts = {r["class"]: r["count"] for r in cropped.groupBy("class").count().collect()}
    assert counts["edge"] < 130 and counts["inside"] > 400
    assert cropped.select(F.sum(F.aggregate("values", F.lit(0), lambda s, v: s + v))).first()[0] == sum(holds([[*disc, disc[0]]], c + 0.5, 256 - r - 0.5) for r in range(256) for c in range(256))
    text = cropped._jdf.queryExecution().optimizedPlan().toString()
    assert "block_row" in text[text.index("Join Inner") :].split("\n")[0]


def test_projections_and_back(spark):
    rng = random.Random(2)
    places = {4326: (-180, 180, -90, 90), 3857: (-180, 180, -85, 85), 6974: (-180, 180, -89, 89), 3034: (-20, 40, 30, 72), 5070: (-130, -60, 20, 55), 32633: (10, 20, 0, 80), 32733: (10, 20, -80, 0)}
    rows = [(s, (rng.uniform(a, b), rng.uniform(c, d))) for s, (a, b, c, d) in places.items() for _ in range(200)] + [(2154, (3.0, 46.0)), (None, (1.0, 1.0))]
    df = spark.createDataFrame(rows, "srid int, p struct<x:double,y:double>")
    df = df.withColumn("q", P.forward(F.col("p"), F.col("srid"))).withColumn("b", P.inverse(F.col("q"), F.col("srid")))
    off = {r.srid: r.off for r in df.groupBy("srid").agg(F.max(F.greatest(F.abs(F.col("b.x") - F.col("p.x")), F.abs(F.col("b.y") - F.col("p.y")))).alias("off")).collect()}
    assert off.pop(2154) is None and off.pop(None) is None
    assert not [(s, v) for s, v in off.items() if v > (1e-6 if s > 32600 else 1e-9)]
    # Origins of the conic systems, and the corner of tile h18v04, whose numbers are published.
    known = spark.createDataFrame([(3034, (10.0, 52.0), 4000000.0, 2800000.0), (5070, (-96.0, 23.0), 0.0, 0.0), (6974, (0.0, 50.0), 0.0, 5559752.598)], "srid int, p struct<x:double,y:double>, x double, y double")
    for r in known.select("x", "y", P.forward(F.col("p"), F.col("srid")).alias("q")).collect():
        assert abs(r.q.x - r.x) < 1e-3 and abs(r.q.y - r.y) < 1e-3


def test_unknown_systems_keep_the_area(spark):
    heads = spark.createDataFrame([(1, 0.0, 4.0, 1.0, 1.0, 4, 4, 2154), (2, 0.0, 4.0, 1.0, 1.0, 4, 4, 4326), (3, 1781000.0, 5000000.0, 1000.0, 1000.0, 4, 4, 3857)], "raster_id int, origin_x double, origin_y double, px double, py double, width int, height int, srid int")
    blocks = heads.select("raster_id", F.lit(1).alias("band"), F.lit(0).alias("block_row"), F.lit(0).alias("block_col"), F.expr("transform(sequence(1, 16), x -> 1.5D)").alias("values"))
    areas = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)]), (2, [(15.0, 40.0), (17.0, 40.0), (17.0, 42.0), (15.0, 42.0), (15.0, 40.0)])], f"aoi_id int, ring {RING}")
    got = raster.crop_blocks(blocks, heads, areas, block=16)
    rows = {(r.aoi_id, r.raster_id): (r.status, sum(r.mask), sum(r["values"])) for r in got.collect()}
    assert rows == {(1, 1): ("as_is", 8, 12.0), (1, 2): ("reprojected", 8, 12.0), (2, 3): ("reprojected", 16, 24.0)}
    assert raster.frames(heads).select(G.bounds(F.col("ring")).alias("b")).where("b.xmin is null").count() == 0


@pytest.mark.parametrize("block", [5, 64])
def test_turns_are_brute_force(spark, block):
    """Edges through cell centres, corners on them and areas far beyond the raster; in one block also rings that are not closed."""
    rng = random.Random(4)
    spot = lambda: (rng.randrange(-8, 40) / 4, rng.randrange(-8, 40) / 4)
    areas = {i: [[spot() for _ in range(rng.choice([4, 5, 9]))]] for i in range(60)}
    for i, (r,) in areas.items():
        if i % 3 or block < 64:
            r.append(r[0])
    areas |= {60: [[(-1e9, -1e9), (1e9, -1e9), (3.0, 1e9), (-1e9, -1e9)]]}
    headers = [(1, 0.0, 8.0, 0.5, 0.25, 16, 32), (2, 0.25, 8.25, 0.5, 0.5, 13, 11)]
    heads = spark.createDataFrame(headers, "raster_id int, origin_x double, origin_y double, px double, py double, width int, height int")
    cells = spark.createDataFrame([(i, r, c, 1) for i, *_, w, h in headers for r in range(h) for c in range(w)], "raster_id int, row int, col int, value int")
    want = brute(headers, areas)
    got = raster.mask_cells(cells, heads, spark.createDataFrame([(a, [rings]) for a, rings in areas.items()], f"aoi_id int, ring array<array<{RING}>>"), block=block).collect()
    assert {(r.aoi_id, r.raster_id, r.row, r.col): (r.inside, r.value) for r in got} == {k: (m, int(m)) for k, m in want.items()}
    assert len(got) == len(want) and 0 < sum(want.values()) < len(want)


def test_areas_are_moved_once_for_many_rasters(spark):
    """An area that meets 150 rasters of one system and 3 of another, and one that meets 1."""
    heads = spark.range(153).select(F.col("id").alias("raster_id"), *(F.lit(1.0).alias(c) for c in raster.HEADER[:4]), *(F.lit(1).alias(c) for c in raster.HEADER[4:]), F.when(F.col("id") < 150, 3857).otherwise(6974).alias("srid"))
    met = heads.withColumn("aoi_id", F.lit(1)).unionByName(heads.limit(1).withColumn("aoi_id", F.lit(2)))
    groups = raster._groups(met).select("aoi_id", "srid", F.size("_rasters").alias("n"), F.expr("transform(_rasters, r -> r.raster_id)").alias("ids")).collect()
    assert sorted((g.aoi_id, g.srid, g.n) for g in groups) == [(1, 3857, 22), (1, 3857, 64), (1, 3857, 64), (1, 6974, 3), (2, 3857, 1)]
    assert sorted(i for g in groups if g.aoi_id == 1 for i in g.ids) == list(range(153))


def test_few_bytes_are_dealt_to_many_tasks(spark):
    """Pairs of an area and a raster are short rows; the work behind them is not put together in one task."""
    from conftest import SF

    from skylattice.plans import registry

    text = registry.QUERIES["crop_grid"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # The plan is read from its end: what is moved comes out of an exchange that keeps its number of tasks.
    assert "REPARTITION_BY_NUM" in text[text.index("_moved") :]
