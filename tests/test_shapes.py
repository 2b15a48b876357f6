"""Shapes of several rings, joins over boxes of very different sizes, and long rings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import geometry as G
from skylattice.operators import spatial
from skylattice.operators.spatial import keys_of, levels_of, long_ring_join, spatial_join
from skylattice.sources import readers

RING = "array<struct<x:double,y:double>>"
SHAPE = f"array<array<{RING}>>"


def square(x, y, size=1.0):
    return [(float(a), float(b)) for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y))]


def overlap(a, b):
    return a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[2] and b[1] <= a[1] + a[2]


@pytest.mark.parametrize("seed", range(4))
def test_levels_are_brute_force(spark, seed):
    """Boxes from a thousandth to a million wide, points and repeated boxes among them; the world meets all."""
    rng = random.Random(seed)
    widths = [0.0, 0.001, 0.03, 1, 7, 8, 64, 3000, 1e6] if seed % 2 else [0.5, 4, 40]
    box = lambda: (rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice(widths) * rng.uniform(0.9, 1.1))
    left, right = [box() for _ in range(120)] + [(-5e5, -5e5, 1e6)], [box() for _ in range(80)]
    make = lambda rows, key: spark.createDataFrame([(i, square(*r)) for i, r in enumerate(rows)], f"{key} int, ring {RING}")
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if overlap(a, b))
    for given in ({}, {"ids": ("l", "r")}, {"levels": [-2, 1]}, {"levels": [0], "exact": False}):
        if seed % 2 and "levels" in given:
            continue  # a box of a million by cells of one: right, but slow
        got = spatial_join(make(left[:-1] if "levels" in given else left, "l"), make(right, "r"), **given).select("l", "r").collect()
        assert sorted(map(tuple, got)) == [p for p in want if "levels" not in given or p[0] < 120]


def test_no_box_has_more_than_sixteen_keys(spark):
    rng = random.Random(3)
    rows = [(i, square(rng.uniform(-180, 180), rng.uniform(-90, 90), 10 ** rng.uniform(-7, 6))) for i in range(2000)] + [(-1, square(-2e7, -2e7, 4e7))]
    df = spark.createDataFrame(rows, f"i int, ring {RING}")
    most = levels_of(df)[-1]
    ladder = list(range(most - spatial.ABOVE, most + 1))
    sizes = df.select(F.size(keys_of(G.bounds(F.col("ring")), ladder, ladder, 1)).alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert sizes[0] <= 16 and sizes[1] < 13


def test_shapes_travel_once_with_ids(spark):
    make = lambda key: spark.createDataFrame([(i, square(i, i)) for i in range(9)], f"{key} int, ring {RING}")
    text = spatial_join(make("l"), make("r"), ids=("l", "r"))._jdf.queryExecution().optimizedPlan().toString()
    generated = [x for x in text.splitlines() if "Generate explode" in x]
    assert len(generated) == 2 and not any("edges" in x[x.index("Generate explode") :] for x in generated)
    assert "NestedLoop" not in text and text.count("Join Inner") == 3


def test_texts_of_shapes(spark):
    good = {
        "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 1))": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
        "  multipolygon (((0 0, 1 0, 1 1, 0 0)) , ((5 5, 6 5, 6 6, 5 5), (5.1 5.05, 5.2 5.1, 5.2 5.05, 5.1 5.05)))": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.05, 5.2 5.1, 5.2 5.05, 5.1 5.05)))",
        "POLYGON Z ((0 0 9, 1e0 0 9, 1 1 9, 0 0 9))": "POLYGON ((0 0, 1 0, 1 1, 0 0))",
    }
    bad = {
        None: "not a polygon", "": "not a polygon", "POINT (1 2)": "not a polygon", "POLYGON ((0 0, 1 0, 1 1, 0 0)": "not a polygon", "POLYGON ((0 0, 1 0, 1 1, 0 0),)": "not a polygon",
        "POLYGON EMPTY": "empty", "MULTIPOLYGON Z EMPTY": "empty", "POLYGON ((0 0, 1 0, 1, 0 0))": "bad number", "POLYGON ((0 0, 1 0, NaN 1, 0 0))": "bad number", "POLYGON ((0 0, 1 0, 0 0))": "short ring",
        "POLYGON ((0 0, 1 0, 1 1, 0 1))": "open ring", "MULTIPOLYGON ((0 0, 1 0, 1 1, 0 0))": "not a polygon", "POLYGON ((0 0, 1 0, 1 1, 0 0)) x": "not a polygon",
    }
    df = spark.createDataFrame([(t, w, None) for t, w in good.items()] + [(t, None, e) for t, e in bad.items()], "t string, w string, e string")
    p = G.shape_from_wkt(F.col("t"))
    for row in df.select("t", "w", "e", G.shape_to_wkt(p.shape).alias("text"), p.error.alias("error"), p.shape.isNull().alias("none")).collect():
        assert (row.text if row.w else None, row.error, row.none) == (row.w, row.e, row.w is None), row.t
    long = "POLYGON ((" + ", ".join(f"{i} {i % 2}" for i in range(100_000)) + ", 5 9, 0 0), (1 1, 2 2, 3 1, 1 1))"
    many = "MULTIPOLYGON (" + ", ".join(f"(({i} 0, {i} 1, {i + 1} 1, {i} 0))" for i in range(20_000)) + ")"
    rows = spark.createDataFrame([(long,), (many,)], "t string").select(F.size(F.flatten(F.flatten(G.shape_from_wkt(F.col("t")).shape)))).collect()
    assert [r[0] for r in rows] == [100_006, 80_000]


def test_geojson_of_shapes(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5,1],[6,5,1],[6,6,1],[5,5,1]]]]}}, {"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,null],[0,0]]]}}, {"geometry": {"type": "Polygon", "coordinates": []}}, {"geometry": null}, {"geometry": {"type": "LineString", "coordinates": [[0,0],[1,1]]}}]}')
    rows = readers.areas(spark, str(tmp_path / "a.geojson")).select("wkt", "error", F.size(F.flatten("shape")).alias("n")).collect()
    assert [(r.error, r.n) for r in rows] == [(None, 2), ("bad number", None), ("not a polygon", None), ("not a polygon", None), ("not a polygon", None)]
    assert rows[0].wkt == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"


def test_holes_and_parts(spark):
    ring_with_hole, far = [[square(0, 0, 10), square(2, 2, 6)]], [square(20, 20, 2)]
    cases = [
        (ring_with_hole, [[square(3, 3, 2)]], False),  # within the hole
        (ring_with_hole, [[square(1.5, 1.5, 2)]], True),  # over the hole's edge
        (ring_with_hole, [[square(0.5, 0.5, 1)]], True),  # within the rim
        (ring_with_hole, [[square(2, 2, 6)]], True),  # the hole itself: edges touch
        ([*ring_with_hole, far], [[square(21, 21, 0.5)]], True),  # in the second part
        ([far, *ring_with_hole], [[square(40, 0)], [square(20.5, 20.5, 0.1)]], True),  # parts that only later rings show
        ([*ring_with_hole, far], [[square(14, 14)]], False),
        ([[square(0, 0, 30), square(1, 1, 28)]], ring_with_hole, True),
        ([[square(-5, -5, 40), square(-1, -1, 31)]], [*ring_with_hole, far], False),  # all within the hole
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {SHAPE}, b {SHAPE}")
    left, right = df.select("i", "a"), df.select(F.col("i").alias("j"), "b")
    for way in (spatial_join(left, right, left_ring="a", right_ring="b"), spatial_join(right, left, left_ring="b", right_ring="a", ids=("j", "i")), long_ring_join(left, right, ("i", "j"), left_ring="a", right_ring="b")):
        assert sorted(r.i for r in way.where("i = j").collect()) == [i for i, c in enumerate(cases) if c[2]]


def star(cx, cy, radius, points, wiggle):
    out = [(cx + radius * (1 + wiggle * (i % 2)) * math.cos(2 * math.pi * i / points), cy + radius * (1 + wiggle * (i % 2)) * math.sin(2 * math.pi * i / points)) for i in range(points)]
    return [*out, out[0]]


def test_long_rings(spark):
    """Rings of ten thousand points each: crossing, one in the other, apart within each other's boxes, and small ones."""
    left = {0: star(0, 0, 10, 10_000, 0.01), 1: star(100, 0, 3, 10_000, 0.2)}
    right = {0: star(1, 0, 10, 10_000, 0.01), 1: star(0.5, 0.5, 2, 10_000, 0.1), 2: star(9.5, 9.5, 2, 10_000, 0.01), 3: square(99, 0, 0.1), 4: square(-300, -300, 900), 5: square(300, 0), 6: square(100, 0.2, 1e-6)}
    make = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} int, ring {RING}")
    got = long_ring_join(make(left, "l"), make(right, "r"), ("l", "r")).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 1), (0, 4), (1, 3), (1, 4), (1, 6)]


def test_long_rings_are_brute_force(spark):
    rng = random.Random(4)
    some = lambda n: {i: star(rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(0.2, 4), rng.choice([6, 40, 80]), rng.uniform(0, 0.5)) for i in range(n)}
    make = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} int, ring {RING}")
    left, right = make(some(30), "l"), make(some(25), "r")
    want = sorted(map(tuple, spatial_join(left, right).collect()))
    assert sorted(map(tuple, long_ring_join(left, right, ("l", "r")).collect())) == want and 0 < len(want) < 750
