"""Plans and helpers that matter on larger tables."""

import pytest
from conftest import SF

from skylattice.plans import registry


@pytest.mark.parametrize("name", ["crop_raster", "border_search"])
def test_no_derived_table_goes_through_the_driver(spark, name):
    assert "Broadcast" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("error", [ImportError, MemoryError, OSError, ValueError])
def test_only_damaged_data_is_passed_over(monkeypatch, error):
    """A failure while data is inflated is no clean text, in ``find`` and in ``mask`` alike."""
    import base64
    import zlib

    from skylattice.llm import secrets

    packed = zlib.compress(b"token = abcdefghijkl123456, and some more text to inflate")
    assert list(secrets.inflate(packed[:-3])) == [] and list(secrets.inflate(b"\x28\xb5\x2f\xfd" + bytes(9))) == []
    text = "see " + base64.b64encode(packed).decode()
    assert secrets.find_secrets(text)[1]

    def broken(raw):
        raise error("no such thing")
        yield

    monkeypatch.setattr(secrets, "_inflating", broken)
    with pytest.raises(error):
        secrets.find_secrets(text)


@pytest.mark.parametrize("descending", [False, True])
def test_slices_of_a_search_are_one_search(spark, monkeypatch, descending):
    """Slices of a few rows, equal times, nulls and areas with fewer products than asked for; most pairs are not made."""
    from pyspark.sql import functions as F

    from skylattice.functions import geometry as G
    from skylattice.operators import catalog as C

    square = lambda x, side: G.ring((x, F.lit(0.0)), (x + side, F.lit(0.0)), (x + side, F.lit(side)), (x, F.lit(side)), (x, F.lit(0.0)))
    rows = spark.range(3000).select(F.col("id").alias("scene_id"), F.expr("case when id % 97 > 0 then (id * 7919) % 500 end").alias("t"), square((F.col("id") * 31 % 100).cast("double"), 1.0).alias("ring"))
    areas = spark.range(30).select(F.col("id").alias("aoi_id"), square(F.when(F.col("id") % 10 == 9, F.col("id") + 80.5).otherwise(F.col("id") * 3).cast("double"), 2.0).alias("ring"))
    want = C.first_met(rows, areas, "t", "scene_id", 70, descending=descending).select("aoi_id", "rank", "scene_id").collect()
    made = []
    join = C.spatial_join
    monkeypatch.setattr(C, "SLICE", 2)
    monkeypatch.setattr(C, "spatial_join", lambda *a, **b: made.append(join(*a, **b)) or made[-1])
    got = C.first_met(rows, areas, "t", "scene_id", 70, descending=descending).select("aoi_id", "rank", "scene_id").collect()
    assert len(made) > 1 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def _random_shapes(spark):
    """Tilted squares of either turn, triangles and bow ties on a coarse grid, where shapes often just touch; and Ls, shapes with
    a hole and a second part, combs with an edge that two boxes border, triangles and spikes."""
    import random

    rng = random.Random(11)
    at = lambda: (rng.randrange(-160, 160) / 8, rng.randrange(-160, 160) / 8)
    closed = lambda points: [*points, points[0]]

    def small():
        (x, y), w, k = at(), rng.choice([1.0, 2.0, 1.5]), rng.choice([0.0, 0.25, 0.5])
        tilted = [(x, y), (x + w, y + k), (x + w - k, y + w + k), (x - k, y + w)]
        return closed(rng.choice([tilted, tilted[::-1], tilted[:3], [tilted[0], tilted[2], tilted[1], tilted[3]]]))

    def large():
        x, y = at()
        box = lambda a, b, c, d: closed([(x + a, y + b), (x + c, y + b), (x + c, y + d), (x + a, y + d)])
        path = lambda *points: [[closed([(x + a, y + b) for a, b in points])]]
        return rng.choice([path((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)), [[box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(6, 0, 7, 1)]], [[box(0, 0, 2, 2)], [box(2, 0, 4, 2)], [box(1, 2, 3, 4)]], path((0, 0), (4, 1), (1, 4)), path((0, 0), (2, 0), (2, 2), (5, 2), (2, 2), (0, 2))])

    ring = "array<struct<x:double,y:double>>"
    as_double = lambda shape: [[[(float(a), float(b)) for a, b in r] for r in part] for part in shape]
    left = spark.createDataFrame([(i, small()) for i in range(500)], f"l int, ring {ring}")
    return left, spark.createDataFrame([(i, as_double(large())) for i in range(60)], f"r int, shape array<array<{ring}>>")


def test_pairs_settled_by_boxes_are_brute_force(spark):
    from pyspark.sql import functions as F

    from skylattice.functions import geometry as G
    from skylattice.operators.spatial import spatial_join

    left, right = _random_shapes(spark)
    meet = G.shapes_meet(G.edges_of(left, "ring"), G.corners_of(left, "ring"), G.edges_of(right, "shape"), G.corners_of(right, "shape"))
    want = sorted(map(tuple, left.crossJoin(right).where(meet).select("l", "r").collect()))
    assert len(want) > 300
    assert sorted(map(tuple, spatial_join(left, right, right_ring="shape").select("l", "r").collect())) == want
    assert sorted(map(tuple, spatial_join(right, left, left_ring="shape").select("l", "r").collect())) == want
    covers = right.select(G.box_cover(G.edges_of(right, "shape"), 6).alias("c")).select(F.size("c.boxes").alias("n"), "c.whole").distinct().collect()
    assert {(2, True), (5, True)} <= set(map(tuple, covers)) and any(not w for _, w in map(tuple, covers))


def test_few_pairs_come_to_one_cell_without_meeting(spark):
    """Of many small boxes and a few wide ones most pairs of a cell meet."""
    import random

    from pyspark.sql import functions as F

    from skylattice.functions import geometry as G
    from skylattice.operators import spatial

    rng = random.Random(5)
    box = lambda side: (rng.uniform(0, 100), rng.uniform(0, 100), side)
    make = lambda n, side: spark.createDataFrame([box(side()) for _ in range(n)], "x double, y double, s double").select(F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + F.col("s")).alias("xmax"), (F.col("y") + F.col("s")).alias("ymax")).alias("b"))
    sides = {"l": make(3000, lambda: rng.uniform(0.5, 1.7)), "r": make(100, lambda: 4.0)}
    plan = spatial._plan_of(sides["l"].select(F.lit("l").alias("side"), spatial._rung_of(F.col("b")).alias("rung")).unionByName(sides["r"].select(F.lit("r").alias("side"), spatial._rung_of(F.col("b")).alias("rung"))))
    keyed = {s: df.select(F.col("b").alias(s), spatial._fine_keys(F.col("b"), s, plan).alias("k")) for s, df in sides.items()}
    assert keyed["l"].agg(F.max(F.size("k"))).first()[0] == 1 and keyed["r"].agg(F.max(F.size("k"))).first()[0] <= 64
    pairs = keyed["l"].select("l", F.explode("k").alias("k")).join(keyed["r"].select("r", F.explode("k").alias("k")), "k")
    met = pairs.where(G.boxes_overlap(F.col("l"), F.col("r"))).count()
    assert met == sides["l"].select(F.col("b").alias("l")).crossJoin(sides["r"].select(F.col("b").alias("r"))).where(G.boxes_overlap(F.col("l"), F.col("r"))).count() > 0
    assert pairs.count() < 2.5 * met


def test_pairs_are_not_shuffled_again(spark):
    text = registry.QUERIES["shape_search"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join Inner") == 1


def test_areas_of_equal_shape_are_counted_for_once(spark, monkeypatch, tmp_path):
    """Suppliers 67200 keys apart have areas of equal shape."""
    import os

    from skylattice.plans import search

    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name)
    os.unlink(tmp_path / "supplier.parquet")
    spark.sql(f"select s_suppkey + 67200 * i as s_suppkey, s_name, s_nationkey from parquet.`{SF}/supplier.parquet`, (select explode(array(0, 1, 2)) as i)").write.parquet(str(tmp_path / "supplier.parquet"))
    sides, join = [], search.spatial_join
    monkeypatch.setattr(search, "spatial_join", lambda a, b, **c: sides.append(b) or join(a, b, **c))
    from oracles import same

    same(search.search_counts(spark, str(tmp_path)), registry.ORACLES["search_counts"], str(tmp_path))
    assert 3 * sides[0].count() == spark.read.parquet(str(tmp_path / "supplier.parquet")).count()


def test_footprints_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from skylattice.functions import geometry as G
    from skylattice.sources import adapters, readers

    pages = spark.createDataFrame([], readers.PRODUCT_PAGE)
    products = pages.select(F.explode("value").alias("p")).select("p.*")
    found = adapters.copernicus(products).select("bbox.xmin", "bbox.ymax", G.to_wkt(F.col("ring")).alias("wkt"))
    # A parse names its pattern where it looks for a text and where it splits it.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?i:POLYGON)") <= 2


def test_areas_of_equal_shape_are_clipped_to_once(spark, monkeypatch, tmp_path):
    """Suppliers 67200 keys apart have areas of equal shape."""
    import os

    from oracles import same

    from skylattice.plans import shapes

    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name)
    os.unlink(tmp_path / "supplier.parquet")
    spark.sql(f"select s_suppkey + 67200 * i as s_suppkey, s_name, s_nationkey from parquet.`{SF}/supplier.parquet`, (select explode(array(0, 1, 2)) as i)").write.parquet(str(tmp_path / "supplier.parquet"))
    sides, crop = [], shapes.R.crop_blocks
    monkeypatch.setattr(shapes.R, "crop_blocks", lambda a, b, c, **d: sides.append(c) or crop(a, b, c, **d))
    same(shapes.crop_grid(spark, str(tmp_path)), registry.ORACLES["crop_grid"], str(tmp_path))
    assert 3 * sides[0].count() == spark.read.parquet(str(tmp_path / "supplier.parquet")).count()


def test_rasters_of_one_frame_are_clipped_once(spark, monkeypatch, tmp_path):
    """Rasters 67200 keys apart have one frame, those 134400 apart equal cells too; areas 67200 keys apart have equal shapes. A
    raster's negative key is the remainder of none."""
    from oracles import same

    from skylattice.plans import shapes

    spark.sql("select id + 67200 * i as p_partkey from range(-300, 300), (select explode(array(0, 1, 2)) as i)").write.parquet(str(tmp_path / "part.parquet"))
    spark.sql("select id + 67200 * i as s_suppkey from range(200), (select explode(array(0, 1, 2)) as i)").write.parquet(str(tmp_path / "supplier.parquet"))
    given, crop = [], shapes.R.crop_blocks
    monkeypatch.setattr(shapes.R, "crop_blocks", lambda *a, **b: given.append(a) or crop(*a, **b))
    found = shapes.crop_raster(spark, str(tmp_path))
    assert found.select("raster_id").distinct().count() > 100
    same(found, registry.ORACLES["crop_raster"], str(tmp_path))
    blocks, heads, areas = given[0]
    assert areas.count() == 200 and heads.count() < 1800 and heads.count() == heads.select("origin_x", "origin_y").distinct().count()
    assert blocks.where("raster_id between 0 and 299").count() == 4 * 2 * 300


def test_blocks_are_made_by_many_tasks(spark):
    """The headers that blocks are made from are few bytes."""
    from skylattice.plans import shapes

    head = shapes.headers(spark, SF).selectExpr("*", "1 as band")
    assert "REPARTITION_BY_NUM" in shapes._blocks(head, 8, "r")._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_areas_in_many_tasks(spark):
    """Parts of windows are short rows whose cells are put together after they met their blocks; no side is shuffled twice for it."""
    import re

    text = registry.QUERIES["crop_raster"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"hashpartitioning\(raster_id#\w+, block_row#\w+, block_col#\w+, (\d+)\), (\w+)", text)
    assert sorted(kind for _, kind in found) == ["ENSURE_REQUIREMENTS", "REPARTITION_BY_NUM"] and len({n for n, _ in found}) == 1
