"""Hand cases of the operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import geometry as G
from skylattice.operators import catalog, files, ledger
from skylattice.operators.spatial import spatial_join
from skylattice.sources import adapters, readers
from skylattice.streaming import streams

RING = "array<struct<x:double,y:double>>"


def square(x, y, size=1.0):
    return [(float(a), float(b)) for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y))]


def test_polygons_meet(spark):
    cases = [
        (square(0, 0), square(1, 1), True),  # a corner touches
        (square(0, 0), square(1, 0), True),  # an edge touches
        (square(0, 0), square(1.1, 0), False),
        (square(0, 0, 4), square(1, 1), True),  # one holds the other
        (square(1, 1), square(0, 0, 4), True),
        ([(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0), (0.0, 0.0)], square(2, 2), False),  # in the notch of an L
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {RING}, b {RING}")
    got = {r.i: (r.m, r.n) for r in df.select("i", G.polygons_meet(G.edges(F.col("a")), G.edges(F.col("b"))).alias("m"), G.polygons_meet(G.edges(F.col("b")), G.edges(F.col("a"))).alias("n")).collect()}
    assert got == {i: (want, want) for i, (_, _, want) in enumerate(cases)}


def test_grid_join_is_brute_force(spark):
    rng = random.Random(7)
    box = lambda: (rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.5, 3, 300]))
    left, right = [box() for _ in range(60)], [box() for _ in range(40)]
    make = lambda rows, key: spark.createDataFrame([(i, square(*r)) for i, r in enumerate(rows)], f"{key} int, ring {RING}")
    got = sorted((r.l, r.r) for r in spatial_join(make(left, "l"), make(right, "r"), exact=False).collect())
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[2] and b[1] <= a[1] + a[2])
    assert got == want


@pytest.mark.parametrize("unit", [1.0, 30_000.0])
def test_grid_join_in_any_unit(spark, unit):
    """Degrees or metres: the cells follow the boxes, and boxes thousands of times as wide still meet the others."""
    rng = random.Random(8)
    box = lambda big: (rng.uniform(-20, 20) * unit, rng.uniform(-20, 20) * unit, (rng.choice([30, 2000]) if big and rng.random() < 0.1 else rng.uniform(0.2, 1.5)) * unit)
    for wide_left, wide_right in ((False, False), (True, False), (False, True), (True, True)):
        left, right = [box(wide_left) for _ in range(80)], [box(wide_right) for _ in range(60)]
        make = lambda rows, key: spark.createDataFrame([(i, square(*r)) for i, r in enumerate(rows)], f"{key} int, ring {RING}")
        joined = spatial_join(make(left, "l"), make(right, "r"))
        got = sorted((r.l, r.r) for r in joined.collect())
        want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[2] and b[1] <= a[1] + a[2])
        assert got == want
    assert spatial_join(make(left, "l").limit(0), make(right, "r")).count() == 0


def test_numbers_have_no_exponent(spark):
    values = {1e7: "10000000", 12345678.5: "12345678.5", -20037508.342789244: "-20037508.342789244", 0.0: "0", -0.0: "0", 1e-4: "0.0001", -1e-13: "0", 2.50: "2.5", 100.0: "100", 1e15: "1000000000000000"}
    rows = spark.createDataFrame([(v, w) for v, w in values.items()] + [(-0.0, "0")], "v double, w string")
    assert [(r.v, r.n) for r in rows.select("v", "w", G.number(F.col("v")).alias("n")).where("n <> w").collect()] == []


def test_progress_lines(spark):
    cases = {
        "Concurrent Downloads:  40%|####      | 2/5 [00:10<00:15,  5.00s/it]": ("Concurrent Downloads", 40, "2", "5"),
        "Concurrent Downloads: 0%|          | 0/5 [00:00<?, ?it/s]": ("Concurrent Downloads", 0, "0", "5"),
        "Concurrent Downloads:  40%|####| 2/5 [00:10<00:15] 5it/s": ("Concurrent Downloads", 40, "2", "5"),
        "Concurrent Downloads:  40%|####| 2/5 [00:10<00:15] and then some": None,
        "Concurrent Downloads:  40%|####| 2M/5M [00:10<00:15]": None,
        "Downloading a b: c.zip:  7%|# | 1.5M/20.0M [00:01<00:19, 1.0MB/s] and then some": ("a b: c.zip", 7, "1.5M", "20.0M"),
        "Downloading x.zip: 7%|# | 512/20.0k [00:01<?]": ("x.zip", 7, "512", "20.0k"),
        "Resuming x.zip: 7%|# | 512/20.0k [00:01<00:02]": ("x.zip", 7, "512", "20.0k"),
        "Uploading x.zip: 7%|# | 512/20.0k [00:01<00:02]": None,
        "plain": None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, line string").select("i", files.progress(F.col("line")).alias("p")).collect()
    assert {r.i: tuple(r.p) if r.p else None for r in rows} == dict(enumerate(cases.values()))
    resumed = spark.createDataFrame([("Resuming x.zip: 7%|# | 512/20.0k [00:01<00:02]",)], "line string")
    assert resumed.where(files.progress(F.col("line"), strict=True).isNotNull()).count() == 0


def test_catalogue_partitions_are_replaced(spark, tmp_path):
    """Only partitions with new rows are replaced, and a large month is rebalanced, not sent to one task by its key."""
    path = str(tmp_path / "catalogue")
    make = lambda rows: spark.createDataFrame(rows, "provider string, collection string, product_id string, start_ts string").withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))
    readers.write_catalogue(make([("p", "c", "1", "2020-01-02"), ("p", "c", "2", "2020-01-03"), ("p", "c", "3", "2020-02-01"), ("q", "d", "4", None)]), path)
    readers.write_catalogue(make([("p", "c", "5", "2020-01-09")]), path)
    assert sorted(r.product_id for r in spark.read.parquet(path).collect()) == ["3", "4", "5"]
    assert sorted(x.name for x in (tmp_path / "catalogue" / "provider=p" / "collection=c").iterdir()) == ["month=2020-01", "month=2020-02"]


def test_adapters_by_name(spark):
    images = spark.createDataFrame([("a/b/c", "a", None)], "id string, collection string, start_ts timestamp_ntz")
    row = adapters.normalise("GEE", images).first()
    assert row.asDict().keys() == adapters.NORMALISED.keys() and (row.provider, row.name, row.ring) == ("gee", "c", None)
    with pytest.raises(ValueError, match="unknown provider landsat"):
        adapters.normalise("landsat", images)


def test_a_batch_that_runs_again_does_not_count_twice(spark, tmp_path):
    stream = lambda: streams.last_states(spark.readStream.schema("file_id long, seq int, status int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for i, rows in enumerate([[(1, 1, 503), (2, 1, 200)], [(1, 2, 200)]]):
        spark.createDataFrame(rows, "file_id long, seq int, status int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = streams.run_into(stream(), str(tmp_path / "out"), "update", key="file_id")
        assert sorted(map(tuple, got.collect())) == ([(1, 503, 1), (2, 200, 1)] if i == 0 else [(1, 200, 2), (2, 200, 1)])
    again = streams.run_into(stream(), str(tmp_path / "out"), "update", key="file_id")
    assert sorted(map(tuple, again.collect())) == [(1, 200, 2), (2, 200, 1)]


def test_wkt_round_trip_and_rejects(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 1.5 0, 1 0.00025, 0 0))",), ("POLYGON ((0 0,1 0,1 1,0 0),(0 0,1 0,1 1,0 0))",), ("POINT (1 2)",)], "wkt string")
    rows = [r[0] for r in df.select(G.to_wkt(G.from_wkt(F.col("wkt")))).collect()]
    assert rows == ["POLYGON ((0 0, 1.5 0, 1 0.00025, 0 0))", None, None]


def test_orientation_is_stable(spark):
    clockwise = square(0, 0)[::-1]
    df = spark.createDataFrame([(clockwise,)], f"r {RING}")
    once = G.counter_clockwise(F.col("r"))
    a, b = df.select(once, G.counter_clockwise(once)).first()
    assert a == b and [tuple(p) for p in a] == clockwise[::-1]


def test_output_layout_skips_missing_and_empty(spark):
    df = spark.createDataFrame([("k", None, "", "p", None, ""), ("k", "2020/01/02", None, "p", "c", "t")], "k string, s string, e string, p string, c string, t string")
    rows = [r[0] for r in df.select(files.output_layout(*map(F.col, "ksepct"))).collect()]
    digest = "8ce4b16b22b58894aa86c421e8759df3"
    assert rows == [f"downloads/{digest}/p", f"downloads/{digest}/20200102/p/c/t"]


def test_open_window_leaves_out_its_bounds(spark):
    df = spark.sql("select explode(array(timestamp_ntz'2020-01-01 00:00:00', timestamp_ntz'2020-01-01 00:00:01', timestamp_ntz'2020-01-02 23:59:58', timestamp_ntz'2020-01-02 23:59:59')) as ts")
    assert df.where(catalog.open_window(F.col("ts"), "2020-01-01", "2020-01-02")).count() == 2


@pytest.mark.parametrize(("member", "bad"), [("a/b", False), ("../a", True), ("a/../b", False), ("a/../../b", True), ("/a", True), ("./a", False)])
def test_members_that_leave_the_base(spark, member, bad):
    assert spark.range(1).select(files.leaves_base(F.lit(member))).first()[0] is bad


def walk(rows, rules):
    """The retry loop by hand."""
    refreshes = spent = 0
    delay = rules.first_delay
    for seq, status, after in rows:
        if status in (200, 206) or (status == 416 and rules.refreshes):
            yield seq, "ok", 0.0
            return
        if status == 401 and rules.refreshes:
            refreshes += 1
            verdict = "unauthorized" if not rules.refreshing else "refresh_limit" if refreshes > rules.refreshes else "retry"
            yield seq, verdict, 0.0
            if verdict != "retry":
                return
            continue
        spent += 1
        wait = float(min(after, rules.most_retry_after or after)) if status == 429 and after is not None else delay
        if status == -1:
            delay = min(delay * 2, 120.0)
        elif status != 429 and not 500 <= status < 600:
            delay = min(delay * rules.growth, rules.most_delay or 1e300)
        yield seq, "exhausted" if spent >= rules.attempts else "retry", wait
        if spent >= rules.attempts:
            return


RULES = [ledger.DOWNLOAD, ledger.LOOKUP, ledger.RetryRules(refreshing=False), ledger.RetryRules(attempts=30, first_delay=20.0)]


@pytest.mark.parametrize("rules", RULES, ids=["download", "lookup", "no refresh", "long"])
def test_retry_plan_is_the_loop_in_batch_and_stream(spark, tmp_path, rules):
    rng = random.Random(3)
    rows = [(f, s, rng.choice([200, 401, 401, 416, 429, 429, 503, 404, 0, 0, -1, -1] if rules.attempts < 9 else [0, -1, -1]), rng.choice([None, 7, 900])) for f in range(80) for s in range(1, 12)]
    df = spark.createDataFrame(rows, "file_id long, seq int, status int, retry_after int")
    want = sorted((f, *x) for f in range(80) for x in walk([(s, st, a) for g, s, st, a in rows if g == f], rules))
    plan = ledger.retry_plan(df, rules)
    assert sorted((r.file_id, r.seq, r.verdict, r.wait) for r in plan.collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with streams.rocksdb(spark):
        out = streams.run_into(streams.retry_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rules), str(tmp_path / "out"), "append")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert sorted((r.file_id, r.seq, r.verdict, r.wait) for r in out.collect()) == want
    ended = {r.file_id: r.outcome for r in ledger.outcomes(plan.withColumn("bytes", F.lit(0))).collect()}
    assert set(ended) == set(range(80))


def test_readers(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x)) and str(tmp_path / name)
    assert readers.products(spark, put("p.json", {"value": [{"Id": "a", "Attributes": [{"Name": "n", "Value": "v"}]}]})).first().Id == "a"
    assert readers.products(spark, put("q.json", {"error": 1})).count() == 0
    assert readers.scenes(spark, put("s.json", {"results": [{"entityId": "e"}]})).count() == 0
    assert readers.scenes(spark, put("t.json", {"recordsReturned": 1, "results": [{"entityId": "e", "metadata": [{"fieldName": "Satellite", "value": 8}]}]})).first().metadata[0].value == "8"
    assert readers.granule_links(spark, put("g.json", {"feed": {"entry": [{"id": "g", "links": [{"href": "h"}, {"href": "i"}]}]}})).count() == 2
    option = {"available": True, "entityId": "e", "id": "i", "productName": "Bundle"}
    (tmp_path / "o").mkdir()
    put("o/list.json", [option])
    put("o/box.json", {"options": [option, option]})
    assert readers.download_options(spark, str(tmp_path / "o")).count() == 3
    assert readers.areas(spark, put("a.wkt", "POLYGON ((0 0, 1 0, 1 1, 0 0))\n\n POLYGON ((0 0, 2 0, 1 1, 0 0))\n")).count() == 2
    feature = {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    assert [r.wkt for r in readers.areas(spark, put("a.geojson", {"features": [feature, feature]})).collect()] == ["POLYGON ((0 0, 1 0, 1 1, 0 0))"] * 2
    with pytest.raises(ValueError, match="areas are read"):
        readers.areas(spark, "x.shp")
    assert [tuple(r)[1:] for r in readers.log_lines(spark, put("l.log", "a\n b \nc")).orderBy("line_no").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert readers.log_lines(spark, str(tmp_path / "none.log")).count() == 0
    put("o/long.json", json.dumps({"options": [option]}, indent=1))
    assert readers.download_options(spark, str(tmp_path / "o")).count() == 4


def test_deferred_list_replaces_the_last(spark, tmp_path):
    path = str(tmp_path / "later")
    for url in ("a", "b"):
        readers.write_deferred(spark.createDataFrame([(url, "n")], "url string, file_name string"), path)
    readers.write_deferred(spark.createDataFrame([], "url string, file_name string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["b\tn"]


def test_scratch_folders_go(spark):
    path = readers.scratch(spark, "some") + ".wkt"
    spark.range(3).selectExpr("cast(id as string) as value").write.text(path)
    assert readers.exists(spark, path)
    readers.drop_scratch(spark)
    assert not readers.exists(spark, path)
