"""Catalogue tables derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geometry as G

VIEWS = {
    "scenes": """select o_orderkey as scene_id,
 case o_orderkey % 5 when 0 then 'SENTINEL-1' when 1 then 'SENTINEL-2' when 2 then 'SENTINEL-3' when 3 then 'SENTINEL-5P' else 'landsat_ot_c2_l2' end as collection,
 case o_orderkey % 4 when 0 then 'S2MSI1C' when 1 then 'S2MSI2A' when 2 then 'GRD' else null end as product_type,
 concat('T', cast(o_custkey % 60 as string)) as tile_id, o_orderdate as acq_date,
 case o_orderkey % 50 when 0 then 0 when 1 then 86399 else (o_orderkey*7919) % 86400 end as sec_of_day,
 cast((o_orderkey*37) % 22400 as double)/64 - 175 as x0, cast((o_custkey*53) % 9600 as double)/64 - 75 as y0,
 cast(32 + o_orderkey % 64 as double)/64 as w, cast(o_custkey % 16 as double)/64 as k from orders""",
    "aois": "select s_suppkey as aoi_id, cast((s_suppkey*911) % 22400 as double)/64 - 175 as x, cast((s_suppkey*577) % 9600 as double)/64 - 75 as y from supplier",
    "shapes": "select s_suppkey as shape_id, cast((s_suppkey*911) % 22400 as double)/64 - 175 as x, cast((s_suppkey*577) % 9600 as double)/64 - 75 as y from supplier",
    "border_points": "select c_nationkey as nation, row_number() over (partition by c_nationkey order by c_custkey) as i, cast(c_nationkey*14 - 175 as double) as x, cast((c_nationkey*37) % 100 - 50 as double) + cast((c_custkey*13) % 64 as double)/64 as low, cast((c_nationkey*37) % 100 - 46 as double) + cast((c_custkey*29) % 64 as double)/64 as high from customer",
    "tiles": "select concat('T', cast(p_partkey as string)) as name, -180 + 6*(p_partkey % 60) as x, -90 + 6*cast(floor(p_partkey/60) as int) as y from part where p_partkey < 1800",
    "product_info": "select o_orderkey as product_id, concat('P_', cast(o_orderkey as string), '_', o_orderstatus) as name from orders where o_orderkey % 7 <> 0",
    "scene_meta": """select o_orderkey as entity_id, (o_orderkey % 3 <> 0) as bulk,
 concat('LC0', cast(8 + o_orderkey % 2 as string), '_', case o_orderkey % 3 when 0 then 'L1TP' when 1 then 'L2SP' else 'L2SR' end, '_', cast(o_custkey as string)) as display_id,
 case o_custkey % 4 when 0 then '8' when 1 then '9' when 2 then '08' else 'n/a' end as satellite from orders""",
    "download_options": "select l_orderkey as entity_id, l_linenumber as option_id, l_returnflag <> 'R' as available, case l_linestatus when 'F' then 'Product Bundle' else 'Band File' end as product_name from lineitem",
    "granule_links": """select l_orderkey as granule_id, l_linenumber as link_no, concat('http://d.example/', cast(l_partkey as string), case l_linenumber % 3 when 0 then '.hdf' when 1 then '.HDF' else '.xml' end) as href,
 case l_returnflag when 'A' then 'http://x/data#' when 'N' then 'http://x/browse#' else null end as rel from lineitem""",
    "attempts": """select user_id as file_id, row_number() over (partition by user_id order by ts, event_id) as seq, ts,
 case when event_id % 7 = 0 then case event_id % 3 when 0 then 200 when 1 then 206 else 416 end else case event_id % 8 when 0 then 401 when 1 then 429 when 2 then 503 when 3 then 404 when 4 then 0 when 5 then 429 when 6 then 401 else 0 end end as status,
 case when event_id % 8 = 1 then 400 when event_id % 16 = 5 then 17 else null end as retry_after, cast(floor(value*1000) as bigint) as bytes from events""",
    "probes": """select user_id as file_id, row_number() over (partition by user_id order by ts, event_id) as seq, cast(null as int) as retry_after, cast(floor(value*1000) as bigint) as bytes,
 case event_id % 6 when 0 then -1 when 1 then 0 when 2 then -1 when 3 then 503 when 4 then 401 else 404 end as status from events""",
    "members": """select l_suppkey as archive, l_orderkey*10 + l_linenumber as ordinal,
 case when l_suppkey % 10 = 3 and l_linenumber = 7 then '../evil.tif' when l_linenumber % 4 = 0 then concat('a/../b', cast(l_linenumber as string), '.TIF') when l_linenumber % 4 = 1 then concat('g/', cast(l_partkey as string), '.jp2') when l_linenumber % 4 = 2 then 'meta.xml' else 'a/b/c.tiff' end as member_name from lineitem""",
    "raster": "select p_partkey as raster_id, cast((p_partkey*37) % 22400 as double)/64 - 175 + cast(1 as double)/128 as origin_x, cast((p_partkey*53) % 9600 as double)/64 - 70 + cast(1 as double)/128 as origin_y from part",
    "grids": "select p_partkey as raster_id, cast(-20015109.354 as double) + cast(1111950.519667 as double) * (p_partkey % 36) as origin_x, cast(10007554.677 as double) - cast(1111950.519667 as double) * cast(floor(p_partkey / 36) as int) as origin_y from part where p_partkey < 648",
    "progress": """select event_id as line_no, case when event_type = 'error' then concat('plain message ', cast(event_id as string)) when event_type = 'view' then concat('Concurrent Downloads:  ', cast(event_id % 101 as string), '%|##  | ', cast(event_id % 101 as string), '/100 [00:05<00:05]') else concat('Downloading F', cast(user_id as string), '.zip:  ', cast(event_id % 101 as string), '%|##  | 1.0M/10.0M [00:01<00:09]') end as line from events""",
}
#: Corners of the rings over the views above, as SQL of either engine.
CORNERS = {
    "scenes": [("x0", "y0"), ("x0+w", "y0+k"), ("x0+w-k", "y0+w+k"), ("x0-k", "y0+w"), ("x0", "y0")],
    "aois": [("x", "y"), ("x+4", "y"), ("x+4", "y+2"), ("x+2", "y+2"), ("x+2", "y+4"), ("x", "y+4"), ("x", "y")],
    "tiles": [("x", "y"), ("x+6", "y"), ("x+6", "y+6"), ("x", "y+6"), ("x", "y")],
}
#: Parts of the shapes over the view ``shapes``: a square with a square hole, and a smaller square beside it.
_BOX = lambda a, b, c, d: [(f"x+{a}", f"y+{b}"), (f"x+{c}", f"y+{b}"), (f"x+{c}", f"y+{d}"), (f"x+{a}", f"y+{d}"), (f"x+{a}", f"y+{b}")]
PARTS = [[_BOX(0, 0, 4, 4), _BOX(1, 1, 3, 3)], [_BOX(6, 0, 7, 1)]]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; ``scenes``, ``aois`` and ``tiles`` also bear their ring, ``scenes`` its start."""
    sql = re.sub(r"\bfrom (\w+)", lambda m: f"from parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name])
    df = spark.sql(sql)
    if name in CORNERS:
        df = df.withColumn("ring", G.ring(*((F.expr(x), F.expr(y)) for x, y in CORNERS[name])))
    if name == "shapes":
        rings = [[G.ring(*((F.expr(x), F.expr(y)) for x, y in r)) for r in part] for part in PARTS]
        df = df.withColumn("shape", F.array(*(F.array(*part) for part in rings)))
    if name == "scenes":
        df = df.withColumn("start_ts", F.expr("acq_date + make_dt_interval(0, 0, 0, sec_of_day)"))
    return df


def _box_sql(name: str) -> str:
    return f"{name}_box as (select id, min(x1) as xmin, min(y1) as ymin, max(x1) as xmax, max(y1) as ymax from {name}_edge group by id)"


def borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long ring for each nation: along its customers' high points and back along the low ones."""
    rows = view(spark, sf_dir, "border_points").select("nation", "i", F.expr("x + i / 16D").alias("x"), "low", "high")
    chain = rows.groupBy("nation").agg(F.sort_array(F.collect_list(F.struct("i", "x", "low", "high"))).alias("p"))
    there, back = F.transform("p", lambda p: G.point(p.x, p.high)), F.reverse(F.transform("p", lambda p: G.point(p.x, p.low)))
    return chain.select("nation", G.close_ring(F.concat(there, back)).alias("border"))


def border_edges() -> str:
    """CTEs for DuckDB: edges and boxes of ``borders``."""
    lead = "lead({}) over (partition by nation order by i)"
    ends = lambda f, y: f"select nation as id, {n_of[f]} as n, {'true' if f == 'min' else 'false'} as first, x + i / 16.0::double as x1, high as y1, x + i / 16.0::double as x2, low as y2 from border_points where (nation, i) in (select nation, {f}(i) from border_points group by 1)"
    n_of = {"min": "0", "max": "-1"}
    chain = lambda y, n: f"select * from (select nation as id, {n} * i as n, false as first, x + i / 16.0::double as x1, {y} as y1, {lead.format('x + i / 16.0::double')} as x2, {lead.format(y)} as y2 from border_points) where x2 is not null"
    return f"borders_edge as ({ends('min', 'high')} union all {ends('max', 'high')} union all {chain('high', 10)} union all {chain('low', -10)}),\n{_box_sql('borders')}"


def ctes(*names: str, edges: tuple[str, ...] = ()) -> str:
    """``with`` clause for DuckDB: the named views (``scenes`` with ``start_ts``) and, for ``edges``, tables
    ``<view>_edge(id, n, x1, y1, x2, y2)`` and ``<view>_box``."""
    out = []
    for name in names:
        sql = VIEWS[name]
        if name == "scenes":
            sql = f"select *, acq_date + to_seconds(sec_of_day) as start_ts from ({sql})"
        out.append(f"{name} as ({sql})")
    for name in edges:
        key = {"scenes": "scene_id", "aois": "aoi_id", "tiles": "name", "shapes": "shape_id"}[name]
        rings = [r for part in PARTS for r in part] if name == "shapes" else [CORNERS[name]]
        lines = [(a, b, n == 0) for r in rings for n, (a, b) in enumerate(zip(r, r[1:], strict=False))]
        sides = " union all ".join(f"select {key} as id, {n} as n, {first} as first, ({a[0]})::double as x1, ({a[1]})::double as y1, ({b[0]})::double as x2, ({b[1]})::double as y2 from {name}" for n, (a, b, first) in enumerate(lines))
        out.append(f"{name}_edge as ({sides})")
        out.append(_box_sql(name))
    return "with " + ",\n".join(out) + "\n"


def meets_sql(left: str, right: str) -> str:
    """CTEs that end in ``hit(a, b)``: the pairs of two edge tables whose polygons meet, by brute force over box pairs."""
    turn = lambda p, q, r: f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    e1, e2, f1, f2 = (("e.x1", "e.y1"), ("e.x2", "e.y2"), ("f.x1", "f.y1"), ("f.x2", "f.y2"))
    on = lambda p, a, b: f"({p[0]} between least({a[0]}, {b[0]}) and greatest({a[0]}, {b[0]}) and {p[1]} between least({a[1]}, {b[1]}) and greatest({a[1]}, {b[1]}))"
    corner = lambda a, b, edge, own, other: f"""select near.a, near.b from near join {a}_edge c on c.id = near.{own} and c.first join {edge}_edge g on g.id = near.{other}
  where (g.y1 > c.y1) <> (g.y2 > c.y1) and c.x1 < (g.x2 - g.x1) * (c.y1 - g.y1) / (g.y2 - g.y1) + g.x1 group by near.a, near.b, c.n having count(*) % 2 = 1"""  # noqa: E731
    return f"""near as (select l.id as a, r.id as b from {left}_box l, {right}_box r where l.xmin <= r.xmax and r.xmin <= l.xmax and l.ymin <= r.ymax and r.ymin <= l.ymax),
side as (
  select near.a, near.b, {turn(f1, f2, e1)} as s, {turn(f1, f2, e2)} as t, {turn(e1, e2, f1)} as u, {turn(e1, e2, f2)} as v,
    {on(e1, f1, f2)} as e1, {on(e2, f1, f2)} as e2, {on(f1, e1, e2)} as f1, {on(f2, e1, e2)} as f2
  from near join {left}_edge e on e.id = near.a join {right}_edge f on f.id = near.b),
hit as (
  select a, b from side where (s * t < 0 and u * v < 0) or (s = 0 and e1) or (t = 0 and e2) or (u = 0 and f1) or (v = 0 and f2)
  union
  {corner(left, right, right, 'a', 'b')}
  union
  {corner(right, left, left, 'b', 'a')})
"""


def number_sql(e: str) -> str:
    """DuckDB SQL of a coordinate's canonical text."""
    return rf"regexp_replace(regexp_replace(({e})::double::varchar, '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


def wkt_sql(name: str) -> str:
    """DuckDB SQL of the text of a view's ring."""
    points = " || ', ' || ".join(f"{number_sql(x)} || ' ' || {number_sql(y)}" for x, y in CORNERS[name])
    return f"'POLYGON ((' || {points} || '))'"
