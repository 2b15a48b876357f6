"""Spatial joins by grid cells of several sizes: one equi-join on cells, then one guarded exact predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions import geometry as G

#: Cells of one level are so many times as wide as those of the level below.
RATIO = 8
#: Levels above the lowest one that is used; smaller boxes share the lowest.
ABOVE = 7
#: The same in powers of two, for cells by the boxes that were asked for.
DEEP = 21
#: How much farther than its power of two a box may reach, so that rounding loses no pair.
REACH = 1.000001
#: Boxes that a shape may be made of, for pairs to be settled by them.
COVER = 6

CELL = "array<struct<z:int,x:bigint,y:bigint>>"


def own_level(box: Column) -> Column:
    """The level whose cells are just wide enough for a box and an eighth of a cell; null for a box without extent."""
    side = F.greatest(box.xmax - box.xmin, box.ymax - box.ymin)
    return F.ceil(F.log(side * RATIO / (RATIO - 1)) / F.log(F.lit(float(RATIO)))).cast("int")


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. The planner takes the size of a table from its files and counts
    neither what an explode adds nor how long an array is, so it would send tables of many gigabytes through the driver."""
    return df.hint("merge")


def levels_of(df: DataFrame, r: str = "ring") -> list[int]:
    """Levels of the boxes of a table: a scan of its shapes, for callers that keep them with a catalogue."""
    rows = _valid(df, r).select(own_level(G.bounds_of(df, r)).alias("level")).distinct().collect()
    return sorted(x.level for x in rows if x.level is not None)


def _valid(df: DataFrame, r: str) -> DataFrame:
    return df.where(G.is_shape(df, r))


def _snap(level: Column, ladder: list[int]) -> Column:
    """The lowest rung at or above ``level``; the highest for anything above all."""
    out = F.when(level.isNull(), ladder[0])
    for rung in ladder[:-1]:
        out = out.when(level <= rung, rung)
    return out.otherwise(ladder[-1]).cast("int")


def _size(level: Column) -> Column:
    return F.pow(F.lit(float(RATIO)), level.cast("double"))


def _place(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("long")


def _key(rung: Column, tag: int, x: Column, y: Column) -> Column:
    return F.struct((rung * 4 + tag).cast("int").alias("z"), x.alias("x"), y.alias("y"))


def _cells(box: Column, rung: Column, tag: int, slack: Column | float = 0.0) -> Column:
    """Keys of the cells that a box covers, grown to the lower left by ``slack`` of a cell."""
    size = _size(rung)
    span = lambda a, b: F.sequence(_place(a - size * slack, size), _place(b, size))
    return F.flatten(F.transform(span(box.xmin, box.xmax), lambda x: F.transform(span(box.ymin, box.ymax), lambda y: _key(rung, tag, x, y))))


def keys_of(box: Column, own: list[int], other: list[int], meets: int) -> Column:
    """Join keys of a box in a table with levels ``own`` against one with levels ``other``; ``meets`` is 1 on the left and 2 on
    the right.

    Boxes of one level meet in the cells that they cover (tag 0), four each at most. Of two levels, the wider box waits in the
    cells of its own level, grown by the width of the narrower (tag ``meets``), four again, and the narrower one comes to the
    one cell of its lower left corner at each higher level where there are wider ones. So a row has 8 keys and one for each
    higher level, at most, however wide it is; a pair of two levels meets once.
    """
    ladder = sorted({*own, *other})
    rung = _snap(own_level(box), ladder)
    none = F.lit(None)
    same = F.when(rung.isin(other), _cells(box, rung, 0))
    waiting = F.when(rung > min(other), _cells(box, rung, meets, 1 / RATIO)) if min(other) < max(own) else none.cast(CELL)
    coming = F.array_compact(F.array(*(F.when(rung < z, _key(F.lit(z), 3 - meets, _place(box.xmin, _size(F.lit(z))), _place(box.ymin, _size(F.lit(z))))) for z in other if z > min(own))))
    return F.flatten(F.array_compact(F.array(same, waiting, coming.cast(CELL))))


def _rung_of(box: Column) -> Column:
    """The power of two that a box is no wider than, but for rounding (``REACH``); null for a box without extent."""
    side = F.greatest(box.xmax - box.xmin, box.ymax - box.ymin)
    return F.ceil(F.log2(side) - 1e-7).cast("int")


def _plan_of(seen: DataFrame) -> dict[str, list[tuple[int, int | None, int]]]:
    """How the rows of each side wait for the other's, from a table ``side, rung`` of all boxes: ``rung, widest, cell`` for each
    rung in use, where ``widest`` is the highest rung of the other side's that come to it, if any, and ``cell`` the power of two
    of the cells. Boxes that are few against those that come wait in cells a quarter as wide as themselves, which leaves few
    pairs whose boxes do not meet; others in cells of their own width."""
    found = [(x.side, x.rung, x["count"]) for x in seen.groupBy("side", "rung").count().collect()]
    most = max((rung for _, rung, _ in found if rung is not None), default=0)
    held: dict[str, dict[int, int]] = {"l": {}, "r": {}}
    for side, rung, n in found:
        rung = max(most - DEEP if rung is None else rung, most - DEEP)
        held[side][rung] = held[side].get(rung, 0) + n
    plan: dict[str, list[tuple[int, int | None, int]]] = {}
    for side, other in (("l", "r"), ("r", "l")):
        plan[side] = []
        for rung, n in sorted(held[side].items()):
            # Of two boxes of one rung the right one waits.
            come = {x: m for x, m in held[other].items() if x < rung or (x == rung and side == "r")}
            few = 4 * n <= sum(come.values())
            finer = 0 if not few else 1 if max(come) == rung else 2
            plan[side].append((rung, max(come, default=None), rung - finer))
    return plan


def _fine_keys(box: Column, side: str, plan: dict[str, list[tuple[int, int | None, int]]]) -> Column:
    """Join keys of a box: the cells it waits in for narrower ones, of which the widest reaches as far to its upper right as the
    box is grown to its lower left, and for each wider rung of the other side the one cell of its lower left corner. So a pair
    meets once. At most 64 keys wait, where there are several times as many rows on the other side, else 16."""
    own, other = plan[side], plan["r" if side == "l" else "l"]
    tag = {"l": 1, "r": 2}
    if not own or not other:
        return F.lit(None).cast(CELL)
    rung = _snap(_rung_of(box), [x for x, _, _ in own])
    cell = lambda v, size: F.floor(v / size).cast("long")

    def waiting(at: int, widest: int, power: int) -> Column:
        size, reach = F.lit(2.0**power), F.lit(2.0**widest * REACH)
        span = lambda a, b: F.sequence(cell(a - reach, size), cell(b, size))
        return F.flatten(F.transform(span(box.xmin, box.xmax), lambda x: F.transform(span(box.ymin, box.ymax), lambda y: _key(F.lit(at), tag[side], x, y))))

    waits = [F.when(rung == at, waiting(at, widest, power)) for at, widest, power in own if widest is not None]
    comes = [F.when((rung < at) | ((rung == at) & F.lit(side == "l")), _key(F.lit(at), 3 - tag[side], cell(box.xmin, F.lit(2.0**power)), cell(box.ymin, F.lit(2.0**power)))) for at, widest, power in other if widest is not None]
    parts = [w.cast(CELL) for w in waits] + ([F.array_compact(F.array(*comes)).cast(CELL)] if comes else [])
    return F.flatten(F.array_compact(F.array(*parts))) if parts else F.lit(None).cast(CELL)


def _flat(df: DataFrame, s: str) -> DataFrame:
    """Plain numbers of a side's box and of what settles most pairs (``geometry.convex_four``, ``geometry.box_cover``), never
    null: predicates over them are short compiled code, while those over arrays are worked out step by step."""
    number = lambda c, missing: F.coalesce(c, F.lit(missing))
    if s == "l":
        return G.convex_four(df, "l_edges", "l_four", [(f"l_x{i}", f"l_y{i}") for i in range(4)])
    held = G.hold(df, _cover=G.box_cover(F.col("r_edges"), COVER))
    limits = {"xmin": float("inf"), "ymin": float("inf"), "xmax": float("-inf"), "ymax": float("-inf")}
    boxes = {f"r_{c}{i}": number(F.get(F.col("_cover.boxes"), i)[c], missing) for i in range(COVER) for c, missing in limits.items()}
    return held.select("*", *(v.alias(k) for k, v in boxes.items()), F.coalesce("_cover.whole", F.lit(False)).alias("r_whole")).drop("_cover")


def _settled() -> Column:
    """Whether a convex left shape of four corners meets one of the right one's boxes: none of its edges has the whole box on
    its outer side."""
    out = F.lit(False)
    for i in range(COVER):
        xmin, ymin, xmax, ymax = (F.col(f"r_{c}{i}") for c in ("xmin", "ymin", "xmax", "ymax"))
        meets = (F.col("_lx0") <= xmax) & (xmin <= F.col("_lx1")) & (F.col("_ly0") <= ymax) & (ymin <= F.col("_ly1"))
        for k in range(4):
            px, py, qx, qy = F.col(f"l_x{k}"), F.col(f"l_y{k}"), F.col(f"l_x{(k + 1) % 4}"), F.col(f"l_y{(k + 1) % 4}")
            x, y = F.when(qy >= py, xmin).otherwise(xmax), F.when(qx >= px, ymax).otherwise(ymin)
            meets &= (qx - px) * (y - py) - (qy - py) * (x - px) >= 0
        out |= meets
    return out


def spatial_join(left: DataFrame, right: DataFrame, *, left_ring: str = "ring", right_ring: str = "ring", exact: bool = True, ids: tuple[str, str] | None = None, levels: list[int] | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose polygons (``exact``) or boxes meet; all columns of both sides but the shapes, whose names must
    differ otherwise. Shapes are rings or polygons of several rings (``geometry``); null ones and rings of fewer than four
    points meet nothing.

    Both sides go to grid cells by the size of their boxes and meet by one equi-join, to which ``on`` adds columns that both
    sides share. How many boxes there are of each size is asked first, by a scan of the shapes of both sides in one job
    (``_plan_of``), unless ``levels`` tells which sizes there are (``levels_of``, kept with a catalogue; ``keys_of``); levels that
    miss some boxes only make these take more cells. The predicate stands behind a CASE, since the optimiser may put its dear
    part before the cheap one: pairs of a convex left shape of four corners and a right one of a few boxes are settled by plain
    numbers, others by their edges. With ``ids``, the names of a unique column of each side, only ids and boxes are shuffled to
    the cells, and the rest is joined to the pairs whose boxes meet: the way for large shapes or wide rows, where pairs are few.
    """
    sides = {"l": (_valid(left, left_ring), left_ring), "r": (_valid(right, right_ring), right_ring)}
    if levels is None:
        seen = [df.select(F.lit(s).alias("side"), _rung_of(G.bounds_of(df, r)).alias("rung")) for s, (df, r) in sides.items()]
        plan = _plan_of(seen[0].unionByName(seen[1]))
        keys = lambda s: _fine_keys(F.col(f"{s}_box"), s, plan)
    else:
        held = sorted(set(levels))
        keys = lambda s: keys_of(F.col(f"{s}_box"), held, held, 1 if s == "l" else 2)

    def rows(s: str) -> DataFrame:
        df, r = sides[s]
        if not exact:
            return G.hold(df, **{f"{s}_box": G.bounds_of(df, r)}).drop(r)
        return _flat(G.hold(df, **{f"{s}_box": G.bounds_of(df, r), f"{s}_edges": G.edges_of(df, r), f"{s}_corners": G.corners_of(df, r)}).drop(r), s)

    def dealt(s: str) -> DataFrame:
        df = rows(s) if ids is None else G.hold(sides[s][0], **{f"{s}_box": G.bounds_of(*sides[s])}).select(ids["lr".index(s)], *on, f"{s}_box")
        numbers = [F.coalesce(f"{s}_box.{c}", F.lit(float("nan"))).alias(f"_{s}{n}") for c, n in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))]
        return G.hold(df, _keys=keys(s)).select("*", *numbers).withColumn("_key", F.explode("_keys")).drop("_keys", f"{s}_box").select("*", F.col("_key.z").alias("_z"), F.col("_key.x").alias("_x"), F.col("_key.y").alias("_y")).drop("_key")

    pairs = dealt("l").join(by_shuffle(dealt("r")), [*on, "_z", "_x", "_y"])
    near = (F.col("_lx0") <= F.col("_rx1")) & (F.col("_rx0") <= F.col("_lx1")) & (F.col("_ly0") <= F.col("_ry1")) & (F.col("_ry0") <= F.col("_ly1"))
    if levels is not None:
        size = _size(F.floor(F.col("_z") / 4))
        corner = (_place(F.greatest("_lx0", "_rx0"), size) == F.col("_x")) & (_place(F.greatest("_ly0", "_ry0"), size) == F.col("_y"))
        near &= (F.pmod("_z", F.lit(4)) != 0) | corner
    met = F.when(F.col("l_four") & _settled(), F.lit(True)).when(F.col("l_four") & F.col("r_whole"), F.lit(False)).otherwise(G.shapes_meet(*(F.col(c) for c in ("l_edges", "l_corners", "r_edges", "r_corners"))))
    inner = [c for c in ("_z", "_x", "_y", "l_box", "r_box", "l_edges", "r_edges", "l_corners", "r_corners", "l_four", "r_whole", *(f"_{s}{n}" for s in "lr" for n in ("x0", "y0", "x1", "y1")), *(f"l_{c}{i}" for i in range(4) for c in "xy"), *(f"r_{c}{i}" for i in range(COVER) for c in ("xmin", "ymin", "xmax", "ymax")))]
    if ids is None:
        return pairs.where(F.when(~near, F.lit(False)).otherwise(met if exact else F.lit(True))).drop(*inner)
    found = pairs.where(near).select(*ids, *on, *(f"_l{n}" for n in ("x0", "y0", "x1", "y1")))
    for s, key in zip("lr", ids, strict=True):
        found = found.join(by_shuffle(rows(s).drop(f"{s}_box", *(on if s == "r" else ()))), [key, *(on if s == "l" else ())])
    return (found.where(met) if exact else found).drop(*inner)


def _pieces(df: DataFrame, r: str, key: str, side: str, per_piece: int = 16) -> DataFrame:
    """``key``, runs of neighbouring edges as ``<side>e`` and the box of each run as a ring."""
    edges = G.hold(_valid(df, r).select(key, r), _all=G.edges_of(df, r)).select(key, "_all", F.explode(F.sequence(F.lit(1), F.size("_all"), F.lit(per_piece))).alias("_at"))
    runs = edges.select(key, F.slice("_all", F.col("_at"), per_piece).alias(f"{side}e"))
    e = F.col(f"{side}e")
    b = G.bounds(F.flatten(F.transform(e, lambda x: F.array(G.point(x.ax, x.ay), G.point(x.bx, x.by)))))
    runs, b = G.hold(runs, _b=b), F.col("_b")
    return runs.select(key, f"{side}e", G.ring((b.xmin, b.ymin), (b.xmax, b.ymin), (b.xmax, b.ymax), (b.xmin, b.ymax), (b.xmin, b.ymin)).alias("ring"))


def _corners_held(points: DataFrame, point_ring: str, point_id: str, shapes: DataFrame, ring: str, shape_id: str, per_column: int = 16) -> DataFrame:
    """Pairs of ids where a corner of the first side's shapes lies within a shape of the second, by the even-odd rule.

    A corner meets the shapes whose boxes hold it, and of each only the edges of its own column. It goes right to the end of
    the column and from there up, and is inside if that way crosses an odd number of edges. Columns are as many as keep the
    table of their edges at twice the shape's edges: a line across the shape crosses ``spread`` edges on average, which lie in
    as many more columns. Of the two axes that with the smaller spread is taken; the other way round, x and y change places.
    """
    corners = _valid(points, point_ring).select(point_id, F.posexplode(G.corners_of(points, point_ring)).alias("_n", "p")).withColumn("ring", F.array_repeat("p", 4))
    own = G.hold(_valid(shapes, ring).select(shape_id, F.col(ring).alias("_ring")), _edges=G.edges_of(shapes.withColumnRenamed(ring, "_ring"), "_ring"), _box=G.bounds_of(shapes.withColumnRenamed(ring, "_ring"), "_ring"))
    wide, high = F.col("_box.xmax") - F.col("_box.xmin"), F.col("_box.ymax") - F.col("_box.ymin")
    length = lambda f: F.aggregate("_edges", F.lit(0.0), lambda s, e: s + f(e))
    own = G.hold(own, _across=length(lambda e: F.abs(e.bx - e.ax)) / F.nullif(wide, F.lit(0.0)), _along=length(lambda e: F.abs(e.by - e.ay)) / F.nullif(high, F.lit(0.0)))
    own = own.where("_across is not null and _along is not null").withColumn("_turned", F.expr("_along < _across"))
    columns = F.ceil(F.size("_edges") / F.greatest(F.lit(float(per_column)), F.least("_across", "_along"))).cast("long")
    own = own.withColumns({"_count": columns, "_low": F.when(F.col("_turned"), F.col("_box.ymin")).otherwise(F.col("_box.xmin"))})
    own = own.withColumn("_wide", F.when(F.col("_turned"), high).otherwise(wide) / F.col("_count"))
    frame = ["_turned", "_low", "_wide", "_count"]
    column = lambda v: F.greatest(F.lit(0).cast("long"), F.least(F.col("_count") - 1, F.floor((v - F.col("_low")) / F.col("_wide")).cast("long")))
    met = spatial_join(corners, own.select(shape_id, *frame, F.col("_ring").alias("ring")), right_ring="ring", exact=False)
    swap = lambda a, b: (F.when(F.col("_turned"), b).otherwise(a), F.when(F.col("_turned"), a).otherwise(b))
    x, y = swap(F.col("p.x"), F.col("p.y"))
    met = met.withColumns({"_x": x, "_y": y}).withColumn("_column", column(F.col("_x"))).drop("p")
    turned = F.transform("_edges", lambda e: F.struct(*(v.alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*swap(e.ax, e.ay), *swap(e.bx, e.by)), strict=True))))
    asked = own.join(by_shuffle(met.select(shape_id).distinct()), shape_id, "left_semi")
    sides = G.hold(asked, _sides=turned).select(shape_id, *frame, F.explode("_sides").alias("e"))
    slack = F.col("_wide") * 1e-9
    sides = sides.select(shape_id, "e", F.explode(F.sequence(column(F.least("e.ax", "e.bx") - slack), column(F.greatest("e.ax", "e.bx") + slack))).alias("_column"))
    sides = sides.groupBy(shape_id, "_column").agg(F.collect_list("e").alias("_sides"))
    end = F.col("_low") + (F.col("_column") + 1) * F.col("_wide")

    def crossed(e: Column) -> Column:
        at = (e.bx - e.ax) * (F.col("_y") - e.ay) / F.nullif(e.by - e.ay, F.lit(0.0)) + e.ax
        right = ((e.ay > F.col("_y")) != (e.by > F.col("_y"))) & (F.col("_x") < at) & (at <= F.col("_end"))
        height = (e.by - e.ay) * (F.col("_end") - e.ax) / F.nullif(e.bx - e.ax, F.lit(0.0)) + e.ay
        rising = (e.by > e.ay) == (e.bx > e.ax)
        up = ((e.ax > F.col("_end")) != (e.bx > F.col("_end"))) & ((height > F.col("_y")) | ((height == F.col("_y")) & (e.ay != e.by) & rising))
        return F.coalesce(right, F.lit(False)) != F.coalesce(up, F.lit(False))

    held = met.withColumn("_end", end).join(by_shuffle(sides), [shape_id, "_column"])
    return held.where(F.aggregate("_sides", F.lit(False), lambda inside, e: inside != crossed(e))).select(point_id, shape_id)


def long_ring_join(left: DataFrame, right: DataFrame, ids: tuple[str, str], *, left_ring: str = "ring", right_ring: str = "ring") -> DataFrame:
    """As ``spatial_join``, for shapes of many thousand edges (coasts, borders): pairs of ``ids``, each unique on its side.

    Nothing is done for each pair of shapes with all their edges. Runs of neighbouring edges are rows of a table on each side
    and meet by the cells of their boxes; shapes without a common edge point meet if one holds a corner of the other, for
    which a corner looks at the edges of one column. The work grows with the edges and with those that are close to each other.
    """
    a, b = _pieces(left, left_ring, ids[0], "l"), _pieces(right, right_ring, ids[1], "r")
    touching = spatial_join(a, b, exact=False).where(F.exists("le", lambda x: F.exists("re", lambda y: G.edges_meet(x, y)))).select(*ids)
    inside = _corners_held(left, left_ring, ids[0], right, right_ring, ids[1])
    around = _corners_held(right, right_ring, ids[1], left, left_ring, ids[0])
    return touching.unionByName(inside).unionByName(around).distinct()
