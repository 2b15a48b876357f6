"""Polygon functions as Column expressions. A ring is ``array<struct<x double, y double>>``, an edge list
``array<struct<ax, ay, bx, by>>``, a shape an array of parts, each its outer ring and its holes; coordinates are planar longitude
and latitude. What lies in a shape follows from the even-odd rule over all its edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

RING = "array<struct<x:double,y:double>>"
SHAPE = f"array<array<{RING}>>"


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` that are worked out once a row. The optimiser repeats the expression of a plain column in every
    filter and projection that it moves past it, long ones many times over; it moves nothing past a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def let(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` of a struct of ``values``, each of which is worked out once; as plain expressions they would be repeated wherever
    they are used."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), f)[0]


def point(x: Column | float, y: Column | float) -> Column:
    as_double = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_double(x).alias("x"), as_double(y).alias("y"))


def ring(*points: tuple[Column | float, Column | float]) -> Column:
    return F.array(*(point(x, y) for x, y in points))


def edges(r: Column) -> Column:
    """Edges between neighbouring points; the ring has to be closed."""
    starts, ends = F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))


def bounds(r: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p.x), F.transform(r, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed overlap of two bounds."""
    return (a.xmin <= b.xmax) & (b.xmin <= a.xmax) & (a.ymin <= b.ymax) & (b.ymin <= a.ymax)


def north_west_south_east(r: Column) -> Column:
    b = bounds(r)
    return F.array(b.ymax, b.xmin, b.ymin, b.xmax)


def close_ring(r: Column) -> Column:
    """The ring with its first point at the end, if it is not there already."""
    return F.when((F.size(r) > 0) & (r[0] != F.element_at(r, -1)), F.concat(r, F.array(r[0]))).otherwise(r)


def signed_area(r: Column) -> Column:
    """Positive if the closed ring runs counter-clockwise."""
    return F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + e.ax * e.by - e.bx * e.ay) / 2


def counter_clockwise(r: Column) -> Column:
    return F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r)


def number(v: Column) -> Column:
    """Canonical text of a coordinate: no exponent, no ``.0``, no negative zero."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.format_string("%.12f", v), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), "^-0$", "0")
    return F.when((F.abs(v) < 1e-3) | (F.abs(v) >= 1e7), bare).when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def to_pairs(r: Column) -> Column:
    """``lon,lat,lon,lat`` text."""
    return F.array_join(F.transform(r, lambda p: F.concat_ws(",", number(p.x), number(p.y))), ",")


def to_wkt(r: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", number(p.x), number(p.y))), ", "), F.lit("))"))


def to_geography(r: Column, srid: int = 4326) -> Column:
    return F.concat(F.lit(f"geography'SRID={srid};"), to_wkt(r), F.lit("'"))


def to_geojson(r: Column) -> Column:
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(F.transform(r, lambda p: F.concat(F.lit("["), number(p.x), F.lit(","), number(p.y), F.lit("]"))), ","), F.lit("]]}"))


def from_wkt(text: Column) -> Column:
    """Outer ring of ``POLYGON ((...))``; null for anything else, polygons with holes among them."""
    inner = F.regexp_extract(F.trim(text), r"^(?i:POLYGON)\s*\(\(([-+0-9.eE,\s]+)\)\)$", 1)
    points = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.struct(F.expr("0D").alias("z"), F.split(F.trim(p), r"\s+").alias("c")))
    return F.when(inner != "", F.transform(points, lambda p: F.struct(F.get(p.c, 0).try_cast("double").alias("x"), F.get(p.c, 1).try_cast("double").alias("y"))))


def _parsed(rings: Column) -> Column:
    """``shape, error`` of parts of rings whose points may lack numbers; the shape is null where there is an error."""
    flat = F.flatten(rings)
    bad = F.exists(flat, lambda r: F.exists(r, lambda p: p.x.isNull() | p.y.isNull() | F.isnan(p.x) | F.isnan(p.y)))
    short, open_ = F.exists(flat, lambda r: F.size(r) < 4), F.exists(flat, lambda r: r[0] != F.element_at(r, -1))
    error = F.when(rings.isNull(), "not a polygon").when(bad, "bad number").when(short, "short ring").when(open_, "open ring")
    return F.struct(F.when(error.isNull(), rings).alias("shape"), error.alias("error"))


def shape_from_wkt(text: Column) -> Column:
    """``shape, error`` of a ``POLYGON`` or ``MULTIPOLYGON``, holes and parts and all; further coordinates than two are left
    out. Other texts have an error: ``not a polygon``, ``empty``, ``bad number``, ``short ring`` or ``open ring``."""
    given = F.trim(F.regexp_replace(text, r"\s+", " "))
    kind = F.upper(F.regexp_extract(given, r"^([A-Za-z]+)", 1))
    body = F.regexp_replace(given, r"^[A-Za-z]+ ?(?:Z |M |ZM )?", "")
    body = F.when(kind == "POLYGON", F.concat(F.lit("("), body, F.lit(")"))).when(kind == "MULTIPOLYGON", body)
    # Rings, parts and the whole are closed up one after another, which leaves one letter of a well-formed text.
    frame = body
    for inner, mark in ((r"\([^()]+\)", "R"), (r"\([R,]+\)", "P"), (r"\([P,]+\)", "M")):
        frame = F.regexp_replace(F.regexp_replace(frame, inner, mark), " ", "")
        frame = F.when(F.rlike(frame, F.lit(r",,|\(,|,\)")), F.lit("")).otherwise(frame)
    parts = F.regexp_extract_all(body, F.lit(r"\( ?(\([^()]*\)(?: ?, ?\([^()]*\))*+) ?\)"), F.lit(1))
    read = lambda p: F.transform(F.array(F.split(F.trim(p), " ")), lambda c: F.struct(F.get(c, 0).try_cast("double").alias("x"), F.get(c, 1).try_cast("double").alias("y")))[0]
    rings = F.transform(parts, lambda part: F.transform(F.regexp_extract_all(part, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda r: F.transform(F.split(r, ","), read)))
    found = _parsed(F.when(frame == "M", rings))
    empty = F.rlike(given, F.lit(r"^(?i)(MULTI)?POLYGON ?(Z|M|ZM)? ?EMPTY$"))
    return F.when(empty, F.struct(F.lit(None).cast(SHAPE).alias("shape"), F.lit("empty").alias("error"))).otherwise(found)


def shape_from_geojson(kind: Column, coordinates: Column) -> Column:
    """``shape, error`` of a GeoJSON geometry's type and the text of its coordinates."""
    rings = "array<array<array<double>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(coordinates, rings))).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{rings}>"))
    shape = F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))))
    whole = F.coalesce(~F.exists(parts, lambda part: part.isNull() | (F.size(part) == 0)), F.lit(False)) & (F.size(parts) > 0)
    return _parsed(F.when(whole, shape))


def shape_to_wkt(shape: Column) -> Column:
    ring_text = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", number(p.x), number(p.y))), ", "), F.lit(")"))
    part_text = lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, ring_text), ", "), F.lit(")"))
    parts = F.transform(shape, part_text)
    return F.when(F.size(shape) == 1, F.concat(F.lit("POLYGON "), parts[0])).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")")))


def shape_area(shape: Column) -> Column:
    """Area of the parts less that of their holes, however the rings run."""
    part_area = lambda part: F.aggregate(F.transform(part, lambda r: F.abs(signed_area(r))), F.lit(0.0), lambda s, a: s - a) + 2 * F.abs(signed_area(part[0]))
    return F.aggregate(F.transform(shape, part_area), F.lit(0.0), lambda s, a: s + a)


def is_nested(df: DataFrame, column: str) -> bool:
    """Whether a column holds shapes and not single rings."""
    return isinstance(df.schema[column].dataType.elementType, ArrayType)


def is_shape(df: DataFrame, column: str) -> Column:
    """Whether all rings of a row's shape have at least four points."""
    c = F.col(column)
    return (F.size(c) > 0) & ~F.exists(F.flatten(c), lambda r: F.size(r) < 4) if is_nested(df, column) else F.size(c) > 3


def edges_of(df: DataFrame, column: str) -> Column:
    """Edges of all rings of a ring or shape column."""
    return F.flatten(F.transform(F.flatten(F.col(column)), edges)) if is_nested(df, column) else edges(F.col(column))


def corners_of(df: DataFrame, column: str) -> Column:
    """One corner of each ring of a ring or shape column."""
    return F.transform(F.flatten(F.col(column)), lambda r: r[0]) if is_nested(df, column) else F.array(F.col(column)[0])


def bounds_of(df: DataFrame, column: str) -> Column:
    return bounds(F.flatten(F.flatten(F.col(column))) if is_nested(df, column) else F.col(column))


def _turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _on(e: Column, x: Column, y: Column) -> Column:
    return x.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx)) & y.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by))


def edges_meet(e: Column, f: Column) -> Column:
    """Closed intersection of two segments; most pairs are settled by their boxes."""
    low, high = F.least, F.greatest
    apart = (low(e.ax, e.bx) > high(f.ax, f.bx)) | (low(f.ax, f.bx) > high(e.ax, e.bx)) | (low(e.ay, e.by) > high(f.ay, f.by)) | (low(f.ay, f.by) > high(e.ay, e.by))
    a, b = _turn(f.ax, f.ay, f.bx, f.by, e.ax, e.ay), _turn(f.ax, f.ay, f.bx, f.by, e.bx, e.by)
    c, d = _turn(e.ax, e.ay, e.bx, e.by, f.ax, f.ay), _turn(e.ax, e.ay, e.bx, e.by, f.bx, f.by)
    meet = ((a * b < 0) & (c * d < 0)) | ((a == 0) & _on(f, e.ax, e.ay)) | ((b == 0) & _on(f, e.bx, e.by)) | ((c == 0) & _on(e, f.ax, f.ay)) | ((d == 0) & _on(e, f.bx, f.by))
    return F.when(apart, F.lit(False)).otherwise(meet)


def holds_point(sides: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over edges; points on the boundary are not decided by it."""

    def crosses(e: Column) -> Column:
        spans = (e.ay > y) != (e.by > y)
        return F.when(spans, x < (e.bx - e.ax) * (y - e.ay) / F.nullif(e.by - e.ay, F.lit(0.0)) + e.ax).otherwise(False)

    return F.aggregate(sides, F.lit(False), lambda inside, e: inside != crosses(e))


def convex_four(df: DataFrame, sides: str, flag: str, corners: list[tuple[str, str]]) -> DataFrame:
    """``df`` with ``flag``, whether a shape is strictly convex and has four edges, and its ``corners``, counter-clockwise; numbers
    without meaning for other shapes, but never null, which keeps expressions over them short."""
    at = [[F.coalesce(F.get(F.col(sides), i)[c], F.lit(0.0)).alias(f"_{c}{i}") for c in ("ax", "ay")] for i in range(4)]
    given = df.select("*", *(c for pair in at for c in pair))
    x, y = [F.col(f"_ax{i}") for i in range(4)], [F.col(f"_ay{i}") for i in range(4)]
    turn = lambda i, j, k: (x[j] - x[i]) * (y[k] - y[j]) - (y[j] - y[i]) * (x[k] - x[j])
    turned = given.select("*", *(turn(i, (i + 1) % 4, (i + 2) % 4).alias(f"_t{i}") for i in range(4)))
    same = lambda sign: (F.least(*(F.col(f"_t{i}") * sign for i in range(4))) > 0)
    order = lambda c, i: F.when(F.col("_t0") < 0, F.col(f"_a{c}{(4 - i) % 4}")).otherwise(F.col(f"_a{c}{i}"))
    named = [order(c, i).alias(n) for i, pair in enumerate(corners) for c, n in zip("xy", pair, strict=True)]
    return turned.select(*df.columns, (F.coalesce(F.size(sides) == 4, F.lit(False)) & (same(1) | same(-1))).alias(flag), *named)


def box_cover(sides: Column, most: int, longest: int = 64) -> Column:
    """``boxes`` that lie within a shape by the even-odd rule, the largest ``most``, and ``whole``: whether they are all of it. One
    for each two neighbouring edges that cross the height between two corners; null for shapes of more than ``longest`` edges.
    """
    low, high = lambda e: F.least(e.ax, e.bx), lambda e: F.greatest(e.ax, e.bx)
    spans = lambda a, b: F.filter(sides, lambda e: (F.least(e.ay, e.by) <= a) & (F.greatest(e.ay, e.by) >= b))

    def between(v: Column) -> Column:
        """Boxes of a height, and whether they are all that lies in it."""
        ends = F.array_sort(F.transform(v.spans, lambda e: F.struct(low(e).alias("low"), high(e).alias("high"))))
        pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w.ends) - 2), lambda i: F.struct(w.ends[i]["high"].alias("xmin"), v.a.alias("ymin"), w.ends[i + 1]["low"].alias("xmax"), v.b.alias("ymax")))
        free = lambda w, p: (p.xmin < p.xmax) & F.forall(w.ends, lambda f: (f.high <= p.xmin) | (f.low >= p.xmax)) & (F.size(F.filter(w.ends, lambda f: f.high <= p.xmin)) % 2 == 1)
        kept = lambda w: F.when(F.size(w.ends) > 1, F.filter(pairs(w), lambda p: free(w, p))).otherwise(F.filter(F.array(F.struct(v.a.alias("xmin"), v.a.alias("ymin"), v.a.alias("xmax"), v.b.alias("ymax"))), lambda p: F.lit(False)))
        return let(lambda w: let(lambda x: F.struct(x.boxes.alias("boxes"), ((F.size(x.boxes) * 2 == F.size(w.ends)) & ~F.exists(w.ends, lambda f: f.low < f.high)).alias("all")), boxes=kept(w)), ends=ends)

    def cover(v: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(v.ys) - 2), lambda i: let(between, a=v.ys[i], b=v.ys[i + 1], spans=spans(v.ys[i], v.ys[i + 1])))
        return let(lambda w: let(lambda x: chosen(w, x), boxes=F.flatten(F.transform(w.found, lambda f: f.boxes))), found=found)

    def chosen(w: Column, x: Column) -> Column:
        on_box = lambda e: F.exists(x.boxes, lambda b: (b.xmin <= low(e)) & (high(e) <= b.xmax) & (b.ymin <= e.ay) & (e.ay <= b.ymax))
        area = lambda b: (b.xmax - b.xmin) * (b.ymax - b.ymin)
        largest = F.transform(F.reverse(F.array_sort(F.transform(x.boxes, lambda b: F.struct(area(b).alias("area"), b.alias("box"))))), lambda b: b.box)
        whole = ~F.exists(w.found, lambda f: ~f["all"]) & (F.size(x.boxes) <= most) & F.forall(F.filter(sides, lambda e: e.ay == e.by), on_box)
        return F.struct(F.slice(largest, 1, most).alias("boxes"), whole.alias("whole"))

    ys = F.array_sort(F.array_distinct(F.flatten(F.transform(sides, lambda e: F.array(e.ay, e.by)))))
    return F.when(F.size(sides) <= longest, let(lambda v: F.when(F.size(v.ys) > 1, cover(v)), ys=ys))


def polygons_meet(e: Column, f: Column) -> Column:
    """Closed intersection of two polygons given by their edges: an edge pair meets or one holds a corner of the other.
    The corners come first: they are cheaper and settle most pairs that meet."""
    inside = holds_point(f, e[0].ax, e[0].ay) | holds_point(e, f[0].ax, f[0].ay)
    return F.when(inside, F.lit(True)).otherwise(F.exists(e, lambda x: F.exists(f, lambda y: edges_meet(x, y))))


def shapes_meet(e: Column, e_corners: Column, f: Column, f_corners: Column) -> Column:
    """As ``polygons_meet`` for shapes of several rings, with one corner of each: where no edges meet, a ring lies wholly within
    the other shape or wholly outside."""
    inside = F.exists(e_corners, lambda p: holds_point(f, p.x, p.y)) | F.exists(f_corners, lambda p: holds_point(e, p.x, p.y))
    return F.when(inside, F.lit(True)).otherwise(F.exists(e, lambda x: F.exists(f, lambda y: edges_meet(x, y))))
