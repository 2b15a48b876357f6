"""Raster windows, masks and grid cubes on tables of blocks and cells.

A raster is a row of its header and a row for each square block of cells and band: ``raster_id, band, block_row, block_col,
values`` with the values row by row. Blocks at the right and lower rim are as small as the raster leaves them.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from skylattice.functions import geometry as G
from skylattice.functions import projections as P

from .spatial import by_shuffle, spatial_join

HEADER = ("origin_x", "origin_y", "px", "py", "width", "height")
#: Rasters of one system that an area is moved for at once.
TOGETHER = 64


def window_of(header: Column, box: Column) -> Column:
    """Smallest window of whole pixels that covers ``box``, clipped to the raster: first and last row and column (ends
    excluded), new origin, and ``status`` (``no_overlap`` if nothing is left). Rows run down from the top left origin."""
    col0, col1 = F.floor((box.xmin - header.origin_x) / header.px), F.ceil((box.xmax - header.origin_x) / header.px)
    row0, row1 = F.floor((header.origin_y - box.ymax) / header.py), F.ceil((header.origin_y - box.ymin) / header.py)
    clip = lambda v, most: F.greatest(F.lit(0).cast("long"), F.least(v, most.cast("long")))
    a, b, c, d = clip(col0, header.width), clip(col1, header.width), clip(row0, header.height), clip(row1, header.height)
    status = F.when((a < b) & (c < d), "ok").otherwise("no_overlap")
    return F.struct(a.alias("col0"), b.alias("col1"), c.alias("row0"), d.alias("row1"), (header.origin_x + a * header.px).alias("new_x"), (header.origin_y - c * header.py).alias("new_y"), status.alias("status"))


def to_blocks(cells: DataFrame, block: int = 256) -> DataFrame:
    """Blocks of a table of cells ``raster_id, band, row, col, value``, which must hold each cell of a block once."""
    keys = [F.col("raster_id"), F.col("band"), F.expr(f"row div {block}").cast("int").alias("block_row"), F.expr(f"col div {block}").cast("int").alias("block_col")]
    ordered = F.sort_array(F.collect_list(F.struct("row", "col", "value")))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c["value"]).alias("values"))


def frames(headers: DataFrame, pieces: int = 16, srids: Collection[int] | None = None) -> DataFrame:
    """``raster_id`` and the box of each raster as a ``ring`` of longitudes and latitudes. The rim is followed in ``pieces`` a
    side through the inverse projection, with as much to spare. Headers without ``srid``, or of one that is not known, count
    as being in the areas' system."""
    x, y = F.col("origin_x"), F.col("origin_y")
    x1, y0 = x + F.col("px") * F.col("width"), y - F.col("py") * F.col("height")
    rim = G.ring((x, y0), (x1, y0), (x1, y), (x, y), (x, y0))
    if "srid" not in headers.columns:
        return headers.select("raster_id", rim.alias("ring"))
    rims = headers.select("raster_id", "srid", rim.alias("rim"), (F.col("srid") != 4326).alias("far"))
    moved = G.hold(G.hold(rims, moved=P.unproject(F.col("rim"), F.col("srid"), pieces, srids)), b=G.bounds(F.col("moved")))
    dx, dy, b = F.when(F.col("far"), (F.col("b.xmax") - F.col("b.xmin")) / pieces).otherwise(0.0), F.when(F.col("far"), (F.col("b.ymax") - F.col("b.ymin")) / pieces).otherwise(0.0), F.col("b")
    box = G.ring((b.xmin - dx, b.ymin - dy), (b.xmax + dx, b.ymin - dy), (b.xmax + dx, b.ymax + dy), (b.xmin - dx, b.ymax + dy), (b.xmin - dx, b.ymin - dy))
    return moved.select("raster_id", F.when(F.col("moved").isNull(), F.col("rim")).otherwise(box).alias("ring"))


def _groups(met: DataFrame) -> DataFrame:
    """``aoi_id, _rasters`` of pairs of an area and a header: the headers that an area meets, by system and ``TOGETHER`` a row at
    most, so that an area is moved to a system once for many rasters and a row stays small for an area that meets all."""
    by = ["aoi_id"] + (["srid"] if "srid" in met.columns else [])
    at = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("raster_id")) - 1) / TOGETHER)
    numbered = met.repartition("aoi_id").withColumn("_at", at)
    return numbered.groupBy(*by, "_at").agg(F.collect_list(F.struct("raster_id", *HEADER)).alias("_rasters"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to a fixed number of tasks: short ones with much work behind each, which would be put together in few
    tasks by their bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _turns() -> Column:
    """``row, col`` of each place where one of ``_edges`` crosses the middle of a row from ``_row0`` to ``_row1``, within the
    window; ``col`` is the first column whose centre is not left of it. Which rows and columns are near follows from the
    distances, which of them it is from the centres, so the work grows with the crossings and not with the cells."""
    y_of, x_of = lambda row: F.col("origin_y") - (row + 0.5) * F.col("py"), lambda col: F.col("origin_x") + (col + 0.5) * F.col("px")
    row = lambda at: F.greatest(F.col("_row0"), F.least(F.col("_row1") - 1, F.floor(at)))

    def crossed(e: Column) -> Column:
        # No number counts as above all others, as it does in comparisons.
        near = F.sequence(row(F.nanvl((F.col("origin_y") - F.greatest(e.ay, e.by)) / F.col("py") - 0.5, F.lit(float("-inf")))), row((F.col("origin_y") - F.least(e.ay, e.by)) / F.col("py") + 0.5))
        spans = F.filter(F.transform(near, lambda r: F.struct(r.alias("row"), y_of(r).alias("y"))), lambda t: (e.ay > t.y) != (e.by > t.y))
        x = lambda y: (e.bx - e.ax) * (y - e.ay) / F.nullif(e.by - e.ay, F.lit(0.0)) + e.ax
        return F.transform(spans, lambda t: F.struct(t.row.alias("row"), x(t.y).alias("x")))

    about = lambda x: F.floor(F.greatest(F.col("col0") - 1.0, F.least(F.col("col1") + 0.0, (x - F.col("origin_x")) / F.col("px") - 0.5)))
    after = lambda x, c: c + F.when(x_of(c) < x, 1).otherwise(0) + F.when(x_of(c + 1) < x, 1).otherwise(0)
    near = F.transform(F.flatten(F.transform(F.filter("_edges", lambda e: e.ay != e.by), crossed)), lambda t: F.struct(t.row.alias("row"), t.x.alias("x"), about(t.x).alias("c")))
    return F.transform(near, lambda t: F.struct(t.row.alias("row"), F.greatest(F.col("col0"), F.least(F.col("col1"), after(t.x, t.c))).alias("col")))


def _paired(turns: Column) -> Column:
    """The turns of rings that may be open: what crosses a row an odd number of times leaves its start inside."""
    odd = lambda r: F.size(F.filter(turns, lambda t: t.row == r)) % 2 == 1
    starts = F.transform(F.filter(F.sequence("_row0", F.col("_row1") - 1), odd), lambda r: F.struct(r.alias("row"), F.col("col0").alias("col")))
    return F.concat(turns, starts)


def crop_blocks(blocks: DataFrame, headers: DataFrame, areas: DataFrame, *, block: int = 256, nodata: int | float = 0, ring: str = "ring", pieces: int = 16, levels: list[int] | None = None, srids: Collection[int] | None = None) -> DataFrame:
    """Blocks of each raster cut to the window of each area (``aoi_id, ring``, a ring or shape) that it overlaps, all bands:
    ``aoi_id, raster_id, band, block_row, block_col, row0, row1, col0, col1`` (the part within the window, ends excluded), its
    ``values`` with ``nodata`` where a cell's centre is outside, ``mask``, ``class`` and ``status``.

    Areas go to a raster's own system by ``srid``, their edges cut into ``pieces``; where that is not known they stay as they are
    (``status`` ``as_is``). Which systems there are is asked first, one distinct over the headers, unless ``srids`` tells. Rasters and
    areas meet by their boxes in longitude and latitude; pairs without a cell inside come where their boxes meet in both systems.
    An area is moved once for many rasters of a system (``_groups``), by a fixed number of tasks (``dealt``). A pair's window is laid
    out in rows of blocks, each with the area's edges at its height and the cells at which they cross its rows; a block that no edge
    touches is ``inside`` or ``outside`` as a whole (decided at one cell, values kept or blanked as a whole), ``edge`` blocks consist of
    runs of cells between crossings. Blocks are looked up by raster, row and column, so a raster of any size is dealt over many tasks,
    again by a fixed number of them.
    """
    known = "srid" in headers.columns
    if known and srids is None:
        srids = [x.srid for x in headers.select("srid").distinct().collect()]
    met = spatial_join(frames(headers, pieces, srids), areas.select("aoi_id", F.col(ring).alias("ring")), exact=False, levels=levels)
    groups = _groups(met.join(by_shuffle(headers.select("raster_id", *HEADER, *(["srid"] if known else []))), "raster_id"))
    rings = F.flatten(F.col(ring)) if G.is_nested(areas, ring) else F.array(F.col(ring))
    groups = dealt(groups.join(by_shuffle(areas.select("aoi_id", rings.alias("_given"))), "aoi_id"), "aoi_id", *(["srid"] if known else []), "_at")
    if known:
        groups = G.hold(groups, _moved=F.when(P.is_known(F.col("srid")), F.transform("_given", lambda r: P.reproject(r, F.col("srid"), pieces, srids))))
        groups = G.hold(groups, _rings=F.coalesce("_moved", "_given"), status=F.when(F.col("_moved").isNull(), "as_is").otherwise("reprojected"))
    else:
        groups = groups.withColumns({"_rings": F.col("_given"), "status": F.lit("same")})
    groups = G.hold(groups, _box=G.bounds(F.flatten("_rings")), _edges=F.flatten(F.transform("_rings", G.edges)))
    pairs = G.hold(groups, _open=F.coalesce(F.exists("_rings", lambda r: r[0] != F.element_at(r, -1)), F.lit(True))).select("aoi_id", "status", "_box", "_edges", "_open", F.inline("_rasters"))
    pairs = G.hold(pairs, w=window_of(F.struct(*HEADER), F.col("_box"))).where("w.status = 'ok'")

    part = lambda low, high, at: (F.greatest(F.col(low), F.col(at) * block).alias(f"_{low}"), F.least(F.col(high), (F.col(at) + 1) * block).alias(f"_{high}"))
    last = lambda high: F.expr(f"({high} - 1) div {block}")
    y_of, x_of = lambda row: F.col("origin_y") - (row + 0.5) * F.col("py"), lambda col: F.col("origin_x") + (col + 0.5) * F.col("px")
    rows = pairs.select("aoi_id", "raster_id", *HEADER, "status", "w.row0", "w.row1", "w.col0", "w.col1", "_edges", "_open", F.explode(F.sequence(F.expr(f"w.row0 div {block}"), last("w.row1"))).alias("block_row"))
    rows = rows.select("*", *part("row0", "row1", "block_row"))
    high, low = y_of(F.col("_row0")), y_of(F.col("_row1") - 1)
    rows = G.hold(rows.withColumnRenamed("_edges", "_all"), _edges=F.filter("_all", lambda e: (F.least(e.ay, e.by) <= high) & (F.greatest(e.ay, e.by) >= low))).drop("_all")
    rows = G.hold(rows, _turns=G.let(lambda v: F.when(F.col("_open"), _paired(v.turns)).otherwise(v.turns), turns=_turns()))
    laid = rows.select("*", F.explode(F.sequence(F.expr(f"col0 div {block}"), last("col1"))).alias("block_col")).select("*", *part("col0", "col1", "block_col"))
    left, right = x_of(F.col("_col0")), x_of(F.col("_col1") - 1)
    touched = F.exists("_edges", lambda e: (F.least(e.ax, e.bx) <= right) & (F.greatest(e.ax, e.bx) >= left))
    inside = F.size(F.filter("_turns", lambda t: (t.row == F.col("_row0")) & (t.col > F.col("_col0")))) % 2 == 1
    across, size = F.col("_col1") - F.col("_col0"), (F.col("_row1") - F.col("_row0")) * (F.col("_col1") - F.col("_col0"))
    # Cells of a part, counted row by row, where it changes from outside to inside and back.
    changes = F.sort_array(F.transform("_turns", lambda t: (t.row - F.col("_row0")) * across + F.greatest(F.col("_col0"), F.least(F.col("_col1"), t.col)) - F.col("_col0")))
    laid = G.hold(laid, **{"class": F.when(touched, "edge").when(inside, "inside").otherwise("outside")})
    plain = lambda c: F.col(f"_{c}").cast("int").alias(c)
    ends = F.when(F.col("class") == "edge", F.concat(F.array(F.lit(0)), changes, F.array(size)))
    laid = laid.select("aoi_id", "raster_id", "status", F.col("block_row").cast("int").alias("block_row"), F.col("block_col").cast("int").alias("block_col"), *map(plain, ("row0", "row1", "col0", "col1")), "width", "class", ends.cast("array<int>").alias("_ends"))

    # Mask and values of edge blocks are put together from runs of cells that are all outside or all inside, and not cell by cell.
    at = ["raster_id", "block_row", "block_col"]
    joined = dealt(laid, *at).join(by_shuffle(blocks), at)
    wide, across = F.least(F.lit(block), F.col("width") - F.col("block_col") * block), F.col("col1") - F.col("col0")
    size = ((F.col("row1") - F.col("row0")) * across).cast("int")
    rows = F.flatten(F.transform(F.sequence("row0", F.col("row1") - 1), lambda r: F.slice("values", ((r - F.col("block_row") * block) * wide + F.col("col0") - F.col("block_col") * block + 1).cast("int"), across)))
    # Rows of a part as wide as the block follow each other.
    own = F.when(across == wide, F.slice("values", ((F.col("row0") - F.col("block_row") * block) * wide + 1).cast("int"), size)).otherwise(rows)
    joined = G.hold(joined, _own=F.when(F.col("class") != "outside", own))
    length = lambda i: F.col("_ends")[i + 1] - F.col("_ends")[i]
    runs = lambda f: F.flatten(F.transform(F.sequence(F.lit(0), F.size("_ends") - 2), f))
    blank = F.lit(nodata).cast(joined.schema["values"].dataType.elementType.simpleString())
    kept = runs(lambda i: F.when(i % 2 == 1, F.slice("_own", F.col("_ends")[i] + 1, length(i))).otherwise(F.array_repeat(blank, length(i))))
    kept = F.when(F.col("class") == "edge", kept).when(F.col("class") == "inside", F.col("_own")).otherwise(F.array_repeat(blank, size))
    mask = F.when(F.col("class") == "edge", runs(lambda i: F.array_repeat(i % 2 == 1, length(i)))).otherwise(F.array_repeat(F.col("class") == "inside", size))
    return joined.select("aoi_id", "raster_id", "band", "block_row", "block_col", "row0", "row1", "col0", "col1", kept.alias("values"), mask.alias("mask"), "class", "status")


def cells_of(cropped: DataFrame) -> DataFrame:
    """``aoi_id, raster_id, band, row, col, value, inside`` of cropped blocks, a row a cell."""
    across = F.col("col1") - F.col("col0")
    flat = cropped.select("aoi_id", "raster_id", "band", "row0", "col0", across.alias("n"), F.posexplode(F.arrays_zip(F.col("values").alias("value"), F.col("mask").alias("inside"))).alias("at", "c"))
    return flat.select("aoi_id", "raster_id", "band", (F.col("row0") + F.expr("at div n")).cast("int").alias("row"), (F.col("col0") + F.expr("at % n")).cast("int").alias("col"), "c.value", "c.inside")


def mask_cells(cells: DataFrame, headers: DataFrame, areas: DataFrame, *, nodata: int = 0, block: int = 256) -> DataFrame:
    """``crop_blocks`` for a table of cells, with a row a cell: cells within the window of each area their raster overlaps, those
    outside the area ``nodata``. Cells without ``band`` are of one band, 1."""
    banded = cells if "band" in cells.columns else cells.withColumn("band", F.lit(1))
    return cells_of(crop_blocks(to_blocks(banded, block), headers, areas, block=block, nodata=nodata))


def flatten_cube(cubes: DataFrame, axes: tuple[str, str, str] = ("time", "lat", "lon"), values: str | tuple[str, ...] = "values") -> DataFrame:
    """One row a cell of each cube: the axes' values and each variable at ``(t * n_lat + i) * n_lon + j``, under its own name if
    ``values`` is a tuple and as ``value`` if it is one name. Axis by axis, each with its slices of the values, so that no row
    bears more than its own slice."""
    t, y, x = axes
    names = {values: "value"} if isinstance(values, str) else {v: v for v in values}
    rest = [F.col(c) for c in cubes.columns if c not in (t, y, x, *names)]

    def slices(axis: str, size: Column) -> Column:
        part = lambda v: F.transform(F.sequence(F.lit(0), F.size(axis) - 1), lambda i: F.slice(v, i * size + 1, size)).alias(v)
        return F.inline(F.arrays_zip(F.col(axis).alias(f"{axis}_value"), *map(part, names)))

    some = cubes.where((F.size(t) > 0) & (F.size(y) > 0) & (F.size(x) > 0))
    planes = some.select(*rest, y, x, slices(t, F.size(y) * F.size(x)))
    rows = planes.select(*rest, f"{t}_value", x, slices(y, F.size(x)))
    return rows.select(*rest, f"{t}_value", f"{y}_value", F.inline(F.arrays_zip(F.col(x).alias(f"{x}_value"), *(F.col(v).alias(out) for v, out in names.items()))))


def to_chunks(cubes: DataFrame, variables: tuple[str, ...], shape: tuple[int, int, int], axes: tuple[str, str, str] = ("time", "lat", "lon")) -> DataFrame:
    """Cubes cut into chunks of ``shape``: each has its first index on every axis (``<axis>0``), its part of the axes with their
    least and greatest value (``<axis>_min``, ``<axis>_max``) and its part of each variable. A table of chunks is what a cube of
    any size is kept as; cubes that come as one row a file are cut right after they are read."""
    t, y, x = axes
    rest = [c for c in cubes.columns if c not in (*axes, *variables)]
    out = cubes.where((F.size(t) > 0) & (F.size(y) > 0) & (F.size(x) > 0)).withColumns({"_ny": F.size(y), "_nx": F.size(x)})
    for axis, size in zip(axes, shape, strict=True):
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.size(axis) - 1, F.lit(size))).alias(f"{axis}0"))
    out = G.hold(out, **{f"_{axis}": F.slice(axis, F.col(f"{axis}0") + 1, size) for axis, size in zip(axes, shape, strict=True)})
    own = {axis: F.col(f"_{axis}") for axis in axes}
    span = lambda axis: F.sequence(F.col(f"{axis}0"), F.col(f"{axis}0") + F.size(own[axis]) - 1)
    at = lambda i, j: ((i * F.col("_ny") + j) * F.col("_nx") + F.col(f"{x}0") + 1).cast("int")
    part = lambda v: F.flatten(F.transform(span(t), lambda i: F.flatten(F.transform(span(y), lambda j: F.slice(v, at(i, j), F.size(own[x]))))))
    limits = [f(own[axis]).alias(f"{axis}_{name}") for axis in axes for f, name in ((F.array_min, "min"), (F.array_max, "max"))]
    return out.select(*rest, *(f"{a}0" for a in axes), *(own[a].alias(a) for a in axes), *limits, *(part(v).alias(v) for v in variables))


def subset_chunks(chunks: DataFrame, variables: tuple[str, ...], axes: tuple[str, str, str] = ("time", "lat", "lon"), **ranges: tuple) -> DataFrame:
    """Cells of the chunks within the closed ``ranges`` of the axes named, a row a cell and a column a variable. Chunks are chosen
    by plain comparisons, which reach the scan of a stored table; only variables asked for are read, only chunks that are
    touched are flattened."""
    touched, within = F.lit(True), F.lit(True)
    for axis, (low, high) in ranges.items():
        touched &= (F.col(f"{axis}_max") >= low) & (F.col(f"{axis}_min") <= high)
        within &= F.col(f"{axis}_value").between(low, high)
    inner = {f"{a}0" for a in axes} | {f"{a}_{m}" for a in axes for m in ("min", "max")}
    rest = [c for c in chunks.columns if c not in inner and c not in axes and not c.startswith("_")]
    other = [c for c in rest if c not in variables and not isinstance(chunks.schema[c].dataType, ArrayType)]
    return flatten_cube(chunks.where(touched).select(*other, *axes, *variables), axes, variables).where(within)
