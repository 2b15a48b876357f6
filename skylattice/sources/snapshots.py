"""Versions of a table of shapes, each a list of files with what they hold, swapped in by one rename.

``data/<id>/`` has the files of one write, ``files/<id>/`` the list of a version (a Parquet table with a row for each file: its
keys, rows, box and span of time), ``versions/<number>.json`` names the list. A version is there as a whole or not at all, files
are never changed, and a reader keeps to the version it began with. The rename must not replace a file that is there (HDFS and
local folders keep to that); of two writers one then builds its version anew on the other's.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skylattice.functions import geometry as G
from skylattice.operators.spatial import own_level, spatial_join

BOX = ("xmin", "ymin", "xmax", "ymax")


@dataclass(frozen=True)
class Version:
    number: int
    files: str
    schema: str
    token: str | None
    levels: list[int]


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All versions, oldest first."""
    where, store = _hadoop(spark, f"{path}/versions")
    if not store.exists(where):
        return []
    names = [x.getPath().getName() for x in store.listStatus(where)]
    rows = [f"{path}/versions/{n}" for n in names if n.endswith(".json") and not n.startswith(".")]
    if not rows:
        return []
    read = spark.read.schema("number long, files string, schema string, token string, levels array<int>").json(rows).collect()
    return sorted((Version(r.number, r.files, r.schema, r.token, list(r.levels)) for r in read), key=lambda v: v.number)


def _commit(spark: SparkSession, path: str, version: Version) -> bool:
    """Whether this became version ``number``; it did not if there is one already."""
    jvm = spark.sparkContext._jvm
    waiting, store = _hadoop(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = store.create(waiting)
    out.write(bytearray(json.dumps(version.__dict__).encode()))
    out.close()
    to, _ = _hadoop(spark, f"{path}/versions/{version.number:010d}.json")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(waiting, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        store.delete(waiting, False)
        if store.exists(to):
            return False
        raise error
    return True


def curve(x: Column, y: Column, extent: tuple[float, float, float, float], bits: int = 16) -> Column:
    """Place of a point along a Z-shaped curve over ``extent``: points close on the curve are close on the map."""
    low_x, low_y, high_x, high_y = extent
    whole = (1 << bits) - 1
    cell = lambda v, low, high: F.greatest(F.lit(0), F.least(F.lit(whole), F.floor((v - low) / (high - low) * whole))).cast("long")
    a, b, out = cell(x, low_x, high_x), cell(y, low_y, high_y), F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(a.bitwiseAND(1 << i), i)).bitwiseOR(F.shiftleft(b.bitwiseAND(1 << i), i + 1))
    return out


def write(df: DataFrame, path: str, *, keys: tuple[str, ...] = (), replace: bool = False, token: str | None = None, ring: str = "ring", ts: str = "start_ts", files: int | None = None, extent: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> Version:
    """A new version with the rows of ``df`` beside those that are there: those of the same ``keys`` go if ``replace``, all of them
    without keys.

    A write that bears the ``token`` of an earlier version changes nothing and gives that version, so it can be run again
    whether or not it had come through. Rows lie along a curve over the map within each key, in ``files`` ranges (the session's
    shuffle partitions if None), which keeps each file's box small; rows without a shape come first. The columns ``xmin`` to
    ``ymax`` are added. The list of files is made from these and ``ts`` alone, by a scan of the new files.
    """
    spark = df.sparkSession
    held = versions(spark, path)
    if token is not None and (same := [v for v in held if v.token == token]):
        return same[-1]
    box = G.bounds_of(df, ring)
    rows = G.hold(df, _box=box).select("*", *(F.col(f"_box.{c}").alias(c) for c in BOX)).drop("_box")
    rows = rows.withColumn("_curve", curve((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, extent))
    order = [*keys, "_curve"]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).drop("_curve")
    schema = dealt.schema
    folder = f"{path}/data/{uuid.uuid4().hex}"
    dealt.withColumns({f"_key_{k}": F.col(k) for k in keys}).write.partitionBy(*(f"_key_{k}" for k in keys)).parquet(folder)
    new = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    bounds = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    level = own_level(F.struct(*BOX))
    listed = new.select("*", F.col("_metadata.file_path").alias("file")).groupBy("file", *keys).agg(F.count("*").alias("rows"), *bounds, F.collect_set(level).alias("levels"))
    own = f"{path}/files/{uuid.uuid4().hex}"
    listed.write.parquet(own)
    mine = spark.read.parquet(own)
    levels = [r[0] for r in mine.select(F.explode("levels")).distinct().collect()]
    while True:
        last = held[-1] if held else None
        kept = None
        if last is not None and (keys or not replace):
            kept = spark.read.parquet(f"{path}/files/{last.files}")
            if replace:
                kept = kept.join(mine.select(*keys).distinct(), [F.lit(True) & kept[k].eqNullSafe(mine[k]) for k in keys], "left_anti")
        name = own.rsplit("/", 1)[1]
        if kept is not None:
            name = uuid.uuid4().hex
            kept.unionByName(mine).write.parquet(f"{path}/files/{name}")
        version = Version(last.number + 1 if last else 1, name, schema.json(), token, sorted({*levels, *(last.levels if last else [])}))
        if _commit(spark, path, version):
            return version
        held = versions(spark, path)


def listing(spark: SparkSession, path: str, version: int | None = None) -> tuple[Version, DataFrame]:
    """A version, the newest if None, and its list of files."""
    held = versions(spark, path)
    found = [v for v in held if version in (None, v.number)]
    if not found:
        raise ValueError(f"{path} has no version {'' if version is None else version}")
    return found[-1], spark.read.parquet(f"{path}/files/{found[-1].files}")


def read(spark: SparkSession, path: str, version: int | None = None, *, areas: DataFrame | None = None, ring: str = "ring", first: str | None = None, last: str | None = None, keys: dict[str, list] | None = None) -> DataFrame:
    """Rows of a version, from the files alone whose box meets that of one of ``areas``, whose times reach into ``first`` to
    ``last`` and whose keys are among those given. All rows of such a file come, so filters and joins have still to be made.
    The names of the files that are left come to the driver."""
    found, entries = listing(spark, path, version)
    for key, values in (keys or {}).items():
        entries = entries.where(F.col(key).isin(values))
    if first is not None:
        entries = entries.where(F.col("last_ts") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        entries = entries.where(F.col("first_ts") <= F.lit(last).cast("timestamp_ntz"))
    if areas is not None:
        x0, y0, x1, y1 = map(F.col, BOX)
        boxes = entries.where("xmin is not null").select("file", G.ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)).alias("ring"))
        entries = spatial_join(boxes, areas.select(F.col(ring).alias("ring")), exact=False).select("file").distinct()
    names = sorted(r.file for r in entries.select("file").collect())
    schema = StructType.fromJson(json.loads(found.schema))
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the last ``keep`` versions and delete the files that only those named; gives how many."""
    held = versions(spark, path)
    old, new = held[:-keep], held[-keep:]
    if not old:
        return 0
    names = lambda some: spark.read.parquet(*(f"{path}/files/{v.files}" for v in some)).select("file").distinct()
    gone = [r.file for r in names(old).join(names(new), "file", "left_anti").collect()]
    for file in [*(f"{path}/versions/{v.number:010d}.json" for v in old), *gone]:
        where, store = _hadoop(spark, file)
        store.delete(where, False)
    return len(gone)
