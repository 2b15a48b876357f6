"""Readers with declared schemas for catalogue answers, areas, logs and product files, and writers for results."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import geometry as G

PRODUCT_PAGE = "value array<struct<Id:string,Name:string,Collection:struct<Name:string>,ContentLength:long,Footprint:string,ContentDate:struct<Start:timestamp_ntz,End:timestamp_ntz>,Attributes:array<struct<Name:string,Value:string>>>>"
SCENE_PAGE = "totalHits long, recordsReturned long, results array<struct<entityId:string,displayId:string,options:struct<bulk:boolean>,metadata:array<struct<fieldName:string,value:string>>>>"
GRANULE_FEED = "feed struct<entry:array<struct<id:string,links:array<struct<href:string,rel:string>>>>>"
OPTION = "available boolean, entityId string, id string, productName string"
FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in a local session without one, a folder of our own. On a cluster it must be
    set: executors do not share the driver's local folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found and "SKYLATTICE_LOCAL_CHECKPOINTS" not in os.environ:
        os.environ["SKYLATTICE_LOCAL_CHECKPOINTS"] = tempfile.mkdtemp(prefix="spark-")
    return (found or os.environ["SKYLATTICE_LOCAL_CHECKPOINTS"]).rstrip("/")


#: Scratch folders that were named and not dropped yet.
_named: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder of our own under the shared one; nothing is there yet."""
    _named.append(f"{shared_folder(spark)}/skylattice/{label}-{uuid.uuid4().hex}")
    return _named[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch folders named so far, for callers whose results are written: lazy ones may still read them. What is
    written under such a name with a suffix goes too."""
    for path in _named:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in store.globStatus(where.suffix("*")) or []:
            store.delete(found.getPath(), True)
    _named.clear()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Answers, one a file or (``lines``) one a line; the latter can be split."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def products(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Products of catalogue pages; a page without ``value`` gives none."""
    return _json(spark, path, PRODUCT_PAGE, lines).select(F.explode("value").alias("p")).select("p.*")


def scenes(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Scenes of search answers; an answer that returned none gives none."""
    return _json(spark, path, SCENE_PAGE, lines).where(F.coalesce("recordsReturned", F.lit(0)) > 0).select(F.explode("results").alias("r")).select("r.*")


def granules(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Granules of feeds, with their links in an array."""
    return _json(spark, path, GRANULE_FEED, lines).select(F.explode("feed.entry").alias("e")).select("e.*")


def granule_links(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """``id, link_no, href, rel``: links of granules, numbered from 1."""
    links = granules(spark, path, lines=lines).select("id", F.posexplode("links").alias("at", "l"))
    return links.select("id", (F.col("at") + 1).alias("link_no"), "l.*")


def download_options(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Options from answers of either shape: a list, or an object with ``options``."""
    text = spark.read.text(path, wholetext=not lines).select(F.trim("value").alias("value"))
    bare = text.where(F.startswith("value", F.lit("["))).select(F.explode(F.from_json("value", f"array<struct<{_fields(OPTION)}>>")).alias("o"))
    boxed = text.where(F.startswith("value", F.lit("{"))).select(F.explode(F.from_json("value", f"options array<struct<{_fields(OPTION)}>>")["options"]).alias("o"))
    return bare.unionByName(boxed).select("o.*")


def _fields(ddl: str) -> str:
    return ",".join(":".join(x.split()) for x in ddl.split(","))


def areas(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Areas of interest ``wkt, ring, shape, error`` of a file: one WKT polygon or multipolygon a line, or all features of a
    GeoJSON file. ``shape`` has all parts and holes; ``ring`` is null where there are several rings. What is no polygon, or a
    broken one, has an ``error`` (``geometry.shape_from_wkt``) and no shape; the area's own text (of GeoJSON: its coordinates)
    stays as ``wkt``."""
    if path.endswith((".geojson", ".json")):
        found = _json(spark, path, FEATURES, lines).select(F.explode("features").alias("f")).select("f.geometry.*")
        read = found.select(F.col("coordinates").alias("wkt"), G.shape_from_geojson(F.col("type"), F.col("coordinates")).alias("p"))
        read = read.withColumn("wkt", F.when(F.col("p.error").isNull(), G.shape_to_wkt(F.col("p.shape"))).otherwise(F.col("wkt")))
    elif path.endswith((".wkt", ".txt")):
        read = spark.read.text(path).select(F.trim("value").alias("wkt")).where("wkt <> ''").withColumn("p", G.shape_from_wkt(F.col("wkt")))
    else:
        raise ValueError(f"areas are read from .wkt, .txt, .geojson or .json files, not {path}")
    one = F.when(F.size(F.flatten("p.shape")) == 1, F.flatten("p.shape")[0])
    return read.select("wkt", one.alias("ring"), "p.shape", "p.error")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of log files, numbered from 0 in each; no lines of a log that is not there yet.

    A log of any length is read in splits. A split's lines follow one another as they are read, and splits follow by where
    they start in the file, so a line's number is its place in its split and the lines of the splits before it: a count for
    each split, the only thing that is added up. The text is read twice, once for the counts.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, line_no long, line string")
    at = F.monotonically_increasing_id()
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*split, "value", at.alias("_at"))
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = lines.join(starts, ["file", "start"])
    return numbered.select("file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), F.trim("value").alias("line"))


def product_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".tif", ".tiff", ".jp2", ".zip", ".tar", ".tar.gz", ".tgz")) -> DataFrame:
    """Path and length of product files under ``path``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.endswith(F.lower("path"), F.lit(suffix))
    return rows.where(wanted)


def write_deferred(deferred: DataFrame, path: str) -> None:
    """``url<TAB>file_name`` of what is to be fetched later, in place of the last list; nothing is written for none."""
    if not deferred.isEmpty():
        deferred.select("url", "file_name").write.mode("overwrite").option("sep", "\t").csv(path)


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    """A catalogue partitioned by provider, collection and month; only partitions with new rows are replaced. Rows are
    rebalanced by these, so that a month is in few files but a large one is split between tasks."""
    rows = catalogue.withColumn("month", F.date_format("start_ts", "yyyy-MM"))
    rows.hint("rebalance", "provider", "collection", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "collection", "month").parquet(path)
