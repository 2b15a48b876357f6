"""Manifests, archives, fetch ledgers, logs and their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import geometry as G
from skylattice.operators import files as N
from skylattice.operators import ledger as L
from skylattice.sources import readers as R
from skylattice.sources.readers import scratch
from skylattice.streaming import streams as S
from skylattice.streaming import tail

from .views import VIEWS, ctes, table, view

BASE = "https://download.example"
AS_OF = "2001-08-01"


def output_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "scenes")
    day = F.date_format("acq_date", "yyyy/MM/dd")
    end = F.when(F.col("scene_id") % 3 == 0, F.lit(None)).when(F.col("scene_id") % 3 == 1, F.lit("")).otherwise(day)
    start = F.when(F.col("scene_id") % 5 == 0, F.lit(None)).otherwise(day)
    return s.select("scene_id", N.output_layout(F.col("tile_id"), start, end, F.lit("copernicus"), F.col("collection"), F.col("product_type")).alias("path"))


def dest_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "product_info").select("product_id", N.store_address("bucket", "space", F.col("name")).alias("uri"))


def manifest_odata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with their download address and name; those without product information drop out."""
    found = view(spark, sf_dir, "scenes").join(view(spark, sf_dir, "product_info"), F.col("scene_id") == F.col("product_id"))
    return found.select("product_id", F.format_string(BASE + "/odata/v1/Products(%s)/$value", F.col("product_id").cast("string")).alias("url"), F.concat("name", F.lit(".zip")).alias("file_name"))


def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "scenes").join(view(spark, sf_dir, "product_info"), F.col("scene_id") == F.col("product_id"), "left_anti").select("scene_id")


def manifest_usgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested options matched with the downloads that came back, under one batch label."""
    options = view(spark, sf_dir, "download_options").withColumn("product_id", F.col("option_id").cast("long"))
    requested = options.where("available and contains(product_name, 'Bundle')").select("entity_id", "product_id").distinct()
    returned = options.where("option_id % 2 = 1").select("entity_id", "product_id", F.concat(F.lit(BASE + "/"), F.col("entity_id").cast("string"), F.lit("_"), F.col("product_id").cast("string")).alias("url")).distinct()
    label = F.date_format(F.lit(AS_OF + " 10:11:12").cast("timestamp_ntz"), "'dl_'yyyyMMdd_HHmmss")
    return requested.join(returned, ["entity_id", "product_id"]).select("entity_id", "product_id", "url", label.alias("label"))


def zip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel lists of addresses and names paired by position; the shorter list ends the pairing."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("u"), F.col("l_linenumber").cast("string")))).alias("urls"), F.sort_array(F.collect_list(F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))))).alias("names"))
    short = F.least(F.size("urls"), F.size("names"))
    pairs = F.arrays_zip(F.slice("urls", F.lit(1), short).alias("url"), F.slice("names", F.lit(1), short).alias("file_name"))
    return lists.where(short > 0).select("l_orderkey", F.inline(pairs)).toDF("entity_id", "url", "file_name")


def dem_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = N.dem_url(BASE + "/globaldem", F.lit("SRTM GL1"), G.bounds(F.col("ring")))
    return view(spark, sf_dir, "aois").select("aoi_id", url.alias("url")).withColumn("file_name", N.dem_name(F.col("url")))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from addresses and headers of the pages table."""
    pages = table(spark, sf_dir, "pages").withColumn("header", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('attachment; filename="p'), F.col("page_id").cast("string"), F.lit('.tar"'))))
    return pages.select("page_id", N.last_part(F.col("url")).alias("raw"), F.coalesce(N.disposition_name(F.col("header")), N.path_name(F.col("url"))).alias("name"), F.concat(F.replace(F.parse_url("url", F.lit("PATH")), F.lit("/"), F.lit("_")), F.lit(".zip")).alias("image"))


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat(c_name, case c_custkey % 5 when 0 then '.tar.gz' when 1 then '.TGZ' when 2 then '.tar' when 3 then '.Zip' else '.tif' end)")
    return table(spark, sf_dir, "customer").select("c_custkey", N.archive_base(name).alias("base"), N.archive_mode(name).alias("mode"))


def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dotted path into JSON text; null at the first key that is missing."""
    nested = F.concat(F.lit('{"a":{"props":'), F.coalesce("props", F.lit("{}")), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(nested, "$.a.props.k").alias("k"), F.get_json_object(nested, "$.a.none.k").alias("missing"))


def daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One climate request a day and known variable for each customer order; unknown codes go to ``rejected_codes``."""
    days, codes = _asked_days(spark, sf_dir)
    return days.join(F.broadcast(codes), "code").select("o_orderkey", F.col("day").cast("string").alias("day"), "variable", F.lit("12:00").alias("time"), F.concat(F.lit("CAMS_"), F.date_format("day", "yyyy-MM-dd"), F.lit(".nc")).alias("file_name"), F.replace("codes", F.lit(","), F.lit("_")).alias("folder"))


def rejected_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with codes that no variable is known for, and the days they would be asked for."""
    days, codes = _asked_days(spark, sf_dir)
    unknown = days.join(F.broadcast(codes), "code", "left_anti")
    return unknown.groupBy("o_orderkey", "code").agg(F.count("*").alias("days")).withColumn("error", F.concat(F.lit("unknown code "), "code"))


def _asked_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    codes = spark.createDataFrame([("1", "temperature"), ("2", "ozone"), ("3", "dust")], "code string, variable string")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"), F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 4 - 1 as int))").alias("end"), F.expr("case o_orderkey % 3 when 0 then '1,3' when 1 then '2' else '9' end").alias("codes"))
    days = asked.select("o_orderkey", "codes", F.explode(N.daily_requests(F.col("start"), F.col("end"))).alias("day")).withColumn("code", F.explode(F.split("codes", ",")))
    return days, codes


def unsafe_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.unsafe_archives(view(spark, sf_dir, "members"))


def single_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that do not hold exactly one file."""
    return view(spark, sf_dir, "members").groupBy(F.expr("ordinal div 10").alias("archive")).agg(F.count_if(~F.endswith("member_name", F.lit("/"))).alias("files")).where("files <> 1")


def crop_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to clip of each archive; providers whose files are not clipped are told apart from those without any."""
    rows = view(spark, sf_dir, "members").withColumn("provider", F.expr("case archive % 4 when 0 then 'usgs' when 1 then 'copernicus' when 2 then 'cds' else 'opentopography' end"))
    counted = rows.groupBy("provider", "archive").agg(F.count_if(N.clipped(F.col("provider"), F.col("member_name"))).alias("targets"))
    status = F.when(~F.col("provider").isin(*N.CLIPPED), "unsupported").when(F.col("targets") == 0, "nothing").otherwise("ok")
    return counted.withColumn("status", status)


def attempt_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "attempts").select("file_id", "seq", L.response_class(F.col("status")).alias("class"))


def _plan(rules: L.RetryRules, ledger: str = "attempts"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.retry_plan(view(spark, sf_dir, ledger), rules).select("file_id", "seq", "class", "verdict", "wait")

    return query


def deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = L.outcomes(L.retry_plan(view(spark, sf_dir, "attempts")))
    return ended.where("outcome not in ('ok', 'pending')").select("file_id", "outcome")


def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.outcomes(L.retry_plan(view(spark, sf_dir, "attempts"))).groupBy("outcome").agg(F.count("*").alias("files"), F.sum("made").alias("attempts"), F.sum("bytes").alias("bytes"))


def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = L.outcomes(L.retry_plan(view(spark, sf_dir, "attempts")))
    return ended.groupBy((F.col("file_id") % 10).alias("batch")).agg(F.count_if(F.col("outcome") != "pending").alias("done"), F.count("*").alias("total")).withColumn("percent", F.floor(F.col("done") * 100 / F.col("total")))


def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file's next attempt would begin, and whether a full answer makes it start over."""
    rows = view(spark, sf_dir, "attempts").withColumn("size", F.col("bytes") * 40)
    position = L.resume_position(F.col("size"))
    over = (F.col("status") == 200) & (position > 0)
    return rows.select("file_id", "seq", position.alias("position"), F.when(position > 0, F.concat(F.lit("bytes="), position.cast("string"), F.lit("-"))).alias("range"), F.when((position > 0) & ~over, "append").otherwise("overwrite").alias("mode"))


def size_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "attempts").where("status in (200, 206, 416)").withColumns({"size": F.col("bytes"), "length": F.when(F.col("seq") % 3 == 0, F.lit(None)).when(F.col("seq") % 3 == 1, F.col("bytes") - 10).otherwise(F.col("bytes"))})
    return rows.select("file_id", "seq", L.complete(F.col("size"), F.col("length"), F.lit(10).cast("long"), F.col("status")).alias("complete"))


def envelope_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in their envelope: error rows, or the data within."""
    body = F.when(F.col("event_id") % 9 == 0, F.lit('{"errorCode":"AUTH","data":null}')).otherwise(F.concat(F.lit('{"errorCode":null,"data":{"n":'), F.col("event_id").cast("string"), F.lit("}}")))
    read = F.from_json(body, "errorCode string, data struct<n:long>")
    return table(spark, sf_dir, "events").select("event_id", read.alias("r")).select("event_id", F.col("r.errorCode").alias("error"), F.col("r.data.n").alias("n"))


def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines of log files: the table's lines written as logs of a thousand lines, which are read, split and numbered
    again. A log's first line tells its number."""
    folder = scratch(spark, "logs")
    logs = view(spark, sf_dir, "progress").withColumn("log", F.expr("line_no div 1000")).groupBy("log").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    logs.select(F.concat(F.lit("log "), F.col("log").cast("string"), F.lit("\n  "), F.array_join("lines.line", " \n  "))).write.option("maxRecordsPerFile", 1).text(folder)
    lines = R.log_lines(spark, folder)
    heads = lines.where("line_no = 0").select("file", F.substr("line", F.lit(5)).try_cast("long").alias("log"))
    rows = G.hold(lines, p=N.progress(F.col("line"))).where("p is not null")
    return rows.join(heads, "file").select("log", F.col("line_no").cast("long").alias("line_no"), "p.*")


def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_progress(view(spark, sf_dir, "progress"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four lines that are not progress, in their order."""
    plain = view(spark, sf_dir, "progress").where(N.progress(F.trim("line")).isNull() & (F.trim("line") != ""))
    return plain.orderBy(F.desc("line_no")).limit(4).select("line_no", "line")


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product files by size, smallest first: names and lengths only, no contents. The files are one a supplier, in folders by
    nation, written first; other files there are left out."""
    folder = scratch(spark, "products")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.repeat(F.lit("x"), F.expr("cast(s_suppkey % 97 + s_nationkey as int)")).alias("value"))
    # A file a row from many tasks, which each put theirs in place; by default the driver moves all files one after another.
    spread = rows.repartition(4 * spark.sparkContext.defaultParallelism)
    spread.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("nation").text(folder)
    found = R.product_files(spark, folder, (".txt",))
    return found.select(F.regexp_extract("path", r"/nation=(\d+)/", 1).cast("long").alias("nation"), "length").orderBy("length", "nation")


def _streamed(spark: SparkSession, sf_dir: str, sql_name: str, tables: tuple[str, ...]) -> DataFrame:
    """A derived table read as a stream of its source's files."""
    name = tables[0]
    source = spark.readStream.schema(table(spark, sf_dir, name).schema)
    # A table is one file or a folder of files: the glob takes either.
    stream = source.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parque*")
    stream.createOrReplaceTempView(f"streamed_{name}")
    return spark.sql(VIEWS[sql_name].replace(f"from {name}", f"from streamed_{name}"))


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = S.latest_progress(_streamed(spark, sf_dir, "progress", ("events",)))
    return S.run_into(stream, scratch(spark, "stream"), "complete")


def stream_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parque*")
    stream = S.running_bytes(source.select(F.col("user_id").alias("file_id"), F.floor(F.col("value") * 1000).cast("long").alias("bytes")))
    return S.run_into(stream, scratch(spark, "stream"), "complete")


def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by a stateful stream over the attempt ledger, written first as the files it reads."""
    stream = S.retry_stream(_ledger_stream(spark, sf_dir))
    with S.rocksdb(spark):
        return S.run_into(stream, scratch(spark, "stream"), "append")


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of each file by a stream in update mode, whose sink takes states as they change."""
    return S.run_into(S.last_states(_ledger_stream(spark, sf_dir)), scratch(spark, "stream"), "update", key="file_id")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each file by six hours of event time, of windows that are over by a day."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parque*")
    chunks = source.select(F.col("user_id").alias("file_id"), "ts", F.floor(F.col("value") * 1000).cast("long").alias("bytes"))
    out = S.run_into(S.bytes_by_time(chunks, width="6 hours", lateness="1 day"), scratch(spark, "stream"), "append")
    return out.select("file_id", *(F.col(c).cast("timestamp_ntz").cast("string").alias(c) for c in ("start", "end")), "bytes", "chunks")


def _logs(spark: SparkSession, sf_dir: str) -> str:
    """The table's lines as eight logs, one file each, in order."""
    folder = scratch(spark, "logs")
    rows = view(spark, sf_dir, "progress").withColumn("log", F.col("line_no") % 8)
    rows.repartition("log").sortWithinPartitions("log", "line_no").select("log", F.col("line").alias("value")).write.partitionBy("log").text(folder)
    return folder


def log_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a few long logs numbered within each, read in splits."""
    return R.log_lines(spark, _logs(spark, sf_dir)).select(F.regexp_extract("file", r"/log=(\d+)/", 1).cast("long").alias("log"), "line_no", "line")


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state of each download of each log, by a source that follows the logs."""
    tail.register(spark)
    folder = _logs(spark, sf_dir)
    lines = spark.readStream.format("log_tail").option("path", folder).option("suffix", ".txt").load()
    rows = G.hold(lines, p=N.progress(F.trim("line"))).where("p is not null")
    last = F.max_by(F.struct("p.percent", "p.done", "p.total"), "position")
    found = rows.groupBy(F.regexp_extract("file", r"/log=(\d+)/", 1).cast("long").alias("log"), F.col("p.name").alias("name")).agg(last.alias("last"), F.count("*").alias("lines"))
    return S.run_into(found.select("log", "name", "lines", "last.*"), scratch(spark, "stream"), "complete")


def _ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "attempts")
    ledger = view(spark, sf_dir, "attempts").select(F.col("file_id").cast("long").alias("file_id"), F.col("seq").cast("int").alias("seq"), F.col("status").cast("int").alias("status"), F.col("retry_after").cast("int").alias("retry_after"))
    ledger.write.parquet(folder)
    return spark.readStream.schema(ledger.schema).parquet(folder)


QUERIES = {q.__name__: q for q in (output_layout, dest_uri, manifest_odata, manifest_missing, manifest_usgs, zip_manifest, dem_url, file_names, archive_names, json_path, daily_requests, unsafe_archives, single_member, crop_targets, attempt_class, deferred, fetch_summary, batch_progress, resume_plan, size_verify, envelope_split, progress_lines, progress_latest, log_tail, file_inventory, rejected_codes, log_numbers, stream_tail, stream_windows, stream_progress, stream_bytes, stream_retry, stream_states)} | {"retry_plan": _plan(L.DOWNLOAD), "retry_plan_lookup": _plan(L.LOOKUP), "retry_plan_probe": _plan(L.DOWNLOAD, "probes"), "retry_plan_no_refresh": _plan(L.RetryRules(refreshing=False))}


def _retry_sql(ok: str, refreshes: int | None, delay_cap: str, after_cap: str, ledger: str = "attempts", refreshing: bool = True) -> str:
    """The plan as a recursive walk over each file's attempts, one at a time."""
    kind = f"case when status in ({ok}) then 'ok' " + ("when status = 401 then 'unauthorized' " if refreshes is not None else "") + "when status = -1 then 'timeout' when status = 429 then 'rate_limited' when status between 500 and 599 then 'server_error' else 'failed' end"
    limit = "" if refreshes is None else f"when class = 'unauthorized' and refreshes >= {refreshes} then 'refresh_limit' " if refreshing else "when class = 'unauthorized' then 'unauthorized' "
    verdict = f"case when class = 'ok' then 'ok' {limit}when class not in ('ok', 'unauthorized') and spent >= 4 then 'exhausted' else 'retry' end"
    return ctes(ledger).replace("with ", "with recursive ", 1) + f""", a as (select file_id, seq::int as seq, bytes, retry_after, {kind} as class from {ledger}),
walk as (
  select file_id, seq, class, 0 as refreshes, 0 as spent, 2.0::double as delay, bytes, retry_after from a where seq = 1
  union all
  select a.file_id, a.seq, a.class, w.refreshes + (w.class = 'unauthorized')::int, w.spent + (w.class not in ('ok', 'unauthorized'))::int,
    case w.class when 'failed' then least(w.delay * 1.5::double, {delay_cap}) when 'timeout' then least(w.delay * 2, 120.0::double) else w.delay end, a.bytes, a.retry_after
  from (select *, {verdict} as v from walk) w join a on a.file_id = w.file_id and a.seq = w.seq + 1 where w.v = 'retry'),
plan as (select file_id, seq, class, {verdict} as verdict, bytes, case when class = 'rate_limited' then coalesce(case when retry_after is not null then least(retry_after::double, {after_cap}) end, delay) when class in ('ok', 'unauthorized') then 0.0::double else delay end as wait from walk),
outcome as (select file_id, case when arg_max(verdict, seq) = 'retry' then 'pending' else arg_max(verdict, seq) end as outcome, count(*) as made, arg_max(bytes, seq) as bytes from plan group by file_id)
"""


_DOWNLOAD_SQL = _retry_sql("200, 206, 416", 3, "60.0::double", "300.0::double")
_SCENES = ctes("scenes")
_LINE = r"regexp_extract(line, '{}', {})"
_SINGLE = r"^Downloading\s+(.+?):\s*(\d+)%\|.*\|\s*([0-9.]+[kMGTP]?)/([0-9.]+[kMGTP]?)\s*\["
_BATCH = r"^Concurrent Downloads:\s*(\d+)%\|.*\|\s*(\d+)/(\d+)\s*\["
_X = lambda p, i: _LINE.format(p, i)
_PROGRESS = ctes("progress") + f""", p as (
  select line_no, 'Concurrent Downloads' as name, {_X(_BATCH, 1)}::int as percent, {_X(_BATCH, 2)} as done, {_X(_BATCH, 3)} as total from progress where starts_with(line, 'Concurrent')
  union all select line_no, {_X(_SINGLE, 1)}, {_X(_SINGLE, 2)}::int, {_X(_SINGLE, 3)}, {_X(_SINGLE, 4)} from progress where starts_with(line, 'Downloading'))
"""
_LATEST = _PROGRESS + "select name, arg_max(percent, line_no) as percent, arg_max(done, line_no) as done, arg_max(total, line_no) as total from p group by name"
_DAY = "strftime(acq_date, '%Y%m%d')"
_NUM = lambda e: f"({e})::double::varchar"
_DEM = f"'{BASE}/globaldem?demtype=SRTM+GL1&south=' || {_NUM('y')} || '&north=' || {_NUM('y + 4')} || '&west=' || {_NUM('x')} || '&east=' || {_NUM('x + 4')} || '&outputFormat=GTiff'"
ORACLES = {
    "output_layout": _SCENES + f"select scene_id, concat_ws('/', 'downloads', md5(tile_id), nullif(concat_ws('_', case when scene_id % 5 <> 0 then {_DAY} end, case when scene_id % 3 = 2 then {_DAY} end), ''), 'copernicus', collection, product_type) as path from scenes",
    "dest_uri": ctes("product_info") + "select product_id, 'oci://bucket@space/' || name as uri from product_info",
    "manifest_odata": ctes("product_info") + f"select product_id, '{BASE}/odata/v1/Products(' || product_id || ')/$value' as url, name || '.zip' as file_name from product_info",
    "manifest_missing": "select o_orderkey as scene_id from orders where o_orderkey % 7 = 0",
    "manifest_usgs": ctes("download_options") + f"select distinct entity_id, option_id::bigint as product_id, '{BASE}/' || entity_id || '_' || option_id as url, 'dl_20010801_101112' as label from download_options where available and contains(product_name, 'Bundle') and option_id % 2 = 1",
    "zip_manifest": "with u as (select l_orderkey as k, 'u' || l_linenumber as url, row_number() over (partition by l_orderkey order by 'u' || l_linenumber) as i from lineitem), n as (select l_orderkey as k, 'n' || l_linenumber as file_name, row_number() over (partition by l_orderkey order by 'n' || l_linenumber) as i from lineitem where l_linenumber % 3 <> 0) select k as entity_id, url, file_name from u join n using (k, i)",
    "dem_url": ctes("aois") + f"select aoi_id, {_DEM} as url, 'SRTM+GL1_' || md5({_DEM}) || '.tif' as file_name from aois",
    "file_names": r"with p as (select page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages) select page_id, string_split(url, '/')[-1] as raw, case when page_id % 3 = 0 then 'p' || page_id || '.tar' else string_split(path, '/')[-1] end as name, replace(path, '/', '_') || '.zip' as image from p",
    "archive_names": "select c_custkey, c_name || case when c_custkey % 5 = 4 then '.tif' else '' end as base, case c_custkey % 5 when 0 then 'gz' when 1 then 'gz' when 2 then 'plain' else 'auto' end as mode from customer",
    "json_path": "select event_id, json_extract_string(props, '$.k') as k, null::varchar as missing from events",
    "daily_requests": "with a as (select o_orderkey, o_orderdate::date as start, o_orderkey % 4 - 1 as n, case o_orderkey % 3 when 0 then '1,3' when 1 then '2' else '9' end as codes from orders), d as (select *, start + i::int as day from a, (select unnest(range(3)) as i) where i <= n), v as (select *, unnest(string_split(codes, ',')) as code from d) select o_orderkey, day::date::varchar as day, case code when '1' then 'temperature' when '2' then 'ozone' else 'dust' end as variable, '12:00' as time, 'CAMS_' || day::date || '.nc' as file_name, replace(codes, ',', '_') as folder from v where code in ('1', '2', '3')",
    "unsafe_archives": ctes("members") + "select distinct archive from members where starts_with(member_name, '../')",
    "single_member": ctes("members") + "select ordinal // 10 as archive, count(*) as files from members group by 1 having count(*) <> 1",
    "crop_targets": ctes("members") + ", m as (select *, case archive % 4 when 0 then 'usgs' when 1 then 'copernicus' when 2 then 'cds' else 'opentopography' end as provider, lower(member_name) as n from members), c as (select provider, archive, count(*) filter ((provider = 'usgs' and (ends_with(n, '.tif') or ends_with(n, '.tiff'))) or (provider = 'copernicus' and ends_with(n, '.jp2')) or (provider = 'opentopography' and ends_with(n, '.tif'))) as targets from m group by all) select *, case when provider = 'cds' then 'unsupported' when targets = 0 then 'nothing' else 'ok' end as status from c",
    "attempt_class": _DOWNLOAD_SQL + "select file_id, seq, class from a",
    "retry_plan": _DOWNLOAD_SQL + "select file_id, seq, class, verdict, wait from plan",
    "retry_plan_lookup": _retry_sql("200, 206", None, "1e300::double", "1e300::double") + "select file_id, seq, class, verdict, wait from plan",
    "retry_plan_probe": _retry_sql("200, 206, 416", 3, "60.0::double", "300.0::double", "probes") + "select file_id, seq, class, verdict, wait from plan",
    "retry_plan_no_refresh": _retry_sql("200, 206, 416", 3, "60.0::double", "300.0::double", refreshing=False) + "select file_id, seq, class, verdict, wait from plan",
    "deferred": _DOWNLOAD_SQL + "select file_id, outcome from outcome where outcome not in ('ok', 'pending')",
    "fetch_summary": _DOWNLOAD_SQL + "select outcome, count(*) as files, sum(made)::bigint as attempts, sum(bytes)::bigint as bytes from outcome group by 1",
    "batch_progress": _DOWNLOAD_SQL + "select file_id % 10 as batch, count(*) filter (outcome <> 'pending') as done, count(*) as total, (count(*) filter (outcome <> 'pending') * 100 // count(*))::bigint as percent from outcome group by 1",
    "resume_plan": ctes("attempts") + ", r as (select file_id, seq::int as seq, status, case when bytes * 40 >= 1048576 then bytes * 40 else 0 end as position from attempts) select file_id, seq, position, case when position > 0 then 'bytes=' || position || '-' end as range, case when position > 0 and status <> 200 then 'append' else 'overwrite' end as mode from r",
    "size_verify": ctes("attempts") + ", r as (select *, case seq % 3 when 0 then null when 1 then bytes - 10 else bytes end as length from attempts where status in (200, 206, 416)) select file_id, seq::int as seq, status = 416 or coalesce(length, 0) = 0 or bytes = length + case when status = 200 then 0 else 10 end as complete from r",
    "envelope_split": "select event_id, case when event_id % 9 = 0 then 'AUTH' end as error, case when event_id % 9 <> 0 then event_id end as n from events",
    "progress_lines": _PROGRESS + ", n as (select line_no, line_no // 1000 as log, row_number() over (partition by line_no // 1000 order by line_no) as place from progress) select log::bigint as log, place::bigint as line_no, name, percent, done, total from p join n using (line_no)",
    "file_inventory": "select s_nationkey::bigint as nation, (s_suppkey % 97 + s_nationkey + 1)::bigint as length from supplier",
    "rejected_codes": "select o_orderkey, '9' as code, (o_orderkey % 4)::bigint as days, 'unknown code 9' as error from orders where o_orderkey % 3 = 2 and o_orderkey % 4 > 0",
    "stream_states": ctes("attempts") + "select file_id, arg_max(status, seq)::int as status, count(*) as made from attempts group by 1",
    "progress_latest": _LATEST,
    "log_tail": ctes("progress") + "select line_no, line from progress where starts_with(line, 'plain') order by line_no desc limit 4",
    "stream_progress": _LATEST,
    "log_numbers": ctes("progress") + "select (line_no % 8)::bigint as log, (row_number() over (partition by line_no % 8 order by line_no) - 1)::bigint as line_no, line from progress",
    "stream_tail": _PROGRESS + "select (line_no % 8)::bigint as log, name, count(*) as lines, arg_max(percent, line_no) as percent, arg_max(done, line_no) as done, arg_max(total, line_no) as total from p group by all",
    "stream_windows": "with w as (select user_id as file_id, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as start, floor(value * 1000)::bigint as bytes from events) select file_id, start::varchar as start, (start + interval 6 hours)::varchar as end, sum(bytes)::bigint as bytes, count(*) as chunks from w where start + interval 6 hours <= (select date_trunc('milliseconds', max(ts)) - interval 1 day from events) group by file_id, start",
    "stream_bytes": "select user_id as file_id, sum(floor(value * 1000)::bigint)::bigint as bytes, count(*) as chunks from events group by 1",
    "stream_retry": _DOWNLOAD_SQL + "select file_id, seq, verdict, wait from plan",
}
