"""Structured Streaming forms of the progress log, the byte counter and the retry decisions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from skylattice.functions.geometry import hold
from skylattice.operators.files import progress
from skylattice.operators.ledger import DOWNLOAD, TIMED_OUT, RetryRules
from skylattice.sources.readers import exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_progress(lines: DataFrame) -> DataFrame:
    """Last state of each download by position in the log; a stream gives it in update or complete mode."""
    rows = hold(lines, p=progress(F.trim("line"))).where("p is not null")
    last = F.max_by(F.struct("p.percent", "p.done", "p.total"), "line_no")
    return rows.groupBy(F.col("p.name").alias("name")).agg(last.alias("last")).select("name", "last.*")


def running_bytes(chunks: DataFrame) -> DataFrame:
    """Bytes and chunks so far of each file."""
    return chunks.groupBy("file_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("chunks"))


def bytes_by_time(chunks: DataFrame, *, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Bytes and chunks of each file (``file_id, ts, bytes``) in windows of event time, in append mode: a window comes once,
    when the newest chunk is ``lateness`` beyond its end, and its state is dropped then. Chunks that come later still are
    dropped too and counted (``late_rows``), so state is bounded by the files of the last windows."""
    rows = chunks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    found = rows.groupBy(F.window("ts", width).alias("w"), "file_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("chunks"))
    return found.select("file_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "bytes", "chunks")


def progress_sessions(lines: DataFrame, *, gap: str = "1 hour") -> DataFrame:
    """Last state of each download (``line, position, ts``) once it has been silent for ``gap``, in append mode; then its state
    is dropped. A download that goes on after such a silence is a new one."""
    rows = hold(lines.withColumn("ts", F.col("ts").cast("timestamp")), p=progress(F.trim("line"))).where("p is not null").withWatermark("ts", gap)
    last = F.max_by(F.struct("p.percent", "p.done", "p.total"), F.struct("ts", "position"))
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), F.col("p.name").alias("name")).agg(last.alias("last"), F.count("*").alias("lines"))
    return found.select("name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "lines", "last.*")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream has dropped since they came after their window, over the progress reports it keeps."""
    return sum(op["numRowsDroppedByWatermark"] for report in query.recentProgress for op in report["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each batch reported."""
    return [sum(op["numRowsTotal"] for op in report["stateOperators"]) for report in query.recentProgress]


def retry_stream(attempts: DataFrame, rules: RetryRules = DOWNLOAD, *, ttl_ms: int | None = None) -> DataFrame:
    """Verdict of each attempt (``file_id, seq, status, retry_after``) as it arrives, by the rules of ``retry_plan``, with the
    state of each file kept between batches; attempts after a file's end are ignored. A file's attempts must arrive in
    order of ``seq``; those that share a batch are put in order. State holds two counters, a delay and a flag a file. A
    stream that runs on should be given ``ttl_ms``, after which the state of a file is dropped; one that ends when there
    is no more input (trigger ``availableNow``) must not, as Spark then always has another batch to look at the clock."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    # Plain values only: the workers that run the processor need not have this package.
    tries, first_delay, growth, late_growth = rules.attempts, rules.first_delay, rules.growth, rules.timeout_growth
    endless = float("inf")
    most_delay, most_late, most_after = rules.most_delay or endless, rules.most_after_timeout or endless, float(rules.most_retry_after or endless)
    most_refreshes, refreshing = rules.refreshes, rules.refreshing
    done = (200, 206) if most_refreshes is None else (200, 206, 416)
    timed_out = TIMED_OUT

    class Retry(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", "refreshes int, spent int, delay double, ended boolean", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            refreshes, spent, delay, ended = self.state.get() if self.state.exists() else (0, 0, first_delay, False)
            out = []
            for row in pd.concat(list(rows)).sort_values("seq").itertuples():
                if ended:
                    break
                verdict, wait = "retry", 0.0
                if row.status in done:
                    verdict = "ok"
                elif row.status == 401 and most_refreshes is not None:
                    refreshes += 1
                    verdict = "unauthorized" if not refreshing else "refresh_limit" if refreshes > most_refreshes else "retry"
                else:
                    spent += 1
                    wait = delay
                    if row.status == 429:
                        wait = delay if pd.isna(row.retry_after) else min(float(row.retry_after), most_after)
                    elif row.status == timed_out:
                        delay = min(delay * late_growth, most_late)
                    elif not 500 <= row.status < 600:
                        delay = min(delay * growth, most_delay)
                    verdict = "exhausted" if spent >= tries else "retry"
                ended = verdict != "retry"
                out.append((key[0], row.seq, verdict, wait))
            self.state.update((refreshes, spent, delay, ended))
            yield pd.DataFrame(out, columns=["file_id", "seq", "verdict", "wait"])

        def close(self) -> None:
            pass

    return attempts.groupBy("file_id").transformWithStateInPandas(statefulProcessor=Retry(), outputStructType="file_id long, seq int, verdict string, wait double", outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")


def last_states(attempts: DataFrame) -> DataFrame:
    """Last status and number of attempts of each file; in update mode a batch gives the files it changed, as they change."""
    return attempts.groupBy("file_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("made"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, as stateful processors need; the session is left as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def run_into(stream: DataFrame, folder: str, mode: str, *, key: str | None = None) -> DataFrame:
    """Run a stream over what is available now, into Parquet under ``folder``, and give its result.

    A batch is a folder of its own, which a batch that is run again replaces, so none counts twice. The result is all
    batches (``append``), the last one (``complete``), or the last row of each ``key`` (``update``).
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if not exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif mode == "update":
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last")).select("last.*")
    return rows.select(stream.columns)
