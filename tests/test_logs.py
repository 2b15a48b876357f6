"""Long logs in splits, logs that grow while they are followed, and streams whose state is dropped."""

import random
import time

import pytest
from pyspark.sql import functions as F

from skylattice.sources import readers
from skylattice.streaming import streams, tail


def test_line_numbers_over_splits(spark, tmp_path):
    """A file of many splits, with empty and very long lines, beside short files; nothing is read as a whole."""
    rng = random.Random(1)
    texts = {"long.log": [rng.choice(["", "x", "line", "y" * 900, "é" * 40]) for _ in range(3000)], "one.log": ["only"], "two.log": ["", "b", ""]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = readers.log_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((name, i, x) for name, lines in texts.items() for i, x in enumerate(lines))


@pytest.mark.parametrize("piece_bytes", ["5", "1000000"])
def test_a_growing_log_is_followed(spark, tmp_path, piece_bytes):
    """Lines are appended between batches, some of them half; a restart goes on where the last run ended."""
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    tail.register(spark)

    def run():
        lines = spark.readStream.format("log_tail").option("path", str(logs)).option("pieceBytes", piece_bytes).load()
        return lines.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()

    def seen(n):
        for _ in range(60):
            if out.exists():
                rows = sorted((r.file.rsplit("/", 1)[1], r.position, r.line) for r in spark.read.schema("file string, position long, line string").parquet(str(out)).collect())
                if len(rows) >= n:
                    return rows
            time.sleep(0.5)
        raise AssertionError("lines are missing")

    query = run()
    with (logs / "a.log").open("a") as a:
        a.write("first\nsecond\nhal")
    assert seen(2) == [("a.log", 0, "first"), ("a.log", 6, "second")]
    with (logs / "a.log").open("a") as a:
        a.write("f done\n\n")
    (logs / "b.log").write_text("é other\r\nrest")
    assert seen(5)[2:] == [("a.log", 13, "half done"), ("a.log", 23, ""), ("b.log", 0, "é other")]
    query.stop()
    with (logs / "b.log").open("a") as b:
        b.write(" of it\nlast\n")
    query = run()
    got = seen(7)
    query.stop()
    assert got[5:] == [("b.log", 10, "rest of it"), ("b.log", 21, "last")] and len(got) == 7


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


def test_state_is_dropped_and_late_rows_are_counted(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "file_id long, ts string, bytes long"
    feed(spark, folder, [(i, f"2024-01-01 00:{i % 60:02d}:00", 10) for i in range(200)], schema)
    stream = lambda: streams.bytes_by_time(spark.readStream.schema("file_id long, ts timestamp_ntz, bytes long").parquet(folder))
    query = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    most = max(streams.state_rows(query))
    feed(spark, folder, [(1, "2024-01-01 09:30:00", 7)], schema)
    query.processAllAvailable()
    feed(spark, folder, [(2, "2024-01-01 00:10:00", 5), (1, "2024-01-01 09:40:00", 1)], schema)
    query.processAllAvailable()
    rows, late = streams.state_rows(query), streams.late_rows(query)
    query.stop()
    assert most == 200 and rows[-1] == 1 and late == 1
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 200 and out.agg(F.sum("bytes"), F.sum("chunks")).first()[:] == (2000, 200)


def test_silent_downloads_are_closed(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "line string, position long, ts string"
    line = lambda name, k: f"Downloading {name}: {k}%|# | {k}.0M/100.0M [00:01<00:19]"
    feed(spark, folder, [(line("a", 10), 1, "2024-01-01 00:00:00"), (line("a", 20), 2, "2024-01-01 00:30:00"), (line("b", 5), 3, "2024-01-01 00:40:00"), ("plain", 4, "2024-01-01 00:41:00"), (line("a", 90), 5, "2024-01-01 04:00:00")], schema)
    found = streams.progress_sessions(spark.readStream.schema("line string, position long, ts timestamp_ntz").parquet(folder))
    rows = streams.run_into(found, str(tmp_path / "out"), "append").collect()
    assert sorted((r.name, r.lines, r.percent, r.done) for r in rows) == [("a", 2, 20, "20.0M"), ("b", 1, 5, "5.0M")]
