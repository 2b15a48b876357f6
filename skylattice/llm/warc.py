"""Operator 4: WARC archives, written by Spark's text writer and read back by a salvaging reader.

A record is a row of text that ends in the blank line which WARC asks for after each record; Spark's text writer puts
that in as its line separator, so archives go to any store Hadoop knows, with Spark's commit protocol. The reader walks
an archive's bytes (plain, gzip members, or one compressed file). A record that fails its checks is quarantined: the
reader searches for the next place where a valid member or version line begins, goes on there, and logs the byte gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.sources.readers import exists

from .common import materialise, scratch

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n")
#: The end of headers is first looked for within this many bytes of the version line, then within four times as many, and
#: so on up to the next version line.
USUAL_HEADER = 1 << 16
#: Records of up to so many bytes go to archives of at most so many records; larger ones have an archive each.
ARCHIVES = ((1 << 14, 4096), (1 << 17, 512), (1 << 20, 64), (1 << 23, 8))
MEMBER = b"\x1f\x8b\x08"


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hexes: Column) -> Column:
    """Base32 of a 40-digit hex string, from digits by tens: ten hex digits are eight base32 ones."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    block = lambda i: F.conv(F.substring(hexes, 10 * i + 1, 10), 16, 10).cast("long")
    letter = lambda i, j: F.substring(alphabet, (F.shiftright(block(i), 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*(letter(i, j) for i in range(4) for j in range(8)))


def _class(url: Column, payload: Column) -> Column:
    """The place in ``ARCHIVES`` of a record's size."""
    size = F.octet_length(url).cast("long") + F.octet_length(payload)
    found = F.lit(len(ARCHIVES))
    for i in range(len(ARCHIVES) - 1, -1, -1):
        found = F.when(size <= ARCHIVES[i][0], i).otherwise(found)
    return found


def _records(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit_bytes: int = 0) -> tuple[DataFrame, list[int]]:
    """``record, class`` of each row of ``df``, and the classes of sizes that occur."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumn("hex", F.sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("class", _class(F.col("url"), F.col("payload")))
    firsts = rows.where((F.octet_length("payload") >= least_revisit_bytes) & F.col("id").isNotNull()).groupBy("hex").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("hex", "first")
    # As a table of known size: while it is small Spark sends it to the payloads, and beyond that deals both out by digest.
    firsts = materialise(firsts, "firsts")
    known = rows.join(firsts, "hex", "left").withColumn("revisit", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    size = F.octet_length("payload")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(name(F.col("id")), F.lit("<urn:page:>"))),
        line("WARC-Target-URI", F.translate("url", "\r\n", "")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("hex")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Payload-Length", size.cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(F.col("revisit"), F.lit(0)).otherwise(size) + len(HTTP)).cast("string")),
        F.lit("\r\n" + HTTP),
        F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")),
    )
    return known.select(head.alias("record"), "class"), [x["class"] for x in rows.select("class").distinct().collect()]


def records(df: DataFrame, **columns: str | int) -> DataFrame:
    """A column ``record`` with one WARC record a row of ``df``.

    Of rows whose payloads are equal and of ``least_revisit_bytes`` or more, those with the smallest id are responses and
    the others revisits that refer to it. A null payload is empty. A row with a null id is a response, as no other can
    refer to it. Rows that share the smallest id are all responses.
    """
    return _records(df, **columns)[0].select("record")


def write(df: DataFrame, path: str, *, compression: str = "none", **columns: str | int) -> None:
    """Write ``records(df, **columns)`` as archives under ``path``, of about 64 MB at most unless a record is larger: records
    of each class of sizes that occurs are written by themselves, with its bound on the records of an archive."""
    known, classes = _records(df, **columns)
    for i in sorted(classes):
        some = known if len(classes) == 1 else known.where(F.col("class") == i)
        rows_per_file = ARCHIVES[i][1] if i < len(ARCHIVES) else 1
        some.select("record").write.mode("append").option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", rows_per_file).text(path)


def _head_end(data: bytes, at: int) -> tuple[int, str]:
    """Where the headers of the record at ``at`` end, or why they do not. However long, they end before the next version
    line, so that damaged archives are not searched to their ends again and again."""
    reach = USUAL_HEADER
    while True:
        stop = min(len(data), at + reach)
        end = data.find(b"\r\n\r\n", at, stop)
        next_one = VERSION.search(data, at + 1, end if end >= 0 else stop)
        if next_one:
            return -1, "headers cut short"
        if end >= 0 or stop == len(data):
            return end, "" if end >= 0 else "headers do not end"
        reach *= 4


def _parse(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at ``at`` of plain bytes, its end, or why there is none."""
    if not VERSION.match(data, at):
        return None, at, "no version line"
    body, why = _head_end(data, at)
    if why:
        return None, at, why
    head = data[at : body + 2]
    sizes = LENGTH.findall(head)
    if len(sizes) != 1:
        return None, at, "no single Content-Length"
    end = body + 4 + int(sizes[0])
    if end > len(data):
        return None, at, "cut short"
    block = data[body + 4 : end]
    if data[end : end + 4] != b"\r\n\r\n" and end != len(data):
        return None, at, "no blank line after the block"
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if stated and headers.get("warc-type") == "response" and digest_of(payload_of(block)) != stated:
        return None, at, "payload digest differs"
    return Record(at, min(end + 4, len(data)), headers, block), min(end + 4, len(data)), ""


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP headers of a block."""
    return block.partition(b"\r\n\r\n")[2] if block[:5] == b"HTTP/" else block


def _plain(data: bytes, base: int | None = None) -> Iterator[Record | Gap]:
    """Records and gaps of plain bytes; ``base`` is the offset to report if they lie in a compressed member."""
    place = (lambda x: x) if base is None else (lambda _: base)
    at = 0
    while at < len(data):
        record, end, why = _parse(data, at)
        if record:
            yield record._replace(start=place(record.start), end=place(record.end))
            at = end
            continue
        start = at
        while True:
            found = VERSION.search(data, at + 1)
            at = found.start() if found else len(data)
            if not found or _parse(data, at)[0]:
                break
        yield Gap(place(start), place(at), why)


def _member(data: bytes, at: int) -> tuple[bytes | None, int, str]:
    """The plain bytes of the gzip member at ``at`` and its end, or why it cannot be read; fed in small steps, so that no
    step copies the rest of the archive."""
    stream, parts, step = zlib.decompressobj(31), [], 1 << 16
    try:
        for a in range(at, len(data), step):
            parts.append(stream.decompress(data[a : a + step]))
            if stream.eof:
                return b"".join(parts), min(a + step, len(data)) - len(stream.unused_data), ""
    except zlib.error:
        return None, at, "damaged gzip member"
    return None, at, "member cut short"


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that can be recovered, and the gaps between them, in order of bytes."""
    if data[:2] != MEMBER[:2]:
        yield from _plain(data)
        return
    at = 0
    while at < len(data):
        start = at
        why = "no gzip member"
        if data[at : at + 3] == MEMBER:
            plain, end, why = _member(data, at)
            if plain is not None:
                at = end
                for x in _plain(plain, start):
                    yield x._replace(end=at)
                continue
        at = data.find(MEMBER, at + 1)
        at = len(data) if at < 0 else at
        while at < len(data):
            stream = zlib.decompressobj(31)
            try:
                if VERSION.match(stream.decompress(data[at : at + (1 << 16)], 64)):
                    break
            except zlib.error:
                pass
            at = data.find(MEMBER, at + 1)
            at = len(data) if at < 0 else at
        yield Gap(start, at, why)


FIELDS = "archive string, start long, end long, type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary, quarantined string"


def read(spark: SparkSession, path: str, *, with_payload: bool = True, strict: bool = False) -> DataFrame:
    """One row a record recovered and one a gap (``quarantined`` tells why; its other record columns are null); a gap is an
    error if ``strict``.

    An archive is held in memory while it is read, so archives are best kept small; ``write`` bounds their bytes.
    ``payload_bytes`` and ``payload_digest`` are worked out from a response's bytes and stated in a revisit's headers.
    """
    named = re.compile(r"<urn:page:(.*)>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("quarantined", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                archive, rows, size = batch[0][i].as_py(), [], 0
                for x in salvage(batch[1][i].as_py()):
                    if isinstance(x, Gap) and strict:
                        raise ValueError(f"{archive}: bytes {x.start} to {x.end}: {x.reason}")
                    if isinstance(x, Gap):
                        rows.append((archive, x.start, x.end, None, None, None, None, None, None, None, x.reason))
                    else:
                        payload, get = payload_of(x.block), x.headers.get
                        own = get("warc-type") != "revisit"
                        ids = [(named.fullmatch(get(h, "")) or [None, None])[1] or None for h in ("warc-record-id", "warc-refers-to")]
                        stated = get("warc-payload-length", "")
                        n = len(payload) if own else int(stated) if stated.isdigit() else None
                        rows.append((archive, x.start, x.end, get("warc-type"), ids[0], get("warc-target-uri"), n, digest_of(payload) if own else get("warc-payload-digest", "").removeprefix("sha1:"), ids[1], payload if with_payload else None, None))
                        size += len(payload) if with_payload else 64
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(work, FIELDS)


def round_trip(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archive ``df`` in the shared folder and list what the reader finds there: ``id_col, payload_bytes, payload_digest,
    record_type, refers_to``, one row for each row of ``df``: what the reader cannot read of an archive written here is an
    error. An empty table writes no archive and gives no rows."""
    path = scratch(df.sparkSession, "warc")
    write(df, path, id_col=id_col, url_col=url_col, payload_col=payload_col)
    kind = df.schema[id_col].dataType.simpleString()
    if not exists(df.sparkSession, path):
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    found = read(df.sparkSession, path, with_payload=False, strict=True)
    return found.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
