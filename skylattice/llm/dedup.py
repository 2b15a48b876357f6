"""Operator 2: near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Documents with equal shingle sets are one class from the start. Each class has a MinHash signature. Bands of it bring
classes together; the whole signature, folded into a parity bitmap (an *odd sketch*), lets a pair be judged by the
population count of an XOR; what that lets through is confirmed on the full shingle sets. A bucket is never expanded
into all its pairs: its members are first held against its smallest member. Where a bucket then still spans several
components, sketches are compared inside the bucket, block by block: blocks are bounded in members and in bytes of text,
and blocks of one and the same component never meet, so that a crowd of copies costs no more than its size. Members that look like a member of another
component are fetched with their texts and confirmed there, nearest first, until no pair across components is left
untried; only the links found leave the bucket, fewer than it has members.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch
from .tokens import slices_by_bytes
from .words import mix, split_words, windows

#: Signature: SAMPLES values, the first of which make BANDS bands of ROWS. A pair at similarity 0.8 shares no band with
#: probability 3e-6.
BANDS, ROWS, SAMPLES = 32, 5, 320
#: Bits of an odd sketch.
BITS = 1024
#: Members of a bucket's block, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; of fewer words, the whole sequence is one."""
    words = split_words(pc.ascii_lower(texts))
    hashes = words.map(lambda w: xxhash.xxh3_64_intdigest(w), np.uint64)
    found, starts = windows(hashes, words.offsets, k)
    row_of = words.rows
    cuts = np.searchsorted(row_of[starts] if len(starts) else starts, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = words.offsets[i], words.offsets[i + 1]
        if 0 < b - a < k:
            out.append(windows(hashes[a:b], np.array([0, b - a]), int(b - a))[0])
        else:
            out.append(np.unique(found[cuts[i] : cuts[i + 1]]))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            part = shingles[i : i + 2048]
            best = np.minimum(best, (_FACTORS[:, None] * part[None, :] + _SHIFTS[:, None]).min(axis=1))
    return best


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of a signature, as BITS / 64 long values."""
    at = mix(values + np.arange(len(values), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    bits = np.bincount(at.astype(np.int64), minlength=BITS) % 2
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def estimate(differing_bits: float, samples: int = SAMPLES, bits: int = BITS) -> float:
    """Similarity that an XOR population count of two odd sketches stands for."""
    left = 1 - 2 * differing_bits / bits
    return 1 + bits / (4 * samples) * math.log(left) if left > 0 else 0.0


def most_differing_bits(threshold: float, deviations: float = 5.0, samples: int = SAMPLES, bits: int = BITS) -> int:
    """A count that pairs at ``threshold`` exceed only ``deviations`` standard deviations away."""
    apart = 2 * samples * (1 - threshold)
    mean = bits / 2 * (1 - math.exp(-2 * apart / bits))
    drawn = math.exp(-2 * apart / bits) * 2 * math.sqrt(samples * threshold * (1 - threshold))
    hit = math.sqrt(bits / 4 * (1 - math.exp(-4 * apart / bits)))
    return math.ceil(mean + deviations * math.hypot(drawn, hit))


def fingerprints(df: DataFrame, *, k: int, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 4 << 20) -> DataFrame:
    """``doc, size, n_shingles, set_hi, set_lo, sketch array<long>, bands array<long>`` of each row; no bands for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, texts = batch.columns
            for part in slices_by_bytes(sizes.to_numpy(), group_bytes):
                rows = []
                for shingles in shingle_sets(texts[part].fill_null(""), k):
                    if not len(shingles):
                        rows.append((0, 0, 0, None, None))
                        continue
                    whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
                    values = signature(shingles)
                    bands = np.zeros(BANDS, np.uint64)
                    with np.errstate(over="ignore"):
                        for row in values[: BANDS * ROWS].reshape(BANDS, ROWS).T:
                            bands = mix(bands * np.uint64(31) + row)
                        bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64))
                    rows.append((len(shingles), (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63), odd_sketch(values).tolist(), bands.view(np.int64).tolist()))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([ids[part], sizes[part], *(pa.array(x, pa.int64() if i < 3 else pa.list_(pa.int64())) for i, x in enumerate(columns))], ["doc", "size", "n_shingles", "set_hi", "set_lo", "sketch", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("doc"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"), F.col(text_col).alias("text"))
    return picked.mapInArrow(work, f"doc {kind}, size long, n_shingles long, set_hi long, set_lo long, sketch array<bigint>, bands array<bigint>")


def components(edges: DataFrame, width: int) -> DataFrame:
    """``node, comp``: each node of ``edges(a, b)`` with the smallest node it is connected to.

    Large-star and small-star rounds in turn, each a partial aggregate and an equi-join, until the edges no longer
    change; every round is a table in the shared folder, of at most ``width`` files.
    """
    star = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().coalesce(width), "edges")
    seen = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        star = materialise(small.distinct().coalesce(width), "edges")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    labelled = star.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return labelled.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``key, i, j`` together, from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch[x].to_numpy() for x in ("key", "i", "j")], axis=1)
        starts = [0, *(np.flatnonzero(np.any(np.diff(marks, axis=0) != 0, axis=1)) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], len(marks)], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[-1][x][0] != part[x][0] for x in ("key", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


class _Bucket:
    """Members of a bucket's block, or of two blocks that meet."""

    def __init__(self, rows: pa.Table):
        matrix = lambda x: rows[x].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).view(np.uint64)
        self.sketch, self.bands, self.own = matrix("sketch"), matrix("bands"), rows["own"].to_numpy()
        self.same_block = rows["i"][0] == rows["j"][0]
        names: dict = {}
        self.comp = np.array([names.setdefault(c, len(names)) for c in rows["comp"].to_pylist()])
        key = np.array([rows["key"][0].as_py()], np.int64).view(np.uint64)[0]
        self.band = int(np.flatnonzero(self.bands[0] == key)[0])

    def alike(self, r: int, most: int) -> np.ndarray:
        """Later members of other components that differ from member ``r`` in at most ``most`` bits, nearest first; pairs
        that an earlier band brings together are left to it."""
        rest = np.arange(r + 1, len(self.comp))
        rest = rest[(self.comp[rest] != self.comp[r]) & (self.same_block | (self.own[rest] != self.own[r]))]
        if not len(rest):
            return rest
        apart = np.bitwise_count(self.sketch[rest] ^ self.sketch[r]).sum(axis=1)
        rest, apart = rest[apart <= most], apart[apart <= most]
        if self.band and len(rest):
            fresh = ~(self.bands[rest, : self.band] == self.bands[r, : self.band]).any(axis=1)
            rest, apart = rest[fresh], apart[fresh]
        return rest[np.argsort(apart, kind="stable")]


def _in_blocks(placed: DataFrame) -> DataFrame:
    """Members ``key, rep, comp`` of ``placed`` (with ``size``) in the pairs of blocks ``i <= j`` that meet; ``own`` is the
    member's block. A component that would fill half a block has blocks of its own, which do not meet one another."""
    rooms = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    comps = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    comps = comps.withColumn("large", (F.col("n") > BLOCK // 2) | (F.col("bytes") > BLOCK_BYTES // 2))
    mixed = comps.where("not large").groupBy("key").agg(rooms(F.sum("n"), F.sum("bytes")).alias("parts")).withColumn("of", F.lit(None).cast(placed.schema["comp"].dataType))
    pure = comps.where("large").select("key", rooms(F.col("n"), F.col("bytes")).alias("parts"), F.col("comp").alias("of"))
    kinds = materialise(mixed.unionByName(pure), "kinds")
    blocks = kinds.select("key", "of", F.posexplode(F.sequence(F.lit(1), F.col("parts"))).alias("part", "_")).drop("_")
    blocks = blocks.withColumn("own", F.row_number().over(Window.partitionBy("key").orderBy("of", "part")))
    blocks = materialise(blocks, "blocks")
    one, two = blocks.select("key", F.col("own").alias("i"), F.col("of").alias("a")), blocks.select("key", F.col("own").alias("j"), F.col("of").alias("b"))
    # Pairs of blocks, not of members; the blocks of one component have nothing to find in one another.
    meet = one.join(two, "key").where("i <= j and not coalesce(a = b, false)").select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    named = placed.join(comps.select("key", "comp", "large"), ["key", "comp"]).withColumn("of", F.when(F.col("large"), F.col("comp")))
    mine = (F.col("named.key") == F.col("kinds.key")) & F.col("named.of").eqNullSafe(F.col("kinds.of"))
    dealt = named.alias("named").join(kinds.alias("kinds"), mine).select("named.key", "rep", "comp", "named.of", F.pmod(F.when(F.col("large"), F.xxhash64("rep")).otherwise(F.xxhash64("comp")), F.col("parts")).cast("int").alias("part"))
    here = (F.col("dealt.key") == F.col("blocks.key")) & (F.col("dealt.part") == F.col("blocks.part")) & F.col("dealt.of").eqNullSafe(F.col("blocks.of"))
    return dealt.alias("dealt").join(blocks.alias("blocks"), here).select("dealt.key", "rep", "comp", "own").join(meet, ["key", "own"]).select("key", "i", "j", "own", "rep", "comp")


def _involved(placed: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """Those members, in their blocks, that look like a member of another component."""
    dealt = _in_blocks(placed).join(sketches, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            bucket = _Bucket(rows)
            marked = np.zeros(rows.num_rows, bool)
            for r in range(rows.num_rows):
                found = bucket.alike(r, most)
                if len(found):
                    marked[r] = True
                    marked[found] = True
            if marked.any():
                yield from rows.filter(pa.array(marked)).combine_chunks().to_batches()

    return dealt.mapInArrow(work, dealt.schema)


def _links_within(involved: DataFrame, bucketed: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """Confirmed links ``a, b`` across components between members of one block, as few as join what can be joined."""
    kind = involved.schema["rep"].dataType.simpleString()
    dealt = involved.join(bucketed, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            bucket = _Bucket(rows)
            sets = [x for part in slices_by_bytes(rows["size"].to_numpy(), 4 << 20) for x in shingle_sets(rows["text"].combine_chunks()[part].fill_null(""), k)]
            root = list(range(int(bucket.comp.max()) + 1))

            def find(c: int, root: list[int] = root) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            comp, reps, links = bucket.comp.tolist(), rows["rep"].to_pylist(), []
            for r in range(rows.num_rows):
                for x in bucket.alike(r, most).tolist():
                    a, b = find(comp[r]), find(comp[x])
                    small, large = sorted((sets[r], sets[x]), key=len)
                    if a == b or 100 * len(small) < percent * len(large):
                        continue
                    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if 100 * common >= percent * (len(small) + len(large) - common):
                        root[a] = b
                        links.append((reps[r], reps[x]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, rows.schema.field("rep").type) for x in zip(*links, strict=True)], ["a", "b"])

    return dealt.mapInArrow(work, f"a {kind}, b {kind}")


def _confirm(pairs: DataFrame, texts: DataFrame, bucketed: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that the full shingle sets confirm. ``bucketed`` is ``texts`` dealt by ``rep`` already; the
    side of the leaders, whose keys may be hot, is joined from ``texts``, so that Spark can split them."""
    kind = pairs.schema["a"].dataType.simpleString()
    text = lambda t, x: t.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"), F.col("size").alias(f"size_{x}"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size_a"].to_numpy() + batch["size_b"].to_numpy()
            for part in slices_by_bytes(sizes, 4 << 20):
                own = batch.slice(part.start, part.stop - part.start)
                ids = pc.dictionary_encode(own["a"])
                first = np.unique(ids.indices.to_numpy(), return_index=True)[1]
                left = shingle_sets(own["text_a"].take(pa.array(first)).fill_null(""), k)
                keep = []
                for i, right in zip(ids.indices.to_pylist(), shingle_sets(own["text_b"].fill_null(""), k), strict=True):
                    common = len(np.intersect1d(left[i], right, assume_unique=True))
                    keep.append(100 * common >= percent * (len(left[i]) + len(right) - common))
                yield own.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.join(text(bucketed, "b"), "b").join(text(texts, "a"), "a").mapInArrow(exact, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for each row of ``df``.

    Words are runs of anything but white space, with A-Z lower-cased; a document is the set of its distinct k-word
    shingles. Two documents are linked if ``100 * |A and B| >= percent * |A or B|``; ``component_id`` is the smallest id
    reachable by links and ``kept`` marks the row that bears it. Texts that are null or hold no word have empty sets and
    are linked with nothing. A row with a null id is linked with nothing: its component is null and it is kept. Rows that
    share an id count as one document. Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    most = most_differing_bits(percent / 100)
    prints = materialise(fingerprints(df, k=k, id_col=id_col, text_col=text_col), "prints")
    # Tables of ids are far smaller than the input: one file for some ten thousand documents.
    width = max(12, prints.count() // 20_000)
    full = prints.where("n_shingles > 0 and doc is not null")
    same = ["set_hi", "set_lo", "n_shingles"]
    nodes = materialise(full.groupBy(*same).agg(F.min("doc").alias("rep"), F.max("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes")
    rows = nodes.select("rep", F.explode("bands").alias("key"))
    crowds = rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    crowded = materialise(rows.join(crowds, "key").select("key", "rep", "leader"), "crowded")
    wanted = crowded.select("rep").distinct()
    source = df.select(F.col(id_col).alias("rep"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"), F.col(text_col).alias("text"))
    source = source.join(wanted, "rep", "left_semi").dropDuplicates(["rep"])
    path, name = scratch(spark, "texts"), f"texts_{uuid.uuid4().hex}"
    source.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep").sortBy("rep").option("path", path).saveAsTable(name)
    bucketed, texts = spark.table(name), spark.read.schema(source.schema).parquet(path)
    sketches = nodes.select("rep", "sketch")

    apart = F.aggregate(F.zip_with("sketch", "sketch_a", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    led = crowded.where("rep <> leader").select(F.col("leader").alias("a"), "rep").distinct()
    led = led.join(sketches, "rep").join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").where(apart <= most)
    tried = materialise(led.select("a", F.col("rep").alias("b")).coalesce(width), "tried")
    links = materialise(_confirm(tried, texts, bucketed, k, percent).coalesce(width), "links")
    comp = materialise(components(links, width).coalesce(width), "components")
    placed = crowded.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    placed = materialise(placed.join(several, "key", "left_semi").join(nodes.select("rep", "size"), "rep").coalesce(width), "placed")
    involved = materialise(_involved(placed, nodes.select("rep", "sketch", "bands"), most).coalesce(width), "involved")
    found = materialise(_links_within(involved, bucketed, k, percent, most).coalesce(width), "links")
    if not found.isEmpty():
        links = found.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("a <> b"))
        comp = materialise(components(links, width).coalesce(width), "components")
    spark.sql(f"drop table {name}")

    reps = nodes.select(*same, "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("comp", "rep").alias("comp"))
    linked = full.select("doc", *same).join(reps, same).select("doc", "n_shingles", F.col("comp").alias("component_id"))
    alone = prints.where("n_shingles = 0 or doc is null").select("doc", "n_shingles", F.col("doc").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each group of near duplicates: that with the smallest id. All columns stay."""
    gone = near_duplicates(df, k=k, percent=percent, id_col=id_col, text_col=text_col).where("not kept").select(id_col)
    return df.join(gone, id_col, "left_anti").select(df.columns)
