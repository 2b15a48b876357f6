"""Operator 3: best-fit packing of documents into fixed-length sequences, improved by swap-based local search.

Only lengths matter to a packing, and there are at most ``capacity`` of them. So the plan is made on the histogram of
piece lengths (a table of at most ``capacity`` rows, whatever the corpus size): best-fit decreasing gives *patterns* (how
many pieces of which lengths share a bin) with multiplicities, and the local search moves, swaps and exchanges pieces
between underfull patterns. Spark then ranks the pieces of each length and sends rank ranges to pattern slots by
arithmetic, so every piece of the corpus is placed without any of them passing through the driver.
"""

from __future__ import annotations

import functools
import logging
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import coder_of, slices_by_bytes

#: (length, copies) pairs, longest first.
Pattern = tuple[tuple[int, int], ...]


def fill_of(pattern: Pattern) -> int:
    return sum(length * copies for length, copies in pattern)


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Patterns and their multiplicities, as best-fit decreasing makes them when equal lengths are placed together."""
    done: Counter[Pattern] = Counter()
    open_bins: dict[int, Counter[Pattern]] = {}  # by room left
    rooms: list[int] = []

    def put(pattern: Pattern, bins: int) -> None:
        room = capacity - fill_of(pattern)
        if bins and not room:
            done[pattern] += bins
        elif bins:
            if room not in open_bins:
                open_bins[room] = Counter()
                insort(rooms, room)
            open_bins[room][pattern] += bins

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, bins = open_bins[room].popitem()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, pattern, bins = capacity, (), left
            copies = room // length  # a bin just filled is the next best fit while it has room for one more
            used = min(bins, left // copies)
            rest = left - used * copies if used < bins else 0
            put((*pattern, (length, copies)), used)
            left -= used * copies
            if rest and rest < copies:
                put((*pattern, (length, rest)), 1)
                used, left = used + 1, 0
            if pattern:
                put(pattern, bins - used)
    for patterns in open_bins.values():
        done.update(patterns)
    return done


def _without(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    items = Counter(dict(pattern))
    items.subtract(Counter(out))
    items.update(into)
    return tuple(sorted(((n, k) for n, k in items.items() if k), reverse=True))


@functools.lru_cache(maxsize=1 << 14)
def _choices(pattern: Pattern) -> list[tuple[int, tuple[int, ...]]]:
    """What may leave a bin together (nothing, one piece or two) and its size, smallest first."""
    lengths = [n for n, _ in pattern]
    twice = [(n, n) for n, k in pattern if k > 1]
    found = [(), *((n,) for n in lengths), *((a, b) for i, a in enumerate(lengths) for b in lengths[i + 1 :]), *twice]
    return sorted((sum(x), x) for x in found)


def _largest_shift(low: Pattern, high: Pattern, room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The exchange that moves most from ``low`` to ``high`` within its room: a move of one piece, or a swap of one for one,
    two for one or one for two."""
    best = None
    back = _choices(high)
    for size, out in _choices(low):
        # Back comes the smallest choice that leaves the shift within the room; larger ones only shift less.
        for i in range(bisect_left(back, (size - room,)), len(back)):
            less, into = back[i]
            if less >= size or (best and size - less <= best[0]):
                break
            if len(out) + len(into) <= 3 and (len(out) == 1 or len(into) == 1):
                best = (size - less, out, into)
                break
    return best


def improve(patterns: Counter[Pattern], capacity: int, max_moves: int = 5000) -> Counter[Pattern]:
    """Local search over underfull bins: move one piece, swap one for one, or two for one, whenever the sum of squared
    fills grows, emptiest bins first, until no such move is left, the bins reach the volume bound, or (with a warning)
    ``max_moves`` are made. A move is made in as many bins of the two patterns as there are. No piece is ever lost, only re-placed.
    """
    bins = Counter(patterns)
    total = sum(fill_of(p) * k for p, k in bins.items())
    floor = -(-total // capacity)
    settled: set[tuple[Pattern, Pattern]] = set()
    for _ in range(max_moves):
        if sum(bins.values()) <= floor:
            break
        under = sorted((p for p in bins if fill_of(p) < capacity), key=lambda p: (fill_of(p), p))
        move = None
        for i, low in enumerate(under):
            best = 0
            for high in reversed(under[i:]):
                if (low, high) in settled or (low == high and bins[low] < 2):
                    continue
                if (found := _largest_shift(low, high, capacity - fill_of(high))) is None:
                    settled.add((low, high))
                    continue
                shift, out, into = found
                gain = 2 * shift * (fill_of(high) - fill_of(low) + shift)
                if gain > best:
                    best, move = gain, (low, high, out, into)
            if move:
                break
        if not move:
            break
        low, high, out, into = move
        times = bins[low] // 2 if low == high else min(bins[low], bins[high])
        for pattern, gone, come in ((low, out, into), (high, into, out)):
            bins[pattern] -= times
            if new := _without(pattern, gone, come):
                bins[new] += times
        bins = +bins
    else:
        logging.getLogger(__name__).warning("The local search was ended after %d moves, with %d bins above the volume bound", max_moves, sum(bins.values()) - floor)
    return bins


def plan(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    return improve(best_fit_decreasing(histogram, capacity), capacity)


def slots(patterns: Counter[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first bin, copies in a bin and offset in the bin of each slot range, by rank."""
    rank: Counter[int] = Counter()
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for pattern, bins in sorted(patterns.items(), reverse=True):
        offset = 0
        for length, copies in pattern:
            found.setdefault(length, []).append((rank[length], first_bin, copies, offset))
            rank[length] += copies * bins
            offset += length * copies
        first_bin += bins
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in found.items()}


def encode_pieces(df: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_bytes: int = 8 << 20) -> DataFrame:
    """Encode each text, append ``end_id`` and cut what is longer than ``capacity`` into pieces; the first may be shorter."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer_path)
        for batch in batches:
            keys, n_bytes, texts = batch.columns
            for part in slices_by_bytes(n_bytes.to_numpy(), group_bytes):
                ids, offsets = coder.encode(texts[part].fill_null(""))
                ends = offsets[1:] + np.arange(1, len(offsets))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                sizes = np.diff(np.concatenate([[0], ends]))
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = sizes - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                at = (ends - sizes)[row] + start
                crc = [zlib.crc32(ids[a : a + n].data) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [keys[part].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("doc"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return picked.mapInArrow(encode, f"doc {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(df: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``, if asked for), one row a piece.

    A null text counts as empty and is one piece that holds ``end_id`` alone. Null ids and repeated rows are packed like
    any other row. Very long texts become several pieces. An empty table gives an empty result. Other columns are not
    read. Full pieces take a sequence each (negative ids); the rest follow the plan (ids from 0).
    """
    spark = df.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = encode_pieces(df, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    # Salted by place, so that repeated rows do not share one; the table is written once, so that its salts stay.
    pieces = materialise(pieces.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "pieces")
    part = pieces.where(F.col("length") < capacity)
    counts = part.groupBy("length", "salt").count()
    histogram = {x["length"]: x["n"] for x in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    where = slots(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[x].to_numpy() for x in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                low, first, copies, base = where[n]
                at = np.searchsorted(low, rank[own], "right") - 1
                nth = rank[own] - low[at]
                sequence[own] = first[at] + nth // copies[at]
                offset[own] = base[at] + nth % copies[at] * n
            kept = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    columns = ["doc", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = part.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).select(*columns, (F.coalesce("before", F.lit(0)) + F.col("nth") - 1).cast("long").alias("rank"))
    kind = df.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"doc {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
    whole = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole).withColumnRenamed("doc", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from the result of ``pack(..., with_ids=True)``: at most ``capacity`` ids a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x.ids)).alias("ids"))
