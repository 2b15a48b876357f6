"""Operator 1: sentence pieces. N-best segmentation of texts by a piece model, and decoding of ids.

The scores of a lattice's paths add up, so the best score of any path from the start to a place (forward Viterbi) is an
exact heuristic for a search that runs backward from the end: A* then takes paths off its queue in order of their full
scores, and the first n that reach the start are the n best. No path runs across a place between two characters that no
piece has side by side, so a text's lattice falls apart there into those of its words: the stretches between. Forward and backward Viterbi scores of each
distinct word, many words at a time in numpy, give its best path and how far its second best lies behind. The n best of a
text can differ from its best only in the n - 1 words where that is least: A* searches those, and the n best of the text
are put together from their lists.
"""

from __future__ import annotations

import functools
import heapq
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices_by_bytes
from .words import mix

SPACE = "▁"
#: What a character without a piece costs beyond the lowest score of any piece, as unigram models have it.
UNKNOWN_PENALTY = 10.0

#: Score of a path and its ids as little-endian unsigned 32-bit numbers.
Path = tuple[float, bytes]
#: The same, and whether decoding the ids gives the word back.
Checked = tuple[float, bytes, bool]


@dataclass
class Model:
    """The pieces of a ``.model`` file with their scores (log-probabilities, or ranks of merges taken for them)."""

    processor: object
    pieces: dict[str, tuple[float, bytes]]
    longest: int
    unknown: float
    bytes_at: list[int]

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): (sp.get_score(i), struct.pack("<I", i)) for i in usable}
        # Pieces that the model forbids in all but name (scores of -1e9) do not set the price of an unknown character.
        lowest = min((score for score, _ in pieces.values() if score > -1e8), default=0.0)
        byte_ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        table = [byte_ids[f"<0x{b:02X}>"] for b in range(256)] if len(byte_ids) == 256 else []
        return cls(sp, pieces, max(map(len, pieces)), lowest - UNKNOWN_PENALTY, table)

    def fallback(self, char: str) -> tuple[float, bytes]:
        """A character that no piece of its own covers: its bytes, or the unknown id."""
        ids = [self.bytes_at[b] for b in char.encode()] if self.bytes_at else [self.processor.unk_id()]
        return self.unknown, struct.pack(f"<{len(ids)}I", *ids)

    @functools.cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character that some piece has beside another (0: none), and which numbers stand side by side."""
        longer = [p for p in self.pieces if len(p) > 1]
        known = {c: i for i, c in enumerate(sorted({c for p in longer for c in p}), 1)}
        number = np.zeros(max(map(ord, known), default=0) + 2, np.int32)
        number[[ord(c) for c in known]] = list(known.values())
        beside = np.zeros((len(known) + 1, len(known) + 1), bool)
        for piece in longer:
            for a, b in zip(piece, piece[1:], strict=False):
                beside[known[a], known[b]] = True
        return number, beside

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of normalised texts, one after another, and where each text's begin and end among them."""
        number, beside = self.neighbours
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        own = number[np.minimum(codes, len(number) - 1)]
        begins = np.ones(len(codes) + 1, bool)
        begins[1:-1] = ~beside[own[:-1], own[1:]]
        ends = np.cumsum([0, *map(len, texts)])
        begins[ends] = True
        sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.concatenate([[0], np.cumsum(sizes)])[begins].astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(whole.encode())])
        return words, (np.cumsum(begins) - 1)[ends]

    @functools.cached_property
    def byte_sizes(self) -> np.ndarray:
        return np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))

    @functools.cached_property
    def bytes_of(self) -> list[bytes]:
        """The bytes that each id stands for."""
        sp = self.processor
        places = {i: b for b, i in enumerate(self.bytes_at)}
        return [bytes([places[i]]) if i in places else b"" if sp.is_control(i) else b"\xef\xbf\xbd" if sp.is_unknown(i) else sp.id_to_piece(i).encode() for i in range(sp.get_piece_size())]


def lattice_n_best(model: Model, word: str, n: int) -> list[Path]:
    """The ``n`` best paths through the lattice of ``word``, best first, in a fixed order among equals."""
    size, find, longest = len(word), model.pieces.get, model.longest
    into: list[list[tuple[int, float, bytes]]] = [[] for _ in range(size + 1)]
    forward = [0.0] + [-math.inf] * size
    for at in range(size):
        so_far = forward[at]
        for end in range(at + 1, min(size, at + longest) + 1):
            found = find(word[at:end])
            if found is None:
                if end > at + 1:
                    continue
                found = model.fallback(word[at])
            score, ids = found
            into[end].append((at, score, ids))
            if so_far + score > forward[end]:
                forward[end] = so_far + score
    # An entry: (-best full score, place, order of entry, score so far, ids so far with the rest of them behind). Among
    # equals those nearest the start come first, so that ties never widen the search.
    queue: list[tuple] = [(-forward[size], size, 0, 0.0, None)]
    out: list[Path] = []
    entered = 0
    while queue and len(out) < n:
        _, at, _, behind, path = heapq.heappop(queue)
        if not at:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            out.append((behind, b"".join(ids)))
            continue
        for start, score, ids in into[at]:
            entered += 1
            heapq.heappush(queue, (-(forward[start] + score + behind), start, entered, score + behind, (ids, path)))
    return out


def restores(model: Model, words: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """Whether decoding its ids gives each word back: all at once where they do, one by one otherwise."""
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    plain = [w.encode() for w in words]
    ends = np.concatenate([[0], np.cumsum(model.byte_sizes[flat])])[np.cumsum([0, *map(len, ids)])]
    if (np.diff(ends) == np.fromiter(map(len, plain), np.int64, len(plain))).all() and b"".join(map(model.bytes_of.__getitem__, flat.tolist())) == b"".join(plain):
        return np.ones(len(words), bool)
    return np.fromiter((decode_ids(model, x.tolist()) == w for w, x in zip(words, ids, strict=True)), bool, len(words))


class WordLists(dict):
    """Word -> its n best paths, each checked by decoding; emptied when ``most`` words are held."""

    def __init__(self, model: Model, n: int, most: int = 30_000):
        self.model, self.n, self.most = model, n, most

    def __missing__(self, word: str) -> list[Checked]:
        if len(self) >= self.most:
            self.clear()
        paths = lattice_n_best(self.model, word, self.n)
        whole = restores(self.model, [word] * len(paths), [np.frombuffer(ids, "<u4") for _, ids in paths]).tolist()
        found = self[word] = [(*path, x) for path, x in zip(paths, whole, strict=True)]
        return found


def combine(lists: list[list[Checked]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best choices of one path from each list: how much less than the best, and which path of each list."""
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for paths in lists:
        best = heapq.nsmallest(n, ((cost + paths[0][0] - score, (*chosen, j)) for cost, chosen in best for j, (score, *_) in enumerate(paths[:n])))
    return best


class WordCoder:
    """Best path, its score, the gap to the second best path and whether decoding restores the word, of many words at once,
    remembered for ``most`` words."""

    WIDEST = 32
    BATCH = 2048
    #: Bits of the first table of pieces by hash; pieces whose place is taken go to the next table, of other bits.
    TABLE = 20

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, most
        rng = np.random.default_rng(11)
        self.base = np.uint64(rng.integers(1 << 62, 1 << 63) | 1)
        hashed = sorted((self._hash(p), score, struct.unpack("<I", ids)[0]) for p, (score, ids) in model.pieces.items())
        self.hashes = np.array([x[0] for x in hashed], np.uint64)
        self.scores = np.array([x[1] for x in hashed])
        self.ids_of = np.array([x[2] for x in hashed], np.uint32)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        rest = np.arange(len(self.hashes))
        while len(rest):
            factor = np.uint64(rng.integers(1 << 62, 1 << 63) | 1)
            table = np.zeros(1 << self.TABLE, np.int32)
            place = self._place(self.hashes[rest], factor)
            table[place] = rest
            self.tables.append((factor, table))
            rest = rest[table[place] != rest]
        self.powers = np.ones(self.WIDEST + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.WIDEST):
                self.powers[i + 1] = self.powers[i] * self.base
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.best, self.gaps, self.whole = np.zeros(0), np.zeros(0), np.zeros(0, bool)
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _hash(self, piece: str) -> int:
        out = 0
        for c in mix(np.array([ord(c) + 1 for c in piece], np.uint64)).tolist():
            out = (out * int(self.base) + c) % (1 << 64)
        return out

    def _place(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * factor) >> np.uint64(64 - self.TABLE)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the piece of each hash is, and whether there is one."""
        at = self.tables[0][1][self._place(keys, self.tables[0][0])]
        hit = self.hashes[at] == keys
        for factor, table in self.tables[1:]:
            rest = np.flatnonzero(~hit)
            more = table[self._place(keys[rest], factor)]
            good = self.hashes[more] == keys[rest]
            at[rest[good]] = more[good]
            hit[rest[good]] = True
        return at, hit

    def _many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Scores, gaps and ids of ``words`` in order of falling length, and which of them need a search of their own."""
        model, width, long = self.model, max(map(len, words)), self.model.longest
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        chars = np.array(words, f"U{width}").view(np.uint32).reshape(n, width)
        fall = np.array([model.bytes_at[c] for c in range(128)] if model.bytes_at else [model.processor.unk_id()] * 128, np.uint32)
        prefix = np.zeros((n, width + 1), np.uint64)
        forward, behind = np.full((n, width + 1), -np.inf), np.full((n, width + 1), -np.inf)
        forward[:, 0] = 0
        step, mark = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.uint32)
        edge = np.full((width + 1, long + 1, n), -np.inf)
        odd = np.zeros(n, bool)
        with np.errstate(over="ignore"):
            mixed = mix(chars.astype(np.uint64) + np.uint64(1))  # no character counts as nothing
            for e in range(1, width + 1):
                live = int(np.searchsorted(-sizes, -e, "right"))
                prefix[:live, e] = prefix[:live, e - 1] * self.base + mixed[:live, e - 1]
                for k in range(1, min(long, e) + 1):
                    key = prefix[:live, e] - prefix[:live, e - k] * self.powers[k]
                    at, hit = self._find(key)
                    score, ids = np.where(hit, self.scores[at], -np.inf), self.ids_of[at]
                    if k == 1:
                        code = chars[:live, e - 1]
                        odd[:live] |= ~hit & (code >= 128)
                        score = np.where(hit, score, model.unknown)
                        ids = np.where(hit, ids, fall[np.minimum(code, 127)])
                    edge[e, k, :live] = score
                    total = forward[:live, e - k] + score
                    better = total > forward[:live, e]
                    forward[:live, e] = np.where(better, total, forward[:live, e])
                    step[:live, e] = np.where(better, k, step[:live, e])
                    mark[:live, e] = np.where(better, ids, mark[:live, e])
        rows = np.arange(n)
        behind[rows, sizes] = 0
        for e in range(width, 0, -1):
            for k in range(1, min(long, e) + 1):
                behind[:, e - k] = np.maximum(behind[:, e - k], edge[e, k] + behind[:, e])
        at, path = sizes.copy(), []
        best = forward[rows, sizes]
        taken = np.zeros(edge.shape, bool)
        while (at > 0).any():
            on = at > 0
            path.append(np.where(on, mark[rows, at], np.uint32(0)))
            taken[at[on], step[rows, at][on], rows[on]] = True
            at = at - np.where(on, step[rows, at], 0)
        second = np.full(n, -np.inf)
        for e in range(1, width + 1):
            for k in range(1, min(long, e) + 1):
                through = forward[:, e - k] + edge[e, k] + behind[:, e]
                second = np.maximum(second, np.where(taken[e, k], -np.inf, through))
        count = taken.sum(axis=(0, 1))
        table = np.stack(path[::-1], axis=1) if path else np.zeros((n, 0), np.uint32)
        return best, best - second, [row[len(path) - c :] for row, c in zip(table, count.tolist(), strict=True)], odd

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > self.most:
            self.forget()
            new = list(words)
        new.sort(key=len, reverse=True)
        best, gaps, ids = np.zeros(len(new)), np.zeros(len(new)), []
        alone = next((i for i, w in enumerate(new) if len(w) <= self.WIDEST), len(new))
        own = list(range(alone))
        ids = [np.zeros(0, np.uint32)] * alone
        for i in range(alone, len(new), self.BATCH):
            part = slice(i, i + self.BATCH)
            best[part], gaps[part], more, odd = self._many(new[part])
            ids += more
            own += (i + np.flatnonzero(odd)).tolist()
        for i in own:
            paths = lattice_n_best(self.model, new[i], 2)
            best[i], gaps[i] = paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
            ids[i] = np.frombuffer(paths[0][1], "<u4")
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.best, self.gaps = np.concatenate([self.best, best]), np.concatenate([self.gaps, gaps])
        self.whole = np.concatenate([self.whole, restores(self.model, new, ids)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids])])
        self.flat = np.concatenate([self.flat, *ids])

    def places(self, words: list[str]) -> np.ndarray:
        self.learn(words)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


@functools.cache
def model_of(path: str) -> Model:
    return Model.load(path)


@functools.cache
def coders_of(path: str, n: int) -> tuple[WordCoder, WordLists]:
    """This worker's coders: what one task has learnt serves the next."""
    return WordCoder(model_of(path)), WordLists(model_of(path), n)


def normalised(model: Model, text: str) -> str:
    return model.processor.normalize(text) if text else ""


def text_n_best(coder: WordCoder, lists: WordLists, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray, bool]]]:
    """For each normalised text the scores and ids of its ``n`` best segmentations, and whether decoding gives the text back:
    no piece crosses words, so it does if each word's ids give that word back."""
    words, ends = coder.model.words(texts)
    flat = words.dictionary_encode()
    codes, distinct = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    at = coder.places(distinct)[codes] if distinct else np.zeros(0, np.int64)
    for a, b in zip(ends, ends[1:], strict=False):
        own = at[a:b]
        gaps, starts, sizes = coder.gaps[own], coder.starts[own], coder.starts[own + 1] - coder.starts[own]
        stops = np.cumsum(sizes)
        ids = coder.flat[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - stops + sizes, sizes)]
        total, whole = float(coder.best[own].sum()), coder.whole[own]
        broken = int(len(whole) - whole.sum())
        close = np.sort(np.argsort(gaps, kind="stable")[: n - 1])
        close = close[np.isfinite(gaps[close])]
        found = [lists[distinct[i]] for i in codes[a + close].tolist()]
        out = []
        for cost, chosen in combine(found, n):
            parts, last, wrong = [], 0, broken
            for i, paths, j in zip(close.tolist(), found, chosen, strict=True):
                if j:
                    wrong += int(whole[i]) - int(paths[j][2])
                    parts += [ids[last : stops[i] - sizes[i]], np.frombuffer(paths[j][1], "<u4")]
                    last = stops[i]
            out.append((total - cost, np.concatenate([*parts, ids[last:]]) if parts else ids, not wrong))
        yield out


def n_best(df: DataFrame, model_path: str, *, n: int = 4, id_col: str = "doc_id", text_col: str = "text", ids_as: str | None = "array", group_bytes: int = 2 << 20) -> DataFrame:
    """``id_col, rank, score, n_pieces, ids_crc32, restored, ids``: up to ``n`` rows a text.

    Rank 1 is the best segmentation. ``ids`` is an array, or with ``ids_as="binary"`` the ids as little-endian unsigned
    32-bit numbers, which Spark writes and reads several times faster; it is left out for None. ``ids_crc32`` is of those
    bytes; ``restored`` tells whether decoding the ids gives the normalised text back. A null or empty text has one empty segmentation. Null
    ids and repeated rows pass through. Whole texts are segmented; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lists = coders_of(model_path, n)
        model = coder.model
        for batch in batches:
            keys, sizes, texts = batch.columns
            for part in slices_by_bytes(sizes.to_numpy(), group_bytes):
                rows, row_of, all_ids = [], [], []
                plain = [normalised(model, x) for x in texts[part].fill_null("").to_pylist()]
                for r, found in enumerate(text_n_best(coder, lists, plain, n)):
                    for rank, (score, ids, whole) in enumerate(found, 1):
                        rows.append((rank, score, len(ids), zlib.crc32(ids.astype("<u4", copy=False).data), whole))
                        row_of.append(r)
                        if ids_as:
                            all_ids.append(ids)
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                names = [id_col, "rank", "score", "n_pieces", "ids_crc32", "restored"]
                if ids_as:
                    ends, flat = np.cumsum([0, *map(len, all_ids)]), np.concatenate(all_ids).astype("<u4", copy=False)
                    if ids_as == "binary":
                        columns.append(pa.Array.from_buffers(pa.binary(), len(all_ids), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(flat)]))
                    else:
                        columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([keys[part].take(pa.array(row_of, pa.int64())), *columns], names)

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"), F.col(text_col))
    return picked.mapInArrow(work, f"`{id_col}` {kind}, rank int, score double, n_pieces long, ids_crc32 long, restored boolean" + {"array": ", ids array<int>", "binary": ", ids binary", None: ""}[ids_as])


def decode_ids(model: Model, ids: list[int]) -> str:
    """Normalised text of ``ids``: pieces one after another, runs of byte pieces read as UTF-8."""
    return b"".join(map(model.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def decode(df: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text of ``ids_col`` (an array or bytes, as of ``n_best``) in ``text_col``: spaces for the space mark, without the one put before the
    text. Null ids give a null text, no ids an empty one."""
    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        model = model_of(model_path)
        return pd.Series([None if x is None else decode_ids(model, np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x).replace(SPACE, " ").removeprefix(" ") for x in ids])

    return df.withColumn(text_col, text_of(ids_col))
