"""Operator 13: byte-pair encoding by a priority queue of merge ranks over a doubly linked list of symbols, and decoding by
putting vocabulary strings one after another.

A pre-token starts as one symbol a character. Each pair of neighbours with a merge rank waits in a heap; the lowest rank,
leftmost first, is merged, its neighbours are linked anew and make new entries. An entry whose symbols have changed since is
stale and skipped, so a pre-token of n symbols takes n log n steps however long it is. Only the normaliser and the
pre-tokenizer of the file are the library's.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkCoder, slices_by_bytes
from .words import split_words

#: The pre-tokenizer pattern that ``PLAIN`` stands in for. A fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What it finds in printable ASCII, in lower case.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")


def byte_symbols() -> dict[str, int]:
    """The byte of each character by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the
    others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of one BPE file of the ``tokenizers`` format."""

    def __init__(self, path: str, tokenizer):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("lstrip", "rstrip", "single_word", "normalized") if any(x[k] for x in spec["added_tokens"])]
        decoder = (spec["decoder"] or {}).get("type")
        if model["type"] != "BPE" or odd or decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path}: not a plain BPE file ({model['type']}, {odd}, {decoder})")
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        #: By a symbol's id: the rank of its merge with each symbol that may follow it.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(self.vocab.values()) + 1)]
        for i, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a]][self.vocab[b]] = i
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        strings = {i: s for s, i in (self.vocab | self.special).items()}
        if decoder:
            of = byte_symbols()
            self.strings = {i: bytes(of[c] for c in s) if all(c in of for c in s) else s.encode() for i, s in strings.items()}
        else:
            self.strings = {i: s.encode() for i, s in strings.items()}
        #: What stands between two vocabulary strings of a decoded text.
        self.between = b"" if decoder else b" "
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.plain = steps[0].get("pattern") == {"Regex": WORD_PATTERN} and normal == ["NFC", "Replace", "Lowercase"]
        self.known: dict[str, list[int]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if self.plain and text.isascii() and text.isprintable():
            return [text.lower()] if text.isalpha() else PLAIN.findall(text.lower())
        return [x for x, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)]

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token. A queue entry is a rank, then the place of the pair's left symbol."""
        ranks, made = self.ranks, self.made
        ids = [self.vocab[c] for c in word[:-1]]
        ids.append(self.vocab[word[-1:] + self.suffix])
        end = len(ids)
        if end == 1:
            return ids
        bits = end.bit_length()
        places = (1 << bits) - 1
        queue = [ranks[a][b] << bits | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if b in ranks[a]]
        heapify(queue)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        ids.append(-1)  # merged away, and what follows the last symbol
        while queue:
            entry = heappop(queue)
            at, rank = entry & places, entry >> bits
            other = after[at]
            if ids[at] < 0 or ranks[ids[at]].get(ids[other]) != rank:
                continue  # stale: one of its symbols was merged since
            ids[at] = new = made[rank]
            ids[other] = -1
            after[at] = right = after[other]
            if right < end:
                before[right] = at
                if (found := ranks[new].get(ids[right])) is not None:
                    heappush(queue, found << bits | at)
            left = before[at]
            if left >= 0 and (found := ranks[ids[left]].get(new)) is not None:
                heappush(queue, found << bits | left)
        return [i for i in ids if i >= 0]

    def encode(self, text: str, most: int = 200_000) -> list[int]:
        """Ids of a text; ``most`` bounds the pre-tokens remembered."""
        out: list[int] = []
        for part in self.splits.split(text) if self.splits else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word in self.pre_tokens(part) if part else ():
                ids = self.known.get(word)
                if ids is None:
                    ids = self.merge(word)
                    if len(self.known) >= most:
                        self.known.clear()
                    self.known[word] = ids
                out += ids
        return out

    def string(self, ids: list[int]) -> bytes:
        """Vocabulary strings of ``ids``, those of unknown ids left out."""
        return self.between.join([self.strings[i] for i in ids if i in self.strings])


class MergeCoder(ChunkCoder):
    """``ChunkCoder`` whose chunks are encoded by ``Merges``; it also keeps each chunk's decoded string."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__(path, most)
        self.merges = Merges(path, self.tokenizer)

    def forget(self) -> None:
        super().forget()
        self.strings: list[bytes] = []

    def encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.merges.encode(x) for x in texts]
        self.strings += map(self.merges.string, found)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    encode_spaced = encode_chunks

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``ChunkCoder``; where the pre-tokenizer drops white space, chunks are the words between."""
        if not self.merges.plain:
            return super().cut(texts)
        words = split_words(texts)
        return self.places(pc.binary_join_element_wise(pa.scalar("\0"), words.distinct, "").to_pylist())[words.codes], words.offsets

    def code(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids and decoded bytes of each text (no nulls)."""
        places, offsets = self.cut(texts)
        starts = self.starts[0]
        sizes = np.diff(starts)[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[0][np.arange(ends[-1]) + np.repeat(starts[places] - ends[:-1], sizes)]
        full = np.concatenate([[0], np.cumsum(sizes > 0)])[offsets]
        strings = list(map(self.strings.__getitem__, places[sizes > 0].tolist()))
        for i in range(len(texts)):
            yield ids[ends[offsets[i]] : ends[offsets[i + 1]]], self.merges.between.join(strings[full[i] : full[i + 1]])


@functools.cache
def coder_of(path: str) -> MergeCoder:
    """This worker's coder: what one task has learnt serves the next."""
    return MergeCoder(path)


#: Columns that ``code`` can give, and their types.
COLUMNS = {"n_tokens": ("long", pa.int64()), "ids": ("binary", pa.binary()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def code(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), group_bytes: int = 4 << 20) -> DataFrame:
    """``id_col`` and ``columns`` for each row of ``df``: ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers as
    bytes), ``decoded`` (the text that these decode to, broken UTF-8 replaced) and the SHA-256 of both.

    A null text counts as empty: no ids, an empty decoded text. Null ids and repeated rows pass through, one result a row;
    an empty table gives an empty result; other columns of ``df`` are not read. Special strings inside texts are the special
    tokens. Whole texts are encoded, cut only at lone spaces, which no pre-token crosses. Only plain BPE files are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer_path)
        for batch in batches:
            keys, sizes, texts = batch.columns
            for part in slices_by_bytes(sizes.to_numpy(), group_bytes):
                out: dict[str, list] = {c: [] for c in columns}
                for ids, string in coder.code(texts[part].fill_null("")):
                    raw, text = ids.tobytes(), string.decode("utf-8", "replace")
                    made = {"n_tokens": lambda ids=ids: len(ids), "ids": lambda raw=raw: raw, "decoded": lambda text=text: text, "ids_sha256": lambda raw=raw: hashlib.sha256(raw).hexdigest(), "decoded_sha256": lambda text=text: hashlib.sha256(text.encode()).hexdigest()}
                    for c in columns:
                        out[c].append(made[c]())
                yield pa.RecordBatch.from_arrays([keys[part], *(pa.array(out[c], COLUMNS[c][1]) for c in columns)], [id_col, *columns])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col))
    return picked.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{c} {COLUMNS[c][0]}" for c in columns)]))


def decode(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` of each row's ``ids_col``, bytes as ``code`` gives them. Null ids decode to an empty text,
    ids that the vocabulary lacks to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = coder_of(tokenizer_path).merges
        for batch in batches:
            texts = [merges.string(np.frombuffer(x.as_py() or b"", "<u4").tolist()).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded string")
