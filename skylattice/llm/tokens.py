"""Operator 7: token counts from batched encoding, and the chunk coder that the packing operator shares.

Texts are cut at white space where a pre-tokenizer cannot tell the difference. Each distinct chunk is encoded once per
worker, in batches; a text's count or ids are gathered from its chunks with Arrow and numpy. Only lengths leave the
count operator.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space (and NUL, our own mark) after which a lone space may belong to a longer run. Fixed values.
ODD = r"[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n][ \n]|[ \n]$"
#: A place inside a text before a single space or line feed that stands between two characters that are not white space.
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def load_tokenizer(path: str):
    """A tokenizer of the ``tokenizers`` library (.json) or of ``sentencepiece`` (.model)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def slices_by_bytes(sizes: np.ndarray, budget: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about ``budget``; a larger row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > budget:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


class ChunkCoder:
    """Ids of texts under a ``tokenizers`` tokenizer, by way of chunks that begin at a lone space or line feed.

    Word and byte level pre-tokenizers never let a piece run across such a place, and no special token holds white
    space, so the ids of the chunks, one after another, are the ids of the text. Texts with other white space, or runs of
    it, are cut by ``SAFE`` instead, which looks at both neighbours. ``most`` bounds the chunks remembered by a worker.
    """

    def __init__(self, path: str, most: int = 600_000, batch: int = 8192):
        self.tokenizer, self.most, self.batch = load_tokenizer(path), most, batch
        # Byte-level vocabularies write a space as U+0120 and a line feed as U+010A.
        begins = [(self.tokenizer.id_to_token(i) or "")[:1] in ("\u0120", "\u010a") for i in range(self.tokenizer.get_vocab_size())]
        drops_spaces = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.opens = None if drops_spaces or not any(begins) else np.array(begins)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.ids = [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
        self.size = 0

    def encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and how many each has."""
        found = [x.ids for i in range(0, len(texts), self.batch) for x in self.tokenizer.encode_batch_fast(texts[i : i + self.batch], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def encode_spaced(self, texts: list[str], group: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that begin with their only space or line feed. Put one after another they are a text that
        falls apart into them, so a group is encoded in one call, and a chunk's first id is one that such a byte begins."""
        if self.opens is None:
            return self.encode_chunks(texts)
        groups = [texts[i : i + group] for i in range(0, len(texts), group)]
        ids, sizes = [], []
        for i in range(0, len(groups), self.batch):
            some = groups[i : i + self.batch]
            for chunks, x in zip(some, self.tokenizer.encode_batch_fast(list(map("".join, some)), add_special_tokens=False), strict=True):
                own = np.array(x.ids, np.uint32)
                starts = np.flatnonzero(self.opens[own])
                if len(starts) == len(chunks) and starts[0] == 0:
                    ids.append(own)
                    sizes.append(np.diff(starts, append=len(own)))
                else:
                    for part, kept in zip(self.encode_chunks(chunks), (ids, sizes), strict=True):
                        kept.append(part)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def places(self, keys: list[str]) -> np.ndarray:
        """The places of ``keys`` among the remembered chunks; a key is a chunk without its space, or behind NUL as it stands."""
        if len(self.index) + len(keys) > self.most:
            self.forget()
        index = self.index
        new = [k for k in keys if k not in index]
        if new:
            new.sort(key=lambda k: k[:1] == "\0")
            alone = next((i for i, k in enumerate(new) if k[:1] == "\0"), len(new))
            ids, sizes = map(np.concatenate, zip(self.encode_spaced([k if k[:1] == "\n" else " " + k for k in new[:alone]]), self.encode_chunks([k[1:] for k in new[alone:]]), strict=True))
            self.starts.append(self.size + np.cumsum(sizes))
            self.ids.append(ids)
            self.size += len(ids)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.starts, self.ids = [np.concatenate(self.starts)], [np.concatenate(self.ids)]
        return np.fromiter(map(index.__getitem__, keys), np.int64, len(keys))

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all chunks of ``texts`` (no nulls), and where each text's chunks begin and end among them."""
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\0"), pc.if_else(odd, "", texts), ""), "\n", " \n"), " ")
        if pc.any(odd).as_py():
            rows = plain.to_pylist()
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                rows[i] = ["\0" + x for x in SAFE.split(texts[int(i)].as_py())]
            plain = pa.array(rows, pa.list_(pa.string()))
        words = plain.flatten().dictionary_encode()
        offsets = plain.offsets.to_numpy().astype(np.int64)
        return self.places(words.dictionary.to_pylist())[words.indices.to_numpy()], offsets - offsets[0]

    def counts(self, texts: pa.Array) -> np.ndarray:
        places, offsets = self.cut(texts)
        sizes = np.diff(self.starts[0])[places]
        return np.diff(np.concatenate([[0], np.cumsum(sizes)])[offsets])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` and the offsets of each text's among them."""
        places, offsets = self.cut(texts)
        starts = self.starts[0]
        sizes = np.diff(starts)[places]
        ends = np.cumsum(sizes)
        ids = self.ids[0][np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - ends + sizes, sizes)]
        return ids, np.concatenate([[0], ends])[offsets]


@functools.cache
def coder_of(path: str) -> ChunkCoder:
    """This worker's coder: what one task has learnt serves the next."""
    return ChunkCoder(path)


def count_tokens(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, group_bytes: int = 8 << 20) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row of ``df``.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows pass through, one result a row; an empty
    table gives an empty result. Other columns of ``df`` are not read. A whole text is always counted: long ones are cut
    at white space (``ChunkCoder``), and a stretch without white space is encoded in one piece. ``.model`` files are
    counted text by text, since a sentence piece model may merge across white space.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_tokenizer(tokenizer_path) if tokenizer_path.endswith(".model") else coder_of(tokenizer_path)
        for batch in batches:
            ids, n_bytes, texts = batch.columns
            totals = []
            for part in slices_by_bytes(n_bytes.to_numpy(), group_bytes):
                some = texts[part].fill_null("")
                totals.append(coder.counts(some) if isinstance(coder, ChunkCoder) else np.array([len(x) for x in coder.encode(some.to_pylist(), num_threads=1)], np.int64))
            n = np.concatenate(totals or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col))
    return picked.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
