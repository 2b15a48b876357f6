"""Operator 5: quality rules with a line labeller. A linear-chain conditional random field marks each line as content or
boilerplate; Viterbi decoding and the share of words in content lines decide whether a document stays.

Labels are known for documents only. Labels of lines are latent: at first each line bears its document's, then a model of
single lines and the labels are fitted in turn, under the constraint that most words of a document bear its label. The
field is fitted on the sample's own sequences and on mixed ones, in which lines of one kind stand between those of the
other, so that it learns how kinds follow one another within a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices_by_bytes
from .words import Words, mix, split_words, windows

#: Labelled documents that the field is fitted on, at most (the ones whose hashed ids come first), and bytes of each, at most:
#: longer documents are not in the sample, others are in it whole.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 16
FEATURES = ("bias", "log_words", "word_length", "symbols", "other_marks", "capitals", "digits", "few_distinct", "seen_before", "no_stop", "short", "bars")


def line_table(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts of each text and the features of each of its lines: (per text, features, line offsets)."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    n, docs = len(lines), len(texts)
    doc_of = np.repeat(np.arange(docs), np.diff(offsets))
    words = split_words(lines)
    per_line = np.diff(words.offsets)
    sizes = words.map(len, np.int64)
    running = lambda x, at: np.concatenate([[0], np.cumsum(x)])[at]
    count = lambda pattern: pc.count_substring_regex(lines, pattern).to_numpy().astype(np.float64)
    chars = np.maximum(np.diff(running(sizes, words.offsets)), 1).astype(np.float64)
    symbols = count(r"[#*$%&|<>]")

    text_of_line = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    key = doc_of * (n + 1) + text_of_line
    first = np.zeros(n, bool)
    first[np.unique(key, return_index=True)[1]] = True
    again = ~first & (per_line > 0)

    line_of_word = np.repeat(np.arange(n), per_line)
    pairs = np.unique(line_of_word * (len(words.distinct) + 1) + words.codes)
    distinct = np.bincount(pairs // (len(words.distinct) + 1), minlength=n)

    doc_words = Words(words.codes, words.offsets[offsets], words.distinct)
    hashed, starts = windows(words.codes, doc_words.offsets, 5)
    with np.errstate(over="ignore"):
        hashed = mix(hashed + doc_words.rows[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(starts) else hashed
    _, back, times = np.unique(hashed, return_inverse=True, return_counts=True)
    twice = starts[times[back] > 1] if len(starts) else starts
    edge = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    covered = np.cumsum(edge)[:-1] > 0

    by_doc = lambda x: np.diff(running(x, offsets))
    counts = {
        "n_words": np.diff(doc_words.offsets),
        "word_chars": np.diff(running(sizes, doc_words.offsets)),
        "n_symbols": by_doc(symbols.astype(np.int64)),
        "n_dup_lines": by_doc(again.astype(np.int64)),
        "n_repeat_words": np.diff(running(covered.astype(np.int64), doc_words.offsets)),
    }
    safe = np.maximum(per_line, 1)
    features = np.stack(
        [
            np.ones(n),
            np.log1p(per_line) / 4,
            np.minimum(chars / safe / 10, 3),
            np.minimum(symbols / safe, 2),
            np.minimum(count(r"[^\pL\pN\s.,;:'\"?()#*$%&|<>-]") / safe, 2),
            count(r"\p{Lu}") / chars,
            count(r"[0-9]") / chars,
            1 - distinct / safe,
            again.astype(np.float64),
            1.0 - pc.match_substring_regex(lines, r"[.?!:;\"')]\s*$").to_numpy(zero_copy_only=False),
            (per_line < 4).astype(np.float64),
            np.minimum(count(r"\|") / safe, 1),
        ],
        axis=1,
    )
    features[per_line == 0] = 0
    return counts, features, offsets


class LineField:
    """Two-state linear-chain conditional random field: state 1 is content."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros((2, len(FEATURES))) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps

    def _sums(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition, node and edge marginals of padded sequences."""
        e = x @ self.weights.T
        b, t, _ = e.shape
        alpha, beta = np.zeros((b, t, 2)), np.zeros((b, t, 2))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            step = np.logaddexp.reduce(alpha[:, i - 1, :, None] + self.steps, axis=1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            step = np.logaddexp.reduce(self.steps + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where(mask[:, i + 1, None], step, beta[:, i])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + self.steps + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        return z, node, edge

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.2, penalty: float = 1e-4) -> LineField:
        """Adam on the penalised conditional log-likelihood."""
        gold = np.eye(2)[y] * mask[..., None]
        gold_w = np.einsum("bts,btf->sf", gold, x)
        gold_t = np.einsum("bts,btu->su", gold[:, :-1], gold[:, 1:] * mask[:, 1:, None])
        n = mask.sum()
        theta = np.concatenate([self.weights.ravel(), self.steps.ravel()])
        m = v = np.zeros_like(theta)
        for i in range(1, rounds + 1):
            _, node, edge = self._sums(x, mask)
            slope = np.concatenate([(gold_w - np.einsum("bts,btf->sf", node, x)).ravel(), (gold_t - edge.sum((0, 1))).ravel()]) / n - penalty * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            self.weights, self.steps = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
        return self

    def decode(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Viterbi labels (True: content) of the lines of every text; ties go to content."""
        gap = (features @ (self.weights[1] - self.weights[0])).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        labels = np.ones(len(gap), bool)
        ends = offsets.tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            boil, content, back = 0.0, gap[a] if b > a else 0.0, []
            for g in gap[a + 1 : b]:
                from_boil_0, from_boil_1 = boil + s00 > content + s10, boil + s01 > content + s11
                back.append((from_boil_0, from_boil_1))
                boil, content = (boil + s00 if from_boil_0 else content + s10), (boil + s01 if from_boil_1 else content + s11) + g
            state = content >= boil
            for i in range(b - 1, a - 1, -1):
                labels[i] = state
                if i > a:
                    state = not back[i - a - 1][state]
        return labels


def line_targets(features: np.ndarray, offsets: np.ndarray, words: np.ndarray, quality: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Latent labels of lines (1: content), given those of their documents.

    In turn a model of single lines is fitted to the labels, both kinds of equal weight, and lines take the label it gives
    them; a document most of whose words would then not bear its own label keeps that for all its lines.
    """
    n_lines = np.diff(offsets)
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    own = (quality > 0).astype(np.int64)[doc]
    y, theta = own, np.zeros(features.shape[1])
    counts = words > 0
    for _ in range(rounds):
        weight = np.where(y == 1, 1 / max(1, (counts & (y == 1)).sum()), 1 / max(1, (counts & (y == 0)).sum())) * counts
        for _ in range(12):  # Newton steps of a penalised logistic regression
            p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
            slope = features.T @ (weight * (y - p)) - 1e-3 * theta
            bend = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(len(theta))
            theta = theta + np.linalg.solve(bend, slope)
        y = np.where(counts, features @ theta >= 0, own).astype(np.int64)
        agree = np.bincount(doc, words * (y == own), len(n_lines)) * 2 >= np.bincount(doc, words, len(n_lines))
        y = np.where(agree[doc], y, own)
    return y


def mixed(cuts: list[np.ndarray], y: np.ndarray, kinds: np.ndarray, most: int = 8) -> list[np.ndarray]:
    """Sequences of lines (given as places in ``y``) into each of which a run of up to ``most`` lines of the other kind is put."""
    rng = np.random.default_rng(7)
    of_kind = [[c[y[c] == k] for c, own in zip(cuts, kinds.tolist(), strict=True) if own == k] for k in (0, 1)]
    out = []
    for kind in (0, 1):
        hosts, guests = of_kind[kind], of_kind[1 - kind]
        for i in range(min(len(hosts), len(guests))):
            host, guest = hosts[rng.integers(len(hosts))], guests[rng.integers(len(guests))]
            if len(host) and len(guest):
                a, at = rng.integers(len(guest)), rng.integers(len(host) + 1)
                out.append(np.concatenate([host[:at], guest[a : a + rng.integers(1, most + 1)], host[at:]]))
    return out


def fit_field(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, longest: int = 48) -> LineField | None:
    """A field fitted on the lines of at most ``sample`` labelled documents of at most ``sample_bytes`` bytes (so that no more
    than their product reaches the driver), in sequences of ``longest`` lines. Only fitting is bounded: ``judge`` reads
    every text whole. None if the sample lacks one of the two labels."""
    known = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(quality_col).cast("int").alias("quality"))
    # Twice as many as are wanted, as some may be too long or absent.
    chosen = known.orderBy(F.xxhash64("doc"), "doc", "quality").limit(2 * sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(F.octet_length(text) <= sample_bytes).select(F.col(id_col).alias("doc"), text.alias("text")).join(F.broadcast(chosen), "doc").orderBy(F.xxhash64("doc"), "doc", "text").limit(sample).select("text", "quality").toArrow()
    quality = rows["quality"].to_numpy().astype(np.int64)
    if len(set((quality > 0).tolist())) < 2:
        return None
    _, features, offsets = line_table(rows["text"].combine_chunks())
    y = line_targets(features, offsets, words_of(features), quality)
    parts = [(np.arange(a, min(a + longest, end)), q > 0) for start, end, q in zip(offsets, offsets[1:], quality, strict=False) for a in range(start, end, longest)]
    cuts = [c for c, _ in parts]
    cuts += mixed(cuts, y, np.array([int(k) for _, k in parts]))
    width = max(map(len, cuts))
    x, mask, gold = np.zeros((len(cuts), width, len(FEATURES))), np.zeros((len(cuts), width), bool), np.zeros((len(cuts), width), np.int64)
    for i, c in enumerate(cuts):
        x[i, : len(c)], mask[i, : len(c)], gold[i, : len(c)] = features[c], True, y[c]
    return LineField().fit(x, mask, gold)


def words_of(features: np.ndarray) -> np.ndarray:
    """Words of each line, from its features."""
    return np.rint(np.expm1(features[:, 1] * 4))


def judge(df: DataFrame, field: LineField | None, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5, with_lines: bool = False, group_bytes: int = 4 << 20) -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept`` a row, and the
    labels of its lines in ``lines``, if asked for (true: content).

    A null text has no words, fails the base rules and is not kept. Null ids and repeated rows pass through. Without a
    field (no labelled documents of both kinds) the base rules decide alone. Whole texts are read; other columns are not.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, texts = batch.columns
            for part in slices_by_bytes(sizes.to_numpy(), group_bytes):
                some = texts[part].fill_null("")
                counts, features, offsets = line_table(some)
                words = counts["n_words"]
                failed = (words < 10) | (100 * counts["n_repeat_words"] > 20 * words)
                label = np.ones(len(features), bool) if field is None else field.decode(features, offsets)
                content = np.diff(np.concatenate([[0], np.cumsum(words_of(features) * label)])[offsets]) / np.maximum(words, 1)
                kept = ~failed & (content >= share)
                columns = [ids[part], *(pa.array(counts[x], pa.int64()) for x in names), pa.array(failed), pa.array(content), pa.array(kept)]
                if with_lines:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(label)))
                yield pa.RecordBatch.from_arrays(columns, [id_col, *names, "base_failed", "content_share", "kept", "lines"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"), F.col(text_col))
    return picked.mapInArrow(work, f"`{id_col}` {kind}, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, content_share double, kept boolean" + ", lines array<boolean>" * with_lines)


def keep_good(df: DataFrame, field: LineField | None, *, text_col: str = "text", share: float = 0.5) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, all columns as they were, by one pass over the rows themselves."""
    schema = df.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
            for part in slices_by_bytes(pc.binary_length(texts).to_numpy(), 4 << 20):
                counts, features, offsets = line_table(texts[part])
                words = counts["n_words"]
                good = ~((words < 10) | (100 * counts["n_repeat_words"] > 20 * words))
                if field is not None:
                    good &= np.diff(np.concatenate([[0], np.cumsum(words_of(features) * field.decode(features, offsets))])[offsets]) >= share * np.maximum(words, 1)
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(good))

    return df.mapInArrow(work, schema)
