"""Operator 12: spelling variants, found by walking a trie of all words as a table of edges.

A state says that a word's first ``pos`` letters lead to a trie node with no or one edit. Level by level, states meet the
edges that leave their nodes: without an edit yet, an edge may match, replace a letter or bring an extra one; with one, it must
match. A state that ends on a word with one edit is a pair of neighbours. A letter too few is an extra letter seen from the
other word, and of two words that differ in a letter the smaller one finds the other, so each pair comes up from one side.

One edit leaves a half of a word as it is. So words start on the node of their first half, and once more, read backwards, on
that of their second half: no walk branches near the root, where all words would meet on a few nodes. Edges tell how many
words lie beyond, how long these are and which letters follow, which ends most walks before they are written.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .resample import shift

#: A run of letters in the UTF-8 bytes of a text whose A-Z are in lower case: a-z and U+00C0 to U+00FF.
LETTERS = rb"(?:[a-z]|\xc3[\x80-\xbf])+"
EDGE = ("n", "only", "ends", "shortest", "longest", "follow")


def count_words(df: DataFrame, *, id_col: str, text_col: str, every: int, least_letters: int, most_kept: int = 200_000) -> DataFrame:
    """``word, n`` over all texts. A run of letters loses one where ``every`` divides the CRC of its document and itself.
    Tasks add up their own words first and hold ``most_kept`` of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        pattern = re.compile(LETTERS)
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return made

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                head = crc32(f"{'' if key is None else key}:".encode())
                for raw, n in Counter(pattern.findall((text.as_py() or b"").lower())).items():
                    if len(raw) < least_letters:
                        continue
                    word = raw.decode()
                    if (mark := crc32(raw, head)) % every == 0:
                        at = mark % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_letters:
                        found[word] += n
                if len(found) >= most_kept:
                    yield out()
        yield out()

    return df.select(id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def both_ways(words: DataFrame) -> DataFrame:
    """``key, start``: each word behind ``>`` and, backwards, behind ``<``, and the letters of its half and mark."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    return words.select(F.explode(F.array(F.struct(F.concat(F.lit(">"), "word").alias("key"), (half + 1).alias("start")), F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("key"), (size - half + 1).alias("start")))).alias("k")).select("k.*")


def word_of(key: Column) -> Column:
    letters = F.substring(key, 2, 1 << 30)
    return F.when(F.startswith(key, F.lit(">")), letters).otherwise(F.reverse(letters))


def letter(key: Column | str, at: Column | int) -> Column:
    """The letter behind the first ``at``; empty beyond the end."""
    return F.substring(key, at + 1 if isinstance(at, int) else at + F.lit(1), F.lit(1) if not isinstance(at, int) else 1)


def edge_table(keys: DataFrame, lowest: int) -> DataFrame:
    """The trie from ``lowest`` letters on: ``depth, parent, ch`` and of the words beyond: how many, the only one, whether one
    ends here, the least and greatest length, the letters that may follow (no more than the alphabet)."""
    depth = F.col("depth")
    rows = keys.select("key", F.explode(F.sequence(F.lit(lowest), F.length("key") - 1)).alias("depth"))
    rows = rows.select("depth", F.expr("left(key, depth)").alias("parent"), letter("key", depth).alias("ch"), letter("key", depth + 1).alias("after"), "key")
    size = F.length("key")
    beyond = rows.groupBy("depth", "parent", "ch").agg(F.count("*").alias("n"), F.max("key").alias("only"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.collect_set("after").alias("follow"))
    return beyond.withColumns({"only": F.when(F.col("n") == 1, F.col("only")), "ends": F.col("shortest") == depth + 1})


def walk(keys: DataFrame) -> DataFrame:
    """``a, b``: pairs of words one edit apart, possibly more than once, in one direction only."""
    spark = keys.sparkSession
    spans = keys.agg(F.min("start").alias("low"), F.max("start").alias("high"), F.max(F.length("key")).alias("longest")).first()
    if spans.low is None:
        return spark.createDataFrame([], "a string, b string")
    keys = materialise(keys, "keys")
    edges = materialise(edge_table(keys, spans.low), "edges", ["depth"])
    states, found, depth = None, [], spans.low
    while depth < spans.longest and (depth <= spans.high or states is not None):
        begun = keys.where(F.col("start") == depth).select("key", F.expr(f"left(key, {depth})").alias("node"), F.lit(depth).alias("pos"), F.lit(0).alias("edits"))
        level = step(begun if states is None else begun.unionByName(states), edges.where(F.col("depth") == depth), depth)
        done = materialise(level, "level")
        found.append(done.where("hit is not null").select(word_of(F.col("key")).alias("a"), word_of(F.col("hit")).alias("b")))
        states = done.where("hit is null").select("key", "node", "pos", "edits")
        states = None if states.isEmpty() else states
        depth += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def step(states: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """States on nodes of ``depth`` letters along their edges: ``key, node, pos, edits, hit``, where ``hit`` is the word that
    an ended state has reached."""
    pos, ch, after = F.col("pos"), F.col("ch"), letter("key", F.col("pos"))
    move = lambda to, edits: F.struct(to.alias("to"), F.lit(edits).alias("done"))
    fresh = states.where("edits = 0").join(edges, F.col("node") == F.col("parent"))
    extra, other = move(pos, 1), F.when((after != "") & (ch > after), move(pos + 1, 1))
    fresh = fresh.withColumn("moves", F.when(ch == after, F.array(move(pos + 1, 0))).otherwise(F.array(extra, other)))
    fresh = fresh.withColumn("move", F.explode("moves")).where("move is not null").select("key", "parent", "ch", *EDGE, F.col("move.to").alias("pos"), F.col("move.done").alias("edits"))
    edited = states.where("edits = 1").join(edges, (F.col("node") == F.col("parent")) & (after == ch)).select("key", "parent", "ch", *EDGE, (pos + 1).alias("pos"), "edits")
    moved = fresh.unionByName(edited).withColumn("node", F.concat("parent", "ch"))
    # Of a key's letters, those behind ``pos`` are still to be matched; the word sought is longer by an extra letter, if any.
    size = F.length("key")
    rest = F.substring("key", F.col("pos") + F.lit(1), F.lit(1 << 30))
    alone = (F.col("n") == 1) & (F.col("only") == F.concat("node", rest))
    hit = F.when((F.col("edits") == 1) & alone, F.col("only")).when((F.col("edits") == 1) & (pos == size) & F.col("ends"), F.col("node"))
    sought = size + depth + 1 - pos
    onward = (F.col("n") > 1) & ((F.col("edits") == 0) | ((pos < size) & sought.between(F.col("shortest"), F.col("longest")) & F.array_contains("follow", after)))
    moved = moved.withColumn("hit", hit)
    return moved.where(F.col("hit").isNotNull() | onward).select("key", "node", "pos", "edits", "hit")


def without_each(word: str) -> np.ndarray:
    """CRC of ``word`` without its first letter, without its second and so on, from CRCs of its prefixes alone."""
    raw = np.frombuffer(word.encode("latin-1"), np.uint8)
    prefix = np.zeros(len(raw) + 1, np.uint32)
    for i, byte in enumerate(raw.tolist()):
        prefix[i + 1] = crc32(bytes([byte]), int(prefix[i]))
    left = np.arange(len(raw) - 1, -1, -1)
    behind = shift(prefix[1:], left) ^ prefix[-1]
    return shift(prefix[:-1], left) ^ behind


def long_pairs(words: DataFrame) -> DataFrame:
    """The same pairs among long words, for which a trie is too deep: words meet by the CRC of what stays when a letter is
    taken out, and are compared. A word gives as many rows as it has letters, without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                crcs, size = without_each(word), len(word)
                rows = pa.array([key] * (size + 1)), pa.array([size - 1] * size + [size]), pa.array([*range(size), -1]), pa.array([*crcs.tolist(), crc32(word.encode("latin-1"))])
                yield pa.RecordBatch.from_arrays(list(rows), ["id", "size", "at", "crc"])

    rows = words.select(F.xxhash64("word").alias("id"), "word").mapInArrow(run, "id long, size long, at long, crc long")
    one, two = rows.where("at >= 0"), rows.select(F.col("id").alias("other"), "size", F.col("at").alias("other_at"), "crc")
    met = one.join(two, ["size", "crc"]).where("(other_at = at and id < other) or (other_at = -1 and id <> other)").select("id", "other").distinct()
    text = words.select(F.xxhash64("word").alias("id"), "word")
    met = met.join(text.withColumnRenamed("word", "a"), "id").join(text.select(F.col("id").alias("other"), F.col("word").alias("b")), "other")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_pairs(words: DataFrame, most_letters: int = 64) -> DataFrame:
    """``a, b`` for all pairs of distinct ``word`` one edit apart, each in both directions. Words of up to ``most_letters``
    letters, of which there is a bounded number of levels, walk the trie; longer ones, and those that these may be next to,
    take ``long_pairs``."""
    size = F.length("word")
    pairs = walk(both_ways(words.where(size <= most_letters)))
    if not words.where(size > most_letters).isEmpty():
        far = long_pairs(words.where(size >= most_letters))
        pairs = pairs.unionByName(far.where((F.length("a") > most_letters) | (F.length("b") > most_letters)))
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    return both.distinct()


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """``word, root``: where the forms of each ``word`` with a ``form`` end, by doubling the way ``ceil(log2(hops))`` times."""
    links = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, hops)))):
        onward = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        links = materialise(links.join(onward, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
    return links


def variants(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_letters: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``least_letters`` letters and ``least`` occurrences.

    ``form`` is the most frequent word one edit apart (ties: the smallest), if it occurs ``times`` as often; ``root`` the last
    of a chain of forms, the word itself without one. Each form is at least ``times`` as frequent as its word, so chains are
    short and have no rings. Null texts hold no words; a null id counts as an empty one; repeated rows count each time; an
    empty table gives an empty result; words of any length are taken. Other columns are not read.
    """
    counted = count_words(df, id_col=id_col, text_col=text_col, every=every, least_letters=least_letters)
    words = materialise(counted.where(F.col("n") >= least), "words")
    pairs = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = pairs.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, F.col("word") == F.col("a"), "left")
    fits = -F.col("best.less") >= times * F.col("n")
    found = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    ends = roots(found.where("form is not null"), int(math.log(most, max(2, times))) + 1)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(table: str = "documents") -> str:
    """The same as DuckDB SQL: CRCs bit by bit, neighbours by what stays when a letter is taken out."""
    step = "list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(length(hex(k)) // 2), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
    return f"""with recursive steps as (select list({step} order by i) as t from range(256) r(i)),
r as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from {table}) group by all),
h as (select run, n, {crc} as h from (select *, doc_id || ':' || run as k from r where length(run) >= 6), steps),
w as (select word, sum(n)::bigint as n from (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h) where length(word) >= 6 group by 1 having sum(n) >= 5),
v as (select word, i, substr(word, 1, i::int) || substr(word, i::int + 2) as less from w, unnest(range(length(word))) u(i)),
p as (select x.word as a, y.word as b from v x join v y on x.less = y.less and x.i = y.i and x.word <> y.word union select w.word, v.word from v join w on v.less = w.word union select v.word, w.word from v join w on v.less = w.word),
f as (select a, count(*) as n_near, min((-w.n, b)) as best from p join w on w.word = b group by a),
g as (select word, w.n, coalesce(n_near, 0) as n_near, case when -best[1] >= 5 * w.n then best[2] end as form, case when -best[1] >= 5 * w.n then -best[1] end as form_n from w left join f on a = word),
c as (select word, word as root from g union all select c.word, g.form from c join g on g.word = c.root where g.form is not null),
e as (select word, c.root from c join g using (word) where (select form from g as z where z.word = c.root) is null)
select word, form, root, n, n_near, form_n::bigint as form_n from g join e using (word)"""
