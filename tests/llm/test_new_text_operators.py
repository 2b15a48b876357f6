"""The merge coder, importance resampling and spelling variants against libraries, SQL and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF
from oracles import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylattice.llm import merges, queries, resample, spelling
from skylattice.llm.common import ship, table

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PARTS = ["a", "B", "é", "Σ", "ΑΣ", "İ", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "\x1c", "'s", "'ll", "'S", "1", "23", "<|endoftext|>", "<|startoftext|>", "<|Endoftext|>", "!", "̈", "中", "😀", "\r\n", "​", "\x85", "\0", "the", "ing", "²", "ß", "hel", "lo"]
SCHEMA = "doc_id long, text string, ids string, n_tokens string, decoded string, word string, n string, score string"


def edge_rows():
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "null id text"), (5, long), (6, "é😀  \xa0 a\r\nb  c\x00d"), (7, "x" * 100_000)]
    return [(i, t, *["x"] * 6) for i, t in rows]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names operators use within."""
    ship(spark)
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark, edge):
    return spark.createDataFrame([], SCHEMA)


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", FILES)
def test_merges_equal_the_library(name):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["ab" * 50_000, "e" * 99_999]
    tokenizer, coder = library(name), merges.MergeCoder(public_tokenizers.path(name), most=700)
    coder.merges.known = {}
    expected = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    got = list(coder.code(pa.array(texts)))
    assert [ids.tolist() for ids, _ in got] == expected
    assert [text.decode("utf-8", "replace") for _, text in got] == tokenizer.decode_batch(expected, skip_special_tokens=False)


def test_stale_entries_are_skipped():
    coder = merges.MergeCoder(public_tokenizers.path(FILES[0])).merges
    tokenizer = library(FILES[0])
    for word in ("thethethe", "ththth", "ininin", "aaaaaaa", "andandanda"):
        assert coder.merge(word) == tokenizer.encode(word, add_special_tokens=False).ids


def test_op13_equals_the_library(spark):
    tokenizer = library(FILES[0])
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_merge_queue(spark, SF).collect()}
    assert len(got) == len(docs)
    for row in docs:
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        r = got[row.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("name", FILES)
def test_op13_edges(spark, edge, empty, name):
    path, tokenizer = public_tokenizers.path(name), library(name)
    coded = merges.code(edge, path)
    rows = coded.collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    expected = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in edge_rows()]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=key) == sorted(expected, key=key)
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)
    again = merges.decode(coded.select("doc_id", "ids"), path).collect()
    assert sorted((r.doc_id, r.decoded) for r in again if r.doc_id) == sorted((r.doc_id, r.decoded) for r in rows if r.doc_id)
    assert merges.code(empty, path).collect() == []


def test_other_files_are_refused(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path(FILES[0])))
    spec["model"]["byte_fallback"] = True
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        merges.Merges(str(path), library(FILES[0]))


def brute_draw(docs, target, grams, buckets, percent, least, seed):
    """``resample`` as it is defined, a row at a time."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda t: [zlib.crc32(" ".join(words(t)[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(words(t)) - n + 1)]
    found = [runs(t) for _, t in docs]
    s, t = Counter(b for x in found for b in x), Counter(b for x in target for b in runs(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for (i, text), own in zip(docs, found, strict=True):
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(order[: percent * len(order) // 100])]
    rest = Counter(r[:4] for r in rows)
    rest.subtract(r[:4] for r in drawn)
    return Counter(drawn) + Counter({(*r, None): n for r, n in rest.items() if n > 0})


@pytest.mark.parametrize("n", [1, 2, 5])
def test_gram_crcs_come_from_prefixes(n):
    rng = random.Random(n)
    docs = [[("".join(rng.choice("abcé中9") for _ in range(rng.choice([1, 2, 7, 40, 3000])))).encode() for _ in range(k)] for k in (0, 3, 200, 0, 1, 7, 0)]
    got, rows = resample.gram_crcs(resample.scan(b" ".join(d) for d in docs), n)
    assert list(zip(got.tolist(), rows.tolist(), strict=True)) == [(zlib.crc32(b" ".join(d[i : i + n])), k) for k, d in enumerate(docs) for i in range(len(d) - n + 1)]


def test_op11_equals_its_sql(spark):
    same(queries.op11_crc_resample(spark, SF), queries.ORACLES["op11_crc_resample"], SF)


@pytest.mark.parametrize(("grams", "percent", "least"), [(1, 10, 20), (3, 50, 1), (2, 100, 0), (1, 0, 0)])
def test_op11_edges(spark, edge, empty, grams, percent, least):
    rng = random.Random(7)
    target = [None, "", "The word1 word2, WORD3", "é one"]
    docs = [(i, t) for i, t, *_ in edge_rows() if i != 5] + [(100 + k, " ".join(rng.choice(["Ab", "cd", "é", "word1", "x-y", "9"]) for _ in range(rng.randint(0, 30)))) for k in range(150)]
    docs += [(99, "copy of one text " * 6)] * 40
    df = spark.createDataFrame([(i, t, *["x"] * 6) for i, t in docs], SCHEMA).repartition(7)
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = resample.resample(df, aim, grams=grams, buckets=500, percent=percent, least_words=least, seed=5)
    assert Counter(map(tuple, got.collect())) == brute_draw(docs, target, grams, 500, percent, least, 5)
    assert resample.resample(empty, aim).collect() == []
    assert resample.resample(edge, aim.limit(0)).count() == len(edge_rows())


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_op12_equals_its_sql(spark):
    same(queries.op12_trie_variants(spark, SF), queries.ORACLES["op12_trie_variants"], SF)


def test_crcs_without_a_letter():
    word = "abcéàxyzzz"
    assert spelling.without_each(word).tolist() == [zlib.crc32((word[:i] + word[i + 1 :]).encode("latin-1")) for i in range(len(word))]


@pytest.mark.parametrize("most_letters", [6, 9, 64])
def test_near_pairs_equal_brute_force(spark, most_letters):
    """Dense words over two or three letters: runs, repeats, prefixes that are words, words at the bound of long ones."""
    ship(spark)
    rng = random.Random(most_letters)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(220)} | {"a" * k for k in range(1, 13)} | {"ab" * k for k in range(1, 7)} | {"b" + "ab" * k for k in range(5)}
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string").repartition(5), most_letters).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_op12_edges(spark, edge, empty):
    base = "letters"
    texts = [base] * 90 + ["lettters"] * 18 + ["letters" + "q"] * 5 + ["lettrters"] * 3 + ["LETTERSé"] * 5 + ["x" * 70] * 40 + ["x" * 69 + "y"] * 6 + ["x" * 71] * 5 + ["y" * 3000] * 5 + [None, "", "short"]
    df = spark.createDataFrame([(None, t, *["x"] * 6) for t in texts], SCHEMA)
    got = {r.word: r for r in spelling.variants(df, every=1 << 33).collect()}
    assert set(got) == {base, "lettters", "lettersq", "lettersé", "x" * 70, "x" * 69 + "y", "x" * 71, "y" * 3000}
    assert tuple(got["lettters"]) == ("lettters", base, base, 18, 1, 90)
    assert tuple(got["lettersé"]) == ("lettersé", base, base, 5, 2, 90)
    assert got["x" * 71].form == got["x" * 69 + "y"].root == "x" * 70 and got["x" * 70].n_near == 2
    assert got["y" * 3000].n_near == 0 and got[base].form is None and got[base].root == base
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(edge).count() == 0


def test_roots_follow_chains(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("a", "w9"), ("b", "a")]
    got = dict(spelling.roots(spark.createDataFrame(rows, "word string, form string"), 11).collect())
    assert set(got.values()) == {"w9"} and len(got) == 11


def test_op12_joins_are_equi_joins(spark):
    ship(spark)
    keys = spelling.both_ways(spark.createDataFrame([("lettera",), ("letterb",)], "word string"))
    states = keys.select("key", F.expr("left(key, 5)").alias("node"), F.lit(5).alias("pos"), F.lit(0).alias("edits"))
    text = spelling.step(states, spelling.edge_table(keys, 4).where("depth = 5"), 5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_wrapped_base64_takes_time_in_proportion():
    """Twice the lines of one wrapped payload take about twice the time, where a copy a line made it four times."""
    import base64
    import time

    from skylattice.llm import secrets

    def seconds(lines):
        text = base64.encodebytes(b"some words and nothing else in it, " * (lines * 57 // 35)).decode()
        found = next(secrets.WRAPPED.finditer(text))
        began = time.perf_counter()
        for _ in range(3):
            secrets._from_base64(found)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 8 * seconds(20_000) + 0.5
