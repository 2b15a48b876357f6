"""Operators on pages and vectors, and the pipeline."""

import base64
import gzip
import hashlib
from urllib.parse import urlsplit

import numpy as np
import pytest
from conftest import SF

from skylattice.llm import common, html_text, neighbours, queries, warc
from skylattice.llm.common import ship, table


def test_warc_round_trip(spark):
    ship(spark)
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "http://x\r\ny", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (None, "u", "same"), (6, "u", "é😀" * 100_000), (1, "u", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, hex string")
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    first = {"same": 1, "": 3}
    expected = []
    for i, _, html in rows:
        leader = first.get(html or "")
        revisit = i is not None and leader is not None and i > leader
        expected.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", leader if revisit else None))
    assert got == sorted(expected, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_keeps_long_urls_and_large_pages(spark, tmp_path):
    """A header beyond any usual length, records of every class of sizes, and archives that stay small."""
    ship(spark)
    rows = [(1, "http://x/" + "u" * 1_000_000, "a"), (2, "http://x/" + "v" * 70_000, "WARC/1.1\r\nx\r\n\r\n")]
    rows += [(10 + i, "u", f"{i} " + "m" * n) for n in (10, 20_000, 200_000, 2_000_000, 9_000_000) for i in range(n // 1_000_000 + 1)]
    df = spark.createDataFrame([(100 * k + i, u, h) for k, (i, u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert {i: r.payload_bytes for i, r in got.items()} == {r.page_id: len(r.html) for r in df.collect()}
    warc.write(df, str(tmp_path / "w"))
    back = {int(r.page_id): (r.url, r.payload.decode()) for r in warc.read(spark, str(tmp_path / "w"), strict=True).collect()}
    assert back == {r.page_id: (r.url, r.html) for r in df.collect()}
    (tmp_path / "w" / "x.warc").write_bytes(b"junk")
    with pytest.raises(Exception, match="no version line"):
        warc.read(spark, str(tmp_path / "w"), strict=True).count()


def record(i, payload):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{warc.digest_of(payload)}\r\nContent-Length: {len(payload) + len(warc.HTTP)}\r\n\r\n"
    return (head + warc.HTTP).encode() + payload + b"\r\n\r\n"


RECORDS = [record(i, b"payload %d " % i * 20) for i in range(5)]
DAMAGED = RECORDS[2].replace(b"payload 2", b"pAyload 2", 1)
MEMBERS = [gzip.compress(x, mtime=0) for x in RECORDS]
BROKEN = MEMBERS[2][:60] + bytes([MEMBERS[2][60] ^ 255]) + MEMBERS[2][61:]


@pytest.mark.parametrize(
    ("parts", "bad"),
    [
        (RECORDS, []),
        ([*RECORDS[:2], DAMAGED, *RECORDS[3:]], [2]),
        ([RECORDS[0], RECORDS[1][:100], *RECORDS[2:]], [1]),
        ([RECORDS[0], b"junk\r\n", *RECORDS[1:]], [1]),
        ([*RECORDS[:4], RECORDS[4][:-30]], [4]),
        (MEMBERS, []),
        ([*MEMBERS[:2], BROKEN, *MEMBERS[3:]], [2]),
        ([MEMBERS[0], MEMBERS[1][:50], *MEMBERS[2:]], [1]),
        ([MEMBERS[0], b"zz", *MEMBERS[1:]], [1]),
    ],
)
def test_salvage(parts, bad):
    found = list(warc.salvage(b"".join(parts)))
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    gaps = [(x.start, x.end) for x in found if isinstance(x, warc.Gap)]
    assert gaps == [(starts[i], starts[i + 1]) for i in bad]
    whole = [p for i, p in enumerate(parts) if i not in bad]
    assert [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)] == [f"<urn:page:{(RECORDS if p in RECORDS else MEMBERS).index(p)}>" for p in whole]


def test_salvage_of_a_file_in_one_member():
    assert sum(isinstance(x, warc.Record) for x in warc.salvage(gzip.compress(b"".join(RECORDS)))) == 5


def test_read_lists_gaps(spark, tmp_path):
    ship(spark)
    (tmp_path / "a.warc").write_bytes(RECORDS[0] + b"junk" + RECORDS[1])
    rows = warc.read(spark, str(tmp_path)).collect()
    assert [(r.page_id, r.quarantined is None) for r in rows] == [("0", True), (None, False), ("1", True)]
    assert rows[0].payload == b"payload 0 " * 20


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu<li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="site-header">Brand</div><article class="post"><div class="post-header">By A</div><header><h1>A &amp; B</h1></header><p><b>One  two<br>three<p>Four <i>five</i>.</p><form><p>Mail</p></form><div id="comments"><p>First!</div><aside>See also</aside><p>Last</article><footer>Foot</footer>"""


def structured(page):
    return "\n\n".join(text for _, text in html_text.blocks_of(page))


def test_main_text_by_structure():
    assert structured(PAGE) == "By A\n\nA & B\n\nOne two three\n\nFour five.\n\nLast"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>Hello world <span class="share">x</span> more</p>', "Hello world more"),
        ('<p>Text before <a class="ad">ad</a> and after.</p>', "Text before and after."),
        ("<p>One <script>var x</script>two <button>b</button>three", "One two three"),
        ('<div class="no-sidebar"><article><p>In</article></div>', "In"),
        ('<div id="content-with-sidebar"><p>In</div>', "In"),
        ('<article><p class="related-work">In<div class="related-posts">Out</div></article>', "In"),
        ('<div class="banner"><main><p>In</main></div><div class="sidebar"><article>Out</article></div>', "In"),
        ('<div class="sidebarLeft site-menu">Out</div><div class="comment-list"><article>Out</article></div><p>In', "In"),
        ('<div class="wp-block-comments">Out</div><div class="cc-banner">Out</div><div class="has-ads">In</div>', "In"),
        ("<head><title>Out</title><meta charset=x><body><p>In", "In"),
        ("<ul><li class=ad><a>Out<li>In</ul>", "In"),
        ("<p>a<![foo[x]]>b", "ab"),
        ("<p>a<![ x", "a"),
        ("<p>a<!-- x", "a"),
        ("<p>a<!-->b<!--x--!>c<!doctype x>d", "abcd"),
        ("<p>a<a href='x", "a"),
        ("<p>a &lt; b &amp;c &#x41;", "a < b &c A"),
    ],
)
def test_marks_and_malformed_markup(page, text):
    assert structured(page) == text


def test_any_markup_is_read():
    rng = np.random.default_rng(8)
    bits = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "</", "<p", "<div class=", '"', "'", "=", "<?", "&", "&#", "&#x", ";", "ad", " ", "x", "\0", "<script", "</script>", "<article>", "</p>", "\n", "<title>", "<svg", "/>"]
    for _ in range(3000):
        html_text.blocks_of("".join(rng.choice(bits, rng.integers(1, 25))))


def brute_texts(rows, run):
    """Main texts by comparing every window of an open block with every other page of the host."""
    found = [(urlsplit(url).netloc, tuple(html_text.blocks_of(html or ""))) for _, url, html in rows]
    grams = {}
    for host, blocks in found:
        words = [w for _, t in blocks for w in t.split(" ")]
        for i in range(len(words) - run + 1):
            grams.setdefault((host, tuple(words[i : i + run])), set()).add(blocks)
    out = []
    for host, blocks in found:
        words = [w for _, t in blocks for w in t.split(" ")]
        covered = [False] * len(words)
        for i in range(len(words) - run + 1):
            if len(grams[host, tuple(words[i : i + run])]) > 1:
                covered[i : i + run] = [True] * run
        at, kept = 0, []
        for state, text in blocks:
            own, marks = text.split(" "), covered[at : at + len(text.split(" "))]
            at += len(own)
            if state == html_text.OPEN:
                own = html_text.unique_words(own, marks, run)
            if own:
                kept.append(" ".join(own))
        out.append("\n\n".join(kept))
    return out


def test_main_text_by_repetition(spark):
    """Small and large hosts against brute force; the result does not depend on how a host is dealt into groups."""
    ship(spark)
    rng = np.random.default_rng(6)
    word = lambda: f"w{rng.integers(200)}"
    passages = [" ".join(word() for _ in range(rng.integers(5, 30))) for _ in range(40)]
    rows = []
    for i in range(500):
        blocks = []
        for _ in range(rng.integers(1, 6)):
            text = " ".join(word() for _ in range(rng.integers(1, 20)))
            if rng.random() < 0.4:
                text = f"{text} {passages[rng.integers(40)]} {word()}"
            blocks.append(f"<article>{text}</article>" if rng.random() < 0.3 else f"<div>{text}</div>")
        rows.append((i, f"http://{'large' if i < 350 else f'h{i % 40}'}.example/{i}", "".join(blocks)))
    rows += [(600 + i, rows[i][1] + "copy", rows[i][2]) for i in range(0, 500, 25)]
    expected = dict(zip([r[0] for r in rows], brute_texts(rows, 8), strict=True))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group_bytes in (1 << 20, 2000):
        assert {r.page_id: r.text for r in html_text.main_texts(df, group_bytes=group_bytes).collect()} == expected
    assert any(expected[i] != structured(html) for i, _, html in rows)
    shared = "This site belongs to nobody and all text on it is free"
    same = spark.createDataFrame([(i, "http://a/", f"<p>{shared}") for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_texts(same).collect()} == {shared}  # equal pages are one page


def test_wrappers_do_not_take_articles_with_them():
    kept = ['<form id="f"><div><article><p>x', "<form><main><p>x", '<div class="content share"><article><p>x', "<nav>menu<article><p>x"]
    left_open = ['<div class="text social"><p>x', '<div class="page header-menu"><p>x', '<div class="article-list widget"><p>x']
    gone = ["<form><p>x", "<form hidden><article>x", '<div class="comments"><article>x', '<div class="widget widget_text"><p>x', '<div class="page menu" id="sidebar">x', '<div class="page sidebar">x']
    for pages, expected in ((kept, [(html_text.KEEP, "x")]), (left_open, [(html_text.OPEN, "x")]), (gone, [])):
        for page in pages:
            assert html_text.blocks_of(page) == expected, page


def test_pages_table_by_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF.replace("0.001", "0.01"), "pages").select("page_id", "url", "html").collect()]
    expected = dict(zip([r[0] for r in rows], brute_texts(rows, 8), strict=True))
    assert {r.page_id: r.text for r in queries.op8_host_suffix_text(spark, SF.replace("0.001", "0.01")).collect()} == expected


def test_copies_of_a_page_are_dealt_out(spark, monkeypatch):
    """A host nine tenths of whose rows are one page, with groups so small that it has many."""
    monkeypatch.setattr(html_text, "CROWD", 50)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    lines = [" ".join(rng.choice(words, 12)) for _ in range(30)]
    htmls = ["".join(f"<p>{x} {rng.choice(words)}" for x in rng.choice(lines, 4)) for _ in range(60)]
    rows = [(i, "http://a/", htmls[0] if i % 10 else htmls[i // 10]) for i in range(600)]
    expected = brute_texts(rows, 8)
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), group_bytes=500)
    assert {r.page_id: r.text for r in got.collect()} == dict(enumerate(expected)) and got.count() == 600
    assert len({x for x in expected}) > 10


def test_suffix_array_covers_what_windows_do():
    rng = np.random.default_rng(4)
    for run in (2, 3, 5):
        tokens = rng.integers(0, 3, 200)
        page = np.repeat(np.arange(10), 20)
        tokens[19::20] = -1 - np.arange(10)
        covered = np.zeros(200, bool)
        for i in range(200 - run + 1):
            if any(page[j] != page[i] and (tokens[j : j + run] == tokens[i : i + run]).all() for j in range(200 - run + 1)):
                covered[i : i + run] = True
        assert (html_text.covering(html_text.repeated(tokens, page, run), 200, run) == covered).all()
        order, _ = html_text.suffix_order(tokens, 200)
        assert [tuple(tokens[i:]) for i in order] == sorted(tuple(tokens[i:]) for i in range(200))


def test_main_texts_edges(spark):
    ship(spark)
    rows = [(1, None, None, "h"), (2, "http://a/x", "", "h"), (2, "http://a/x", "", "h"), (None, "bad url", "<p>x", "h"), (3, "HTTP://A/y", "<p>" + "long " * 100_000, "h")]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("2", 0), ("3", 499_999), ("None", 1)]
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_neighbours(spark):
    rows = table(spark, SF, "embeddings").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    got = {}
    for r in queries.op6_multiprobe(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        scores = vectors @ vectors[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
        assert all(abs(s - scores[ids == v][0]) < 1e-12 for _, v, s in found)
        hits += len({x[1] for x in found} & set(ids[order].tolist()))
        total += 20
    assert hits >= 0.9 * total


def test_neighbours_edges(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 120)]
    rows += [(200 + i, [3.0] * 8) for i in range(60)]  # copies of one vector, some of them queries
    rows += [(300, None), (320, []), (340, [0.0] * 8), (360, [float("nan")] * 8), (380, [1.0, None] * 4), (None, [1.0] * 8), (400, [1.0, 2.0]), (20, rows[19][1])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, node int, key int")
    got = {}
    for r in neighbours.nearest(df, queries="vec_id % 20 = 0", k=5, probes=6561).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {20, 40, 60, 80, 100, 200, 220, 240}  # the others take no part, or stand alone in their length
    assert [got[220][i][0] for i in range(1, 6)] == [200, 201, 202, 203, 204]
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    for q in (20, 40, 60):
        best = sorted((-float(v @ good[q]), i) for i, v in good.items() if i != q)[:5]
        assert [got[q][r][0] for r in range(1, 6)] == [i for _, i in best]
    assert neighbours.nearest(df.limit(0), queries="vec_id % 20 = 0").count() == 0
    assert neighbours.nearest(df.where("vec_id = 20"), queries="vec_id % 20 = 0").count() == 0


@pytest.mark.parametrize("forced", [{}, {"probes": 60, "hashes": 4, "width": 2.0}], ids=["fitted", "crowded"])
def test_neighbours_with_a_dense_third(spark, monkeypatch, forced):
    """Also with buckets far beyond what a shard takes, whose entries and queries a grid of shards shares."""
    ship(spark)
    if forced:
        monkeypatch.setattr(neighbours, "SHARD", 100)
        monkeypatch.setattr(neighbours, "ASKED", 10)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[:1000] = vectors[0] + rng.normal(size=(1000, 64)) * 0.02
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, queries="vec_id % 20 = 0", **forced).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for stratum in (range(0, 1000, 20), range(1000, 3000, 20))[: 1 if forced else 2]:
        hits = 0
        for q in stratum:
            scores = vectors @ vectors[q]
            scores[q] = -np.inf
            hits += len(set(got[q]) & set(np.argsort(-scores)[:20].tolist()))
        assert hits >= 0.92 * 20 * len(stratum)


def test_neighbours_of_small_tables_are_all_rows(spark):
    ship(spark)
    rows = [(i, [(1.0 if i % 2 else -1.0) * (1 + i / 100), 0.5 * (i % 3)]) for i in range(21)]
    for some in (rows, rows[:2]):
        df = spark.createDataFrame(some, "vec_id long, embedding array<float>")
        for probes in (None, 1):
            got = neighbours.nearest(df, queries="vec_id % 20 = 0", probes=probes).collect()
            assert {(r.query_id, r.vec_id) for r in got} == {(q, i) for q in (0, 20) for i, _ in some if i != q and q < len(some)}


def test_rank_of_a_perturbation_is_its_place_in_the_sequence():
    rng = np.random.default_rng(5)
    for hashes in (1, 4, 5):
        fraction = rng.uniform(size=hashes)
        cost = np.array([sum((fraction[i] if x < 0 else 1 - fraction[i]) ** 2 for i, x in enumerate(m) if x) for m in neighbours.probe_sequence(fraction, 3**hashes)])
        assert neighbours.cheaper(fraction, cost - 1e-12).tolist() == list(range(3**hashes))


def test_hashes_and_width_follow_the_number_of_rows():
    """Clusters of 40 close vectors: with more of them probes serve all queries, and finer buckets are taken."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(100, 32)))
    queries = unit(centres + rng.normal(size=(100, 32)) * 0.05)
    found = [unit(c + rng.normal(size=(20, 32)) * 0.05) for c in centres]
    others = unit(rng.normal(size=(2000, 32)))
    (_, m, w, share), (_, more_m, more_w, more_share) = [neighbours.fit(queries, found, others, 1.0, n, tables=8, hashes=None, width=None) for n in (10**5, 10**9)]
    assert more_m / more_w > m / w and more_share < share < 0.05


def test_queries_are_answered_by_probes(spark, monkeypatch):
    """On vectors without structure: no more than one query in twenty is searched exactly, and recall holds all the same."""
    asked = []
    exactly = neighbours.exactly
    monkeypatch.setattr(neighbours, "exactly", lambda nodes, asking, k: asked.append(asking.num_rows) or exactly(nodes, asking, k))
    rows = table(spark, SF.replace("0.001", "0.1"), "embeddings").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op6_multiprobe(spark, SF.replace("0.001", "0.1")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert asked[0] == len(got) == 100 and sum(asked[1:]) <= 5  # the first is the sample that probes are fitted on
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        if ids[i] in got:
            scores = vectors @ vectors[i]
            scores[i] = -np.inf
            hits += len(set(got[ids[i]]) & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits >= 0.9 * 20 * sum(1 for q in got if q % 50 == 0)


def test_probes_come_in_order_of_cost():
    rng = np.random.default_rng(0)
    fraction = rng.uniform(size=5)
    cost = lambda m: sum((fraction[i] if x < 0 else 1 - fraction[i]) ** 2 for i, x in enumerate(m) if x)
    moves = [tuple(m) for m in neighbours.probe_sequence(fraction, 243)]
    assert len(set(moves)) == 243 and [cost(m) for m in moves] == sorted(cost(m) for m in moves)


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = SF.replace("0.001", "0.01")
    docs = table(spark, sf, "documents")
    step = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, step, sf)
        assert out.columns == docs.columns, name
        step = spark.createDataFrame(out.collect(), docs.schema)
    kept = {r.doc_id: r.text for r in step.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    judged = {r.doc_id: r for r in queries.op5_crf_quality(spark, sf).collect()}
    assert all(judged[i].kept for i in kept)
    assert not [t for t in kept.values() if "AKIA" in t and any(len(x) >= 18 for x in t.split() if x.startswith("AKIA"))]
    before = common.made()
    packed = P.run(spark, sf)
    assert common.made() == before + 1  # what the stages made besides is gone
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)
    assert sum(bool(labels.get(i)) for i in kept) > 0


def test_pipeline_edges(spark):
    import corpus_pipeline as P

    sf = SF
    text = "A fine sentence of more than ten plain words, as good prose has it.\nAnd one more line, so that there is some length to it."
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, text, "en", "s", len(text)), (3, text, "en", "s", len(text)), (4, text, "en", "s", len(text)), (None, text, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} == {3, None}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
