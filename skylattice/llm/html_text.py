"""Operator 8: main text of web pages, by page structure and by suffix arrays over each host's pages.

A page is cut into blocks of text. Structure settles most blocks: what lies in navigation, headers of the site, footers,
asides, forms, scripts, adverts, notices or comments goes, what lies in an article or main element stays. For blocks
that structure leaves open, the token streams of a host's pages are concatenated, a suffix array of them is built, and
substrings of ``run`` tokens or more that occur on distinct pages are boilerplate: covered tokens go, unique runs stay.

A large host is dealt into groups of bounded size, each with a suffix array of its own. What groups share is exchanged as
the distinct hashes of their suffixes, each with the smallest and largest page it is on: a suffix on two pages of a host is
repeated wherever these lie. So the text of a page does not depend on how large its host is or how it was dealt.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import slices_by_bytes
from .words import mix, windows

#: Elements whose text is never content. Fixed values.
DROPPED = frozenset("script style noscript template svg math head title nav footer aside form button select option textarea iframe object canvas dialog menu".split())
#: Elements that hold the page's content. Fixed values.
TRUSTED = frozenset(("article", "main"))
#: Elements that begin and end a block of text. Fixed values.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without an end tag. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a head may hold; any other start tag ends it. Fixed values.
HEAD = frozenset("base bgsound link meta noframes noscript script style template title".split())
#: Elements whose end tag may be left out: an element on the left is closed by a start tag on the right. Fixed values.
IMPLIED = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
#: Words in class, id or role that mark what is not content. Fixed values.
MARKS = frozenset("ad ads adsbygoogle adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu menubar menus modal nav navbar navigation newsletter notice notices overlay pagination popup promo related replies respond search share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets".split())
#: The same, where it is not within the content's own element. Fixed values.
MARKS_OUTSIDE = frozenset(("header", "topbar"))
#: Marks that a wrapper of a whole page may bear: article and main elements within it are content all the same. Fixed values.
MARKS_OF_WRAPPERS = frozenset("alert banner consent cookie header masthead menu menus modal nav navbar navigation notice overlay popup toolbar topbar".split())
#: Words that may stand beside a mark in one name, as in site-footer or comment-list. A name with any other word, as
#: no-sidebar or related-work, is no mark. Fixed values.
BESIDE = frozenset("area article articles author bar block blog body bottom bottoms box btn button buttons center col column container content element entry fixed form global google group head heading icon icons info inner item items js left level line link links list main message mobile news next outer page panel post posts prev previous primary reader region right row secondary section signup site slot small sticky stories story text title toggle top trail unit user view wrap wrapper".split())

#: Marks that say little of a wrapper whose other names speak of content: what repeats over the host decides. Fixed values.
GENERIC = frozenset("banner header menu menubar notice notices overlay promo share sharing social sticky toolbar topbar widget widgets".split())
#: Words of such other names. Fixed values.
CONTENT = frozenset("article articles body content entry main page post posts story text".split())
#: Dropped elements that often wrap a page or are left open: article and main elements within them are content. Fixed values.
WRAPPING = frozenset(("form", "nav"))

#: States of a place: undecided, content, and gone: for good, unless a main element begins, unless a main or article does.
OPEN, KEEP, DROP, DROP_BUT_MAIN, DROP_BUT_TRUSTED = range(5)
#: Copies of a page that are dealt out together, at most.
CROWD = 4096
SPACE = re.compile(r"\s+")
COMMENT_END = re.compile("--!?>")
PARTS = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@functools.lru_cache(maxsize=1 << 14)
def mark_of(names: str, inside: bool) -> int | None:
    """The state that a class, id or role sets: that of its first name which marks what is not content. Outside of the
    content's own element a place stays open if its marks are generic and another name speaks of content."""
    known = MARKS if inside else MARKS | MARKS_OUTSIDE
    state, marks, content = None, set(), False
    for name in names.split():
        parts = {x for x in PARTS.split(re.sub("(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x}
        found = parts & known
        # Beside a mark short prefixes mean nothing either, as in wp-comments; but no-sidebar is no sidebar.
        if found and all(x in known or x in BESIDE or (len(x) < 3 and x != "no") for x in parts):
            marks |= found
            if state is None:
                state = DROP_BUT_TRUSTED if found <= MARKS_OF_WRAPPERS else DROP_BUT_MAIN
        elif not found and parts & CONTENT:
            content = True
    return OPEN if content and marks and marks <= GENERIC and not inside else state


class Blocks(HTMLParser):
    """Collects ``(state, text)`` of each block of a page, in order. The page has to be fed in one piece; what its end cuts
    short (a tag, a comment, a declaration) is no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []
        self.open_tags: Counter[str] = Counter()
        self.found: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.state = self.part_state = OPEN
        self.inside = False

    def updatepos(self, i: int, j: int) -> int:
        return j

    def _to(self, end: int) -> int:
        return len(self.rawdata) if end < 0 else end

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = COMMENT_END.search(self.rawdata, i + 2)
        return found.end() if found else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self._to(self.rawdata.find(">", i + 2) + 1 or -1)

    def parse_starttag(self, i: int) -> int:
        return self._to(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._to(super().parse_endtag(i))

    def parse_pi(self, i: int) -> int:
        return self._to(super().parse_pi(i))

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts.clear()
            if text:
                self.found.append((self.part_state, text))

    def _close_implied(self, tag: str) -> None:
        """Close what the start of ``tag`` ends: an open element that leaves its end tag out, with what is open in it, or a
        head."""
        again = True
        while again:
            again = False
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if tag in IMPLIED.get(name, ()) or (name == "head" and tag not in HEAD):
                    while len(self.stack) > i:
                        self.pop()
                    again = True
                    break
                if name in BLOCKS or name in DROPPED:
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._close_implied(tag)
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        self.stack.append((tag, self.state, self.inside))
        self.open_tags[tag] += 1
        if tag in TRUSTED:
            if self.state in (OPEN, KEEP, DROP_BUT_TRUSTED) or (tag == "main" and self.state == DROP_BUT_MAIN):
                self.state, self.inside = KEEP, True
        elif self.state in (OPEN, KEEP):
            if tag in DROPPED or any(name == "hidden" for name, _ in attrs):
                self.state = DROP_BUT_TRUSTED if tag in WRAPPING and not any(name == "hidden" for name, _ in attrs) else DROP
            elif tag == "header" and not self.inside:
                self.state = DROP_BUT_TRUSTED
            elif tag not in ("html", "body"):
                marks = [x for name, value in attrs if name in ("class", "id", "role") and value and (x := mark_of(value, self.inside)) is not None]
                if gone := [x for x in marks if x != OPEN]:
                    self.state = min(gone)
                elif marks:
                    self.state = OPEN

    def pop(self) -> None:
        tag, before, inside = self.stack.pop()
        self.open_tags[tag] -= 1
        if tag in BLOCKS:
            self.flush()
        self.state, self.inside = before, inside

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.open_tags[tag]:
            if tag == "p":
                self.flush()
            return
        # An inline element that was never closed does not outlive its block; a block is not closed by an inline end tag.
        if tag not in BLOCKS and tag not in DROPPED:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    break
                if self.stack[i][0] in BLOCKS or self.stack[i][0] in DROPPED:
                    return
        while self.stack:
            last = self.stack[-1][0]
            self.pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.state in (OPEN, KEEP):
            if not self.parts:
                self.part_state = self.state
            self.parts.append(data)


def blocks_of(page: str) -> list[tuple[int, str]]:
    """The blocks of a page that structure keeps or leaves open."""
    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.found


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` tokens or more (prefix doubling), and each suffix's rank: suffixes that
    agree on those tokens share a rank."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    size = 1
    while size < depth:
        step = min(size, depth - size)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - step] = rank[step:]
        _, rank = np.unique(rank * (len(tokens) + 2) + ahead, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        size += step
    return np.argsort(rank, kind="stable"), rank


def repeated(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Where substrings of ``run`` tokens start that occur on two distinct pages. Pages are ended by tokens of their own, so
    no substring runs across. A longer substring is repeated if and only if all those of ``run`` tokens in it are, so the
    array need be in order no further than that."""
    if len(tokens) < run:
        return np.zeros(0, np.int64)
    order, rank = suffix_order(tokens, run)
    same = (rank[order][1:] == rank[order][:-1]) & (page[order][1:] != page[order][:-1])
    groups = np.unique(rank[order][1:][same])  # neighbours in the array from two pages: the substring is shared
    return np.flatnonzero(np.isin(rank, groups))


def covering(starts: np.ndarray, size: int, run: int) -> np.ndarray:
    """Which of ``size`` tokens lie in a substring of ``run`` tokens from any of ``starts``."""
    edge = np.zeros(size + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[:size] > 0


def unique_words(words: list[str], covered: list[bool], run: int) -> list[str]:
    """A block's words without its covered stretches: those of ``run`` words or more, or a stretch that is the block. A
    shorter stretch is only the edge of a repeated passage that lies in the blocks beside it."""
    out: list[str] = []
    for gone, stretch in itertools.groupby(zip(words, covered, strict=True), key=lambda x: x[1]):
        own = [w for w, _ in stretch]
        if not gone or (len(own) < run and len(own) < len(words)):
            out += own
    return out


class Streams:
    """Token streams of a group of pages, each distinct page once."""

    def __init__(self, rows: pa.Table, run: int):
        self.print = rows["print"].to_numpy()
        texts = rows["texts"].combine_chunks()
        self.first = np.sort(np.unique(self.print, return_index=True)[1])
        self.texts = texts.take(pa.array(self.first))
        words = pc.split_pattern(self.texts.flatten(), " ")
        self.words = words.flatten()
        flat = self.words.dictionary_encode()
        self.codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = flat.dictionary
        base = words.offsets.to_numpy().astype(np.int64)
        self.block_ends = base - base[0]
        by_page = self.texts.offsets.to_numpy().astype(np.int64)
        self.blocks = by_page - by_page[0]
        self.ends = self.block_ends[self.blocks]
        self.run = run

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of every substring of ``run`` tokens, and where it starts."""
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, self.names.to_pylist()), np.uint64, len(self.names))
        found, starts = windows(known[self.codes] if len(known) else np.zeros(0, np.uint64), self.ends, self.run)
        return mix(found).view(np.int64), starts

    def shared(self) -> np.ndarray:
        """Where substrings start that the group's suffix array has on two pages."""
        pages = np.arange(len(self.first))
        # A token of its own behind each page.
        tokens = np.insert(self.codes, self.ends[1:], -1 - pages)
        owner = np.repeat(pages, np.diff(self.ends) + 1)
        starts = repeated(tokens, owner, self.run)
        return starts - owner[starts]

    def main_texts(self, rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, str]]:
        """``(row, text)`` of the rows with open blocks, without what substrings from ``starts`` cover there."""
        covered = covering(starts, len(self.codes), self.run)
        page_of = {x: i for i, x in enumerate(self.print[self.first].tolist())}
        states = rows["states"].combine_chunks().take(pa.array(self.first)).flatten().to_numpy()
        texts = self.texts.flatten()
        open_pages = set(np.flatnonzero(np.bincount(np.repeat(np.arange(len(self.first)), np.diff(self.blocks)), states == OPEN, len(self.first)) > 0).tolist())
        done: dict[int, str] = {}
        for row, print_ in enumerate(self.print.tolist()):
            page = page_of[print_]
            if page not in open_pages:
                continue
            if page not in done:
                kept = []
                for b in range(self.blocks[page], self.blocks[page + 1]):
                    text = texts[b].as_py()
                    marks = covered[self.block_ends[b] : self.block_ends[b + 1]]
                    if states[b] == OPEN and marks.any():
                        text = " ".join(unique_words(text.split(" "), marks.tolist(), self.run))
                    if text:
                        kept.append(text)
                done[page] = "\n\n".join(kept)
            yield row, done[page]


def parsed_pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page, url, host, print, size, has_open, states, texts`` of each row: its blocks, a fingerprint of them, and the bytes
    of their texts."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), host.alias("host"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"))
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch["bytes"].to_numpy(), 8 << 20):
                some = batch.slice(part.start, part.stop - part.start)
                found = [blocks_of(x.as_py()) for x in some["html"]]
                states, texts = [[s for s, _ in x] for x in found], [[t for _, t in x] for x in found]
                prints = [xxhash.xxh3_64_intdigest("\n".join(f"{s}{t}" for s, t in x)) - (1 << 63) for x in found]
                columns = [pa.array(prints, pa.int64()), pa.array([sum(len(t.encode()) for t in x) for x in texts], pa.int64()), pa.array([OPEN in x for x in states], pa.bool_()), pa.array(states, pa.list_(pa.int8())), pa.array(texts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([some["page"], some["url"], some["host"], *columns], ["page", "url", "host", "print", "size", "has_open", "states", "texts"])

    return rows.mapInArrow(work, f"page {kind}, url string, host string, print long, size long, has_open boolean, states array<tinyint>, texts array<string>")


def main_texts(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = 8, group_bytes: int = 8 << 20) -> DataFrame:
    """``id_col, url_col, text, n_chars`` for each row of ``df``.

    ``text`` joins the kept blocks by two line feeds, in page order; it is empty if there is none, as for a null or empty
    page. Rows with a null url form a host of their own; null ids and repeated rows pass through. Pages of a host that are
    alike in every block count as one page and get equal texts. Malformed markup is read as browsers read it, so far as
    that matters to the text. ``group_bytes`` is about how much text one suffix array is built over, and has no bearing on
    the result. Whole pages are read; other columns are not.
    """
    pages = materialise(parsed_pages(df, id_col, url_col, html_col), "pages")
    prints = materialise(pages.groupBy("host", "print").agg(F.first("size").alias("size"), F.first("has_open").alias("has_open"), F.count("*").alias("copies")), "prints")
    # Only hosts with blocks that structure leaves open, on more than one distinct page, have anything to look for.
    hosts = prints.groupBy("host").agg(F.bool_or("has_open").alias("has_open"), F.count("*").alias("n"), F.ceil(F.sum("size") / group_bytes).alias("groups"))
    # As a table of known size: while hosts are few Spark sends it to the pages, and beyond that deals both out by host.
    hosts = materialise(hosts.where("has_open and n > 1").select("host", "groups"), "hosts")
    columns = [F.col("page").alias(id_col), F.col("url").alias(url_col)]
    whole = F.array_join("texts", "\n\n")
    settled = pages.where("not has_open").unionByName(pages.where("has_open").join(hosts, "host", "left_anti").select(pages.columns)).select(*columns, whole.alias("text"))

    # Pages that are alike are one row; each task leaves one of them before the shuffle.
    one = pages.join(hosts, "host").groupBy("host", "print").agg(F.first("groups").alias("groups"), F.first(F.struct("states", "texts")).alias("blocks"))
    dealt = materialise(one.select("host", "print", "groups", F.pmod("print", F.col("groups")).alias("part"), "blocks.*"), "dealt")

    def suffixes(rows: pa.Table) -> pa.Table:
        """Distinct hashes of the suffixes of a group, each with the smallest and largest page it is on."""
        streams = Streams(rows, run)
        found, starts = streams.hashes()
        print_ = streams.print[streams.first][np.searchsorted(streams.ends, starts, "right") - 1]
        order = np.lexsort((print_, found))
        found, print_ = found[order], print_[order]
        first = np.flatnonzero(np.diff(found, prepend=found[:1] - 1)) if len(found) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(found)) - 1 if len(found) else first
        n = len(first)
        return pa.table([pa.array([rows["host"][0].as_py()] * n, pa.string()), pa.array(np.full(n, rows["part"][0].as_py()), pa.int64()), pa.array(found[first]), pa.array(print_[first]), pa.array(print_[last])], ["host", "part", "hash", "low", "high"])

    several = dealt.where("groups > 1").select("host", "part", "print", "texts")
    told = materialise(several.groupBy("host", "part").applyInArrow(suffixes, "host string, part long, hash long, low long, high long"), "suffixes")
    both = told.groupBy("host", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "hash")
    back = told.select("host", "part", "hash").join(both, ["host", "hash"])

    def cut(rows: pa.Table, shared: pa.Table) -> pa.Table:
        """Main texts of a group: covered is what its own suffix array finds on two pages or the exchange has told of."""
        out: list[tuple[int, str]] = []
        if rows.num_rows:
            streams = Streams(rows, run)
            starts = streams.shared()
            if shared.num_rows:
                found, at = streams.hashes()
                starts = np.union1d(starts, at[np.isin(found, shared["hash"].to_numpy())])
            out = list(streams.main_texts(rows, starts))
        at = pa.array([i for i, _ in out], pa.int64())
        return pa.table([rows["host"].take(at), rows["print"].take(at), pa.array([x for _, x in out], pa.string())], ["host", "print", "text"])

    streams = dealt.select("host", "part", "print", "states", "texts")
    found = streams.groupBy("host", "part").cogroup(back.groupBy("host", "part")).applyInArrow(cut, "host string, print long, text string")
    # Back to the rows; the copies of a page that has many are dealt, and its text is sent to each deal.
    deals = F.ceil(F.col("copies") / CROWD).cast("int")
    crowded = materialise(prints.where(F.col("has_open") & (F.col("copies") > CROWD)).join(hosts, "host", "left_semi").select("host", "print", deals.alias("deals")), "crowded")
    dealt_out = F.coalesce("deals", F.lit(1))
    found = found.join(crowded, ["host", "print"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), dealt_out - 1))).drop("deals")
    rows = pages.where("has_open").select("page", "url", "host", "print").join(crowded, ["host", "print"], "left")
    rows = rows.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), dealt_out).cast("int")).drop("deals")
    rest = rows.join(found, ["host", "print", "deal"]).select(*columns, "text")
    return settled.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
