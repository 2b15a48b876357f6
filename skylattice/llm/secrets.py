"""Operator 10: secrets in texts, also under layers of encoding.

A worklist of layers starts with the text itself. Each layer is scanned; each decoder (URL escapes, Unicode and character
escapes, base64 with or without compression) that finds something to undo gives a new layer, unless that layer was seen
before. Every layer carries a map back to the text, so that what is found in it has a span there.

All patterns are of ASCII characters. So decoded bytes are read as Latin-1, one character a byte (UTF-16 as one character a
code unit), which makes the way back plain arithmetic on runs: a layer costs a few bytes a character and a few entries a
match, however long it is.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import itertools
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Kinds in the order of the contract, with their patterns. Fixed values.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|(&#[^;]+;)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, which may be indented; the last line ends with the line or before a closing mark.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}(?=[ \t]*(?:\r?\n|$)|[\"'`<,;)\]}\\])")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: What a text must match for any of the patterns above to match it.
HINT = r"[0-9a-f]{16}|AKIA[A-Z0-9]|(?i:password|passwd|secret|token|api_?key)|%[0-9A-Fa-f]{2}|\\u|\\x|&#|[A-Za-z0-9+/_-]{16}"
HINTED = re.compile(HINT)
#: A row of Latin letters in UTF-16.
UTF16 = re.compile(rb"(?:[\x20-\x7e]\x00){8}")
#: How gzip, zlib and Zstandard data begin.
COMPRESSED = re.compile(rb"\x1f\x8b|\x78|\x28\xb5\x2f\xfd")
#: Inflated data is read in pieces of about this many bytes, each of which begins with the last bytes of the one before.
MOST_INFLATED, OVERLAP = 16 << 20, 1 << 20

Span = tuple[str, int, int]
#: From a stretch of decoded characters to the stretch of a match that it comes from.
Way = Callable[[int, int], tuple[int, int]]
#: A run of a decoded match: its characters, its start and end in the match, and the way back within the match; None if the
#: run comes from all of that stretch.
Run = tuple[str, int, int, Way | None]


def scan(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _from_url(found: re.Match) -> list[Run]:
    return [(bytes.fromhex(found[0].replace("%", "")).decode("latin-1"), 0, len(found[0]), lambda i, j: (3 * i, 3 * j))]


def _from_escapes(found: re.Match) -> list[Run]:
    chars: list[str] = []
    ends = array("q", [0])
    for m in ONE_ESCAPE.finditer(found[0]):
        if m[4]:
            char = html.unescape(m[4])
        else:
            code = int(m[1] or m[2] or m[3], 16)
            char = chr(code) if code < 0x110000 else "\ufffd"
        # One character an escape, and no half of a pair: none of either is in any pattern.
        chars.append("\ufffd" if len(char) != 1 or "\ud800" <= char <= "\udfff" else char)
        ends.append(m.end())
    return [("".join(chars), 0, len(found[0]), lambda i, j: (ends[i], ends[j]))]


def _decoded(raw: bytes) -> tuple[str, int] | None:
    """The characters of a layer and how many bytes each takes; None if there is nothing to look for.

    A byte order mark or a row of letters with NULs between them makes it UTF-16, else it is Latin-1, as which UTF-8 can be
    read here. A layer that is not clean text must match ``HINT``, so that mere binary data is left alone.
    """
    if not raw:
        return None
    if _strict(raw):
        return raw.decode("latin-1"), 1
    order = {b"\xff\xfe": "<", b"\xfe\xff": ">"}.get(raw[:2])
    if order is None and (row := UTF16.search(raw)):
        order = ">" if row.start() % 2 else "<"
    if order:
        units = np.frombuffer(raw, f"{order}u2", len(raw) // 2)
        text = np.where(units < 128, units, 0xFFFD).astype("<u2").tobytes().decode("utf-16-le")
        if HINTED.search(text):
            return text, 2
    text = raw.decode("latin-1")
    return (text, 1) if HINTED.search(text) else None


def _strict(raw: bytes) -> bool:
    """Whether bytes are clean text."""
    try:
        return raw.decode().replace("\t", " ").replace("\n", " ").replace("\r", " ").isprintable()
    except UnicodeDecodeError:
        return False


class Damaged(Exception):
    """Compressed data that is broken or ends too early."""


def _inflating(raw: bytes) -> Iterator[bytes]:
    """What gzip, zlib or Zstandard bytes hold, in small chunks; all members of a file. Raises if they are damaged."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0):
        rest = raw
        while rest is raw or rest[:2] == b"\x1f\x8b":
            stream = zlib.decompressobj(47)
            while not stream.eof:
                out = stream.decompress(rest, 1 << 20)
                rest = stream.unconsumed_tail
                if not out and not rest and not stream.eof:
                    raise Damaged("cut short")
                yield out
            rest = stream.unused_data.lstrip(b"\0")
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        at = 0
        while raw[at : at + 4] == b"\x28\xb5\x2f\xfd":
            stream = zstandard.ZstdDecompressor().decompressobj()
            while not stream.eof:
                if at >= len(raw):
                    raise Damaged("cut short")
                try:
                    out = stream.decompress(raw[at : at + 1024])
                except zstandard.ZstdError as error:
                    raise Damaged(str(error)) from error
                at = min(len(raw), at + 1024) - len(stream.unused_data)
                yield out


def inflate(raw: bytes) -> Iterator[bytes]:
    """What gzip, zlib or Zstandard bytes hold, in overlapping pieces; nothing if they are none of these or damaged before
    the first piece is full. Of data damaged later the pieces before the damage are given. Only damaged data is passed over:
    a missing library, a lack of memory or any other error is raised, as nothing found would look like a clean text."""
    held, fresh, first = bytearray(), False, True
    try:
        for chunk in _inflating(raw):
            held += chunk
            fresh = fresh or bool(chunk)
            if len(held) >= MOST_INFLATED + OVERLAP:
                yield bytes(held)
                del held[:-OVERLAP]
                fresh = first = False
    except (zlib.error, Damaged):
        fresh = fresh and not first
    if fresh:
        yield bytes(held)


def _lines(found: re.Match) -> list[tuple[int, int]]:
    """Where the base64 of a match lies in it: its one line, or the lines that are as wide as the first full one and the
    shorter one that ends them."""
    lines = [m.span() for m in LINE.finditer(found[0])]
    if len(lines) < 2:
        return lines
    width = [b - a for a, b in lines]
    last = 1
    while width[last] == max(width[:2]) and last + 1 < len(lines) and width[last + 1] <= width[last]:
        last += 1
    return lines[: last + 1]


def _raw(found: re.Match, lines: list[tuple[int, int]]) -> bytes | None:
    whole = found[0]  # a copy of the match each time
    body = "".join(whole[a:b] for a, b in lines)
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _from_base64(found: re.Match) -> list[Run] | None:
    lines = _lines(found)
    if (raw := _raw(found, lines)) is None:
        return None
    end, whole = lines[-1][1], found[0]
    while end < len(whole) and whole[end] == "=":
        end += 1
    rest: list[Run] = [(whole[end:], end, len(whole), lambda i, j: (end + i, end + j))] if end < len(whole) else []
    if COMPRESSED.match(raw) and (inner := next(inflate(raw), None)):
        text = (_decoded(inner) or ("", 1))[0]
        if not text and next(_more(found), None) is None:
            return None
        return [(text, 0, end, None), *rest]
    if (known := _decoded(raw)) is None:
        return None
    text, width = known
    before = list(itertools.accumulate((b - a for a, b in lines), initial=0))

    def place(digit: int) -> int:
        """Where a base64 digit stands among the lines."""
        line = bisect_right(before, digit, 0, len(lines)) - 1
        return lines[line][0] + digit - before[line]

    def way(i: int, j: int) -> tuple[int, int]:
        return place(i * width * 4 // 3), min(end, place(min(before[-1], -(-j * width * 4 // 3)) - 1) + 1)

    return [(text, 0, end, way), *rest]


def _more(found: re.Match) -> Iterator[str]:
    """The further pieces of inflated data that is too large to be one layer."""
    raw = _raw(found, _lines(found))
    if raw and COMPRESSED.match(raw):
        for piece in itertools.islice(inflate(raw), 1, None):
            if known := _decoded(piece):
                yield known[0]


DECODERS: tuple[tuple[re.Pattern, Callable[[re.Match], list[Run] | None]], ...] = ((URL, _from_url), (ESCAPES, _from_escapes), (BASE64, _from_base64), (WRAPPED, _from_base64))


class Map:
    """The way from a layer back to the one below: where each run starts in the layer, and its stretch and way there."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.runs: list[tuple[int, int, int, Way | None]] = []
        self.size = 0

    def put(self, length: int, base: int, a: int, b: int, way: Way | None) -> None:
        """A run of ``length`` characters from ``a:b`` of the match at ``base``."""
        self.starts.append(self.size)
        self.runs.append((base, a, b, way))
        self.size += length

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the layer below that holds ``start:end`` (not empty) of the layer."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        base, a, _, way = self.runs[first]
        begin = base + (way(start - self.starts[first], start + 1 - self.starts[first])[0] if way else a)
        base, _, b, way = self.runs[last]
        return begin, base + (way(end - 1 - self.starts[last], end - self.starts[last])[1] if way else b)


def _same(i: int, j: int) -> tuple[int, int]:
    return i, j


def _undo(text: str, pattern: re.Pattern, decode: Callable) -> tuple[str, Map] | None:
    """``text`` with every match that ``decode`` can read put in plain, and the map that leads back to ``text``."""
    parts: list[str] = []
    back = Map()
    last = 0

    def put(part: str, base: int, a: int, b: int, way: Way | None) -> None:
        if part:
            parts.append(part)
            back.put(len(part), base, a, b, way)

    for m in pattern.finditer(text):
        plain = decode(m)
        if plain is None:
            continue
        put(text[last : m.start()], last, 0, m.start() - last, _same)
        for part, a, b, way in plain:
            put(part, m.start(), a, b, way)
        last = m.end()
    if not last:
        return None
    put(text[last:], last, 0, len(text) - last, _same)
    return "".join(parts), back


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and all spans with those of the layers beneath, each in order and without repeats."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s[1], rank[s[0]], s[2])
    base = sorted(scan(text), key=order)
    spans = set(base)
    seen = {hashlib.sha256(text.encode()).digest()}

    def look(layer: str, path: list[Map]) -> bool:
        if (mark := hashlib.sha256(layer.encode()).digest()) in seen:
            return False
        seen.add(mark)
        for kind, a, b in scan(layer):
            for level in path:
                a, b = level.back(a, b)
            spans.add((kind, a, b))
        return True

    def unwrap(layer: str, path: list[Map]) -> None:
        work = [(layer, path)]
        while work:
            layer, path = work.pop()
            for pattern, decode in DECODERS:
                if (undone := _undo(layer, pattern, decode)) is None:
                    continue
                inner, back = undone
                if look(inner, [back, *path]):
                    work.append((inner, [back, *path]))
                # One at a time, so that no more than a piece of each large layer is held.
                if decode is _from_base64:
                    for m in pattern.finditer(layer):
                        if m.end() - m.start() > MOST_INFLATED >> 15:
                            for piece in _more(m):
                                whole = Map()
                                whole.put(len(piece), m.start(), 0, m.end() - m.start(), None)
                                if look(piece, [whole, *path]):
                                    unwrap(piece, [whole, *path])

    unwrap(text, [])
    return base, sorted(spans, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span], mask: str) -> str:
    """``text`` with every stretch that spans cover replaced by ``mask``."""
    out, last, reach = [], 0, 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a >= reach:
            out += [text[last:a] if a > last else "", mask]
        last = reach = max(reach, b)
    return "".join(out) + text[last:]


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans`` for each row: counts and digest of the spans in the text
    itself, and all spans as ``kind:start:end`` (code points, end exclusive).

    A null or empty text has none. Null ids and repeated rows pass through. Whole texts are read; other columns are not.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            hint = pc.match_substring_regex(texts, HINT).fill_null(False)
            columns: list[list] = [[0] * len(ids), [0] * len(ids), [0] * len(ids), [nothing] * len(ids), [""] * len(ids)]
            for i in pc.indices_nonzero(hint).to_pylist():
                base, spans = find_secrets(texts[i].as_py())
                if spans:
                    kinds = [k for k, _, _ in base]
                    for column, value in zip(columns, (*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                        column[i] = value
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in columns[:3]), *(pa.array(x, pa.string()) for x in columns[3:])], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(df: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", with_text: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced, all rows and columns kept; ``chars_col``, if ``df`` has it, is the
    new text's length wherever the text changed. Null texts stay null."""
    schema = df.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            changed = {}
            for i in pc.indices_nonzero(pc.match_substring_regex(texts, HINT).fill_null(False)).to_pylist():
                text = texts[i].as_py()
                spans = find_secrets(text)[1]
                if spans:
                    changed[i] = masked(text, spans, with_text)
            if changed:
                replace = lambda old, new: pc.replace_with_mask(old, pa.array([i in changed for i in range(len(texts))]), pa.array(new, old.type))
                batch = batch.set_column(at, batch.schema.field(at), replace(texts, list(changed.values())))
                n = batch.schema.get_field_index(chars_col) if chars_col else -1
                if n >= 0:
                    batch = batch.set_column(n, batch.schema.field(n), replace(batch.column(n), [len(x) for x in changed.values()]))
            yield batch

    return df.mapInArrow(work, schema)
