"""Secret scans: decode nested layers until nothing new appears and rescan each of them.

A text is the first layer of a worklist. Every layer is searched, then unwrapped: percent
escapes, ``\\u``, ``\\U``, ``\\x``, octal, ``%u`` and HTML escapes, base64 (plain and url-safe). Bytes that base64 or percent
escapes give are layers too: gzip, zlib and bz2 are opened, all members of them, until what
comes out is not compressed. A layer knows where each of its characters lies in the text it
came from, so findings carry spans of the original text. Layers already seen are not opened
again.

A base64 run is read by itself and, if only line ends part it from others, joined with them.
A run that isn't base64 from end to end is read at all four offsets: what is text there, or
begins as a compressed stream, is a layer, whatever stands before and behind it.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html.entities
import re
import urllib.parse
import zlib
from bisect import bisect_right
from collections.abc import Generator, Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.llm.common import table, text_or_empty

KINDS = ("assign", "access", "hex")
#: Fixed values of the query's contract: pattern, group whose length counts, least length.
_BASE = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]{24,}"), 0, 24),
)

#: A text without one of these has no match of the kind.
_NEEDS = (("password", "passwd", "secret", "token", "apikey", "api_key"), ("AKIA",), ("",))
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|%u([0-9A-Fa-f]{4})|&#x([0-9A-Fa-f]{1,6});"
    r"|&#([0-9]{1,7});|\\([0-3][0-7]{2})|&([A-Za-z][A-Za-z0-9]{1,31};)"
)
#: A text without one of these has no such escape.
_ESCAPED = re.compile(r"\\[uxU0-3]|%u|&[#A-Za-z]")
#: Characters of UTF-16 up to U+00FF among other bytes, in both byte orders.
_WIDE = re.compile(rb"(?:[\t-\r\x20-\x7e\xa0-\xff]\x00){12,}+|(?:\x00[\t-\r\x20-\x7e\xa0-\xff]){12,}+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")  # no finding is shorter than 12 bytes
_URL_SAFE = str.maketrans("-_", "+/")
#: Lines of base64; the breaks may be escapes, as in JSON, and lines indented.
_BREAK = re.compile(r"[ \t]*+(?:\r\n?|\n|\\r\\n|\\n)[ \t]*+")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
_SEPARATORS = "/_+-"
#: Text of UTF-8 among other bytes; no finding is shorter.
_STRETCH = re.compile(rb"(?:[\t-\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}+")
_STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|x[\x01\x5e\x9c\xda]")
_PRINTABLE = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f]*")

_SAFE = r"A-Za-z0-9_.~!*'()/@:$,;+-"
#: Percent escapes that begin as gzip, zlib or bz2 do; other bytes may stand for themselves.
_PERCENT_PACKED = re.compile(
    r"(?:%1[Ff]%8[Bb]%08|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|(?:B|%42)(?:Z|%5[Aa])(?:h|%68)(?:[1-9]|%3[1-9])(?:[1A]|%31|%41){2}(?:Y|%59)(?:&|%26))"
    rf"(?:%[0-9A-Fa-f]{{2}}|[{_SAFE}])*+"
)
_GZIP, _BZIP = b"\x1f\x8b\x08", re.compile(rb"BZh[1-9](?:1AY&SY|\x17rE8P\x90)")
#: Compressed bytes are fed in pieces of this size.
_PIECE, _CHUNK = 1 << 14, 1 << 20

#: A compressed layer is searched in windows of so many bytes, which share their last so many.
WINDOW_BYTES, SHARED_BYTES = 1 << 25, 1 << 20


class Layer(NamedTuple):
    """``text`` and, at ``marks[i]`` and after, its place in the original: ``spans[i]``.

    A span (start, end, True) grows with the distance from its mark; (start, end, False) is
    one encoded run that stands for every character up to the next mark.
    """

    text: str
    marks: list[int]
    spans: list[tuple[int, int, bool]]

    def place(self, start: int, end: int) -> tuple[int, int]:
        a = bisect_right(self.marks, start) - 1
        b = bisect_right(self.marks, end - 1) - 1
        first, last = self.spans[a], self.spans[b]
        low = first[0] + (start - self.marks[a] if first[2] else 0)
        high = last[0] + (end - self.marks[b]) if last[2] else last[1]
        return low, high


class Packed(NamedTuple):
    """Bytes from ``start`` to ``end`` of the original; ``opened`` if a compressed stream held them."""

    data: bytes
    start: int
    end: int
    opened: bool = False


def _key(layer: Layer | Packed) -> tuple:
    if isinstance(layer, Packed):
        return (hashlib.sha256(layer.data).digest(), layer.opened, layer.start, layer.end)
    return (hashlib.sha256(layer.text.encode("utf-8", "replace")).digest(), layer.spans[0][0], layer.spans[-1][1])


def base_matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, index of the kind, end) of the three base patterns."""
    low = text.lower()
    for kind, (pattern, group, least) in enumerate(_BASE):
        if not any(x in (low if kind == 0 else text) for x in _NEEDS[kind]):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield m.start(), kind, m.end()


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """``layer`` with every match decoded; None if nothing changes."""
    parts, marks, spans, at, size = [], [], [], 0, 0
    for m in pattern.finditer(layer.text):
        new = decode(m)
        if new is None or new == m[0]:
            continue
        _copy(layer, at, m.start(), size, parts, marks, spans)
        size += m.start() - at
        if new:
            marks.append(size)
            spans.append((*layer.place(m.start(), m.end()), False))
        parts.append(new)
        size += len(new)
        at = m.end()
    if not parts:
        return None
    _copy(layer, at, len(layer.text), size, parts, marks, spans)
    return Layer("".join(parts), marks, spans)


def _copy(layer: Layer, start: int, end: int, size: int, parts: list, marks: list, spans: list) -> None:
    """Appends a stretch that stays as it is, with the marks that lie in it."""
    if start == end:
        return
    parts.append(layer.text[start:end])
    i = bisect_right(layer.marks, start) - 1
    while i < len(layer.marks) and layer.marks[i] < end:
        low = max(start, layer.marks[i])
        a, b, grows = layer.spans[i]
        marks.append(size + low - start)
        spans.append((a + low - layer.marks[i], b, True) if grows else (a, b, False))
        i += 1


def _from_percent(m: re.Match) -> str:
    """A run of escapes as text; bytes that aren't UTF-8 give U+FFFD each and part nothing else."""
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _from_escape(m: re.Match) -> str | None:
    if m[9]:
        return html.entities.html5.get(m[9])
    digits = next((m[i] for i in range(1, 7) if m[i]), None)
    code = int(digits, 16) if digits else int(m[7]) if m[7] else int(m[8], 8)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _format(data: bytes, at: int) -> str:
    """What the bytes from ``at`` on look like: gzip, bz2, zlib or nothing known."""
    if data.startswith(_GZIP, at):
        return "gzip"
    if _BZIP.match(data, at):
        return "bz2"
    head = data[at : at + 2]
    # Method 8, a window of up to 32 KB, no preset dictionary, and the header's own check.
    return "zlib" if len(head) == 2 and head[0] & 0x8F == 8 and not head[1] & 32 and (head[0] << 8 | head[1]) % 31 == 0 else ""


def _chunks(data: bytes, at: int) -> Generator[bytes, None, int]:
    """What the one stream at ``at`` holds, in bounded pieces; returns where it ends.

    The end is -1 if the stream is cut off, -2 if it is damaged.
    """
    zipped = _format(data, at) == "bz2"
    opened = bz2.BZ2Decompressor() if zipped else zlib.decompressobj(47)
    while at < len(data) and not opened.eof:
        piece = data[at : at + _PIECE]
        at += len(piece)
        while True:
            before = None if zipped else opened.copy()
            try:
                new = opened.decompress(piece, _CHUNK)
            except (zlib.error, OSError):
                if before:
                    yield _up_to_damage(before, piece, _CHUNK)
                return -2
            yield new
            piece = b"" if zipped else opened.unconsumed_tail
            if opened.eof or (opened.needs_input if zipped else not piece and len(new) < _CHUNK):
                break
    return at - len(opened.unused_data) if opened.eof else -1


def _cut_off(data: bytes, at: int) -> bool:
    chunks = _chunks(data, at)
    while True:
        try:
            next(chunks)
        except StopIteration as done:
            return done.value == -1


def _up_to_damage(opened, piece: bytes, room: int) -> bytes:
    out = bytearray()
    for i in range(len(piece)):
        try:
            out += opened.decompress(piece[i : i + 1], room + 1 - len(out))
        except zlib.error:
            break
        if len(out) > room:
            break
    return bytes(out[:room])


def _members(data: bytes, at: int) -> Generator[bytes, None, tuple[int, bool] | None]:
    """All members from ``at`` on in bounded pieces; returns where they end and if they are whole.

    Returns None if the bytes only look compressed. Members of one format that follow each other
    belong together, as pigz and pbzip2 write them.
    """
    kind, known = _format(data, at), False
    while kind:
        held, chunks = 0, _chunks(data, at)
        while True:
            try:
                new = next(chunks)
            except StopIteration as done:
                end = done.value
                break
            held += len(new)
            yield new
        if end < 0 and kind == "zlib" and not held and (end == -2 or data[at] != 0x78):
            break  # two bytes by chance
        known = True
        if end < 0:
            return len(data), False
        at = end
        while kind == "gzip" and data.startswith(b"\0", at):  # padding between members
            at += 1
        if _format(data, at) != kind:
            break
    return (at, True) if known else None


class Opened(NamedTuple):
    """The first bytes of a compressed layer, where it ends, if it is whole, and if it holds more."""

    head: bytes
    end: int
    whole: bool
    more: bool


def _unpacked(data: bytes, at: int, window: int) -> Opened | None:
    """All members from ``at`` on, of which up to ``window`` bytes are kept; None without any."""
    if not _format(data, at):
        return None
    parts, room, size, members = [], window, 0, _members(data, at)
    while True:
        try:
            new = next(members)
        except StopIteration as done:
            return Opened(b"".join(parts), *done.value, size > window) if done.value else None
        size += len(new)
        if room:
            parts.append(new[:room])
            room -= len(parts[-1])


def _windows(data: bytes, window: int) -> Iterator[bytes]:
    """What the members at the start hold, in windows that share their ends."""
    shared, held, fresh = min(SHARED_BYTES, window // 2), bytearray(), 0
    for new in _members(data, 0):
        held += new
        fresh += len(new)
        while len(held) >= window:
            yield bytes(held[:window])
            del held[: window - shared]
            fresh = len(held) - shared
    if fresh > 0:
        yield bytes(held)


def _wide_text(data: bytes) -> str | None:
    """``data`` as UTF-16 if it begins with its mark or nearly every second byte is zero."""
    if len(data) < 4:
        return None
    for order, mark, zeros in (("utf-16-le", b"\xff\xfe", data[1::2]), ("utf-16-be", b"\xfe\xff", data[::2])):
        if data.startswith(mark) or zeros.count(0) * 10 >= len(zeros) * 9 and data.count(0) <= len(zeros) + 1:
            return data[: len(data) // 2 * 2].decode(order, "replace").removeprefix("\ufeff")
    return None


def _text(layer: Packed) -> str | None:
    """The layer as text: control characters and bytes that aren't UTF-8 pass if a stream held them."""
    if wide := _wide_text(layer.data):
        return wide
    if layer.opened:
        return layer.data.decode("utf-8", "replace") or None
    try:
        text = layer.data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and _PRINTABLE.fullmatch(text) else None


def _from_packed(layer: Packed, window: int) -> Iterator[tuple[Layer | Packed, bool]]:
    """The bytes of a compressed layer, else its text; bytes behind the last member are kept."""
    at, text = (layer.start, layer.end), _text(layer)
    got = _unpacked(layer.data, 0, window)
    if got and (got.whole or layer.opened or text is None):
        for part in _windows(layer.data, window) if got.more else [got.head]:
            yield Packed(part, *at, True), got.whole
        if got.end < len(layer.data):
            yield Packed(layer.data[got.end :], *at, layer.opened), True
    elif text:
        yield Layer(text, [0], [(*at, False)]), True


def _bytes_of(body: str) -> bytes:
    """Base64 without its padding; one character too many is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _from_run(run: str, window: int, lines: tuple[int, ...] = ()) -> Iterator[tuple[bytes | str, list[tuple[int, int, int]], bool]]:
    """Readings of a base64 run: bytes or text, (from which character on, start, end in the run), whole.

    ``lines`` says where lines begin in a joined run.
    """
    starts = {0, *lines}
    body = run.rstrip("=").translate(_URL_SAFE)
    if len(body) % 4 != 1:
        data = _bytes_of(body)
        got = _unpacked(data, 0, window)
        if got and (got.end, got.whole) == (len(data), True) or _text(Packed(data, 0, 0)):
            yield data, [(0, 0, len(run))], True
            return
    for shift in range(4):
        data, done = _bytes_of(body[shift:]), 0
        texts = []
        for at in ([0] if not shift and _format(data, 0) else []) + [m.start() for m in _STREAM.finditer(data)]:
            if at < done or not (got := _unpacked(data, at, window)):
                continue
            out, end, whole, _ = got
            place = (0, *_ends(run, shift, at, end, len(data)))
            # Two bytes at a guessed place that lead into damage may be no stream: only their text is read.
            if whole or at == shift == 0 or data[at] != 0x78 or _STRETCH.match(out) and _cut_off(data, at):
                yield data[at:end], [place], whole
                texts.append((done, at))
                done = end
            else:
                for m in _STRETCH.finditer(out):
                    yield m[0].decode("utf-8", "replace"), [place], True
        for m in _WIDE.finditer(data) if b"\0\x20" in data or data.count(0) * 4 > len(data) else ():
            order = "utf-16-be" if data[m.start()] == 0 else "utf-16-le"
            yield m[0].decode(order), [(0, *_ends(run, shift, m.start(), m.end(), len(data)))], True
        for low, high in [*texts, (done, len(data))]:
            for m in _STRETCH.finditer(data, low, high):
                start, end = _ends(run, shift, m.start(), m.end(), len(data))
                places = [(0, start, end)]
                # Bytes before a separator or line can be text by chance: what is behind has its own place.
                if m.start() % 3 or start not in starts and run[start - 1] not in _SEPARATORS:
                    first = shift + (m.start() // 3 + 1) * 4
                    for p in range(first, min(first + 16, end), 4):
                        if p in starts or run[p - 1] in _SEPARATORS:
                            head = data[m.start() : (p - shift) // 4 * 3]
                            places = [(0, start, end), (len(head.decode("utf-8", "ignore")), p, end)]
                            break
                yield m[0].decode("utf-8", "replace"), places, True


def _ends(run: str, shift: int, low: int, high: int, size: int) -> tuple[int, int]:
    """Where the bytes ``low:high`` of ``size``, decoded from ``shift`` on, lie in the run."""
    if high == size:
        return shift + low * 4 // 3, len(run)
    end = shift - (-high * 4 // 3)
    while run[end - 1] in _SEPARATORS:
        end -= 1
    return shift + low * 4 // 3, end


def _from_base64(layer: Layer, window: int) -> Iterator[Layer | Packed]:
    opened: list[tuple[int, int]] = []  # by joined lines
    if re.search(r"[\r\n]|\\[rn]", layer.text):
        for m in _WRAPPED.finditer(layer.text):
            if m.end() - m.start() < 16:
                continue
            lines, at = [], m.start()
            for gap in _BREAK.finditer(m[0]):
                lines.append((at, m.start() + gap.start()))
                at = m.start() + gap.end()
            lines.append((at, m.end()))
            firsts = [0, *accumulate(b - a for a, b in lines)]
            line = lambda i: bisect_right(firsts, i) - 1  # noqa: B023, E731
            place = lambda i: lines[line(i)][0] + i - firsts[line(i)]  # noqa: B023, E731
            for what, places, whole in _from_run("".join(layer.text[a:b] for a, b in lines), window, tuple(firsts)):
                if line(places[0][1]) == line(places[0][2] - 1):
                    continue  # read below
                places = [(c, place(a), place(b - 1) + 1) for c, a, b in places]
                if whole and isinstance(what, bytes):
                    opened.append(places[0][1:])
                yield _child(layer, what, places)
    opened.sort()
    for m in _BASE64.finditer(layer.text):
        for what, places, whole in _from_run(m[0], window):
            places = [(c, m.start() + a, m.start() + b) for c, a, b in places]
            # A line of a stream that was opened is not a cut stream.
            if whole or not _within(places[0][1], places[0][2], opened):
                yield _child(layer, what, places)


def _child(layer: Layer, what: bytes | str, places: list[tuple[int, int, int]]) -> Layer | Packed:
    if isinstance(what, bytes):
        return Packed(what, *layer.place(*places[0][1:]))
    return Layer(what, [c for c, _, _ in places], [(*layer.place(a, b), False) for _, a, b in places])


def _within(start: int, end: int, places: list[tuple[int, int]]) -> bool:
    """Whether one of the sorted, disjoint ``places`` holds ``start:end``."""
    i = bisect_right(places, start, key=lambda x: x[0]) - 1
    return i >= 0 and end <= places[i][1]


def _percent_packed(text: str, window: int) -> Iterator[tuple[tuple[int, int], tuple[bytes, bool]]]:
    """Runs of percent escapes that hold a compressed stream: place, bytes and whether it is whole."""
    for m in _PERCENT_PACKED.finditer(text):
        best = None
        for run in dict.fromkeys((m[0], m[0].replace("+", "%20"))):  # a form writes blanks as +
            data = urllib.parse.unquote_to_bytes(run)
            if (got := _unpacked(data, 0, window)) and (best is None or got.whole):
                best = data, got.whole
                if got.whole:
                    break
        if best:
            yield m.span(), best


def _children(layer: Layer | Packed, window: int) -> Iterator[tuple[Layer | Packed, bool]]:
    if isinstance(layer, Packed):
        yield from _from_packed(layer, window)
        return
    if "%" in layer.text:
        packed = dict(_percent_packed(layer.text, window))
        for (start, end), (data, _) in packed.items():
            yield Packed(data, *layer.place(start, end)), True
        # What was opened whole isn't text: its escapes stay, else its parts look like cut streams.
        done = [at for at, (_, whole) in packed.items() if whole]
        new = _replaced(layer, _PERCENT, lambda m: None if _within(*m.span(), done) else _from_percent(m))
        if new:
            yield new, True
    if _ESCAPED.search(layer.text) and (new := _replaced(layer, _ESCAPE, _from_escape)):
        yield new, True
    for child in _from_base64(layer, window):
        yield child, True


def scan_text(text: str, window: int = WINDOW_BYTES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, bool]:
    """(base findings, all findings, texts opened, complete); findings are (start, kind, end).

    Layers are opened depth first, so of a long one a window at a time is held.
    """
    base = sorted(base_matches(text))
    found, complete, opened = set(base), True, -1
    seen: set[tuple] = set()
    work: list[Iterator[tuple[Layer | Packed, bool]]] = [iter([(Layer(text, [0], [(0, len(text), True)]), True)])]
    while work:
        layer, whole = next(work[-1], (None, True))
        if layer is None:
            work.pop()
            continue
        complete &= whole
        if (key := _key(layer)) in seen:
            continue
        seen.add(key)
        if isinstance(layer, Layer):
            opened += 1
            if opened:
                for start, kind, end in base_matches(layer.text):
                    low, high = layer.place(start, end)
                    found.add((low, kind, high))
        work.append(_children(layer, window))
    return base, sorted(found), opened, complete


_SCANNED = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, layers int, complete boolean"


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", window: int = WINDOW_BYTES) -> DataFrame:
    """``docs`` with one struct ``out``: ``base`` and ``spans`` (kind, start, end), layers, complete.

    Spans are code points of the text, end exclusive, ordered by start, kind and end. A null
    text counts as empty and has no findings. ``layers`` counts the texts that were decoded.
    ``complete`` is false where a compressed stream is cut off or damaged; what it holds up to
    there is searched. A layer of more than ``window`` bytes is searched in windows that share
    ``SHARED_BYTES``. Rows are judged one by one: repeated rows and ties don't
    matter, an empty table gives an empty result, other columns stay; a column named like
    ``out`` is replaced. No shuffle.
    """

    @F.pandas_udf(_SCANNED)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, found, layers, complete = scan_text(t, window)
            named = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in (base, found)]
            rows.append((*named, layers, complete))
        return pd.DataFrame(rows, columns=["base", "spans", "layers", "complete"])

    return docs.withColumn(out, scanned(text_or_empty(text)))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"),
        F.col("secrets.layers").alias("n_layers"), F.col("secrets.complete").alias("complete"),
    )
