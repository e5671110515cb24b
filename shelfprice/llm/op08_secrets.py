"""Secret scans over a text and over everything that is encoded in it, layer by layer."""

from __future__ import annotations

import binascii
import bisect
import hashlib
import re
import sys
import zlib
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm.common import map_batches, read_table

# The patterns of the contract. Runs of hex digits and key letters are maximal, so the least length can
# stand in the pattern; the value of an assignment is measured after the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6

# What may be a layer: percent escapes with what stands around them, \u and \x escapes, base64 of 16 letters or more.
# A match starts where a run of letters starts, so that long runs are read once.
URL = re.compile(r"(?<![A-Za-z0-9_.~+/=:&-])[A-Za-z0-9_.~+/=:&-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~+/=:&-]*+)+")
ESCAPES = re.compile(r"(?<![A-Za-z0-9_+/=:.-])(?:[A-Za-z0-9_+/=:.-]*+(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}))+[A-Za-z0-9_+/=:.-]*+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
# Every escape of a text: runs of percent escapes, %uXXXX, pairs of surrogates, \u{X}, \uXXXX, \UXXXXXXXX, \xXX, and the
# escaped quotes, slashes and backslashes of texts inside texts.
ANY_ESCAPE = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|%u(?P<wide>[0-9A-Fa-f]{4})|\\u(?P<high>[dD][89abAB][0-9A-Fa-f]{2})\\u(?P<low>[dD][c-fC-F][0-9A-Fa-f]{2})"
    r"|\\u\{(?P<open>[0-9A-Fa-f]{1,6})\}|\\u(?P<four>[0-9A-Fa-f]{4})|\\U(?P<eight>[0-9A-Fa-f]{8})|\\x(?P<two>[0-9A-Fa-f]{2})|\\(?P<quoted>[\"'/\\])"
)
#: Letters of the two base64 alphabets. Their runs are maximal and apart: one may hold a piece of the other.
ALPHABETS = ("A-Za-z0-9+/", "A-Za-z0-9_-")
RUNS = [re.compile(x) for a in ALPHABETS for x in (rf"[{a}]{{16,}}={{0,2}}", rf"(?<![{a}])[{a}]++(?:\r?\n[ \t]*+[{a}]++)+={{0,2}}")]
LEAST_RUN = 16
#: Starts of gzip and zlib streams, as bytes and behind escapes, and what may stand for their bytes there.
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
PACKED_URL = re.compile(r"%1f%8b|(?:x|%78)(?:%01|%5e|\^|%9c|%da)", re.IGNORECASE)
PACKED_ESCAPES = re.compile(r"(?:\\x|\\u00)1f(?:\\x|\\u00)8b|(?:x|(?:\\x|\\u00)78)(?:(?:\\x|\\u00)(?:01|5e|9c|da)|\^)", re.IGNORECASE)
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|([!-$&-~])")
ESCAPE_BYTE = re.compile(r"""\\(?:x|u00)([0-9A-Fa-f]{2})|([ -\[\]-~])|\\([abfnrtv0\\'"])""")
SHORT = dict(zip("abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\"", strict=True))
#: Readable bytes: printable ASCII and white space, and UTF-8 beyond.
READABLE = re.compile(rb"(?:[\t\r\n -~]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
#: Bytes that are unfolded at once; bytes that a stream keeps for matches over its cuts; start of an escaped run it keeps.
CHUNK, OVERLAP, HELD = 1 << 16, 64, 1 << 20
#: Streams inside each other that are opened. Some packed bytes unfold to ever new packed bytes, without end.
DEPTH = 1000


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


class Layer(NamedTuple):
    """A decoded text. Characters from marks[i] on stand at places[i] of the document; None: all at begin to end."""

    text: str
    begin: int
    end: int
    marks: list[int] | None
    places: list[tuple[int, int]] | None

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.marks is None:
            return self.begin, self.end
        first, last = (bisect.bisect_right(self.marks, i) - 1 for i in (start, end - 1))
        return self.places[first][0], self.places[last][1]


class Whole(NamedTuple):
    """The document itself as the outermost layer: every place is its own."""

    text: str

    def span(self, start: int, end: int) -> tuple[int, int]:
        return start, end


class Rewritten(NamedTuple):
    """A whole text with all of its escapes decoded. Pieces start at starts[i] and stand at sources[i] of the outer text; plain ones letter by letter."""

    text: str
    starts: list[int]
    sources: list[tuple[int, int, bool]]
    outer: Rewritten | Layer | Whole

    @property
    def begin(self) -> int:
        return self.span(0, 1)[0]

    def span(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        # A loop, as layers may be many.
        while isinstance(layer, Rewritten):
            i, j = (bisect.bisect_right(layer.starts, k) - 1 for k in (start, end - 1))
            (first, _, plain), (second, last, plain_end) = layer.sources[i], layer.sources[j]
            start, end = first + (start - layer.starts[i] if plain else 0), second + end - layer.starts[j] if plain_end else last
            layer = layer.outer
        return layer.span(start, end)


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def readable(data: bytes) -> str | None:
    """The text of decoded bytes, if they are mostly printable UTF-8."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(not (c.isprintable() or c in "\t\r\n") for c in text)
    return text if text and odd * 10 <= len(text) else None


def decoded(letters: bytes) -> bytes:
    """Bytes of base64 letters of either alphabet; a single letter at the end, which holds no whole byte, is left out."""
    core = letters[:-1] if len(letters) % 4 == 1 else letters
    return binascii.a2b_base64(core.translate(STANDARD) + b"=" * (-len(core) % 4))


STANDARD = bytes.maketrans(b"-_", b"+/")


class Unpacker:
    """A gzip or zlib stream; what it unfolds to goes on in chunks."""

    def __init__(self, target: Stream) -> None:
        self.stream, self.target, self.read = zlib.decompressobj(47), target, 0

    def feed(self, data: bytes) -> bool:
        """Whether the stream goes on behind these bytes."""
        rest = data
        while True:
            try:
                out = self.stream.decompress(rest, CHUNK)
            except zlib.error:
                return False
            rest = self.stream.unconsumed_tail
            if out:
                self.target.feed(out)
            if self.target.full():
                return False
            if self.stream.eof:
                self.read += len(data) - len(self.stream.unused_data)
                return False
            if not rest and len(out) < CHUNK:
                self.read += len(data)
                return True


class Runs:
    """The runs of one base64 alphabet in a stream, decoded from each of their first four letters on.

    Runs go on over line ends. Where a stream is cut, blanks join them too: more letters in front shift a run only to
    another of the four.
    """

    def __init__(self, outer: Stream, alphabet: str) -> None:
        self.outer, self.open, self.held, self.long = outer, False, b"", False
        self.special = alphabet[-2:].encode()
        a = alphabet.encode()
        self.token = re.compile(b"(?<![%b])(?:[%b]{16,}+(?:\r?\n[ \t]*+[%b]++)*|[%b]++(?:\r?\n[ \t]*+[%b]++)+)" % (a, a, a, a, a))
        self.members = bytes(c for c in range(128) if re.match(b"[%b]" % a, bytes([c]))) + b"\r\n\t "
        self.rest, self.targets = [b""] * 4, []

    def feed(self, data: bytes) -> None:
        head = 0
        if self.open:
            head = len(data) - len(data.lstrip(self.members))
            self.put(data[:head])
            if head == len(data):
                return
            self.end()
        tail = len(data.rstrip(self.members))
        for m in self.token.finditer(data, head, tail):
            word = m[0]
            # A run without - and _ is part of one of the other alphabet.
            if self.special == b"_-" and b"-" not in word and b"_" not in word:
                continue
            if not one_case(word):
                self.put(word)
                self.end()
        if tail < len(data):
            self.put(data[tail:])
            self.open = True

    def put(self, data: bytes) -> None:
        letters = data.translate(None, b"\r\n\t ")
        if not self.long:
            self.held += letters
            if len(self.held) < LEAST_RUN:
                return
            self.long, letters = True, self.held
            if not self.targets:
                self.targets = [self.outer.inner() for _ in range(4)]
            self.rest = [letters[i:] for i in range(4)]
        else:
            self.rest = [r + letters for r in self.rest]
        for i, target in enumerate(self.targets):
            whole = len(self.rest[i]) // 4 * 4
            target.feed(decoded(self.rest[i][:whole]))
            self.rest[i] = self.rest[i][whole:]

    def end(self) -> None:
        if self.long:
            for r, target in zip(self.rest, self.targets, strict=True):
                target.feed(decoded(r) + b"\0")
        self.open, self.held, self.long = False, b"", False

    def state(self) -> tuple | None:
        targets = [t.state() for t in self.targets]
        return None if None in targets else (self.open, self.held, self.long, *self.rest, *targets)

    def close(self) -> None:
        if self.open:
            self.end()
        for target in self.targets:
            target.close()


def one_case(word: str | bytes) -> bool:
    """Long natural words and names are letters of one case; base64 of any text mixes them or has digits."""
    return word.isalpha() and (word[1:].islower() or word.isupper())


class Escaped:
    """Runs with percent, or backslash, escapes in a stream; they go on decoded."""

    def __init__(self, outer: Stream, mark: bytes, run: str, members: str, escape: re.Pattern) -> None:
        self.outer, self.mark, self.escape, self.held, self.target, self.open, self.begun = outer, mark, escape, b"", None, False, False
        self.run = re.compile(run.encode())
        self.members = bytes(c for c in range(128) if re.match(f"[{members}]", chr(c))) + mark

    def feed(self, data: bytes) -> None:
        head = 0
        if self.open:
            head = len(data) - len(data.lstrip(self.members))
            self.put(data[:head])
            if head == len(data):
                return
            self.end()
        tail = len(data.rstrip(self.members))
        if self.mark in data:
            for m in self.run.finditer(data, head, tail):
                self.put(m[0])
                self.end()
        if tail < len(data):
            self.put(data[tail:])
            self.open = True

    def put(self, data: bytes) -> None:
        self.held += data
        if not self.begun:
            if not (self.mark in self.held[-len(data) - 5:] and self.escape.search(self.held)):
                self.held = self.held[-HELD:]
                return
            self.begun = True
            self.target = self.target or self.outer.inner()
        # An escape may be cut.
        cut = self.held.rfind(self.mark, -5)
        cut = len(self.held) if cut < 0 or self.escape.match(self.held, cut) else cut
        self.target.feed(self.escape.sub(escaped_byte, self.held[:cut]))
        self.held = self.held[cut:]

    def end(self) -> None:
        if self.begun:
            self.target.feed(self.held + b"\0")
        self.open, self.begun, self.held = False, False, b""

    def state(self) -> tuple | None:
        target = self.target.state() if self.target else ()
        return None if target is None else (self.open, self.begun, self.held, target)

    def close(self) -> None:
        if self.open:
            self.end()
        if self.target:
            self.target.close()


def escaped_byte(m: re.Match) -> bytes:
    code = int(next(g for g in m.groups() if g), 16)
    return bytes([code]) if code < 256 else chr(code).encode("utf-8", "replace")


PERCENT_BYTES, ESCAPE_BYTES = re.compile(rb"%([0-9A-Fa-f]{2})"), re.compile(ESCAPE.pattern.encode())
ASSIGN_BYTES, ACCESS_BYTES, HEX_BYTES = re.compile(ASSIGN.pattern.encode(), re.IGNORECASE), re.compile(ACCESS.pattern.encode()), re.compile(HEX.pattern.encode())
NAMES_BYTES = tuple(n.encode() for n in NAMES)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Stream:
    """Decoded bytes that all have one place in the document, so only the kinds of their secrets matter.

    They come in pieces and are not kept: secrets are matched with an overlap, and inner layers are fed from here, so the
    memory needed doesn't grow with what packed layers unfold to. All of it ends when every kind was found.
    """

    def __init__(self, kinds: set[int], depth: int = 0, above: frozenset[bytes] = frozenset(), opened: dict[bytes, set[tuple[int, bytes]]] | None = None) -> None:
        self.kinds, self.depth, self.above, self.opened = kinds, depth, above, {} if opened is None else opened
        self.last, self.packed, self.parts = b"", [], None
        self.repeated, self.known = b"", None

    def state(self) -> tuple | None:
        """All that the further course depends on besides the kinds found; None while a packed stream is open."""
        if self.packed:
            return None
        parts = [p.state() for p in self.parts or ()]
        return None if None in parts else (self.last, *parts)

    def full(self) -> bool:
        return len(self.kinds) == len(KINDS)

    def inner(self) -> Stream:
        return Stream(self.kinds, self.depth + 1, self.above, self.opened)

    def feed(self, data: bytes) -> None:
        if not data or self.full() or self.depth > DEPTH:
            return
        # The same bytes again, and all as it was before them: nothing new can come of it.
        if data == self.repeated:
            state = self.state()
            if state is not None and state == self.known:
                return
            self.known = state
        else:
            self.repeated, self.known = data, None
        self.packed = [u for u in self.packed if u.feed(data)]
        both = self.last[-2:] + data
        for m in PACKED.finditer(both):
            if m.end() > len(self.last[-2:]):
                self.unpack(both[m.start():])
        window = self.last + data
        self.match(window)
        # Blanks between a name and its value may be many.
        self.last = re.sub(rb" {2,}", b" ", window)[-OVERLAP:] if b"  " in window[-OVERLAP:] else window[-OVERLAP:]
        if self.parts is None:
            self.parts = [
                *(Runs(self, a) for a in ALPHABETS),
                Escaped(self, b"%", URL.pattern, "A-Za-z0-9_.~+/=:&-", PERCENT_BYTES),
                Escaped(self, b"\\", ESCAPES.pattern, "A-Za-z0-9_+/=:.-", ESCAPE_BYTES),
            ]
        for part in self.parts:
            part.feed(data)
        for pattern, grammar in ((PACKED_URL, URL_BYTE), (PACKED_ESCAPES, ESCAPE_BYTE)):
            if (b"%" if grammar is URL_BYTE else b"\\") in data:
                text = data.decode("latin-1")
                for m in pattern.finditer(text):
                    packed_kinds(text, m.start(), grammar, self)

    def unpack(self, data: bytes) -> None:
        # Packed bytes that don't shrink stand in their outer stream as well; each is opened once.
        known = self.opened.setdefault(data[:16], set())
        if any((n, digest(data[:n])) in known for n in {n for n, _ in known}):
            return
        first = digest(data[:CHUNK])
        # A stream that unfolds to itself holds nothing new.
        if first in self.above:
            return
        unpacker = Unpacker(Stream(self.kinds, self.depth + 1, self.above | {first}, self.opened))
        if unpacker.feed(data):
            self.packed.append(unpacker)
            return
        unpacker.target.close()
        if unpacker.stream.eof:
            known.add((unpacker.read, digest(data[:unpacker.read])))

    def match(self, data: bytes) -> None:
        low = data.lower()
        if 0 not in self.kinds and any(n in low for n in NAMES_BYTES) and any(len(m[2]) >= LEAST_VALUE for m in ASSIGN_BYTES.finditer(data)):
            self.kinds.add(0)
        if b"AKIA" in data and ACCESS_BYTES.search(data):
            self.kinds.add(1)
        if 2 not in self.kinds and HEX_BYTES.search(data):
            self.kinds.add(2)

    def close(self) -> None:
        for u in self.packed:
            u.target.close()
        for part in self.parts or ():
            part.close()


def kinds_in(data: bytes) -> set[int]:
    """Kinds of the secrets in bytes and in all layers inside them."""
    kinds: set[int] = set()
    stream = Stream(kinds)
    for at in range(0, len(data), HELD):
        stream.feed(data[at:at + HELD])
    stream.close()
    return kinds


def packed_kinds(text: str, at: int, grammar: re.Pattern, outer: Stream) -> int:
    """Feed the packed stream whose escaped bytes start here to a stream inside outer; give the place behind it.

    The stream's own end counts, not that of a run of letters: between its escapes any printable byte may stand.
    """
    unpacker, size, spaced = Unpacker(outer.inner()), 256, grammar is URL_BYTE
    end = at
    while True:
        data, ends = bytearray(), []
        while len(data) < size and (m := grammar.match(text, end)):
            data.append(int(m[1], 16) if m[1] else ord(m[2]) if m[2] else SHORT[m[3]])
            end = m.end()
            ends.append(end)
        if not data:
            break
        before = unpacker.read
        if not unpacker.feed(bytes(data)):
            if unpacker.stream.eof:
                end = ends[unpacker.read - before - 1]
            break
        size = min(size * 2, CHUNK)
    unpacker.target.close()
    return end


def escaped_layer(match: re.Match, outer: Layer | Whole) -> Layer | None:
    r"""Decode \u and \x escapes; each escape keeps its own place in the document."""
    text, marks, places, at = [], [], [], 0
    size, units = 0, []

    def flush() -> None:
        nonlocal size
        if units:
            run = b"".join(u.to_bytes(2, "little") for u, _, _ in units).decode("utf-16-le", "replace")
            marks.append(size)
            places.append(outer.span(units[0][1], units[-1][2]))
            text.append(run)
            size += len(run)
            units.clear()

    base, whole = match.start(), match[0]
    for m in ESCAPE.finditer(whole):
        if m.start() > at:
            flush()
            plain_pieces(whole[at:m.start()], base + at, outer, text, marks, places, size)
            size += m.start() - at
        code = int(m[1] or m[2], 16)
        units.append((code, base + m.start(), base + m.end()))
        if not 0xD800 <= code < 0xDC00:
            flush()
        at = m.end()
    flush()
    if at < len(whole):
        plain_pieces(whole[at:], base + at, outer, text, marks, places, size)
    return Layer("".join(text), *outer.span(match.start(), match.end()), marks, places)


def plain_pieces(part: str, start: int, outer: Layer | Whole, text: list, marks: list, places: list, size: int) -> None:
    for i in range(len(part)):
        marks.append(size + i)
        places.append(outer.span(start + i, start + i + 1))
    text.append(part)


def url_layer(match: re.Match, outer: Layer | Whole) -> Layer | None:
    """Decode percent escapes; a character of several escapes has the place of all of them."""
    text, marks, places, size = [], [], [], 0
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+|[^%]+|%", match[0]):
        start = match.start() + m.start()
        if m[0][0] != "%" or len(m[0]) < 3:
            plain_pieces(m[0], start, outer, text, marks, places, size)
            size += len(m[0])
            continue
        data = unquote_to_bytes(m[0])
        chars = data.decode("utf-8", "replace")
        exact = len(chars.encode()) == len(data)
        at = 0
        for c in chars:
            width = len(c.encode()) if exact else 0
            marks.append(size)
            places.append(outer.span(start + 3 * at, start + 3 * (at + width)) if exact else outer.span(start, start + len(m[0])))
            text.append(c)
            size += 1
            at += width
    return Layer("".join(text), *outer.span(match.start(), match.end()), marks, places)


def rewritten(outer: Rewritten | Layer | Whole) -> Rewritten | None:
    """The text with every escape of either kind decoded, None without any: names and values that are only partly escaped stand together again."""
    parts, starts, sources, size, at = [], [], [], 0, 0

    def put(text: str, start: int, end: int, plain: bool) -> None:
        nonlocal size
        if text:
            parts.append(text)
            starts.append(size)
            sources.append((start, end, plain))
            size += len(text)

    for m in ANY_ESCAPE.finditer(outer.text):
        put(outer.text[at:m.start()], at, m.start(), True)
        at = m.end()
        if m["url"]:
            data = unquote_to_bytes(m["url"])
            chars = data.decode("utf-8", "replace")
            if len(chars.encode()) == len(data):
                here = m.start()
                for c in chars:
                    put(c, here, here + 3 * len(c.encode()), False)
                    here += 3 * len(c.encode())
            else:
                put(chars, m.start(), m.end(), False)
        elif m["high"]:
            put(chr(0x10000 + (int(m["high"], 16) - 0xD800 << 10) + int(m["low"], 16) - 0xDC00), m.start(), m.end(), False)
        elif m["quoted"]:
            put(m["quoted"], m.start(), m.end(), False)
        else:
            code = int(m["wide"] or m["open"] or m["four"] or m["eight"] or m["two"], 16)
            # Numbers that are no character stand as its replacement.
            put(chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "\ufffd", m.start(), m.end(), False)
    if not at:
        return None
    put(outer.text[at:], at, len(outer.text), True)
    return Rewritten("".join(parts), starts, sources, outer)


def layers_in(outer: Rewritten | Layer | Whole) -> list[Rewritten | Layer]:
    """The layers of percent and backslash escapes in a text: each run of them by itself, and the whole text with all of them decoded."""
    found, text = [], outer.text
    if ("%" in text or "\\" in text) and not isinstance(outer, Layer) and (whole := rewritten(outer)):
        found.append(whole)
    if "%" in text:
        found += [url_layer(m, outer) for m in URL.finditer(text)]
    if "\\" in text:
        found += [escaped_layer(m, outer) for m in ESCAPES.finditer(text)]
    return found


def hidden(outer: Rewritten | Layer | Whole) -> set[Span]:
    """Secrets in the base64 runs and packed streams of a text, and in all layers inside those."""
    text, spans = outer.text, set()

    def add(start: int, end: int, kinds: set[int]) -> None:
        begin, stop = outer.span(start, end)
        spans.update(Span(begin, k, stop) for k in kinds)

    for pattern, grammar, mark in ((PACKED_URL, URL_BYTE, "%"), (PACKED_ESCAPES, ESCAPE_BYTE, "\\")):
        if mark in text:
            for m in pattern.finditer(text):
                kinds: set[int] = set()
                end = packed_kinds(text, m.start(), grammar, Stream(kinds))
                add(m.start(), end, kinds)
    runs = {(m.start(), m.end()) for r in RUNS for m in r.finditer(text) if m.end() - m.start() >= LEAST_RUN}
    done: list[tuple[int, int]] = []
    for start, end in sorted(runs, key=lambda r: (r[0] - r[1], r)):
        if not any(a <= start and end <= b for a, b in done):
            for a, b, kinds in run_items(text, start, end):
                add(a, b, kinds)
                done.append((a, b))
    return spans


def repacked(data: bytes) -> set[int] | None:
    """Kinds of the secrets in bytes that are UTF-16 text or a raw deflate stream as a whole; None if they are neither."""
    for codec, zeros in (("utf-16-le", data[1::2]), ("utf-16-be", data[::2])):
        if 2 * zeros.count(0) > len(zeros) > 0 and len(data) % 2 == 0:
            try:
                text = data.decode(codec).lstrip("\ufeff")
            except UnicodeDecodeError:
                continue
            if readable(text.encode("utf-8", "replace")) is not None:
                return kinds_in(text.encode())
    if PACKED.match(data):
        return None
    trial = zlib.decompressobj(-15)
    try:
        first = trial.decompress(data, CHUNK)
    except zlib.error:
        return None
    if len(first) < LEAST_RUN or readable(first.decode("utf-8", "ignore").encode()) is None or first.decode("utf-8", "replace").count("\ufffd") > 2:
        return None
    kinds: set[int] = set()
    unpacker = Unpacker(Stream(kinds))
    unpacker.stream = zlib.decompressobj(-15)
    unpacker.feed(data)
    unpacker.target.close()
    return kinds if unpacker.stream.eof else None


def run_items(text: str, start: int, end: int) -> list[tuple[int, int, set[int]]]:
    """(start, end, kinds) of encoded runs with secrets in a maximal run of letters.

    Mostly the run is one. If it isn't readable as a whole, its bytes are read from each of its first four letters on, as
    other letters may stand in front or behind, like the folders of a path: packed streams and readable parts count.
    """
    whole = text[start:end].rstrip("=")
    if one_case(whole):
        return []
    lines, places, at = [], [], 0
    for m in re.finditer(r"[^\s]+", whole):
        lines.append(m[0])
        places.append((at, start + m.start()))
        at += len(m[0])
    letters = "".join(lines)
    if len(letters) < LEAST_RUN or one_case(letters):
        return []
    data = decoded(letters.encode())
    if len(letters) % 4 != 1 and readable(data) is not None:
        kinds = kinds_in(data)
        return [(start, end, kinds)] if kinds else []

    def place(letter: int) -> int:
        i = bisect.bisect_right(places, (letter, len(text))) - 1
        return places[i][1] + letter - places[i][0]

    def found(first: int, last: int, kinds: set[int]) -> tuple[int, int, set[int]]:
        return place(first), end if last >= len(letters) else place(last - 1) + 1, kinds

    other = repacked(data)
    if other is not None:
        return [(start, end, other)] if other else []
    starts = sorted({m.end() for m in re.finditer(r"[+/_-]", letters)} | {a for a, _ in places})
    items, settled = [], []

    def taken(first: int, last: int) -> bool:
        """Letters of a packed stream that was read to its end are nothing else, at no other phase."""
        return any(first < b and a < last for a, b in settled)

    for phase in range(4):
        if any(a <= 3 and b >= len(letters) - 4 for a, b in settled):
            break
        data = decoded(letters[phase:].encode()) if phase else data
        behind = 0
        for m in PACKED.finditer(data):
            if m.start() < behind or taken(phase + m.start() // 3 * 4, phase + -(-m.end() // 3) * 4):
                continue
            kinds: set[int] = set()
            unpacker = Unpacker(Stream(kinds))
            unpacker.feed(data[m.start():])
            unpacker.target.close()
            if unpacker.stream.eof:
                behind = m.start() + unpacker.read
                settled.append((phase + m.start() // 3 * 4, phase + -(-behind // 3) * 4))
            if kinds:
                stop = behind if unpacker.stream.eof else len(data)
                items.append(found(phase + m.start() // 3 * 4, phase + -(-stop // 3) * 4, kinds))
        for m in READABLE.finditer(data):
            if taken(phase + m.start() // 3 * 4, phase + -(-m.end() // 3) * 4):
                continue
            kinds = kinds_in(m[0])
            if not kinds:
                continue
            first, last = phase + m.start() // 3 * 4, phase + -(-m.end() // 3) * 4
            # Readable by chance: a letter or two before the start, or behind the end of a line.
            for s in starts[bisect.bisect_left(starts, first):]:
                if s > first + 32:
                    break
                if (s - phase) % 4 == 0 and (s - phase) // 4 * 3 >= m.start() and kinds_in(data[(s - phase) // 4 * 3:m.end()]) == kinds:
                    first = s
                    break
            for a, _ in reversed(places):
                if first < a < min(last, len(letters)) and last - a <= 8 and kinds_in(data[(first - phase) // 4 * 3:-(-(a - phase) * 3 // 4)]) == kinds:
                    last = a
                    break
            items.append(found(first, last, kinds))
    return items


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and these together with the spans of secrets in nested layers, mapped to the document.

    A worklist holds layers of escapes, whose characters keep their places. A decoded text that was met at the same place
    is not taken up again, which ends cycles; as every decoding shortens its text, the list runs empty. What base64 and
    packed layers hold has the place of their run, whatever is inside.
    """
    # A stream feeds the one inside it.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEPTH))
    base = base_spans(text)
    every = set(base)
    every |= hidden(Whole(text))
    work = layers_in(Whole(text))
    seen = {(x.text, x.begin) for x in work}
    while work:
        layer = work.pop()
        every.update(Span(b, s.kind, e) for s in base_spans(layer.text) for b, e in [layer.span(s.start, s.end)])
        every |= hidden(layer)
        for inner in layers_in(layer):
            if (inner.text, inner.begin) not in seen and inner.text != layer.text:
                seen.add((inner.text, inner.begin))
                work.append(inner)
    return base, sorted(every)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of whole texts: key, base and spans, arrays of (kind, start, end) in code points, ends exclusive.

    base holds direct matches, spans these and the matches in nested layers at the place of the outermost encoded run
    that holds them. Null and empty texts have empty arrays; each row gives one row, repeated and null keys included;
    other columns are left out. Equal spans from different layers count once.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan(x or "") for x in batch.column(1).to_pylist()]
        rows = [pa.array([[{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in f[i]] for f in found], pieces) for i in (0, 1)]
        return pa.record_batch([batch.column(0), *rows], names=[key, "base", "spans"])

    return map_batches(docs.select(key, text), each, f"`{key}` {kind}, base {SPANS}, spans {SPANS}")


def redacted(docs: DataFrame, mask: str = "[SECRET]", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns with every secret span of the text, nested ones included, replaced by a mask.

    Overlapping spans give one mask. Null texts stay null.
    """
    at = docs.columns.index(text)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in batch.column(at).to_pylist():
            if x:
                parts, done = [], 0
                for s in scan(x)[1]:
                    if s.start >= done:
                        parts += [x[done:s.start], mask]
                    done = max(done, s.end)
                x = "".join([*parts, x[done:]])
            out.append(x)
        return pa.record_batch([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1:]], names=batch.schema.names)

    return map_batches(docs, each, docs.schema)


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
