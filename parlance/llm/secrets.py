"""Secret scans: a worklist that unwraps encoded layers of a text until nothing new turns up.

The whole text is scanned first. Then every layer is searched for encodings, each of which gives a new layer:

* URL escapes (%41), all of a layer at once,
* Unicode and hex escapes (\\u0041, \\x41, \\u{41}, &#65;, &#x41;), all of a layer at once,
* base64 runs of 16 or more characters, plain or URL-safe, also wrapped over lines, decoded from each of the four places
  in step with them (text that is glued to a run shifts it), of which whole texts and stretches of readable characters
  (one or two bytes each) count,
* gzip, zlib, bzip2 and xz streams, with all their members, among decoded bytes or written in URL or \\x escapes.

A stream is unpacked piece by piece, whatever it unpacks to, and each piece is a layer that overlaps the one before, so
memory is bounded and nothing is left packed. Streams inside streams go on a worklist of their own, which knows the
content of all that it has taken up. Of a damaged stream all counts that comes out of it before the damage.

Each layer keeps, for each of its characters, the part of the original text that it came from, so a secret found at any
depth is reported as a span of the original. A layer that was seen before (same characters from the same place) is not
taken up again, which ends cycles such as a stream that unpacks to itself.

Null and empty texts have no spans. Spans count code points; ends are exclusive. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds and their patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGNED = 12

_URL = re.compile(r"%[0-9A-Fa-f]{2}")
_URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]*={0,2}")
# The first bytes of streams: those that count where bytes begin, and those that are long enough to count anywhere.
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00")
_SURE = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
# The same in escapes; a stream has bytes that do not print, so escapes follow soon.
_URL_MAGIC = re.compile(r"%1[fF]%8[bB]|(?:x|%78)(?:%01|%5[eE]|%9[cC]|%[dD][aA]|\^(?=.{0,3}%))|BZh[1-9]1AY|%[fF][dD]7zXZ")
_X_MAGIC = re.compile(r"\\x1[fF]\\x8[bB]|(?:x|\\x78)(?:\\x01|\\x5[eE]|\\x9[cC]|\\x[dD][aA]|\^(?=.{0,3}\\x))|BZh[1-9]1AY|\\x[fF][dD]7zXZ")
_URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|[^\s\"'<>]")
_X_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'\"])|.", re.DOTALL)
_CONTROL = dict(zip("abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\""))
#: Stretches of readable bytes of at least this length count where not all of them are text.
LEAST_READABLE = 12
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % LEAST_READABLE)
_READABLE_16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}|(?:\x00[\t\n\r\x20-\x7e]){%d,}" % (LEAST_READABLE, LEAST_READABLE))

#: Bytes of a piece of an unpacked stream, and those that it shares with the piece before.
PIECE, OVERLAP = 4 << 20, 1 << 16


def scan(text: str) -> list[tuple[int, int, str]]:
    """The spans (start, end, kind) of one layer, leftmost and non-overlapping for each kind."""
    low = text.lower()
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED] if any(k in low for k in KEYWORDS) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class Layer:
    """Decoded characters and where each starts and ends in the original text: two arrays, or one span for all of them
    (a piece of a stream), or None (the layer is the original)."""

    __slots__ = ("text", "starts", "ends", "whole")

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None, whole: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.whole = text, starts, ends, whole

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The original's part that characters a to b came from."""
        if self.whole:
            return self.whole
        if self.starts is None:
            return a, b
        return min(self.starts[a:b]), max(self.ends[a:b])

    def key(self) -> bytes:
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        if self.whole:
            h.update(b"%d %d" % self.whole)
        elif self.starts is not None and len(self.text):
            h.update(b"%d %d" % (min(self.starts), max(self.ends)))
        return h.digest()


class _Derived:
    """A layer in the making: parts of another one and characters that stand for parts of it."""

    def __init__(self, of: Layer):
        self.of, self.out, self.starts, self.ends = of, [], array("q"), array("q")

    def plain(self, a: int, b: int) -> None:
        self.out.append(self.of.text[a:b])
        if not self.of.whole:
            for i in range(a, b):
                s, e = self.of.span(i, i + 1)
                self.starts.append(s)
                self.ends.append(e)

    def add(self, c: str, a: int, b: int) -> None:
        self.out.append(c)
        if not self.of.whole:
            s, e = self.of.span(a, b)
            self.starts.append(s)
            self.ends.append(e)

    def layer(self) -> Layer:
        return Layer("".join(self.out), whole=self.of.whole) if self.of.whole else Layer("".join(self.out), self.starts, self.ends)


class Bytes:
    """Decoded bytes; `at(i)` says where the i-th came from."""

    def __init__(self, raw: bytes, at: Callable[[int], tuple[int, int]]):
        self.raw, self.at = raw, at

    def layer(self, a: int, b: int, wide: int, text: str) -> Layer:
        """Bytes a to b as characters of so many bytes each (0: as in UTF-8)."""
        starts, ends, i = array("q"), array("q"), a
        for c in text:
            n = wide or len(c.encode("utf-8", "surrogatepass"))
            starts.append(self.at(i)[0])
            ends.append(self.at(i + n - 1)[1])
            i += n
        return Layer(text, starts, ends)


#: Bytes given to an unpacker at once. A zlib stream is copied before each, so that what it gives up to a damaged byte is
#: kept; the others have no copy and get few bytes at once, so that little is lost with them.
FEED, FEED_OTHER = 4096, 64
#: The longest file name or comment in the head of a gzip stream.
LONGEST_NAME = 4096


def _headed(data: bytes, at: int) -> bool:
    """Whether the head of a gzip stream that starts here can end; without this, a mark among bytes that has no zero
    behind it would be read to their end."""
    flags, i = data[at + 3], at + 10
    if flags & 0xE0 or data[at + 2] != 8:
        return False
    if flags & 4:
        i += 2 + int.from_bytes(data[i : i + 2], "little")
    for flag in (8, 16):
        if flags & flag and i < len(data):
            end = data.find(b"\0", i, i + LONGEST_NAME)
            if end < 0:
                return len(data) < i + LONGEST_NAME  # more may be to come
            i = end + 1
    return True


class _Stage:
    """Unpacks a stream and the members behind it, out of bytes that are fed to it, less the first `skip`."""

    def __init__(self, skip: int):
        self.skip, self.data, self.at, self.before = skip, b"", 0, 0
        self.d, self.tail, self.kept = None, b"", None
        self.closed = self.finished = False
        #: Bytes that whole members took up; whether the input ended within a member.
        self.used, self.starved = 0, False

    def feed(self, chunk: bytes) -> None:
        cut = min(self.skip, len(chunk))
        self.skip -= cut
        self.before += self.at
        self.data, self.at = self.data[self.at :] + chunk[cut:], 0

    def take(self) -> bytes | None:
        """Some unpacked bytes; nothing where the stream has ended or is damaged; None where more input is needed."""
        while not self.finished:
            if self.d is None:
                ahead = self.data[self.at : self.at + 12]
                if len(ahead) < 12 and not self.closed:
                    return None
                if not ahead.startswith(_MAGIC) or ahead.startswith(b"\x1f\x8b") and (len(ahead) < 12 or not _headed(self.data, self.at)):
                    self.finished = True
                    break
                self.d = bz2.BZ2Decompressor() if ahead.startswith(b"BZh") else lzma.LZMADecompressor() if ahead.startswith(b"\xfd7z") else zlib.decompressobj(wbits=47)
                self.zlib = not ahead.startswith((b"BZh", b"\xfd7z"))
            part, fresh = self.tail, False
            if not part and (self.zlib or self.d.needs_input):
                part, fresh = self.data[self.at : self.at + (FEED if self.zlib else FEED_OTHER)], True
                if not part:
                    if not self.closed:
                        return None
                    self.finished = self.starved = True
                    break
                self.at += len(part)
            self.kept = self.d.copy() if self.zlib else None
            try:
                out = self.d.decompress(part, PIECE)
            except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
                self.finished = True
                return self._up_to_the_damage(part)
            self.tail = self.d.unconsumed_tail if self.zlib else b""
            if self.d.eof:
                self.at -= len(self.d.unused_data)
                self.used = self.before + self.at
                self.d, self.tail = None, b""
            if out:
                return out
        return b""

    def _up_to_the_damage(self, part: bytes) -> bytes:
        out = []
        if self.kept is not None:
            try:
                for i in range(len(part)):
                    out.append(self.kept.decompress(part[i : i + 1]))
            except (zlib.error, ValueError):
                pass
        return b"".join(out)


class Stream:
    """What the stream holds that starts at byte `skip` of its source: bytes, or what another stream holds."""

    def __init__(self, source: bytes | Stream, skip: int):
        self.source, self.skip = source, skip
        self.used, self.starved = 0, False

    def chunks(self) -> Iterator[bytes]:
        """In order; no call goes deeper for a stream within streams, and none holds more than a piece of each.

        Afterwards `used` is the number of bytes of the source that whole members took up, and `starved` says whether the
        source ended within a member.
        """
        path = [self]
        while isinstance(path[0].source, Stream):
            path.insert(0, path[0].source)
        raw, at = path[0].source, path[0].skip
        stages = [_Stage(0), *[_Stage(s.skip) for s in path[1:]]]
        top = i = len(stages) - 1
        while True:
            got = stages[i].take()
            if got is None and i == 0:
                chunk = raw[at : at + (1 << 16)]
                at += len(chunk)
                stages[0].feed(chunk)
                stages[0].closed = not chunk
            elif got is None:
                i -= 1
            elif i < top:
                i += 1
                stages[i].feed(got)
                stages[i].closed = not got
            elif got:
                yield got
            else:
                self.used, self.starved = stages[top].used, stages[top].starved
                return

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """Where each piece begins and its bytes; each begins with the end of the one before."""
        held, at = b"", 0
        for chunk in self.chunks():
            held += chunk
            if len(held) >= PIECE:
                yield at, held
                at, held = at + len(held) - OVERLAP, held[-OVERLAP:]
        if held:
            yield at, held

    def digest(self) -> bytes | None:
        """Of all that it holds; None if it holds nothing, that is, is no stream."""
        h, any_of_it = hashlib.blake2b(digest_size=16), False
        for chunk in self.chunks():
            h.update(chunk)
            any_of_it = True
        return h.digest() if any_of_it else None


def _marks(raw: bytes) -> Iterator[int]:
    """Where streams may start: anywhere by their longer marks, at the very beginning by the shorter ones, too."""
    if raw.startswith(_MAGIC):
        yield 0
    yield from (m.start() for m in _SURE.finditer(raw) if m.start())


def _held(stream: Stream, seen: set[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The pieces of a stream and of all streams in it, and whether a piece is itself the inside of nothing but a stream.

    A worklist of streams, each with the pieces that are still to come. A stream whose content has been taken up before,
    however deep, is not taken up again, which ends streams that unpack to themselves or to many copies. A stream that
    begins in one piece and goes on in the next is read out of its own source from the start.
    """
    work = [(stream, stream.pieces(), [0])]
    while work:
        outer, pieces, upto = work[-1]
        at, piece = next(pieces, (0, b""))
        if not piece:
            work.pop()
            continue
        inner, packed = [], False
        for m in _marks(piece):
            if at + m < upto[0]:
                continue
            new = Stream(piece, m)
            content = new.digest()
            if content is not None and new.starved and len(piece) >= PIECE:
                new = Stream(outer, at + m)
                content = new.digest()
            if content is not None and not new.starved and new.used:
                upto[0] = at + m + new.used
            packed |= content is not None and at + m == 0 and new.used > 0  # a whole member with its checksum; text may look like a stream
            if content is not None and content not in seen:
                seen.add(content)
                inner.append((new, new.pieces(), [0]))
        yield piece, packed
        work += reversed(inner)


def _unpacked(raw: bytes, start: int, whole: tuple[int, int]) -> tuple[int, Iterator[Layer]] | None:
    """(bytes taken up by whole members, the layers of all that a stream holds), or None if there is no stream here."""
    stream = Stream(raw, start)
    content = stream.digest()
    if content is None:
        return None

    def layers() -> Iterator[Layer]:
        for piece, packed in _held(stream, {content}):
            if not packed:
                zeros = piece.count(0)
                kind = "utf-8" if 10 * zeros < 3 * len(piece) else "utf-16-le" if piece[1::2].count(0) * 2 >= zeros else "utf-16-be"
                yield Layer(piece.decode(kind, "replace"), whole=whole)

    return (stream.used if not stream.starved else 0), layers()


def _used(raw: bytes) -> int:
    """How many of the bytes the first stream and the members behind it take up; all where one is damaged."""
    stream = Stream(raw, 0)
    for _ in stream.chunks():
        pass
    return stream.used or len(raw)


def _opened(b: Bytes, text: bool = True) -> Iterator[Layer]:
    """The layers that decoded bytes give: what streams hold, the whole as text or its readable stretches."""
    raw, upto = b.raw, 0
    for m in _marks(raw):
        if m >= upto and (got := _unpacked(raw, m, (b.at(m)[0], b.at(len(raw) - 1)[1]))) is not None:
            yield from got[1]
            upto = m + got[0]
            if m == 0 and got[0]:
                text = False
    if not text:
        return
    try:
        whole = raw.decode("utf-8")
    except UnicodeDecodeError:
        whole = ""
    if whole and 10 * sum(c.isprintable() or c in "\t\n\r" for c in whole) >= 9 * len(whole):
        yield b.layer(0, len(raw), 0, whole)
        return
    for m in _READABLE.finditer(raw):
        yield b.layer(m.start(), m.end(), 1, m[0].decode("ascii"))
    for m in _READABLE_16.finditer(raw):
        yield b.layer(m.start(), m.end(), 2, m[0].replace(b"\0", b"").decode("ascii"))


def _escaped_streams(layer: Layer, magic: re.Pattern, byte: re.Pattern) -> Iterator[Layer]:
    """Streams whose bytes are written in escapes, from each place that looks like the start of one."""
    upto = 0
    for m in magic.finditer(layer.text):
        if m.start() < upto:  # within the one before
            continue
        raw, places, i = bytearray(), [], m.start()
        while (x := byte.match(layer.text, i)) is not None:
            code = [int(x[1], 16)] if x[1] else [_CONTROL[x[2]]] if x.re is _X_BYTE and x[2] else x[0].encode("utf-8", "surrogatepass")
            raw += bytes(code)
            places += [i] * len(code)
            i = x.end()
        places.append(i)
        used = _used(bytes(raw))
        for got in _opened(Bytes(bytes(raw[:used]), lambda k, p=places: layer.span(p[k], max(p[k] + 1, p[k + 1]))), text=False):
            upto = places[used]
            yield got


def _url(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text or not _URL.search(layer.text):
        return
    new, at = _Derived(layer), 0
    for m in _URL_RUN.finditer(layer.text):
        new.plain(at, m.start())
        raw = bytes.fromhex(m[0].replace("%", ""))
        at, i = m.end(), 0
        while i < len(raw):
            # The longest valid character that starts here; a byte that starts none stands for itself.
            for n in (1, 2, 3, 4):
                try:
                    c = raw[i : i + n].decode("utf-8")
                    break
                except UnicodeDecodeError:
                    c, n = chr(raw[i]), 1 if n == 4 else n
            if len(c) != 1:
                c, n = chr(raw[i]), 1
            new.add(c, m.start() + 3 * i, m.start() + 3 * (i + n))
            i += n
    new.plain(at, len(layer.text))
    yield new.layer()
    yield from _escaped_streams(layer, _URL_MAGIC, _URL_BYTE)


def _unicode(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    new, at = _Derived(layer), 0
    for m in _UNICODE.finditer(layer.text):
        code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        new.plain(at, m.start())
        new.add(chr(code), m.start(), m.end())
        at = m.end()
    if at:
        new.plain(at, len(layer.text))
        yield new.layer()
        yield from _escaped_streams(layer, _X_MAGIC, _X_BYTE)


def _decoded(layer: Layer, run: str, places: Sequence[int]) -> Iterator[Layer]:
    """The layers of a base64 run whose characters stand at these places of a layer."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    for step in range(min(4, len(run) - 1)):
        part = run[step:]
        if len(part) % 4 == 1:
            part = part[:-1]
        raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))

        def at(i: int, step: int = step) -> tuple[int, int]:
            return layer.span(places[step + 8 * i // 6], places[step + (8 * i + 7) // 6] + 1)

        if step == 0:
            clean = raw.isascii() or not raw.startswith(_MAGIC) and _is_utf8(raw)
            yield from _opened(Bytes(raw, at))
            if clean:
                return  # it is in step
        elif _READABLE.search(raw) or _SURE.search(raw) or b"\0" in raw and _READABLE_16.search(raw):
            yield from _opened(Bytes(raw, at))


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        yield from _decoded(layer, m[0], range(m.start(), m.end()))
    if "\n" in layer.text:
        for m in _BASE64_LINES.finditer(layer.text):
            places = [i for i in range(m.start(), m.end()) if layer.text[i] not in " \t\r\n"]
            yield from _decoded(layer, "".join(layer.text[i] for i in places), places)


def spans_of(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text, sorted by start and then by kind as listed in KINDS."""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    if not text:
        return [], []
    base = scan(text)
    found = set(base)
    # A stack of layers still to come: each is made when its turn comes, and dropped when those within it are done.
    work, seen = [iter([Layer(text)])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if (k := layer.key()) in seen:
            continue
        seen.add(k)
        if layer.starts is not None or layer.whole:
            found.update((*layer.span(a, b), kind) for a, b, kind in scan(layer.text))
        work.append(itertools.chain(_url(layer), _unicode(layer), _base64(layer)))
    return sorted(base, key=order), sorted(found, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, base (of the text as it stands) and spans (base and decoded), as arrays.

    The structs are (start, stop, kind). Rows are independent, so the scan has no shuffle; ties and repeated rows each
    give their own row.
    """

    def run(batches):
        for pdf in batches:
            rows = [spans_of(t if isinstance(t, str) else None) for t in pdf["text"]]
            as_dicts = lambda xs: [{"start": a, "stop": b, "kind": k} for a, b, k in xs]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": [as_dicts(b) for b, _ in rows], "spans": [as_dicts(s) for _, s in rows]})

    span = "array<struct<start:long,stop:long,kind:string>>"
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(run, f"doc_id string, base {span}, spans {span}").withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as one string."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan_documents(docs)
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
