"""Secret scans through recursive decoding.

A document's text is the first layer on a worklist.  Each layer is scanned for the three
kinds of secret; then its encoded stretches are unwrapped into further layers, until
nothing new appears:

* Percent escapes and Unicode escapes are replaced in place, so that a secret which is
  escaped in part is still found.  Where a decoded character begins another escape, that
  one is followed to its end at once, so any depth of nesting takes one pass.
* Base64 runs, over wrapped lines too, are decoded at each of the four alignments, so
  that letters, slashes or underscores in front of a payload don't hide it.  What is
  decoded becomes a layer if some stretch of it is readable, whatever else it holds.
* Compressed data (gzip, zlib, bzip2, xz, zstandard, all members) is inflated from wherever
  its magic number stands in a layer, through compression within compression.  It streams:
  the inflated text is scanned in segments, cut where no secret and no encoded run can
  cross, so memory holds a segment (and the longest run without such a place), not the
  stream, and there is no limit to its length.

A layer (by its digest and the range it comes from) that occurred before is not unwrapped
again, and compression within compression ends where a stream repeats, which ends cycles.

Each layer maps its characters back, layer by layer, to the document; a span found in a
layer is reported as the range from its first to its last character's origin.  Inflated text
comes as a whole from the range of the compressed data.  Spans of the first layer (base spans)
always stay; a span found in a deeper layer is added unless the same kind and range is known.

Deeper layers hold one character for each byte: secrets are ASCII, so no other decoding
could change what is found; for UTF-16 each second byte is a layer too.

Edge cases: null and empty text have no spans; lone escapes and undecodable runs stay as they
are; damaged compressed data is read up to the damage; very long texts are read whole; repeated
rows and null ids give a row each; an empty table gives an empty result; columns of any other
name play no part.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from . import common

KINDS = ("assign", "access", "hex")
CHUNK = 1 << 20
MIN_BASE64 = 16

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ESCAPE = re.compile(
    r"%([0-9A-Fa-f]{2})|\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))"
    r"|&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));"
)
_LONGEST_ESCAPE = 12
_BASE64 = re.compile(
    r"[A-Za-z0-9+/_-]{%d,}+(?:\r?+\n[ \t]*+[A-Za-z0-9+/_-]{%d,}+)*+(?:\r?+\n[ \t]*+[A-Za-z0-9+/_-]++)?+"
    % (MIN_BASE64, MIN_BASE64)
)
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: All secrets, and all encodings of them in text, have so many printable characters in a row.
_READABLE = re.compile(rb"[\x20-\x7e\t\r\n]{12,}")
_MAGIC = re.compile(
    r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd"
)
#: No secret and no encoded run crosses such a place.
_SAFE = re.compile(r"""[^A-Za-z0-9+/_.=\-"':\x20%\\&#;{}\r\n\t]|[^A-Za-z0-9+/_=\-\x20\t\r]\r?\n""")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in one layer."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


class Layer:
    """A text and the way back to the document, here itself."""

    def __init__(self, text: str) -> None:
        self.text = text

    def back(self, start: int, end: int) -> tuple[int, int]:
        return start, end


class Unescaped(Layer):
    """``parent`` with the units (start, end, character) replaced."""

    def __init__(self, parent: Layer, units: list[tuple[int, int, str]]) -> None:
        self.parent = parent
        self.here, self.there = [0], [0]  # where each unit ends, here and there
        parts, at, size = [], 0, 0
        for start, end, char in units:
            parts += [parent.text[at:start], char]
            size += start - at + 1
            self.here.append(size)
            self.there.append(end)
            at = end
        super().__init__("".join([*parts, parent.text[at:]]))

    def _range(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.here, i)
        if k < len(self.here) and self.here[k] == i + 1:  # a unit
            start = self.there[k - 1] + i - self.here[k - 1]
            return start, self.there[k]
        start = self.there[k - 1] + i - self.here[k - 1]
        return start, start + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self.parent.back(self._range(start)[0], self._range(end - 1)[1])


class Decoded(Layer):
    """Every ``step``-th byte, from ``first`` on, of base64 that begins ``skip`` characters into the lines given as
    (start in the run, start in the parent)."""

    def __init__(self, parent: Layer, data: bytes, skip: int, lines: list[tuple[int, int]], first: int = 0, step: int = 1) -> None:
        super().__init__(data.decode("latin-1"))
        self.parent, self.skip, self.first, self.step = parent, skip, first, step
        self.runs, self.places = zip(*lines)

    def _place(self, i: int) -> int:
        k = bisect_right(self.runs, i) - 1
        return self.places[k] + i - self.runs[k]

    def back(self, start: int, end: int) -> tuple[int, int]:
        a, b = self.first + self.step * start, self.first + self.step * (end - 1)
        return self.parent.back(
            self._place(self.skip + a // 3 * 4 + a % 3), self._place(self.skip + b // 3 * 4 + b % 3 + 1) + 1
        )


class Inflated(Layer):
    """A segment of a stream, all of it from one range of the document."""

    def __init__(self, text: str, origin: tuple[int, int]) -> None:
        super().__init__(text)
        self.origin = origin

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self.origin


# escapes


def _char(m: re.Match) -> str | None:
    code = int(m[6]) if m[6] else int(m[1] or m[2] or m[3] or m[4] or m[5] or m[7], 16)
    return chr(code) if code <= 0x10FFFF else None


def escapes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, character) of the escapes, each followed to its end."""
    out, at = [], 0
    while (m := _ESCAPE.search(text, at)) is not None:
        at = m.end()
        char = _char(m)
        if char is None:
            continue
        while char in "%\\&" and (n := _ESCAPE.match(char + text[at : at + _LONGEST_ESCAPE])):
            inner = _char(n)
            if inner is None:
                break
            char, at = inner, at + n.end() - 1
        out.append((m.start(), at, char))
    return out


# base64


def decoded(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """What a base64 run holds, at each alignment."""
    lines, size, parts = [], 0, []
    for line in _LINE.finditer(layer.text, m.start(), m.end()):
        lines.append((size, line.start()))
        parts.append(line[0])
        size += len(line[0])
    run = "".join(parts).translate({45: 43, 95: 47}).encode()
    for skip in range(4):
        body = run[skip:]
        if len(body) % 4 == 1:
            body = body[:-1]
        data = binascii.a2b_base64(body + b"=" * (-len(body) % 4))
        if _READABLE.search(data) or _MAGIC.search(data.decode("latin-1")):
            yield Decoded(layer, data, skip, lines)
        if data.count(0) * 4 >= len(data):
            for first in (0, 1):
                half = data[first::2]
                if _READABLE.search(half):
                    yield Decoded(layer, half, skip, lines, first, 2)


# compressed data


def _kind(head: bytes) -> str | None:
    m = _MAGIC.match(head.decode("latin-1"))
    return m and {"\x1f": "gzip", "x": "zlib", "B": "bzip2", "\xfd": "xz", "(": "zstd"}[m[0][0]]


_MAKE = {
    "gzip": lambda: zlib.decompressobj(31),
    "zlib": zlib.decompressobj,
    "bzip2": bz2.BZ2Decompressor,
    "xz": lzma.LZMADecompressor,
    "zstd": lambda: zstandard.ZstdDecompressor().decompressobj(),
}


class Stream:
    """The inflated bytes of all members of one kind at the start of ``outer``, itself chunks of bytes; it can be read
    again.  After a reading, ``used`` is how much of ``outer`` they took up, and ``whole`` tells that none is cut or damaged."""

    def __init__(self, outer: Iterable[bytes], kind: str) -> None:
        self.outer, self.kind, self.used, self.whole = outer, kind, 0, False

    def __iter__(self) -> Iterator[bytes]:
        self.used, self.whole = 0, False
        # an object of zstandard has no limit to what it gives for what it takes: it takes little
        width = 256 if self.kind == "zstd" else 1 << 16
        d, rest = _MAKE[self.kind](), b""
        try:
            for chunk in self.outer:
                for at in range(0, len(chunk), width):
                    rest += chunk[at : at + width]
                    while rest:
                        if d.eof:
                            if len(rest) < 12 and at + width < len(chunk):
                                break
                            if _kind(rest[:12]) != self.kind:
                                return
                            d = _MAKE[self.kind]()
                        before = len(rest)
                        for out in self._feed(d, rest):
                            yield out
                        rest = bytes(d.unused_data) if d.eof else b""
                        self.used += before - len(rest)
                        self.whole = d.eof
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError):
            return

    def _feed(self, d, data: bytes) -> Iterator[bytes]:
        if self.kind == "zstd":
            if out := d.decompress(data):
                yield out
            return
        while True:
            out = d.decompress(data, CHUNK)
            if out:
                yield out
            data = d.unconsumed_tail if self.kind in ("gzip", "zlib") else b""
            if d.eof or not (data if self.kind in ("gzip", "zlib") else not d.needs_input):
                return


def _digest(stream: Iterable[bytes]) -> tuple[bytes, bytes]:
    """Digest of all of a stream, and its first bytes."""
    h, head = xxhash.xxh3_128(), b""
    for chunk in stream:
        h.update(chunk)
        if len(head) < 12:
            head += chunk[:12]
    return h.digest(), head[:12]


class _Bytes:
    """The bytes that a text's characters from ``at`` on stand for, up to one that stands for none."""

    def __init__(self, text: str, at: int) -> None:
        self.text, self.at = text, at

    def __iter__(self) -> Iterator[bytes]:
        for i in range(self.at, len(self.text), 1 << 16):
            part = self.text[i : i + (1 << 16)]
            try:
                yield part.encode("latin-1")
            except UnicodeEncodeError as e:
                yield part[: e.start].encode("latin-1")
                return


def inflated(layer: Layer) -> Iterator[Layer]:
    """Segments of what is compressed in a layer, through further compression."""
    done = 0
    for m in _MAGIC.finditer(layer.text):
        at = m.start()
        if at < done:  # within a stream that was read to its end
            continue
        first = stream = Stream(_Bytes(layer.text, at), _kind(m[0].encode("latin-1")))
        digest, head = _digest(stream)
        if first.whole:
            done = at + first.used
        seen = {digest}
        while head and (kind := _kind(head)) is not None:
            inner = Stream(stream, kind)
            digest, more = _digest(inner)
            if not more or digest in seen:
                break
            seen.add(digest)
            stream, head = inner, more
        if not head:
            continue
        origin = layer.back(at, at + max(first.used, 1))
        for segment in segments(stream):
            text = segment.decode("latin-1")
            if _READABLE.search(segment) or _MAGIC.search(text):
                yield Inflated(text, origin)


def segments(stream: Iterable[bytes]) -> Iterator[bytes]:
    """A stream cut at safe places, about ``CHUNK`` bytes each."""
    parts: list[bytes] = []
    for chunk in stream:
        text, cut, width = chunk.decode("latin-1"), 0, 64
        while not cut and width < 64 * len(chunk):  # the last place, looked for from the end
            for m in _SAFE.finditer(text, max(0, len(text) - width)):
                cut = m.end()
            width *= 64
        if cut:
            yield b"".join([*parts, chunk[:cut]])
            parts = [chunk[cut:]]
        else:
            parts.append(chunk)
    if any(parts):
        yield b"".join(parts)


def unwrap(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if ("%" in text or "\\" in text or "&#" in text) and (units := escapes(text)):
        yield Unescaped(layer, units)
    for m in _BASE64.finditer(text):
        yield from decoded(layer, m)
    yield from inflated(layer)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as sorted (start, kind, end)."""
    base = scan(text)
    every = set(base)
    seen: set[tuple[bytes, int, int]] = set()
    work = [unwrap(Layer(text))] if text else []
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = xxhash.xxh3_128_digest(layer.text.encode("utf-8", "surrogatepass")), *layer.back(0, len(layer.text))
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in scan(layer.text):
            a, b = layer.back(start, end)
            every.add((a, kind, b))
        work.append(unwrap(layer))
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of base spans by kind, their digest, and all spans."""
    common.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], []]
        digest, spans = [], []
        for text in batch.column(1).to_pylist():
            base, every = find(text or "")
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in base))
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()),
             pa.array(spans, pa.string())],
            [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    fields = f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return common.map_batches(docs, [id_col, text_col], rows, fields)


def op5(spark, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents"))
