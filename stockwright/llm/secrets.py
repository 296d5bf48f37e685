"""Secrets in texts, plain or wrapped in URL, Unicode, base64 and compressed layers.

A text starts a worklist.  Each layer taken from it is scanned with the base rules and unwrapped: percent codes and
Unicode escapes of the whole layer, base64 runs one by one and joined over line breaks, from each of the four places
where a group of four may begin, and all members of compressed streams anywhere inside these.  Every layer knows, for each of its characters, which characters of the original text it came from, so what is found in a layer is
reported as a span of the original.  A layer's text is scanned once, however often it occurs; what it holds is then
mapped to every place that it was unwrapped from.  That ends cycles; the worklist ends when nothing new can be unwrapped.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import narrow, prepare

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f] that are long enough
LEAST = {"assign": 6, "access": 20}

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs of lines that follow each other: base64 as MIME, PEM or the command wrap it.
BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
URL_SAFE = bytes.maketrans(b"-_", b"+/")
#: How compressed streams begin.  ``skip``: a frame of zstd without content.
MAGIC = re.compile(rb"(?P<zlib>\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda])|(?P<bz2>BZh[1-9])|(?P<xz>\xfd7zXZ\x00)|(?P<zstd>\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18)", re.S)
WIDE = re.compile(rb"(?P<le>(?:[\t-~]\x00){8,})|(?P<be>(?:\x00[\t-~]){8,})")
#: A layer that unpacks to more bytes than this is scanned in windows of this size that overlap by half, and is counted in ``closed``.
LAYER_BYTES = 1 << 26

# what a text needs for any of the above: tried on its UTF-8 bytes, so that most texts are not decoded at all
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_MAYBE = re.compile(rb"AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|&#|[A-Za-z0-9+/_-]{16}")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


class Layer:
    """A text whose character i came from characters ``first[i]`` to ``last[i]`` (exclusive) of the text around it."""

    def __init__(self, text: str, first: np.ndarray, last: np.ndarray):
        self.text, self.first, self.last = text, first, last

    def outer(self, spans: set[Span]) -> set[Span]:
        """Spans of this layer as spans of the text around it."""
        return {(int(self.first[a]), kind, int(self.last[b - 1])) for a, kind, b in spans}

    def inner(self, text: str, first: np.ndarray, last: np.ndarray) -> Layer:
        """A layer made of this one's text, with its places outside of this one."""
        return Layer(text, self.first[first], self.last[last - 1])


def base(text: str) -> list[Span]:
    """Start, kind and end of every match of the three rules."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _rewritten(text: str, pattern: re.Pattern, decode) -> Layer | None:
    """The text with all matches replaced; ``decode(match)`` gives the new text and its places, or None."""
    out, first, last, at = [], [], [], 0

    def plain(upto: int) -> None:
        if upto > at:
            out.append(text[at:upto])
            first.append(np.arange(at, upto))
            last.append(np.arange(at + 1, upto + 1))

    for m in pattern.finditer(text):
        made = decode(m)
        if made is None:
            continue
        plain(m.start())
        out.append(made[0])
        first.append(made[1] + m.start())
        last.append(made[2] + m.start())
        at = m.end()
    if not at:
        return None
    plain(len(text))
    return Layer("".join(out), np.concatenate(first), np.concatenate(last))


def _maybe(data: bytes) -> bool:
    """Whether anything can be found in or unwrapped from a text with these bytes."""
    if _MAYBE.search(data):
        return True
    low = data.lower()
    return any(w in low for w in _WORDS)


def _text_of(data: bytes) -> tuple[str, np.ndarray]:
    """The text in UTF-8, or else Latin-1, and the byte borders of its characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1"), np.arange(len(data) + 1)
    if len(text) == len(data):
        return text, np.arange(len(data) + 1)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return text, np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]


def _views(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Texts that the bytes may stand for, with byte borders: UTF-8 or Latin-1, and UTF-16 where letters show in it.
    Those in which nothing can be found are left out."""
    if _maybe(data):
        yield _text_of(data)
    for kind, odd in sorted({(m.lastgroup, m.start() % 2) for m in WIDE.finditer(data)}):
        text = data[odd : len(data) - (len(data) - odd) % 2].decode(f"utf-16-{kind}", "surrogatepass")
        if _maybe(text.encode("utf-8", "surrogatepass")):
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            yield text, odd + np.r_[0, np.cumsum(2 + 2 * (code > 0xFFFF))]


def _percent(m: re.Match):
    text, border = _text_of(bytes.fromhex(m[0].replace("%", "")))
    return text, border[:-1] * 3, border[1:] * 3


def _escape(m: re.Match):
    code = int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
    if code > 0x10FFFF:
        return None
    return chr(code), np.zeros(1, np.int64), np.array([m.end() - m.start()])


def _paired(layer: Layer | None) -> Layer | None:
    """UTF-16 halves that escapes have put next to each other become one character."""
    if layer is None or not re.search("[\ud800-\udbff][\udc00-\udfff]", layer.text):
        return layer
    whole = _rewritten(layer.text, re.compile("[\ud800-\udbff][\udc00-\udfff]"),
                       lambda m: (m[0].encode("utf-16", "surrogatepass").decode("utf-16"), np.zeros(1, np.int64), np.array([2])))
    return layer.inner(whole.text, whole.first, whole.last)


class Stream:
    """The compressed stream that begins at ``at``: where it ends, where others may begin, and whether it is large."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end, self.next, self.large = data, at, len(data), at + 1, False

    def pieces(self) -> Iterator[bytes]:
        """What all members and frames hold; of a broken or cut one what comes before the break."""
        at, view = self.at, memoryview(self.data)
        while m := MAGIC.match(self.data, at):
            kind = m.lastgroup
            one = {"zlib": lambda: zlib.decompressobj(47), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor,
                   "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}[kind]()
            step, place = 1 << (10 if kind == "zstd" else 12), at
            try:
                while not one.eof and place < len(view):
                    given = view[place : place + step]
                    place += len(given)
                    if kind in ("bz2", "xz"):
                        yield one.decompress(given, 1 << 20)
                        while not one.needs_input and not one.eof:
                            yield one.decompress(b"", 1 << 20)
                    else:
                        yield one.decompress(given)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
                return
            if not one.eof:
                return
            at = place - len(one.unused_data)
            self.next = at
            while at < len(view) and view[at] == 0:  # padding
                at += 1
        self.end = self.next

    def windows(self, most: int) -> Iterator[bytes]:
        held = bytearray()
        for piece in self.pieces():
            held += piece
            while len(held) > most:
                self.large = True
                yield bytes(held[:most])
                del held[: most - most // 2]
        if held:
            yield bytes(held)


def _streams(data: bytes) -> Iterator[Stream]:
    at = 0
    while m := MAGIC.search(data, at):
        yield (stream := Stream(data, m.start()))
        at = stream.next


def _contents(stream: Stream, most: int, chain: tuple[bytes, ...] = ()) -> Iterator[bytes]:
    """The windows of a stream, and of all streams inside them; a window that lies in itself is not opened again."""
    for window in stream.windows(most):
        if window in chain:
            continue
        yield window
        for inner in _streams(window):
            for deeper in _contents(inner, most, (*chain, window)):
                stream.large |= inner.large
                yield deeper


def _runs(text: str, most: int) -> Iterator[Layer | tuple[int, int, set[int]]]:
    """Layers inside base64 runs; of one that is too large its place and the kinds found in its windows."""
    for m in (*RUN.finditer(text), *BLOCK.finditer(text)):
        whole = np.frombuffer(m[0].rstrip("=").encode(), np.uint8)
        place = np.flatnonzero(whole > 32)
        body, place = whole[place].tobytes().translate(URL_SAFE), m.start() + place
        for shift in range(4):
            size = len(body) - shift - ((len(body) - shift) % 4 == 1)
            data = binascii.a2b_base64(body[shift : shift + size] + b"=" * (-size % 4))
            for found, border in _views(data):
                yield Layer(found, place[shift + border[:-1] * 8 // 6], place[shift + (border[1:] * 8 - 1) // 6] + 1)
            for stream in _streams(data):
                start, kinds, done = int(place[shift + stream.at * 8 // 6]), set(), set()
                end = lambda: m.end() if stream.end == len(data) else int(place[shift + (stream.end * 8 - 1) // 6]) + 1  # noqa: B023, E731
                for window in _contents(stream, most):
                    if not stream.large:
                        for found, _ in _views(window):
                            yield Layer(found, np.broadcast_to(start, len(found)), np.broadcast_to(end(), len(found)))
                    elif (digest := hashlib.blake2b(window).digest()) not in done:
                        done.add(digest)
                        kinds |= {kind for found, _ in _views(window) for _, kind, _ in scan_text(found, most)[1]}
                if stream.large:
                    yield start, end(), kinds


def scan_text(text: str, most: int = LAYER_BYTES) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and the number of layers too large to be held whole, of one text."""
    plain = base(text)
    spans: dict[str, set[Span]] = {text: set(plain)}  # of each layer's text, in its own places
    around: dict[str, list[tuple[str, Layer]]] = {text: []}  # the texts that each was unwrapped from
    work, order, closed = [text], [], set()
    while work:
        outside = work.pop()
        order.append(outside)
        for inner in (_rewritten(outside, PERCENT, _percent), _paired(_rewritten(outside, ESCAPE, _escape)), *_runs(outside, most)):
            if inner is None:
                continue
            if isinstance(inner, tuple):
                start, end, kinds = inner
                spans[outside] |= {(start, kind, end) for kind in kinds}
                closed.add((len(order), start))
                continue
            if inner.text not in spans:
                spans[inner.text], around[inner.text] = set(base(inner.text)), []
                work.append(inner.text)
            around[inner.text].append((outside, inner))
    work = [(t, spans[t]) for t in order if spans[t]]
    while work:
        inside, new = work.pop()
        for outside, layer in around[inside]:
            if more := layer.outer(new) - spans[outside]:
                spans[outside] |= more
                work.append((outside, more))
    return plain, sorted(spans[text]), len(closed)


def scan_bytes(data: bytes | None) -> tuple[list[Span], list[Span], int]:
    if not data:
        return [], [], 0
    return scan_text(data.decode()) if _maybe(data) else ([], [], 0)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end in code points, by start,
    then kind as listed, then end) and ``closed`` (layers above ``LAYER_BYTES``, which are scanned in
    overlapping windows).

    NULL texts count as empty: empty arrays.  Repeated rows are each scanned; a span found in several layers is
    reported once; spans may overlap.
    """
    df = narrow(docs, doc_id=id, text=text)
    item = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_bytes(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            rows = lambda i: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[i]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), rows(0), rows(1), pa.array([f[2] for f in found], pa.int64())],
                                             ["doc_id", "base", "spans", "closed"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, base {item}, spans {item}, closed bigint")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one.  NULL texts stay NULL."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def clean(data: bytes | None) -> bytes | None:
        spans = scan_bytes(data)[1]
        if not spans:
            return data
        whole, out, done = data.decode(), [], 0
        for start, _, end in spans:
            if start >= done:
                out += [whole[done:start], mark]
            done = max(done, end)
        return "".join([*out, whole[done:]]).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([clean(t) for t in b.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield b.set_column(at, b.schema.field(at), new.cast(pa.string()).cast(b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``scan`` as counts, the digest of the base spans and the list of all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return scan(docs, id, text).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), "closed",
    )
