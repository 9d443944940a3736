"""Secret scans by a worklist of decoded layers.

A text is the first layer. Every layer is scanned, and whatever in it is URL-encoded, Unicode-escaped, base64 or
compressed is unwrapped into further layers, until none is left that was not seen before. Each layer knows, for each of
its characters, from which code points of the text it was made, so that what is found anywhere is given as a span of the
text.
"""

from __future__ import annotations

import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters that the value of an assignment has at least.
VALUE = 6

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\|%)u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?:\r?\n[A-Za-z0-9+/_-]+)?")
#: What no secret and no encoded form is shorter than; all of them are of these characters.
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: How compressed data begins: gzip, zlib, zstandard, bzip2, xz.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|BZh[1-9]|\xfd7zXZ\x00")
#: Bytes that the compressed layers of one text may unpack to: this, or so many times its length if that is more. It guards against bombs; layers refused are counted.
UNPACKED, UNPACKED_TIMES = 64 << 20, 64


def found_in(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the leftmost matches of each kind that don't overlap; kinds are numbered as in KINDS."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= VALUE:
            yield 0, m.start(), m.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


class Layer:
    """A text whose character k was made from the code points ``start[k]`` to ``end[k]`` of the first one."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end

    def key(self) -> tuple:
        """Tells layers apart: what they say, and of which part of the text."""
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(self.start[0]), int(self.end[-1])

    def replaced(self, spans: list[tuple[int, int, str, list[int]]]) -> Layer:
        """This layer with (start, end, text, offsets): each character of ``text`` is made from the piece between two offsets of the span."""
        texts, starts, ends, at = [], [], [], 0
        for s, e, text, cuts in spans:
            texts += [self.text[at:s], text]
            cuts = np.asarray(cuts) + s
            starts += [self.start[at:s], self.start[cuts[:-1]]]
            ends += [self.end[at:s], self.end[cuts[1:] - 1]]
            at = e
        return Layer("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]]))


def _percent(layer: Layer) -> Iterator[Layer]:
    """URL encoding: runs of %XX as UTF-8, or as Latin-1 where they are not."""
    spans = []
    for m in PERCENT.finditer(layer.text):
        data = bytes.fromhex(m.group().replace("%", ""))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("latin-1")
            spans.append((m.start(), m.end(), text, [3 * k for k in range(len(text) + 1)]))
            continue
        spans.append((m.start(), m.end(), text, np.cumsum([0, *(3 * len(c.encode()) for c in text)])))
    if spans:
        yield layer.replaced(spans)


def _escapes(layer: Layer) -> Iterator[Layer]:
    """Unicode escapes and numeric character references; a pair of surrogates is one character, and one alone stays as it is."""
    spans, high = [], None
    for m in ESCAPE.finditer(layer.text):
        code = int(m.group(6)) if m.group(6) else int(next(g for g in m.groups() if g), 16)
        if 0xDC00 <= code < 0xE000 and high and high[1] == m.start():
            spans.append((high[0], m.end(), chr(0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00), [0, m.end() - high[0]]))
        elif not 0xD800 <= code < 0xE000 and code <= 0x10FFFF:
            spans.append((m.start(), m.end(), chr(code), [0, m.end() - m.start()]))
        high = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
    if spans:
        yield layer.replaced(spans)


_FROM64 = np.full(128, -1, np.int16)
_FROM64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")] = np.arange(64)
_FROM64[list(b"-_")] = 62, 63


def _sixes(layer: Layer, budget: list[int]) -> Iterator[Layer]:
    """Base64, plain or for URLs, wrapped lines too: a run is decoded from each of its first four characters, so that what it is glued to does no harm."""
    for m in BASE64.finditer(layer.text):
        codes = np.frombuffer(m.group().encode("ascii"), np.uint8)
        at = m.start() + np.flatnonzero(codes > 13)
        values = _FROM64[codes[codes > 13]].astype(np.uint32)
        for shift in range(4):
            n = (len(values) - shift) * 6 // 8
            v = np.zeros(-(-n // 3) * 4, np.uint32)
            some = values[shift : shift + len(v)]
            v[: len(some)] = some
            word = v[0::4] << 18 | v[1::4] << 12 | v[2::4] << 6 | v[3::4]
            data = np.stack([word >> 16, word >> 8 & 255, word & 255], axis=1).astype(np.uint8).ravel()[:n].tobytes()
            k = np.arange(n)
            first, last = at[shift + k * 8 // 6], at[shift + (k * 8 + 7) // 6]
            yield from _inside(data, layer.start[first], layer.end[last], budget)


def _inside(data: bytes, start: np.ndarray, end: np.ndarray, budget: list[int]) -> Iterator[Layer]:
    """Layers of bytes: stretches of printable characters, and what compressed data in them unpacks to, again as bytes."""
    work, seen = [(data, start, end)], set()
    while work:
        data, start, end = work.pop()
        for m in PRINTABLE.finditer(data):
            yield Layer(m.group().decode("ascii"), start[m.start() : m.end()], end[m.start() : m.end()])
        for m in PACKED.finditer(data):
            unpacked, used = _unpacked(data[m.start() :], m.group(), budget)
            if not unpacked:
                continue
            s, e = start[m.start()], end[m.start() + used - 1]
            key = (hashlib.blake2b(unpacked, digest_size=16).digest(), int(s), int(e))
            if key not in seen:
                seen.add(key)
                work.append((unpacked, np.broadcast_to(s, len(unpacked)), np.broadcast_to(e, len(unpacked))))


def _unpacked(data: bytes, magic: bytes, budget: list[int]) -> tuple[bytes, int]:
    """(what the data unpacks to, bytes of it that were used): data that breaks off gives what came before, others than compressed data nothing."""
    if magic[:1] in b"\x1f\x78":
        tool = zlib.decompressobj(47)
    elif magic[:1] == b"\x28":
        tool = zstandard.ZstdDecompressor().decompressobj()
    else:
        tool = bz2.BZ2Decompressor() if magic[:1] == b"B" else lzma.LZMADecompressor()
    out, size, at, step = [], 0, 0, 1 << 10
    while at < len(data) and not getattr(tool, "eof", False):
        try:
            got = tool.decompress(data[at : at + step])
        except (zlib.error, zstandard.ZstdError, lzma.LZMAError, OSError, EOFError, ValueError):
            break
        at += step
        out.append(got)
        size += len(got)
        if size > budget[0]:
            budget[1] += 1
            return b"", 0
    budget[0] -= size
    return b"".join(out), max(1, min(at, len(data)) - len(getattr(tool, "unused_data", b"") or b""))


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base matches, all matches, layers, compressed layers refused) of a text; matches are (start, kind, end), sorted."""
    base = sorted((s, kind, e) for kind, s, e in found_in(text))
    found, n_layers = set(base), 1
    budget = [max(UNPACKED, UNPACKED_TIMES * len(text)), 0]
    if not ("%" in text or "\\" in text or "&#" in text or BASE64.search(text)):
        return base, base, 1, 0
    at = np.arange(len(text) + 1)
    first = Layer(text, at[:-1], at[1:])
    work, seen = [first], {first.key()}
    while work:
        layer = work.pop()
        if layer is not first:
            n_layers += 1
            found.update((int(layer.start[s]), kind, int(layer.end[e - 1])) for kind, s, e in found_in(layer.text))
        for made in (_percent(layer), _escapes(layer), _sixes(layer, budget)):
            for child in made:
                if child.text and (key := child.key()) not in seen:
                    seen.add(key)
                    work.append(child)
    return base, sorted(found), n_layers, budget[1]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(1):
            base, found, layers, refused = spans_of(text.as_py() or "")
            n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            out.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(found), layers, refused))
        columns = list(zip(*out)) or [()] * 7
        kinds = (*(pa.int64(),) * 3, pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*SCHEMA])


SCHEMA = {"doc_id": "", "n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "n_layers": "long", "n_refused": "long"}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, n_refused`` of each row.

    The counts and the digest are of what the text itself shows; ``spans`` are those and what its decoded layers show, as
    ``kind:start:end`` in code points of the text, by start, then kind, then end, each once. A span of a layer covers the
    encoded form: whole escapes, the base64 characters that hold its bytes, all of a compressed stretch. A layer is never
    unwrapped twice for one part of the text, so that data that unpack to themselves end. Compressed layers of one text
    unpack to UNPACKED bytes or UNPACKED_TIMES its length in all; one that would go beyond is refused and counted in
    ``n_refused``. Texts are taken whole, however long; a null one is empty and gives no span and the digest of nothing.
    Null ids and repeated rows stay, one row each; extra columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{name} {kind or rows.schema['doc_id'].dataType.simpleString()}" for name, kind in SCHEMA.items())
    return small_batches(rows).mapInArrow(_rows, schema)
