"""Secret scans over whole texts and everything encoded inside them.

Three patterns give the base spans. A worklist then unwraps layers until nothing new appears: percent
escapes, Unicode and HTML escapes (both rewritten in place, so each character keeps its own place in the
original), base64 runs (both alphabets, from their start and from behind each separator in them), and compressed
bytes (gzip, zlib, bzip2, xz, any number of times and members) that base64, percent or byte escapes hold; what such a
run holds maps to the run's span from where it was decoded. Bytes are read as UTF-8 or UTF-16. Of the places in a run that lie
whole base64 groups apart and read alike, the first is decoded: the others' bytes are its ends. So work is linear in
a layer's length. Layers already seen are skipped, so cycles end. Every layer is scanned again, and what it shows is reported at the place in the original text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectra.llm.common import small_batches

#: Order of kinds in the digests.
KINDS = ("assign", "access", "hex")
#: Bytes that all compressed layers of a text may grow to together; what goes beyond is counted in n_unfinished and scanned up to here.
UNPACKED = 64 << 20
#: Characters at the start of a base64 run that tell whether it holds text or compressed bytes.
HEAD = 64
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|&#(?:\d{1,7}|[xX][0-9A-Fa-f]{1,6});|&(?:quot|apos|amp|lt|gt);")
_BASE64 = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
_BEHIND = re.compile(r"[/_-](?=[A-Za-z0-9+/_-]{16})")
_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}){8,}|(?:\\x[0-9A-Fa-f]{2}){8,}")
#: Control characters but for tabs and line ends, and what stands for bytes that are no text.
_ODD = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\ufffd]")
_MAGIC = {b"\x1f\x8b": "gzip", b"BZ": "bz2", b"\xfd7": "xz", b"x\x01": "zlib", b"x\x5e": "zlib", b"x\x9c": "zlib", b"x\xda": "zlib"}

Place = tuple[int, int]


class Pieces:
    """Where the characters of a rewritten layer come from, a piece for each stretch left as it was and each escape.

    Piece k holds the characters from begins[k] on. They are those of the original from first[k] on, if last[k] is -1; else each of
    them comes from the span first[k] to last[k]. Both ends of spans grow along the layer.
    """

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.length = 0

    def add(self, length: int, first: int, last: int = -1) -> None:
        if length:
            self.begins.append(self.length)
            self.first.append(first)
            self.last.append(last)
            self.length += length

    def place(self, at: int) -> Place:
        k = bisect_right(self.begins, at) - 1
        if self.last[k] >= 0:
            return self.first[k], self.last[k]
        here = self.first[k] + at - self.begins[k]
        return here, here + 1

    def span(self, a: int, b: int) -> Place:
        """Of the characters a to b, b left out."""
        return self.place(a)[0], self.place(b - 1)[1]

    def copy_to(self, out: Pieces, a: int, b: int) -> None:
        """Appends the places of the characters a to b."""
        k = bisect_right(self.begins, a) - 1
        while a < b:
            end = min(b, self.begins[k + 1] if k + 1 < len(self.begins) else self.length)
            if self.last[k] >= 0:
                out.add(end - a, self.first[k], self.last[k])
            else:
                out.add(end - a, self.first[k] + a - self.begins[k])
            a, k = end, k + 1


def _whole(text: str) -> Pieces:
    out = Pieces()
    out.add(len(text), 0)
    return out


def patterns(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end): leftmost, non-overlapping within a kind, too short ones dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _unquoted(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _unescaped(m: re.Match) -> str:
    s = m[0]
    if s[0] == "&":
        return html.unescape(s)
    if s[1] == "x":
        return chr(int(s[2:], 16))
    return bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be", "replace")


def _rewritten(text: str, at: Place | Pieces, pattern: re.Pattern, decode) -> tuple[str, Place | Pieces] | None:
    """The text with all escapes of a kind replaced, and its characters' places in the original (one for all, where they share it)."""
    if not pattern.search(text):
        return None
    if isinstance(at, tuple):
        new = pattern.sub(decode, text)
        return (new, at) if new != text else None
    parts: list[str] = []
    places = Pieces()
    last = 0
    for m in pattern.finditer(text):
        plain = decode(m)
        parts += [text[last : m.start()], plain]
        at.copy_to(places, last, m.start())
        places.add(len(plain), *at.span(m.start(), m.end()))
        last = m.end()
    at.copy_to(places, last, len(text))
    return "".join((*parts, text[last:])), places


def _opener(kind: str):
    if kind in ("gzip", "zlib"):
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor()


def _opens(data: memoryview) -> bool:
    """Whether a compressed layer begins here, rather than a text or noise with the same first bytes."""
    try:
        return bool(_opener(_MAGIC[bytes(data[:2])]).decompress(data, 1))
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return False


def _expanded(data: bytes | memoryview, most: int) -> tuple[bytes | None, bool]:
    """(bytes of all members of a compressed layer or None, whether they are all)."""
    out: list[bytes] = []
    size = 0
    while kind := _MAGIC.get(data[:2]):
        opened = _opener(kind)
        try:
            more = opened.decompress(data, max(1, most - size))
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            break
        out.append(more)
        size += len(more)
        if size >= most and not opened.eof:
            return b"".join(out), False
        if not opened.eof or not opened.unused_data:
            break
        data = opened.unused_data
    return (b"".join(out) if out else None), True


def _encoding(data: bytes) -> str:
    if len(data) >= 8 and (zeros := data.count(0)) * 4 >= len(data):
        return "utf-16-le" if data[1::2].count(0) * 2 > zeros else "utf-16-be"
    return "utf-8"


def _readable(data: bytes | memoryview) -> str | None:
    """The bytes as a text, if it is one for the most part."""
    data = bytes(data)
    text = data.decode(_encoding(data), "replace")
    odd = sum(1 for _ in _ODD.finditer(text))
    return text if text and odd * 10 <= len(text) else None


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def _base64_bytes(layer: str) -> Iterator[tuple[int, int, memoryview, str | None]]:
    """(start, end, bytes, encoding) of what base64 runs hold, from their start or from behind a separator; no encoding for compressed bytes.

    A start counts if its first bytes are a compressed layer's, or read as a text. All compressed ones are given. Of those that read as text in
    one encoding, end at one place and lie a multiple of four characters apart, the first is given: its bytes end in those of the others.
    """
    ends: dict[int, int] = {}  # the longest run from each start
    for pattern in _BASE64:
        for m in pattern.finditer(layer):
            for at in (m.start(), *(m.start() + x.end() for x in _BEHIND.finditer(m[0]))):
                ends[at] = max(m.end(), ends.get(at, 0))
    whole: dict[tuple[int, int], tuple[int, bytes]] = {}  # the bytes of a run's groups from their first start on
    told: set[tuple[int, int, str]] = set()
    for at, end in sorted(ends.items()):
        head = _decoded(layer[at : min(end, at + HEAD)])
        if not head:
            continue
        packed, kind = head[:2] in _MAGIC, _encoding(head)
        reads = (end, at % 4, kind) not in told and _readable(head) is not None
        if not packed and not reads:
            continue
        if (end, at % 4) not in whole:
            whole[end, at % 4] = at, _decoded(layer[at:end]) or b""
        first, data = whole[end, at % 4]
        rest = memoryview(data)[(at - first) // 4 * 3 :]
        if packed and _opens(rest):
            yield at, end, rest, None
        elif reads:
            told.add((end, at % 4, kind))
            yield at, end, rest, kind


def scan(text: str) -> tuple[list[tuple[str, int, int]], set[tuple[str, int, int]], int]:
    """(base spans, all spans, unfinished layers) of a text; places are code points of the text."""
    base = patterns(text)
    every = set(base)
    unfinished = 0
    left = UNPACKED
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work: list[tuple[str, Place | Pieces]] = [(text, _whole(text))]

    def push(layer: str, places: Place | Pieces) -> None:
        ends = places if isinstance(places, tuple) else (places.place(0), places.place(len(layer) - 1))
        key = hashlib.blake2b(repr(ends).encode() + layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in seen:
            seen.add(key)
            work.append((layer, places))

    def spanned(at: Place | Pieces, a: int, b: int) -> Place:
        return at if isinstance(at, tuple) else at.span(a, b)

    def opened(data: bytes, place: Place) -> None:
        """Unwraps compressed layers until there are none, or one comes again, and takes what is a text."""
        nonlocal left, unfinished
        before: set[bytes] = set()
        while (name := hashlib.blake2b(data, digest_size=16).digest()) not in before:
            before.add(name)
            if left <= 0 and _MAGIC.get(data[:2]):
                unfinished += 1
                break
            inner, whole = _expanded(data, left)
            if inner is None:
                break
            data = inner
            left -= len(data)
            unfinished += not whole
        if (inner_text := _readable(data)) is not None:
            push(inner_text, place)

    while work:
        layer, at = work.pop()
        if layer is not text:
            for kind, a, b in patterns(layer):
                every.add((kind, *spanned(at, a, b)))
        if "%" in layer and (new := _rewritten(layer, at, _PERCENT, _unquoted)) and new[0]:
            push(*new)
        if ("\\" in layer or "&" in layer) and (new := _rewritten(layer, at, _ESCAPE, _unescaped)) and new[0]:
            push(*new)
        if "%" in layer or "\\x" in layer:
            for m in _BYTES.finditer(layer):
                data = bytes.fromhex(m[0].replace("%", "").replace("\\x", ""))
                if _MAGIC.get(data[:2]):
                    opened(data, spanned(at, m.start(), m.end()))
        for a, b, data, encoding in _base64_bytes(layer):
            if encoding is None:
                opened(data, spanned(at, a, b))
            elif inner := str(data, encoding, "replace"):
                push(inner, spanned(at, a, b))
    return base, every, unfinished


def digest(spans) -> str:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        sha, spans, rest = [], [], []
        for text in batch.column(1).to_pylist():
            base, every, unfinished = scan(text or "")
            for i, kind in enumerate(KINDS):
                counts[i].append(sum(s[0] == kind for s in base))
            sha.append(hashlib.sha256(digest(base).encode()).hexdigest())
            spans.append(digest(every))
            rest.append(unfinished)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(rest, pa.int64())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_unfinished"],
        )


def scan_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> counts and digests of the spans found, a row per row; no shuffle.

    Null and empty texts have no spans: zero counts, the digest of an empty string, empty spans. Rows without
    a doc_id, and rows that repeat one, are scanned like any other; very long texts are scanned whole. Spans of
    different kinds that begin at one place stand in the order of KINDS. Other columns are left out; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_unfinished long"
    return plain.mapInArrow(_scan, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
