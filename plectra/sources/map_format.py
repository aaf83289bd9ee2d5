"""The binary format of contact maps (magic HIC, versions 6 to 9): header, footer, matrices, and blocks of cells.

Fixed facts of the format are the order and widths of its fields. A file holds, for each pair of chromosomes and bin
size, square blocks of cells, compressed one by one and found through an index of (number, position, size).
"""

from __future__ import annotations

import io
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

#: What an empty place of a dense block holds.
NO_SHORT = -32768


class Cursor:
    """Little-endian values from a seekable file; counts the bytes that it takes."""

    def __init__(self, file, at: int = 0):
        self.file, self.taken = file, 0
        file.seek(at)

    def raw(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) < n:
            raise EOFError("the map file ends too soon")
        self.taken += n
        return data

    def one(self, kind: str):
        return struct.unpack("<" + kind, self.raw(struct.calcsize("<" + kind)))[0]

    def text(self) -> str:
        held = bytearray()
        while (c := self.raw(1)) != b"\0":
            held += c
        return held.decode()

    def array(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.raw(n * np.dtype(kind).itemsize), kind)


@dataclass
class Header:
    version: int
    index_at: int
    genome: str
    attributes: dict[str, str]
    chromosomes: list[tuple[str, int]]
    bin_sizes: list[int]
    fragment_sizes: list[int]

    @property
    def size_kind(self) -> str:
        return "q" if self.version > 8 else "i"

    @property
    def number(self) -> np.dtype:
        """Type of stored vectors."""
        return np.dtype("<f4" if self.version > 8 else "<f8")


@dataclass
class Zoom:
    """The index of one matrix at one bin size; blocks: rows of number, position, size."""

    chr1: int
    chr2: int
    unit: str
    bin_size: int
    block_bins: int
    columns: int
    total: float
    blocks: np.ndarray


@dataclass
class Vector:
    """A stored vector: of an expectation (chr is None; factors by chromosome) or of a normalisation."""

    norm: str
    unit: str
    bin_size: int
    chr: int | None
    n: int
    at: int
    factors: dict[int, float] = field(default_factory=dict)


BLOCK_ENTRY = np.dtype([("number", "<i4"), ("at", "<i8"), ("size", "<i4")])


def read_header(file) -> Header:
    c = Cursor(file)
    if file.read(4) != b"HIC\0":
        raise ValueError("this is no contact map: the magic word is missing")
    version, index_at, genome = c.one("i"), c.one("q"), c.text()
    if not 6 <= version <= 9:
        raise ValueError(f"version {version} of the map format is not known")
    if version > 8:
        c.raw(16)
    attributes = {c.text(): c.text() for _ in range(c.one("i"))}
    length = "q" if version > 8 else "i"
    chromosomes = [(c.text(), c.one(length)) for _ in range(c.one("i"))]
    sizes = [c.one("i") for _ in range(c.one("i"))]
    return Header(version, index_at, genome, attributes, chromosomes, sizes, [c.one("i") for _ in range(c.one("i"))])


def read_footer(file, header: Header) -> tuple[dict[str, tuple[int, int]], list[Vector], list[Vector]]:
    """(matrices by key with position and size, expectations, normalisation vectors); vectors' values stay in the file."""
    c = Cursor(file, header.index_at)
    behind = header.index_at + c.one(header.size_kind) + struct.calcsize("<" + header.size_kind)
    matrices = {}
    for _ in range(c.one("i")):
        key = c.text()
        matrices[key] = (c.one("q"), c.one("i"))
    expected = [_expectation(c, header, "NONE") for _ in range(c.one("i"))]
    vectors: list[Vector] = []
    end = file.seek(0, 2)
    if behind < end:
        c = Cursor(file, behind)
        expected += [_expectation(c, header, None) for _ in range(c.one("i"))]
        for _ in range(c.one("i")):
            norm, chr_, unit, bin_size, at = c.text(), c.one("i"), c.text(), c.one("i"), c.one("q")
            width = struct.calcsize("<" + header.size_kind)
            vectors.append(Vector(norm, unit, bin_size, chr_, (c.one(header.size_kind) - width) // header.number.itemsize, at + width))
    return matrices, expected, vectors


def _expectation(c: Cursor, header: Header, norm: str | None) -> Vector:
    norm = c.text() if norm is None else norm
    unit, bin_size, n = c.text(), c.one("i"), c.one(header.size_kind)
    found = Vector(norm, unit, bin_size, None, n, c.file.tell())
    c.file.seek(n * header.number.itemsize, 1)
    factor = "f" if header.version > 8 else "d"
    found.factors = {c.one("i"): c.one(factor) for _ in range(c.one("i"))}
    return found


def read_zooms(file, at: int) -> list[Zoom]:
    c = Cursor(file, at)
    chr1, chr2 = c.one("i"), c.one("i")
    out = []
    for _ in range(c.one("i")):
        unit = c.text()
        c.raw(4)
        total = c.one("f")
        c.raw(12)
        bin_size, block_bins, columns = c.one("i"), c.one("i"), c.one("i")
        out.append(Zoom(chr1, chr2, unit, bin_size, block_bins, columns, total, c.array(BLOCK_ENTRY, c.one("i"))))
    return out


def depth_base(header: Header) -> int:
    """Base of the depth of blocks from the diagonal; negative: constant steps."""
    base = int(header.attributes.get("v9-depth-base", 0) or 0)
    return base if base > 1 or base < 0 else 2


def overlapping(zoom: Zoom, header: Header, x: tuple[float, float], y: tuple[float, float]) -> np.ndarray:
    """Which blocks may hold a cell with bins in two closed ranges; none that holds one is left out.

    Version 9 numbers blocks inside a chromosome by place along the diagonal and depth from it, so a block holds
    cells with bin_x + bin_y in one range and |bin_x - bin_y| in another. All others are numbered by row and column.
    """
    number, b = zoom.blocks["number"].astype(np.int64), zoom.block_bins
    major, minor = number // zoom.columns, number % zoom.columns
    if header.version < 9 or zoom.chr1 != zoom.chr2:
        return (minor * b <= x[1]) & ((minor + 1) * b > x[0]) & (major * b <= y[1]) & ((major + 1) * b > y[0])
    base = depth_base(header)
    edge = (lambda d: (float(base) ** d - 1) * math.sqrt(2) * b) if base > 0 else (lambda d: d * math.sqrt(2) * b * -base)
    far = max(x[1] - y[0], y[1] - x[0])
    near = max(0.0, x[0] - y[1], y[0] - x[1])
    return (2 * minor * b <= x[1] + y[1]) & (2 * (minor + 1) * b > x[0] + y[0]) & (edge(major) - 1 <= far) & (edge(major + 1) + 1 >= near)


def grid_of(length: int, bin_size: int, block_bins: int) -> tuple[int, int]:
    """(bins a side of a block, blocks a row) of a matrix whose longer chromosome has this length; some block_bins a side."""
    bins = length // bin_size + 1
    columns = bins // block_bins + 1
    return bins // columns + 1, columns


def decode_block(data: bytes, version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin_x, bin_y, counts) of a compressed block: single cells (version 6), rows of cells, or a dense rectangle."""
    data = zlib.decompress(data)
    n = struct.unpack_from("<i", data)[0]
    if version < 7:
        cells = np.frombuffer(data, np.dtype([("x", "<i4"), ("y", "<i4"), ("v", "<f4")]), n, 4)
        return cells["x"].astype(np.int64), cells["y"].astype(np.int64), cells["v"].astype(np.float64)
    x0, y0, kind = struct.unpack_from("<iib", data, 4)
    value, at = ("<i2" if kind == 0 else "<f4"), 13
    x_kind = y_kind = "<i2"
    if version > 8:
        wide = struct.unpack_from("<bb", data, at)
        x_kind, y_kind, at = "<i4" if wide[0] else "<i2", "<i4" if wide[1] else "<i2", at + 2
    layout, at = data[at], at + 1
    if layout == 2:
        places, width = struct.unpack_from("<ih", data, at)
        values = np.frombuffer(data, value, places, at + 6)
        held = np.flatnonzero(values != NO_SHORT if kind == 0 else ~np.isnan(values))
        return x0 + held % width, y0 + held // width, values[held].astype(np.float64)
    if layout != 1:
        raise ValueError(f"block layout {layout} is not known")
    cell, y_size, x_size = np.dtype([("x", x_kind), ("v", value)]), np.dtype(y_kind).itemsize, np.dtype(x_kind).itemsize
    y_code, x_code = ("<i" if y_size == 4 else "<h"), ("<i" if x_size == 4 else "<h")
    rows, at = struct.unpack_from(y_code, data, at)[0], at + y_size
    ys, parts = [], []
    for _ in range(rows):
        y, k = struct.unpack_from(y_code, data, at)[0], struct.unpack_from(x_code, data, at + y_size)[0]
        at += y_size + x_size
        parts.append(np.frombuffer(data, cell, k, at))
        ys.append((y, k))
        at += k * cell.itemsize
    cells = np.concatenate(parts) if parts else np.zeros(0, cell)
    y = np.repeat(np.array([y for y, _ in ys], np.int64), [k for _, k in ys])
    return x0 + cells["x"].astype(np.int64), y0 + y, cells["v"].astype(np.float64)


def encode_block(x: np.ndarray, y: np.ndarray, counts: np.ndarray, version: int) -> bytes:
    """The shorter of the layouts, cells in row order; counts as two-byte numbers where all are small integers."""
    order = np.lexsort((x, y))
    x, y, v = x[order].astype(np.int64), y[order].astype(np.int64), counts[order].astype(np.float32)
    n = struct.pack("<i", len(x))
    if version < 7:
        cells = np.zeros(len(x), np.dtype([("x", "<i4"), ("y", "<i4"), ("v", "<f4")]))
        cells["x"], cells["y"], cells["v"] = x, y, v
        return zlib.compress(n + cells.tobytes())
    x0, y0 = int(x.min()), int(y.min())
    width, height = int(x.max()) - x0 + 1, int(y.max()) - y0 + 1
    short = bool(np.all((v == np.floor(v)) & (np.abs(v) < 32767)))
    value = "<i2" if short else "<f4"
    x_wide, y_wide = width > 32766, height > 32766
    if version < 9 and (x_wide or y_wide):
        raise ValueError("blocks of this version span at most 32766 bins")
    head = n + struct.pack("<iib", x0, y0, 0 if short else 1) + (struct.pack("<bb", x_wide, y_wide) if version > 8 else b"")
    x_kind, y_kind = "<i4" if x_wide else "<i2", "<i4" if y_wide else "<i2"
    cell = np.dtype([("x", x_kind), ("v", value)])
    ys, starts = np.unique(y, return_index=True)
    row_head = np.dtype(x_kind).itemsize + np.dtype(y_kind).itemsize
    if width <= 32766 and width * height * np.dtype(value).itemsize < len(x) * cell.itemsize + len(ys) * row_head:
        dense = np.full(width * height, NO_SHORT if short else np.nan, value)
        dense[(y - y0) * width + x - x0] = v
        return zlib.compress(head + b"\2" + struct.pack("<ih", len(dense), width) + dense.tobytes())
    cells = np.zeros(len(x), cell)
    cells["x"], cells["v"] = x - x0, v
    out = io.BytesIO()
    out.write(head + b"\1" + np.array(len(ys), y_kind).tobytes())
    for row, begin, end in zip(ys, starts, [*starts[1:], len(x)], strict=True):
        out.write(np.array(row - y0, y_kind).tobytes() + np.array(end - begin, x_kind).tobytes() + cells[begin:end].tobytes())
    return zlib.compress(out.getvalue())


def _text(s: str) -> bytes:
    return s.encode() + b"\0"


def assemble(header: Header, zooms: list[tuple[Zoom, list[bytes]]], expected: list[tuple[Vector, np.ndarray]], vectors: list[tuple[Vector, np.ndarray]]) -> list[bytes]:
    """The bytes of a file, in pieces: blocks behind the header, then matrices, vectors and the footer.

    zooms: with their encoded blocks, whose numbers stand in zoom.blocks; positions are set here.
    """
    wide = header.version > 8
    length, size, number = ("<q", "<q", header.number) if wide else ("<i", "<i", header.number)

    def head(index_at: int, vectors_at: int, vectors_size: int) -> bytes:
        out = _text("HIC") + struct.pack("<iq", header.version, index_at) + _text(header.genome)
        out += struct.pack("<qq", vectors_at, vectors_size) if wide else b""
        out += struct.pack("<i", len(header.attributes)) + b"".join(_text(k) + _text(v) for k, v in header.attributes.items())
        out += struct.pack("<i", len(header.chromosomes)) + b"".join(_text(name) + struct.pack(length, n) for name, n in header.chromosomes)
        for sizes in (header.bin_sizes, header.fragment_sizes):
            out += struct.pack(f"<i{len(sizes)}i", len(sizes), *sizes)
        return out

    pieces: list[bytes] = []
    at = len(head(0, 0, 0))

    def put(data: bytes) -> int:
        nonlocal at
        pieces.append(data)
        at += len(data)
        return at - len(data)

    matrices: dict[str, list[bytes]] = {}
    for zoom, blocks in zooms:
        index = zoom.blocks.copy()
        for k, data in enumerate(blocks):
            index["at"][k], index["size"][k] = put(data), len(data)
        fields = struct.pack("<iffff", 0, zoom.total, 0, 0, 0) + struct.pack("<iiii", zoom.bin_size, zoom.block_bins, zoom.columns, len(index))
        matrices.setdefault(f"{zoom.chr1}_{zoom.chr2}", []).append(_text(zoom.unit) + fields + index.tobytes())
    index = b""
    for key, parts in matrices.items():
        a, b = map(int, key.split("_"))
        data = struct.pack("<iii", a, b, len(parts)) + b"".join(parts)
        index += _text(key) + struct.pack("<qi", put(data), len(data))
    entries = b""
    for v, values in vectors:
        data = struct.pack(size, len(values)) + values.astype(number).tobytes()
        entries += _text(v.norm) + struct.pack("<i", v.chr) + _text(v.unit) + struct.pack("<iq", v.bin_size, put(data)) + struct.pack(size, len(data))

    def expectation(v: Vector, values: np.ndarray) -> bytes:
        factors = b"".join(struct.pack("<if" if wide else "<id", c, f) for c, f in sorted(v.factors.items()))
        return _text(v.unit) + struct.pack("<i", v.bin_size) + struct.pack(size, len(values)) + values.astype(number).tobytes() + struct.pack("<i", len(v.factors)) + factors

    raw = [expectation(v, a) for v, a in expected if v.norm == "NONE"]
    normed = [_text(v.norm) + expectation(v, a) for v, a in expected if v.norm != "NONE"]
    first = struct.pack("<i", len(matrices)) + index + struct.pack("<i", len(raw)) + b"".join(raw)
    index_at = put(struct.pack(size, len(first)) + first)
    put(struct.pack("<i", len(normed)) + b"".join(normed))
    tail = struct.pack("<i", len(vectors)) + entries
    vectors_at = put(tail)
    return [head(index_at, vectors_at, len(tail)), *pieces]
