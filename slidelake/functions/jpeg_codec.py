"""Baseline JPEG without a native library: coefficients, lossless crops, pixels, encoding.

Entropy-coded data is read into quantised coefficients and written again from them, so a crop at unit borders loses nothing.
Transforms are matrix products over all blocks at once (numpy); only Huffman symbols are handled one by one. Frames of 8 bits
with Huffman coding in one scan (baseline, extended sequential) are understood; progressive, lossless and arithmetic ones raise
``ValueError``. Meant for tiles inside Arrow batches; a session with a native codec can use it instead.

Defined results
* data that ends early: the missing units are those of a constant image going on (zero differences);
* crops begin at unit borders (else ``ValueError``); parts outside the frame are filled with one luminance, chroma neutral.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from slidelake.functions.codestream import APP14, DQT, DRI, FRAME_MARKERS, SOS, huffman_codes, segments


def _zigzag() -> np.ndarray:
    """Place in a block, row by row, of each coefficient in the order of the scan: along antidiagonals, to and fro."""
    cells = sorted(((x, y) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[1] if (c[0] + c[1]) % 2 else c[0]))
    return np.array([8 * y + x for x, y in cells])


def _basis() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


ZIGZAG, BASIS = _zigzag(), _basis()


@dataclass
class Component:
    """One colour: identifier, sampling factors, quantisation table, coefficients ``(rows, columns, 64)`` in scan order."""

    ident: int
    h: int
    v: int
    table: int
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Frame:
    """A frame as quantised coefficients."""

    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    adobe: int | None = None

    @property
    def unit(self) -> tuple[int, int]:
        """Pixels of a minimum coded unit."""
        single = len(self.components) == 1
        return (8, 8) if single else (8 * max(c.h for c in self.components), 8 * max(c.v for c in self.components))


def _lookup(codes: dict[int, tuple[int, int]]) -> list[int]:
    """Symbol and length (``symbol << 5 | length``) for each 16 bits that a code may begin."""
    table = [0] * 65536
    for symbol, (code, length) in codes.items():
        first = code << (16 - length)
        table[first : first + (1 << (16 - length))] = [symbol << 5 | length] * (1 << (16 - length))
    return table


def _parts(data: bytes, start: int) -> list[bytes]:
    """Entropy-coded bytes between restart markers, stuffing taken out."""
    out, at = [], start
    while True:
        end = data.find(b"\xff", at)
        while 0 <= end < len(data) - 1 and data[end + 1] == 0:
            end = data.find(b"\xff", end + 2)
        if end < 0 or end >= len(data) - 1:
            return [*out, data[at:].replace(b"\xff\x00", b"\xff")]
        out.append(data[at:end].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= data[end + 1] <= 0xD7:
            return out
        at = end + 2


def read(data: bytes) -> Frame:
    """A frame's coefficients."""
    quantisers: dict[int, np.ndarray] = {}
    adobe, restart, head, scan = None, 0, None, None
    for s in segments(data):
        if s.marker == DQT:
            at = s.body
            while at < s.end:
                wide, number = data[at] >> 4, data[at] & 15
                quantisers[number] = np.frombuffer(data, ">u2" if wide else "u1", 64, at + 1).astype(np.int32)
                at += 1 + (128 if wide else 64)
        elif s.marker == APP14 and data[s.body : s.body + 5] == b"Adobe":
            adobe = data[s.body + 11]
        elif s.marker == DRI:
            (restart,) = struct.unpack_from(">H", data, s.body)
        elif s.marker in FRAME_MARKERS:
            head = s
        elif s.marker == SOS:
            scan = s
    if head is None or scan is None or head.marker not in (0xC0, 0xC1) or data[head.body] != 8:
        raise ValueError("no 8-bit sequential Huffman frame")
    _, height, width, count = struct.unpack_from(">BHHB", data, head.body)
    parts = [Component(data[p], data[p + 1] >> 4, data[p + 1] & 15, data[p + 2]) for p in range(head.body + 6, head.body + 6 + 3 * count, 3)]
    if data[scan.body] != count or not width or not height:
        raise ValueError("components in several scans, or no size")
    frame = Frame(width, height, parts, quantisers, adobe)
    codes = huffman_codes(data)
    tables = {k: _lookup(v) for k, v in codes.items()}
    selectors = [data[scan.body + 2 + 2 * i] for i in range(count)]
    ux, uy = frame.unit
    across, down = -(-width // ux), -(-height // uy)
    factors = [(1, 1)] if count == 1 else [(c.h, c.v) for c in parts]
    for c, (h, v) in zip(parts, factors):
        c.blocks = np.zeros((down * v, across * h, 64), np.int32)
    plan = [(c.blocks, h, v, tables[0, s >> 4], tables[1, s & 15]) for c, (h, v), s in zip(parts, factors, selectors)]
    units = across * down
    for k, part in enumerate(_parts(data, scan.end)):
        first = k * restart if restart else 0
        _read_units(part, plan, first, min(first + restart, units) if restart else units, across)
        if not restart:
            break
    return frame


def _read_units(part: bytes, plan: list, first: int, last: int, across: int) -> None:
    """Coefficients of the units of one restart interval; stops where the data ends."""
    buffer, held, at, size = 0, 0, 0, len(part)
    previous = [0] * len(plan)
    for unit in range(first, last):
        uy, ux = divmod(unit, across)
        for k, (blocks, h, v, dc, ac) in enumerate(plan):
            for b in range(h * v):
                by, bx = divmod(b, h)
                block = blocks[uy * v + by, ux * h + bx]
                place, table = 0, dc
                while place < 64:
                    if held < 32:
                        chunk = part[at : at + 8]
                        at += 8
                        buffer = buffer << 64 | int.from_bytes(chunk.ljust(8, b"\xff"), "big")
                        held += 64
                    entry = table[buffer >> (held - 16) & 0xFFFF]
                    length, symbol = entry & 31, entry >> 5
                    if not length or at - 8 - held // 8 > size:
                        for c, p in enumerate(previous):  # cut off: the image goes on as it was
                            blocks_c, hc, vc = plan[c][0], plan[c][1], plan[c][2]
                            for rest in range(unit, last):
                                ry, rx = divmod(rest, across)
                                blocks_c[ry * vc : ry * vc + vc, rx * hc : rx * hc + hc] = 0
                                blocks_c[ry * vc : ry * vc + vc, rx * hc : rx * hc + hc, 0] = p
                        return
                    held -= length
                    bits = symbol & 15
                    if bits:
                        held -= bits
                        value = buffer >> held & ((1 << bits) - 1)
                        if value < 1 << (bits - 1):
                            value -= (1 << bits) - 1
                    else:
                        value = 0
                    buffer &= (1 << held) - 1
                    if place == 0:
                        previous[k] += value
                        block[0] = previous[k]
                        place, table = 1, ac
                        continue
                    if bits == 0:
                        if symbol == 0xF0:
                            place += 16
                            continue
                        break
                    place += symbol >> 4
                    if place > 63:
                        break
                    block[place] = value
                    place += 1


def _symbols(block: list[int], previous: int) -> Iterator[tuple[int, int, int]]:
    """``(symbol, bits, number of bits)`` of a block: the DC difference, then runs and values."""
    change = block[0] - previous
    n = abs(change).bit_length()
    yield n, change if change >= 0 else change + (1 << n) - 1, n
    run = 0
    last = max((i for i in range(1, 64) if block[i]), default=0)
    for i in range(1, last + 1):
        v = block[i]
        if v == 0:
            run += 1
            continue
        while run > 15:
            yield 0xF0, 0, 0
            run -= 16
        n = abs(v).bit_length()
        yield run << 4 | n, v if v > 0 else v + (1 << n) - 1, n
        run = 0
    if last < 63:
        yield 0, 0, 0


def code_lengths(counts: dict[int, int], most: int = 16) -> dict[int, int]:
    """Lengths of optimal prefix codes of at most ``most`` bits, none of ones alone (package-merge with one symbol kept free)."""
    weights = sorted([(n, (s,)) for s, n in counts.items()] + [(0, (-1,))])
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(most):
        pairs = [(packages[i][0] + packages[i + 1][0], packages[i][1] + packages[i + 1][1]) for i in range(0, len(packages) - 1, 2)]
        packages = list(heapq.merge(weights, pairs))
    length = Counter(s for _, symbols in packages[: 2 * len(weights) - 2] for s in symbols)
    # the free symbol takes the longest code, so that no real one is of ones alone
    longest = max(length, key=lambda s: (length[s], s == -1))
    length[-1], length[longest] = length[longest], length[-1]
    return {s: n for s, n in length.items() if s != -1}


def _table(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table's bytes, and its codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, before, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s] = (code, before)
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order), codes


def write(frame: Frame, restart: int = 0) -> bytes:
    """A frame as a file, with tables made for it: one pair for the first component, one for all others.

    With ``restart`` a marker follows every so many units, from which on differences begin anew.
    """
    count = len(frame.components)
    factors = [(1, 1)] if count == 1 else [(c.h, c.v) for c in frame.components]
    down, across = frame.components[0].blocks.shape[0] // factors[0][1], frame.components[0].blocks.shape[1] // factors[0][0]
    previous, stream, parts = [0] * count, [], []
    counts = [[Counter(), Counter()] for _ in range(min(count, 2))]
    rows = [c.blocks.tolist() for c in frame.components]
    for unit in range(down * across):
        uy, ux = divmod(unit, across)
        if restart and unit % restart == 0 and unit:
            parts.append(stream)
            previous, stream = [0] * count, []
        for k, (h, v) in enumerate(factors):
            pair = min(k, 1)
            for b in range(h * v):
                block = rows[k][uy * v + b // h][ux * h + b % h]
                for i, item in enumerate(_symbols(block, previous[k])):
                    counts[pair][min(i, 1)][item[0]] += 1
                    stream.append((pair, min(i, 1), *item))
                previous[k] = block[0]
    made = [[_table(code_lengths(c or {0: 1})) for c in pair] for pair in counts]
    out = bytearray(b"\xff\xd8")
    if frame.adobe is not None:
        out += b"\xff\xee\x00\x0eAdobe\x00\x64\x00\x00\x00\x00" + bytes([frame.adobe])
    for n, q in sorted(frame.quantisers.items()):
        wide = int(q.max() > 255)
        out += struct.pack(">BBHB", 0xFF, DQT, 67 + 64 * wide, wide << 4 | n) + q.astype(">u2" if wide else "u1").tobytes()
    out += struct.pack(">BBHBHHB", 0xFF, 0xC0, 8 + 3 * count, 8, frame.height, frame.width, count)
    out += b"".join(bytes([c.ident, c.h << 4 | c.v, c.table]) for c in frame.components)
    for n, pair in enumerate(made):
        for kind, (body, _) in enumerate(pair):
            out += struct.pack(">BBHB", 0xFF, 0xC4, 3 + len(body), kind << 4 | n) + body
    if restart:
        out += struct.pack(">BBHH", 0xFF, DRI, 4, restart)
    out += struct.pack(">BBHB", 0xFF, SOS, 6 + 2 * count, count) + b"".join(bytes([c.ident, 0x11 * min(k, 1)]) for k, c in enumerate(frame.components)) + b"\x00\x3f\x00"
    body = b""
    for i, part in enumerate([*parts, stream]):
        bits = "".join(f"{made[p][k][1][s][0]:0{made[p][k][1][s][1]}b}" + (f"{v:0{n}b}" if n else "") for p, k, s, v, n in part)
        bits += "1" * (-len(bits) % 8)
        body += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) else b"\xff\xd9")
    return bytes(out) + body


def crop(frame: Frame, x: int, y: int, width: int, height: int, luminance: float = 1.0) -> Frame:
    """A rectangle of a frame, its coefficients untouched; what lies outside is one luminance."""
    ux, uy = frame.unit
    if x % ux or y % uy or x < 0 or y < 0 or width < 1 or height < 1:
        raise ValueError(f"a crop begins at units of {ux} x {uy}")
    out = []
    for i, c in enumerate(frame.components):
        h, v = (1, 1) if len(frame.components) == 1 else (c.h, c.v)
        left, top, across, down = x // ux * h, y // uy * v, -(-width // ux) * h, -(-height // uy) * v
        blocks = np.zeros((down, across, 64), np.int32)
        if i == 0:
            blocks[..., 0] = round((min(max(luminance, 0.0), 1.0) * 2047 - 1024) / int(frame.quantisers[c.table][0]))
        part = c.blocks[top : top + down, left : left + across]
        blocks[: part.shape[0], : part.shape[1]] = part
        out.append(Component(c.ident, c.h, c.v, c.table, blocks))
    return Frame(width, height, out, frame.quantisers, frame.adobe)


def blank(data: bytes, luminance: float) -> bytes:
    """A frame of the size, sampling and quantisers of ``data`` and one luminance, with tables of its own."""
    frame = read(data)
    for i, c in enumerate(frame.components):
        c.blocks[:] = 0
        if i == 0:
            c.blocks[..., 0] = round((min(max(luminance, 0.0), 1.0) * 2047 - 1024) / int(frame.quantisers[c.table][0]))
    return write(frame)


def crop_many(data: bytes, boxes: Iterable[tuple[int, int, int, int]], luminance: float = 1.0) -> list[bytes]:
    """Several rectangles of one frame, which is read once."""
    frame = read(data)
    return [write(crop(frame, *box, luminance)) for box in boxes]


def pixels(data: bytes) -> np.ndarray:
    """``(height, width)`` or ``(height, width, 3)`` samples; YCbCr is turned into RGB unless the frame says that it is RGB."""
    frame = read(data)
    planes = []
    ux, uy = frame.unit
    for c in frame.components:
        rows, columns = c.blocks.shape[:2]
        spread = np.zeros((rows * columns, 64))
        spread[:, ZIGZAG] = c.blocks.reshape(-1, 64) * frame.quantisers[c.table]
        samples = BASIS.T @ spread.reshape(-1, 8, 8) @ BASIS + 128
        plane = samples.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
        if len(frame.components) > 1:
            plane = plane.repeat(uy // 8 // c.v, 0).repeat(ux // 8 // c.h, 1)
        planes.append(plane[: frame.height, : frame.width])
    image = np.stack(planes, -1)
    rgb = frame.adobe == 0 or bytes(c.ident for c in frame.components) == b"RGB"
    if len(planes) == 3 and not rgb:
        y, cb, cr = image[..., 0], image[..., 1] - 128, image[..., 2] - 128
        image = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    image = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    return image[..., 0] if len(planes) == 1 else image


def encode(image: np.ndarray, quality: int = 95, sampling: tuple[int, int] = (1, 1)) -> bytes:
    """A baseline file of grey or RGB samples; quantisers grow with frequency, scaled as usual by quality."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = 16 + 2.5 * (np.arange(64) // 8 + np.arange(64) % 8)  # luma; chroma is coarser by half
    tables = {n: np.clip((f * steps[ZIGZAG] * scale + 50) // 100, 1, 255).astype(np.int32) for n, f in ((0, 1.0), (1, 1.5))}
    samples = image.astype(np.float64)
    if image.ndim == 3:
        r, g, b = samples[..., 0], samples[..., 1], samples[..., 2]
        luma = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [luma, (b - luma) / 1.772 + 128, (r - luma) / 1.402 + 128]
        shape = [(*sampling, 0), (1, 1, 1), (1, 1, 1)]
    else:
        planes, shape = [samples], [(1, 1, 0)]
    h, v = shape[0][:2]
    parts = []
    for i, (plane, (ch, cv, n)) in enumerate(zip(planes, shape), 1):
        padded = np.pad(plane, ((0, -plane.shape[0] % (8 * v)), (0, -plane.shape[1] % (8 * h))), "edge")
        fy, fx = v // cv, h // ch
        small = padded.reshape(padded.shape[0] // fy, fy, padded.shape[1] // fx, fx).mean((1, 3)) - 128
        rows, columns = small.shape[0] // 8, small.shape[1] // 8
        blocks = BASIS @ small.reshape(rows, 8, columns, 8).swapaxes(1, 2) @ BASIS.T
        parts.append(Component(i, ch, cv, n, np.rint(blocks.reshape(rows, columns, 64)[..., ZIGZAG] / tables[n]).astype(np.int32)))
    used = {p.table for p in parts}
    return write(Frame(image.shape[1], image.shape[0], parts, {n: q for n, q in tables.items() if n in used}))


def half(image: np.ndarray) -> np.ndarray:
    """An image at half its size by the triangle filter of bilinear reduction (weights 1, 3, 3, 1), edges renormalised."""

    def along(a: np.ndarray) -> np.ndarray:
        n = a.shape[0] // 2
        total, weight = np.zeros((n, *a.shape[1:])), np.zeros(n)
        for offset, w in ((-1, 1), (0, 3), (1, 3), (2, 1)):
            at = 2 * np.arange(n) + offset
            ok = (at >= 0) & (at < a.shape[0])
            total[ok] += w * a[at[ok]]
            weight[ok] += w
        return total / weight.reshape(-1, *[1] * (a.ndim - 1))

    return np.clip(np.rint(along(along(image.astype(np.float64)).swapaxes(0, 1)).swapaxes(0, 1)), 0, 255).astype(np.uint8)


def repaired(tiles: list[list[bytes | None]], tile_w: int, tile_h: int, fill: int = 255, quality: int = 95) -> bytes:
    """A damaged tile made from the finer tiles that cover it (rows of a power-of-two square); missing ones are ``fill``."""
    n = len(tiles)
    mosaic = np.full((tile_h * n, tile_w * n, 3), fill, np.uint8)
    for r, row in enumerate(tiles):
        for c, t in enumerate(row):
            if t:
                p = pixels(t)
                p = np.repeat(p[..., None], 3, -1) if p.ndim == 2 else p
                mosaic[r * tile_h : r * tile_h + p.shape[0], c * tile_w : c * tile_w + p.shape[1]] = p
    while n > 1:
        mosaic, n = half(mosaic), n // 2
    return encode(mosaic, quality)


def crop_jobs(jobs: DataFrame, frame: str, boxes: str, luminance: float = 1.0) -> DataFrame:
    """``jobs`` with ``crops``: for each frame (binary) its rectangles (array of ``struct<x, y, w, h>``) as files, the frame read once.

    Null frames and frames that can't be read give null.
    """
    at, boxes_at = jobs.columns.index(frame), jobs.columns.index(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, asked in zip(b.column(at).to_pylist(), b.column(boxes_at).to_pylist()):
                try:
                    out.append(crop_many(data, [tuple(box.values()) for box in asked], luminance) if data and asked is not None else None)
                except (ValueError, KeyError, IndexError, struct.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.binary()))], [*b.schema.names, "crops"])

    return jobs.mapInArrow(run, StructType([*jobs.schema.fields, StructField("crops", ArrayType(BinaryType()))]))

