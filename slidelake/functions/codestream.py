"""JPEG and JPEG 2000 bytes: what headers say, and frames put together without decoding pixels.

Plain functions on bytes, and Arrow UDFs over binary columns for use in DataFrames. A JPEG is read once into a table of its
marker segments; everything else looks at that table. Nothing here needs a native codec.

Defined results
* null, empty and foreign bytes: null (functions: None); cut off headers: what is whole is used, null if the frame header is missing;
* of several frame headers the first counts; 1-component images have no subsampling.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

SOI, EOI, SOS, DQT, DHT, DRI, APP14 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xEE
#: Coding process by frame header marker; others of the range are "OTHER".
PROCESSES = {0xC0: "BASELINE", 0xC1: "EXTENDED", 0xC2: "PROGRESSIVE", 0xC3: "LOSSLESS"}
FRAME_MARKERS = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
STANDALONE = {0x00, 0x01, SOI, EOI, *range(0xD0, 0xD8)}
#: An Adobe segment: marker, length, name, version 100, flags 0x8000 and 0, transform 0 (RGB).
ADOBE_RGB = struct.pack(">BBH5sHHHB", 0xFF, APP14, 14, b"Adobe", 100, 0x8000, 0, 0)

_INT, _BOOL = IntegerType(), BooleanType()
_PAIR = StructType([StructField("h", _INT), StructField("v", _INT)])
_struct = lambda **kinds: StructType([StructField(k, v) for k, v in kinds.items()])
JPEG_SCHEMA = _struct(process=StringType(), bit_depth=_INT, components=_INT, subsampling=_PAIR, rgb=_BOOL, predictor=_INT, width=_INT, height=_INT)
J2K_SCHEMA = _struct(reversible=_BOOL, uses_mct=_BOOL, components=_INT, subsampling=_PAIR, bit_depth=_INT, extended=_BOOL)


@dataclass(frozen=True)
class Segment:
    """A marker segment: ``start`` at its FF byte, ``body`` behind the length, ``end`` behind the segment."""

    marker: int
    start: int
    body: int
    end: int


def segments(data: bytes) -> Iterator[Segment]:
    """Marker segments up to and with the start of scan."""
    at = data.find(b"\xff")
    while 0 <= at < len(data) - 1:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in STANDALONE:
            at = data.find(b"\xff", at + 2)
        else:
            if at + 4 > len(data):
                return
            end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
            yield Segment(marker, at, at + 4, end)
            if marker == SOS:
                return
            at = data.find(b"\xff", end)


def _first(data: bytes, *markers: int) -> Segment | None:
    return next((s for s in segments(data) if s.marker in markers), None)


def jpeg_info(data: bytes | None) -> dict | None:
    """Process, depth, components, subsampling, RGB signal, lossless predictor and size of a frame."""
    if not data:
        return None
    table: dict[int, Segment] = {}
    for s in segments(data):
        key = 0xC0 if s.marker in FRAME_MARKERS else s.marker
        if key != APP14 or data[s.body : s.body + 5] == b"Adobe":
            table.setdefault(key, s) if key == 0xC0 else table.update({key: s})
    frame = table.get(0xC0)
    if frame is None or frame.end > len(data) or frame.end - frame.body < 6:
        return None
    depth, height, width, count = struct.unpack_from(">BHHB", data, frame.body)
    parts = [tuple(data[frame.body + 6 + 3 * i : frame.body + 8 + 3 * i]) for i in range(count)]
    if any(len(p) < 2 for p in parts):
        return None
    process = PROCESSES.get(frame.marker, "OTHER")
    adobe, scan = table.get(APP14), table.get(SOS)
    transform = data[adobe.body + 11] if adobe and adobe.end - adobe.body >= 12 and adobe.end <= len(data) else None
    predictor = None
    if process == "LOSSLESS" and scan and scan.body < len(data):
        place = scan.body + 1 + 2 * data[scan.body]
        predictor = data[place] if place < min(scan.end, len(data)) else None
    sampling = {"h": max(p[1] >> 4 for p in parts), "v": max(p[1] & 15 for p in parts)} if count > 1 else None
    rgb = bytes(p[0] for p in parts) == b"RGB" or transform == 0
    return {"process": process, "bit_depth": depth, "components": count, "subsampling": sampling, "rgb": rgb, "predictor": predictor, "width": width, "height": height}


def mcu_size(data: bytes) -> tuple[int, int] | None:
    """Pixels of a minimum coded unit."""
    info = jpeg_info(data)
    if info is None:
        return None
    s = info["subsampling"] or {"h": 1, "v": 1}
    return 8 * s["h"], 8 * s["v"]


def baseline_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of a baseline frame header; None where there is none or it is cut off."""
    s = _first(data or b"", *FRAME_MARKERS)
    if s is None or s.marker != 0xC0 or s.body + 5 > len(data):
        return None
    height, width = struct.unpack_from(">HH", data, s.body + 1)
    return width, height


def jpeg2000_info(data: bytes | None) -> dict | None:
    """What the SIZ and COD segments of a codestream say; None if either is missing or cut off."""
    siz = (data or b"").find(b"\xff\x51")
    if siz < 0 or siz + 40 > len(data):
        return None
    length, rsiz = struct.unpack_from(">HH", data, siz + 2)
    (count,) = struct.unpack_from(">H", data, siz + 38)
    parts = data[siz + 40 : siz + 40 + 3 * count]
    cod = data.find(b"\xff\x52", siz + 2 + length)
    if len(parts) < 3 * count or count == 0 or cod < 0 or cod + 13 >= len(data):
        return None
    sampling = {"h": max(parts[1::3]), "v": max(parts[2::3])} if count > 1 else None
    return {"reversible": data[cod + 13] == 1, "uses_mct": data[cod + 8] != 0, "components": count, "subsampling": sampling, "bit_depth": (parts[0] & 0x7F) + 1, "extended": rsiz != 0}


def with_header(data: bytes, width: int | None = None, height: int | None = None, restart: int | None = None) -> bytes:
    """A frame (or its header) with another size and restart interval; the interval is put before the scan if there is none."""
    out = bytearray(data)
    table = {s.marker: s for s in segments(data)}
    frame = next((s for m, s in table.items() if m in FRAME_MARKERS), None)
    if frame is None:
        raise ValueError("no frame header")
    if height is not None:
        struct.pack_into(">H", out, frame.body + 1, height)
    if width is not None:
        struct.pack_into(">H", out, frame.body + 3, width)
    if restart is not None:
        if DRI in table:
            struct.pack_into(">H", out, table[DRI].body, restart)
        elif SOS in table:
            out[table[SOS].start : table[SOS].start] = struct.pack(">BBHH", 0xFF, DRI, 4, restart)
        else:
            out += struct.pack(">BBHH", 0xFF, DRI, 4, restart)
    return bytes(out)


def rgb_header(data: bytes) -> bytes:
    """A header whose three components are named R, G and B, with an Adobe segment of transform 0 in front."""
    out = bytearray(data)
    for s in segments(data):
        if s.marker in FRAME_MARKERS and data[s.body + 5] == 3:
            out[s.body + 6], out[s.body + 9], out[s.body + 12] = b"RGB"
        elif s.marker == SOS and data[s.body] == 3:
            out[s.body + 1], out[s.body + 3], out[s.body + 5] = b"RGB"
    return bytes(out[:2]) + ADOBE_RGB + bytes(out[2:])


def tables_prefix(tables: bytes | None, rgb: bool = False) -> bytes:
    """What stands before an abbreviated tile's own segments: start, Adobe segment if RGB, shared tables."""
    inner = tables[2:-2] if tables and tables[-2:] == b"\xff\xd9" else (tables or b"")[2:]
    return b"\xff\xd8" + (ADOBE_RGB if rgb else b"") + inner


def complete_tile(tile: bytes, prefix: bytes) -> bytes:
    """An abbreviated tile made a whole image; empty tiles stay empty."""
    return prefix + tile[2:] if tile else tile


def scan_of(data: bytes) -> bytes:
    """Entropy-coded bytes behind the start of scan, without an end marker."""
    s = _first(data, SOS)
    body = data[s.end :] if s else data
    return body[:-2] if body[-2:] == b"\xff\xd9" else body


def join_fragments(header: bytes, fragments: list[bytes]) -> bytes:
    """Stripes that end in a marker, behind one header: restart markers between them, an end marker behind the last."""
    out = bytearray(header)
    for i, fragment in enumerate(fragments):
        if fragment[-2:-1] != b"\xff":
            raise ValueError("a fragment must end in a marker")
        out += fragment[:-1] + bytes([0xD0 + i % 8])
    out[-1:] = b"\xd9"
    return bytes(out)


def join_scans(frames: list[bytes], tables: bytes | None = None, rgb: bool = False) -> bytes:
    """Strips of one width and sampling stacked: one header of the whole height, each strip one restart interval."""
    whole = [complete_tile(f, tables_prefix(tables)) if tables else f for f in frames]
    sizes = [baseline_size(f) for f in whole]
    if any(s is None for s in sizes) or len({s[0] for s in sizes}) != 1:
        raise ValueError("strips must be baseline frames of one width")
    across, down = mcu_size(whole[0])
    units = -(-sizes[0][0] // across) * -(-sizes[0][1] // down)
    first = with_header(whole[0], height=sum(s[1] for s in sizes), restart=units)
    scan = _first(first, SOS)
    head = rgb_header(first[: scan.end]) if rgb else first[: scan.end]
    parts = [scan_of(f) for f in whole]
    body = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))
    return head + body + b"\xff\xd9"


def huffman_codes(data: bytes) -> dict[tuple[int, int], dict[int, tuple[int, int]]]:
    """``(class, id)`` to ``symbol -> (code, length)`` of all Huffman tables."""
    tables: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    for s in segments(data):
        at = s.body
        while s.marker == DHT and at < s.end:
            key, counts = (data[at] >> 4, data[at] & 15), data[at + 1 : at + 17]
            symbols, at, code, codes = iter(data[at + 17 : at + 17 + sum(counts)]), at + 17 + sum(counts), 0, {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    codes[next(symbols)] = (code, length)
                    code += 1
                code <<= 1
            tables[key] = codes
    return tables


def dc_quantiser(data: bytes, table: int = 0) -> int | None:
    """First element of a quantisation table: identifier in the low, precision in the high half of its first byte."""
    for s in segments(data):
        at = s.body
        while s.marker == DQT and at < s.end:
            wide, number = data[at] >> 4, data[at] & 15
            if number == table:
                return struct.unpack_from(">H", data, at + 1)[0] if wide else data[at + 1]
            at += 1 + (128 if wide else 64)
    return None


def blank_frame(data: bytes, luminance: float) -> bytes:
    """A frame with the header of ``data`` and one luminance everywhere: luma DC coefficients only, all others zero.

    ``ValueError`` where the header's own tables lack a code for that; ``jpeg_codec.blank`` makes tables.
    """
    info, (across, down) = jpeg_info(data), mcu_size(data)
    codes, scan = huffman_codes(data), _first(data, SOS)
    frame = _first(data, *FRAME_MARKERS)
    parts = {data[frame.body + 6 + 3 * i]: data[frame.body + 7 + 3 * i : frame.body + 9 + 3 * i] for i in range(info["components"])}
    chosen = [(data[scan.body + 1 + 2 * i], data[scan.body + 2 + 2 * i]) for i in range(data[scan.body])]
    quantiser = dc_quantiser(data, parts[chosen[0][0]][1]) or 1
    value = round((min(max(luminance, 0.0), 1.0) * 2047 - 1024) / quantiser)
    restart = _first(data, DRI)
    interval = struct.unpack_from(">H", data, restart.body)[0] if restart else 0
    bits, count = 0, 0
    out = bytearray()

    def put(code: int, length: int) -> None:
        nonlocal bits, count
        bits, count = bits << length | code, count + length
        while count >= 8:
            count -= 8
            byte = bits >> count & 0xFF
            out.append(byte)
            if byte == 0xFF:
                out.append(0)
        bits &= (1 << count) - 1

    def flush() -> None:
        if count:
            put((1 << (8 - count)) - 1, 8 - count)

    single = info["components"] == 1
    step_x, step_y = (8, 8) if single else (across, down)
    units = -(-info["width"] // step_x) * -(-info["height"] // step_y)
    fresh = True
    for unit in range(units):
        if interval and unit and unit % interval == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (unit // interval - 1) % 8])
            fresh = True
        for k, (component, selectors) in enumerate(chosen):
            sampling = parts[component][0]
            for block in range(1 if single else (sampling >> 4) * (sampling & 15)):
                change = value if fresh and k == 0 and block == 0 else 0
                size = abs(change).bit_length()
                try:
                    put(*codes[0, selectors >> 4][size])
                    if size:
                        put(change if change > 0 else change + (1 << size) - 1, size)
                    put(*codes[1, selectors & 15][0])
                except KeyError:
                    raise ValueError("the header's tables lack a code") from None
        fresh = False
    flush()
    return data[: scan.end] + bytes(out) + b"\xff\xd9"


def _structs(read, data: pd.Series, schema: StructType) -> pd.DataFrame:
    """One row per value, None for what isn't known."""
    found = [read(bytes(d)) or {} if d is not None else {} for d in data]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in found], dtype=object) for n in schema.names})


@F.pandas_udf(JPEG_SCHEMA)
def jpeg_info_udf(frames: pd.Series) -> pd.DataFrame:
    """Struct of a JPEG frame's header, fields null if it has none."""
    return _structs(jpeg_info, frames, JPEG_SCHEMA)


@F.pandas_udf(J2K_SCHEMA)
def jpeg2000_info_udf(frames: pd.Series) -> pd.DataFrame:
    """Struct of a JPEG 2000 codestream's header, fields null if it has none."""
    return _structs(jpeg2000_info, frames, J2K_SCHEMA)


@F.pandas_udf(BinaryType())
def complete_tile_udf(tiles: pd.Series, tables: pd.Series, rgb: pd.Series) -> pd.Series:
    """Abbreviated tiles made whole with their page's tables."""
    return pd.Series([None if t is None else complete_tile(bytes(t), tables_prefix(bytes(x), bool(r))) if x is not None else bytes(t) for t, x, r in zip(tiles, tables, rgb)])


def register(spark) -> None:
    """Make the functions known to SQL as ``jpeg_info``, ``jpeg2000_info`` and ``complete_tile``."""
    spark.udf.register("jpeg_info", jpeg_info_udf)
    spark.udf.register("jpeg2000_info", jpeg2000_info_udf)
    spark.udf.register("complete_tile", complete_tile_udf)
