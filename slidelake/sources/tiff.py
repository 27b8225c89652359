"""TIFF files read by byte ranges: directories, tags, frames; classic and BigTIFF, either byte order.

Only directories are parsed; pixel bytes are read by the ranges asked for, ranges that touch in one read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import BinaryIO

from slidelake.functions.codestream import DRI, mcu_size, segments, with_header

#: Bytes and struct codes of the field types.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Names of compressions and colour models.
COMPRESSIONS = {1: "NONE", 5: "LZW", 7: "JPEG", 8: "DEFLATE", 22610: "JPEGXR_NDPI", 32946: "DEFLATE", 33003: "APERIO_JP2000_YCBC", 33005: "APERIO_JP2000_RGB", 34712: "JPEG2000", 34933: "PNG", 50000: "ZSTD"}
PHOTOMETRICS = {0: "MINISWHITE", 1: "MINISBLACK", 2: "RGB", 3: "PALETTE", 6: "YCBCR"}
MAX_RUN = 64 << 20  # bytes of one coalesced read


class TiffError(ValueError):
    """The bytes are no TIFF, or one whose directories are damaged."""


@dataclass
class Page:
    """One directory: its tags by number, and what they mean."""

    index: int
    tags: dict[int, object] = field(default_factory=dict)
    parent: int | None = None
    header: bytes | None = None
    stripes: tuple[int, int, list[int], list[int]] | None = None

    def _one(self, tag: int, default=None):
        v = self.tags.get(tag, default)
        return v[0] if isinstance(v, tuple) and v else v

    def _all(self, tag: int) -> list[int]:
        v = self.tags.get(tag, ())
        return list(v) if isinstance(v, tuple) else [v]

    def text(self, tag: int) -> str | None:
        """A tag as text; null without it."""
        v = self.tags.get(tag)
        return v.split(b"\0", 1)[0].decode("utf-8", "replace") if isinstance(v, bytes) else None if v is None else str(self._one(tag))

    @property
    def is_tiled(self) -> bool:
        return 322 in self.tags

    def row(self) -> dict:
        """The page as values of the ``pages`` relation."""
        bits = self._all(258) or [1]
        tiled = self.is_tiled
        jpegtables, icc = self.tags.get(347), self.tags.get(34675)
        ratio = lambda t: (lambda v: float(v[0]) / v[1] if isinstance(v, tuple) and len(v) == 2 and v[1] else None)(self.tags.get(t))
        return {
            "page_idx": self.index, "subfile": self._one(254, 0), "width": self._one(256), "height": self._one(257), "is_tiled": tiled,
            "tile_w": self._one(322) if tiled else self._one(256), "tile_h": self._one(323) if tiled else self._one(278, self._one(257)),
            "compression": COMPRESSIONS.get(self._one(259, 1), str(self._one(259, 1))), "photometric": PHOTOMETRICS.get(self._one(262), None),
            "samples": self._one(277, 1), "bits": bits[0], "description": self.text(270), "software": self.text(305), "make": self.text(271), "model": self.text(272),
            "x_resolution": ratio(282), "y_resolution": ratio(283), "resolution_unit": self._one(296, 2),
            "jpeg_tables": jpegtables if isinstance(jpegtables, bytes) else None, "icc_profile": icc if isinstance(icc, bytes) else None,
            "tags": {t: self.text(t) for t in self.tags if t >= 65000 or t in (306, 700)},
            "offsets": self._all(324 if tiled else 273), "bytecounts": self._all(325 if tiled else 279), "parent": self.parent, "header": self.header,
            **self._striped(),
        }

    def _striped(self) -> dict:
        """A page whose one JPEG is parted by restart markers: its stripes are its frames."""
        if self.stripes is None:
            return {}
        width, height, offsets, sizes = self.stripes
        return {"is_tiled": True, "tile_w": width, "tile_h": height, "offsets": offsets, "bytecounts": sizes}

    def find_stripes(self, f: BinaryIO) -> None:
        """Stripes of a JPEG whose restart intervals are listed (tag 65426, high halves in 65432): header, size and places of each."""
        starts, high = self._all(65426), self._all(65432) if 65432 in self.tags else []
        offsets, sizes = self._all(273), self._all(279)
        if not starts or not starts[0] or self._one(259, 1) not in (6, 7) or len(offsets) != 1 or not sizes:
            return
        starts = [s + (h << 32) for s, h in zip(starts, high or [0] * len(starts))]
        f.seek(offsets[0])
        head = f.read(starts[0])
        unit, interval = mcu_size(head), next((s for s in segments(head) if s.marker == DRI), None)
        if unit is None or interval is None:
            return
        (units,) = struct.unpack_from(">H", head, interval.body)
        if units:
            self.header = with_header(head, units * unit[0], unit[1])
            self.stripes = units * unit[0], unit[1], [offsets[0] + s for s in starts], [b - a for a, b in zip(starts, [*starts[1:], sizes[0]])]


def read_pages(f: BinaryIO) -> list[Page]:
    """All directories of a file: the chain in order, behind it those that pages name as parts of theirs; a directory met twice counts once."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise TiffError("no TIFF")
    (version,) = struct.unpack_from(order + "H", head, 2)
    if version == 42:
        big, (at,) = False, struct.unpack_from(order + "I", head, 4)
    elif version == 43 and len(head) == 16:
        big, (at,) = True, struct.unpack_from(order + "Q", head, 8)
    else:
        raise TiffError(f"TIFF version {version}")
    size = f.seek(0, os.SEEK_END)
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(f, at, order, big, size)
        pages.append(Page(len(pages), tags))
    waiting = [(p.index, a) for p in pages for a in p._all(330)] if pages else []
    for parent, at in waiting:
        if at and at not in seen:
            seen.add(at)
            tags, _ = _directory(f, at, order, big, size)
            pages.append(Page(len(pages), tags, parent))
            waiting += [(pages[-1].index, a) for a in pages[-1]._all(330)]
    for page in pages:
        if 65426 in page.tags:
            page.find_stripes(f)
    return pages


def _directory(f: BinaryIO, at: int, order: str, big: bool, size: int) -> tuple[dict[int, object], int]:
    """Tags of the directory at an offset, and the offset of the next one (0 if there is none)."""
    count_code, entry, next_code, inline = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    f.seek(at)
    raw = f.read(struct.calcsize(order + count_code))
    if len(raw) < struct.calcsize(order + count_code):
        raise TiffError("cut off directory")
    (n,) = struct.unpack(order + count_code, raw)
    body = f.read(n * entry + struct.calcsize(order + next_code))
    if len(body) < n * entry:
        raise TiffError("cut off directory")
    tags: dict[int, object] = {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", body, i * entry)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), body, i * entry + 4)
        code = TYPES.get(kind)
        if code is None:
            continue
        length = struct.calcsize("=" + code) * count
        place = i * entry + (12 if big else 8)
        if length <= inline:
            value = body[place : place + length]
        else:
            (where,) = struct.unpack_from(order + next_code, body, place)
            if where + length > size:
                continue
            f.seek(where)
            value = f.read(length)
        tags[tag] = value if code == "s" else struct.unpack(order + code * count, value)
    tail = body[n * entry :]
    return tags, struct.unpack(order + next_code, tail)[0] if len(tail) == struct.calcsize(order + next_code) else 0


def runs(ranges: Sequence[tuple[int, int]], most: int = MAX_RUN) -> list[tuple[int, int, list[int]]]:
    """Ranges that touch, joined: ``(start, length, positions of the ranges in it)``; empty ranges are in none."""
    out: list[tuple[int, int, list[int]]] = []
    for i in sorted((i for i, r in enumerate(ranges) if r[1] > 0), key=lambda i: ranges[i]):
        start, length = ranges[i]
        if out and start == out[-1][0] + out[-1][1] and out[-1][1] + length <= most:
            out[-1] = (out[-1][0], out[-1][1] + length, [*out[-1][2], i])
        else:
            out.append((start, length, [i]))
    return out


def read_ranges(f: BinaryIO, ranges: Sequence[tuple[int, int]]) -> list[bytes]:
    """The bytes of each range, in the order asked for; touching ranges are read at once."""
    found = [b""] * len(ranges)
    for start, length, members in runs(ranges):
        f.seek(start)
        blob = f.read(length)
        for i in members:
            at = ranges[i][0] - start
            found[i] = blob[at : at + ranges[i][1]]
    return found


def lzw_decode(data: bytes) -> bytes:
    """TIFF LZW: codes of 9 to 12 bits, most significant bit first, the width grown one code early."""
    out, table = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""]
    width, buffer, held, previous = 9, 0, 0, None
    for byte in data:
        buffer, held = (buffer << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = buffer >> held & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, previous = 9, None
            continue
        if previous is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out += entry
        previous = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def decode(data: bytes, compression: str) -> bytes:
    """Raw samples of a frame; only codecs that need no native library."""
    if compression == "NONE":
        return data
    if compression == "LZW":
        return lzw_decode(data)
    if compression == "DEFLATE":
        return zlib.decompress(data)
    raise TiffError(f"no codec for {compression} here")
