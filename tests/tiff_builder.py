"""Small TIFF files for tests: classic or BigTIFF, either byte order, tiles or strips, gaps and missing frames."""

import struct

CODES = {"H": 3, "I": 4, "Q": 16, "s": 2, "B": 7}


def build(pages, order="<", big=False, gap=0):
    """Bytes of a file. A page is ``(tags, frames)``: tags ``{number: (code, values)}``; offsets and counts are put in for ``frames``."""
    out = bytearray(b"II" if order == "<" else b"MM")
    out += struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 0) if big else (42, 0)))
    link = 8 if big else 4
    for tags, frames in pages:
        tags = dict(tags)
        offsets = []
        for f in frames:
            out += bytes(gap)
            offsets.append(len(out) if f else 0)
            out += f
        tiled = 322 in tags
        code = "Q" if big else "I"
        tags[324 if tiled else 273] = (code, offsets)
        tags[325 if tiled else 279] = (code, [len(f) for f in frames])
        entries = []
        for number, (c, values) in sorted(tags.items()):
            body = (values if isinstance(values, bytes) else values.encode() + b"\0") if c in "sB" else struct.pack(order + c * len(values), *values)
            count = len(body) if c in "sB" else len(values)
            if len(body) <= (8 if big else 4):
                field = body.ljust(8 if big else 4, b"\0")
            else:
                out += bytes(len(out) % 2)
                field = struct.pack(order + code, len(out))
                out += body
            entries.append(struct.pack(order + ("HHQ" if big else "HHI"), number, CODES[c], count) + field)
        out += bytes(len(out) % 2)
        struct.pack_into(order + code, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + code, 0)
    return bytes(out)


def tiled(width, height, tile, frames, description=None, compression=1, **more):
    """A tiled RGB page."""
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [8, 8, 8]), 259: ("H", [compression]), 262: ("H", [2]), 277: ("H", [3]), 322: ("I", [tile]), 323: ("I", [tile])}
    if description is not None:
        tags[270] = ("s", description)
    return {**tags, **{int(k[1:]): v for k, v in more.items()}}, frames
