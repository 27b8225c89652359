"""Files of every way of storing, served tile by tile."""

import numpy as np
import pytest

from slidelake.functions import codestream as c
from slidelake.functions import jpeg_codec as j
from slidelake.plans import serve as sv
from slidelake.plans import slides as sl
from tests.test_jpeg_codec import picture
from tests.tiff_builder import build, tiled


def abbreviated(data):
    """A file without its tables, and the tables."""
    inner = [s for s in c.segments(data) if s.marker in (c.DQT, c.DHT)]
    tables = b"\xff\xd8" + b"".join(data[s.start : s.end] for s in inner) + b"\xff\xd9"
    return b"".join(data[a:b] for a, b in zip([0, *(s.end for s in inner)], [*(s.start for s in inner), len(data)])), tables


def striped_ndpi(image, units):
    """A page whose one JPEG is parted by restart markers, with the places of its stripes."""
    data = j.write(j.read(j.encode(image)), units)
    scan = next(s for s in c.segments(data) if s.marker == c.SOS)
    starts, at = [scan.end], scan.end
    count = data.count(b"\xff\xd0") + sum(data[scan.end :].count(bytes([0xFF, m])) for m in range(0xD1, 0xD8))
    for i in range(count):
        at = data.index(bytes([0xFF, 0xD0 + i % 8]), at) + 2
        starts.append(at)
    h, w = image.shape[:2]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8, 8, 8]), 259: ("H", [7]), 262: ("H", [6]), 277: ("H", [3]), 278: ("I", [h]), 65420: ("I", [1]), 65421: ("s", "20.0"), 65426: ("I", starts)}
    return (tags, [data]), data


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("served")
    image = picture(32, 64)
    page, data = striped_ndpi(image, 4)
    plain = {k: v for k, v in page[0].items() if k != 65426} | {256: ("I", [40]), 257: ("I", [24]), 278: ("I", [24])}
    (d / "stripes.ndpi").write_bytes(build([page]))
    (d / "frame.ndpi").write_bytes(build([(plain, [j.encode(picture(24, 40))])], gap=3))
    whole = [j.encode(picture(16, 16, seed)) for seed in range(4)]
    _, tables = abbreviated(whole[0])
    short = [b"\xff\xd8" + t[2:] for t in whole]
    fine = tiled(32, 32, 16, whole, "Aperio Image Library|MPP = 0.5", 7)
    coarse = tiled(16, 16, 8, [j.encode(picture(8, 8, 9)), b"", b"", j.encode(picture(8, 8, 9))], "Aperio\n32x32 -> 16x16", 7)
    (d / "repair.svs").write_bytes(build([fine, coarse]))
    sparse = tiled(32, 32, 16, [short[0], b"", short[2], b""], None, 7)
    sparse[0][65000] = ("s", "<Argos.Scan.Metadata/>")
    (d / "sparse.avs").write_bytes(build([sparse]))
    return d, image, data, whole


def served(spark, d, name, **more):
    return {(r.level_idx, r.x, r.y): r for r in sv.serve_tiles(spark, str(d / name), **more).collect()}


def test_stripes_are_found_and_cut(spark, folder):
    d, image, data, _ = folder
    page = sl.read_pages(spark, str(d / "stripes.ndpi")).collect()[0]
    assert (page.is_tiled, page.tile_w, page.tile_h, len(page.offsets)) == (True, 32, 8, 8)
    got, pixels = served(spark, d, "stripes.ndpi", tile_size=32), j.pixels(data)
    assert len(got) == 2 and {r.status for r in got.values()} == {"cropped"}
    for (_, x, y), r in got.items():
        assert np.array_equal(j.pixels(bytes(r.data)), pixels[32 * y : 32 * y + 32, 32 * x : 32 * x + 32])


def test_one_frame_is_cut(spark, folder):
    d, *_ = folder
    got, pixels = served(spark, d, "frame.ndpi", tile_size=16), j.pixels(j.encode(picture(24, 40)))
    assert len(got) == 6
    tile = j.pixels(bytes(got[0, 1, 0].data))
    assert np.array_equal(tile, pixels[:16, 16:32]) and j.pixels(bytes(got[0, 2, 1].data)).shape == (16, 16, 3)


def test_stored_repaired_and_reduced_levels(spark, folder):
    d, _, _, whole = folder
    got = served(spark, d, "repair.svs")
    assert {k[0] for k in got} == {0, 1}  # the arrow in its text makes the tiled page no thumbnail
    assert [bytes(got[0, x, y].data) for y in range(2) for x in range(2)] == whole
    assert [got[1, x, y].status for y in range(2) for x in range(2)] == ["stored", "repaired", "repaired", "repaired"]
    assert j.pixels(bytes(got[1, 1, 1].data)).shape == (8, 8, 3)


def test_sparse_requests_and_pixels(spark, folder):
    d, _, _, whole = folder
    path = str(d / "sparse.avs")
    asked = [(1, 0), (0, 0), (1, 0), (2, 0), (0, -1)]
    requests = spark.createDataFrame([(path, 0, 0, x, y, n) for n, (x, y) in enumerate(asked)] + [("nowhere", 0, 0, 0, 0, 9)], "path string, level_idx int, plane int, x int, y int, request int")
    got = {r.request: r for r in sv.serve_tiles(spark, path, requests, pixels=True).collect()}
    assert {n: r.status for n, r in got.items()} == {0: "blank", 1: "stored", 2: "blank", 3: "outside", 4: "outside", 9: "outside"}
    assert set(got[0].pixels) == {255} and (got[1].width, got[1].height, got[1].samples) == (16, 16, 3)
    assert bytes(got[1].pixels) == j.pixels(whole[0]).tobytes() and got[3].pixels is None


def test_parts_of_a_page_are_levels(tmp_path, spark):
    import struct

    raw = bytearray(build([tiled(32, 32, 16, [b"a"] * 4, "<OME></OME>", m330=("I", [0])), tiled(16, 16, 16, [b"b"], "x")]))
    # the second directory becomes part of the first: unlink it and name its place
    first = struct.unpack_from("<I", raw, 4)[0]
    n = struct.unpack_from("<H", raw, first)[0]
    link = first + 2 + 12 * n
    second = struct.unpack_from("<I", raw, link)[0]
    struct.pack_into("<I", raw, link, 0)
    at = next(first + 2 + 12 * i for i in range(n) if struct.unpack_from("<H", raw, first + 2 + 12 * i)[0] == 330)
    struct.pack_into("<I", raw, at + 8, second)
    (tmp_path / "a.ome.tif").write_bytes(bytes(raw))
    pages = sl.read_pages(spark, str(tmp_path))
    found = {r.page_idx: (r.parent, r.role) for r in sl.images(pages, sl.slides(pages)).collect()}
    assert found == {0: (None, "level"), 1: (0, "level")}
