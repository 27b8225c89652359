import io
import zlib

import pytest

from slidelake.sources import tiff, wsi
from tests.tiff_builder import build, tiled

LEVEL0 = [bytes([i]) * (8 * 8 * 3) for i in range(6)]  # 3 x 2 tiles
LEVEL0[4] = b""


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("gap", [0, 5])
def test_directories_and_ranges(order, big, gap):
    data = build([tiled(20, 14, 8, LEVEL0, "Aperio Image\nx|MPP = 0.5"), tiled(10, 7, 8, LEVEL0[:2])], order, big, gap)
    pages = tiff.read_pages(io.BytesIO(data))
    first = pages[0].row()
    assert (len(pages), first["width"], first["height"], first["tile_w"], first["compression"], first["photometric"], first["bits"]) == (2, 20, 14, 8, "NONE", "RGB", 8)
    assert first["description"].startswith("Aperio Image")
    ranges = list(zip(first["offsets"], first["bytecounts"]))
    asked = [ranges[i] for i in (3, 0, 1, 4)]
    assert tiff.read_ranges(io.BytesIO(data), asked) == [LEVEL0[3], LEVEL0[0], LEVEL0[1], b""]
    assert len(tiff.runs(ranges)) == (2 if gap == 0 else 5) - (gap == 0)


def test_runs_limit_and_order():
    assert tiff.runs([(10, 5), (0, 10), (20, 1), (15, 0)]) == [(0, 15, [1, 0]), (20, 1, [2])]
    assert tiff.runs([(0, 6), (6, 6)], most=8) == [(0, 6, [0]), (6, 6, [1])]


@pytest.mark.parametrize("data", [b"", b"II", b"PK\x03\x04" * 9, b"II\x2a\x00\xff\xff\xff\x7f", build([tiled(8, 8, 8, [b"x"])])[:-40]])
def test_damaged_files_raise_or_end(data):
    try:
        tiff.read_pages(io.BytesIO(data))
    except tiff.TiffError:
        pass


def test_decoders():
    raw = bytes(range(256)) * 20
    assert tiff.decode(zlib.compress(raw), "DEFLATE") == raw
    with pytest.raises(tiff.TiffError):
        tiff.decode(b"", "JPEG")
    # 256 (clear), 65, 66, 258 = "AB", 257 (end), as 9-bit codes
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 257))
    bits += "0" * (-len(bits) % 8)
    assert tiff.lzw_decode(int(bits, 2).to_bytes(len(bits) // 8, "big")) == b"ABAB"


def test_lzw_round_trip():
    def encode(data):
        table, width, out, w = {bytes([i]): i for i in range(256)}, 9, f"{256:09b}", b""
        n = 258
        for b in data:
            if w + bytes([b]) in table:
                w += bytes([b])
                continue
            out += f"{table[w]:0{width}b}"
            table[w + bytes([b])] = n
            n += 1
            if n == 4094:
                out += f"{256:0{width}b}"
                table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
            elif n >= (1 << width) and width < 12:
                width += 1
            w = bytes([b])
        out += f"{table[w]:0{width}b}"
        n += 1
        if n >= (1 << width) and width < 12:
            width += 1
        out += f"{257:0{width}b}"
        out += "0" * (-len(out) % 8)
        return int(out, 2).to_bytes(len(out) // 8, "big")

    raw = bytes((i * i) % 251 for i in range(20000))
    assert tiff.lzw_decode(encode(raw)) == raw


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.svs").write_bytes(build([tiled(20, 14, 8, LEVEL0, "Aperio Image Library"), tiled(10, 7, 8, LEVEL0[:2])]))
    (tmp_path / "b.tif").write_bytes(build([tiled(8, 8, 8, LEVEL0[:1], "x", m305=("s", "MedScan 1"))], ">", True))
    (tmp_path / "c.txt").write_bytes(b"no slide")
    return str(tmp_path)


def test_relations(spark, folder):
    slides = {r.path.rsplit("/", 1)[1]: r for r in wsi.open_slides(spark, folder).collect()}
    assert {k: (v.format, v.pages) for k, v in slides.items()} == {"a.svs": ("svs", 2), "b.tif": ("trestle", 1), "c.txt": (None, None)}
    assert "no TIFF" in slides["c.txt"].error
    tiles = wsi.read_tiles(spark, folder, page=0)
    got = {(r.path[-5:], r.x, r.y): (r.status, r.data) for r in tiles.collect()}
    assert got["a.svs", 1, 1] == ("blank", None) and bytes(got["a.svs", 2, 1][1]) == LEVEL0[5] and len(got) == 7
    part = wsi.read_tiles(spark, f"{folder}/a.svs", page=0, box=(1, 0, 3, 1))
    assert sorted((r.x, r.y) for r in part.collect()) == [(1, 0), (2, 0)]
    # one load doesn't prune another
    assert tiles.count() == 7 and part.union(part).count() == 4
    frames = spark.read.format("wsi").option("relation", "frames").load(folder)
    assert frames.count() == 9 and frames.where("bytecount = 0").count() == 1
    small = spark.read.format("wsi").option("relation", "tiles").option("bytes_per_task", 300).load(f"{folder}/a.svs")
    assert small.rdd.getNumPartitions() > 3 and small.count() == 8


def test_failfast_and_bad_options(spark, folder):
    with pytest.raises(Exception):
        spark.read.format("wsi").option("mode", "failfast").load(folder).collect()
    with pytest.raises(Exception):
        spark.read.format("wsi").option("relation", "nothing").load(folder).collect()
    assert spark.read.format("wsi").load(f"{folder}/*.none").count() == 0


def test_stream_of_new_files(spark, folder, tmp_path):
    from slidelake.streaming.discovery import arriving, windowed_counts

    q = arriving(spark, folder, "*.svs").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.path[-5:] for r in spark.table("seen").collect()] == ["a.svs"]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "x")], "ts string, kind string").selectExpr("to_timestamp(ts) ts", "kind")
    assert sorted(r.events for r in windowed_counts(events, "ts", "kind").collect()) == [1, 2]
