import struct

import pytest
from pyspark.sql import functions as F

from slidelake.functions import codestream as c


def header(marker=0xC0, ids=(1, 2, 3), sampling=((1, 1),) * 3, precision=8, adobe=None, predictor=0, size=(64, 64)):
    out = b"\xff\xd8"
    if adobe is not None:
        out += b"\xff\xee\x00\x0eAdobe" + bytes(6) + bytes([adobe])
    sof = struct.pack(">BHHB", precision, size[1], size[0], len(ids)) + b"".join(bytes([i, h << 4 | v, 0]) for i, (h, v) in zip(ids, sampling))
    out += struct.pack(">BBH", 0xFF, marker, len(sof) + 2) + sof
    sos = bytes([len(ids)]) + b"".join(bytes([i, 0]) for i in ids) + bytes([predictor, 0, 0])
    return out + struct.pack(">BBH", 0xFF, 0xDA, len(sos) + 2) + sos


@pytest.mark.parametrize("marker, process", [(0xC0, "BASELINE"), (0xC1, "EXTENDED"), (0xC2, "PROGRESSIVE"), (0xC3, "LOSSLESS"), (0xC5, "OTHER")])
def test_process(marker, process):
    assert c.jpeg_info(header(marker))["process"] == process


@pytest.mark.parametrize("ids, adobe, rgb", [(b"RGB", None, True), ((1, 2, 3), 0, True), (b"RGB", 1, True), ((1, 2, 3), 1, False), ((1, 2, 3), 2, False), ((1, 2, 3), None, False)])
def test_rgb_signal(ids, adobe, rgb):
    assert c.jpeg_info(header(ids=ids, adobe=adobe))["rgb"] is rgb


def test_sampling_predictor_depth():
    assert c.jpeg_info(header(sampling=((2, 1), (1, 1), (1, 1))))["subsampling"] == {"h": 2, "v": 1}
    assert c.jpeg_info(header(ids=(1,), sampling=((1, 1),)))["subsampling"] is None
    assert c.jpeg_info(header(0xC3, predictor=1))["predictor"] == 1 and c.jpeg_info(header(0xC0, predictor=1))["predictor"] is None
    assert c.jpeg_info(header(0xC1, precision=12))["bit_depth"] == 12
    assert c.mcu_size(header(sampling=((2, 2), (1, 1), (1, 1)))) == (16, 16)


@pytest.mark.parametrize("data", [None, b"", b"\xff\xd8\xff\xda\x00\x08\x01\x01\x00\x00\x00", b"no jpeg", header()[:12], bytes(100_000)])
def test_no_header(data):
    assert c.jpeg_info(data) is None and c.jpeg2000_info(data) is None


def test_sizes_and_rewrites():
    h = header(size=(70, 33))
    assert c.baseline_size(h) == (70, 33) and c.baseline_size(header(0xC2)) is None and c.baseline_size(b"x") is None
    changed = c.with_header(h, 128, 99, 7)
    assert c.baseline_size(changed) == (128, 99) and b"\xff\xdd\x00\x04\x00\x07" in changed and len(changed) == len(h) + 6
    assert len(c.with_header(changed, restart=9)) == len(changed)
    rgb = c.rgb_header(h)
    assert c.jpeg_info(rgb)["rgb"] and rgb[2:4] == b"\xff\xee"


def test_tables_fragments_scans():
    tables = b"\xff\xd8\xff\xdb\x00\x04\x01\x02\xff\xd9"
    assert c.complete_tile(b"\xff\xd8DATA", c.tables_prefix(tables)) == b"\xff\xd8\xff\xdb\x00\x04\x01\x02DATA"
    assert c.complete_tile(b"", c.tables_prefix(tables)) == b""
    assert c.join_fragments(b"H", [b"a\xff\xd0", b"b\xff\xd0", b"c\xff\xd9"]) == b"Ha\xff\xd0b\xff\xd1c\xff\xd9"
    with pytest.raises(ValueError):
        c.join_fragments(b"H", [b"abc"])
    strips = [header(size=(70, 16)) + bytes([i]) * 3 + b"\xff\xd9" for i in range(3)]
    whole = c.join_scans(strips)
    assert c.baseline_size(whole) == (70, 48) and whole.endswith(b"\x00\x00\x00\xff\xd0\x01\x01\x01\xff\xd1\x02\x02\x02\xff\xd9")
    assert b"\xff\xdd\x00\x04" + struct.pack(">H", 9 * 2) in whole
    with pytest.raises(ValueError):
        c.join_scans([strips[0], header(size=(64, 16))])


def dht(table, counts, symbols):
    return b"\xff\xc4" + struct.pack(">H", 19 + len(symbols)) + bytes([table]) + bytes(counts) + bytes(symbols)


def test_blank_frame_codes_one_luma_dc():
    # DC: 12 sizes of 4 bits; AC: end of block as "0"
    tables = dht(0x00, [0, 0, 0, 12] + [0] * 12, range(12)) + dht(0x10, [1] + [0] * 15, [0])
    quant = b"\xff\xdb\x00\x43\x00" + bytes([4]) + bytes(63)
    h = header(size=(16, 8))
    frame = c.blank_frame(h[:2] + quant + tables + h[2:], 1.0)
    bits = "".join(f"{b:08b}" for b in c.scan_of(frame).replace(b"\xff\x00", b"\xff"))
    value = round((2047 - 1024) / 4)
    size = value.bit_length()
    first = f"{size:04b}{value:0{size}b}0" + "00000" * 2
    assert bits.startswith(first + "00000" * 3) and frame.endswith(b"\xff\xd9")
    assert c.dc_quantiser(frame) == 4 and c.dc_quantiser(frame, 1) is None


def siz(factors, depth=8, sizes=bytes(32), rsiz=0):
    body = struct.pack(">H", rsiz) + sizes + struct.pack(">H", len(factors)) + b"".join(bytes([depth - 1, h, v]) for h, v in factors)
    return b"\xff\x4f\xff\x51" + struct.pack(">H", len(body) + 2) + body


def cod(transformation, mct=0):
    payload = bytes([0, 0, 0, 1, mct, 5, 4, 4, 0, transformation])
    return b"\xff\x52" + struct.pack(">H", len(payload) + 2) + payload


def test_jpeg2000():
    got = c.jpeg2000_info(siz([(1, 1), (2, 1), (2, 1)]) + cod(0))
    assert got == {"reversible": False, "uses_mct": False, "components": 3, "subsampling": {"h": 2, "v": 1}, "bit_depth": 8, "extended": False}
    stray = siz([(1, 1)], 12, b"\xff\x52" * 16, 1) + cod(1, 1)
    assert c.jpeg2000_info(stray) == {"reversible": True, "uses_mct": True, "components": 1, "subsampling": None, "bit_depth": 12, "extended": True}
    assert c.jpeg2000_info(siz([(1, 1)])) is None and c.jpeg2000_info(stray[:30]) is None


def test_udfs_take_nulls(spark):
    c.register(spark)
    df = spark.createDataFrame([(1, bytearray(header())), (2, None), (3, bytearray(b"x"))], "i int, b binary")
    got = {r.i: r.p for r in df.select("i", c.jpeg_info_udf("b").process.alias("p")).collect()}
    assert got == {1: "BASELINE", 2: None, 3: None}
    assert df.selectExpr("jpeg_info(b).width w").where("w = 64").count() == 1
    tiles = df.select(c.complete_tile_udf("b", F.lit(bytearray(b"\xff\xd8T\xff\xd9")), F.lit(False)).alias("t"))
    assert bytes(tiles.collect()[0].t)[:3] == b"\xff\xd8T"
