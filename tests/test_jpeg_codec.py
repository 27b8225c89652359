import numpy as np
import pytest

from slidelake.functions import codestream as c
from slidelake.functions import jpeg_codec as j


def picture(h, w, seed=1):
    rnd = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    smooth = np.stack([x * 255 / w, y * 255 / h, (x + y) * 255 / (w + h)], -1)
    return np.clip(smooth + rnd.normal(0, 6, smooth.shape), 0, 255).astype(np.uint8)


def by_java(spark, data):
    """Pixels by the JVM's own decoder."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h = image.getWidth(), image.getHeight()
    flat = np.array([image.getRGB(x, y) for y in range(h) for x in range(w)], np.int64) & 0xFFFFFF
    return np.stack([flat >> 16, flat >> 8 & 255, flat & 255], -1).reshape(h, w, 3)


def test_zigzag_order():
    assert j.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(j.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2)])
def test_equals_another_decoder(spark, sampling):
    image = picture(21, 37)
    data = j.encode(image, 95, sampling)
    assert c.jpeg_info(data)["subsampling"] == {"h": sampling[0], "v": sampling[1]}
    own, other = j.pixels(data).astype(int), by_java(spark, data)
    assert np.abs(own - other).mean() < (1 if sampling == (1, 1) else 4)
    assert np.abs(own - image).mean() < 9


def test_grey_and_round_trip():
    grey = picture(40, 24)[..., 0]
    data = j.encode(grey)
    assert np.abs(j.pixels(data).astype(int) - grey).max() < 25
    again = j.write(j.read(data))
    assert np.array_equal(j.pixels(again), j.pixels(data))


@pytest.mark.parametrize("sampling, unit", [((1, 1), 8), ((2, 2), 16)])
def test_crop_loses_nothing(sampling, unit):
    data = j.encode(picture(64, 96), 90, sampling)
    whole = j.pixels(data)
    for x, y, w, h in [(0, 0, 32, 32), (unit, unit * 2, 32, 16), (64, 32, 32, 32)]:
        assert np.array_equal(j.pixels(j.crop_many(data, [(x, y, w, h)])[0]), whole[y : y + h, x : x + w])
    beyond = j.pixels(j.crop_many(data, [(80, 48, 32, 32)])[0])
    assert np.array_equal(beyond[:16, :16], whole[48:, 80:]) and (beyond[16:] > 250).all()
    with pytest.raises(ValueError):
        j.crop_many(data, [(3, 0, 8, 8)])


def test_joined_strips_decode_to_stacked_pixels():
    image = picture(48, 64)
    strips = [j.encode(image[i : i + 16]) for i in (0, 16, 32)]
    frames = [j.read(s) for s in strips]
    # strips of one image share their tables; made so by writing them from one frame
    whole = j.write(j.Frame(64, 48, [j.Component(k.ident, k.h, k.v, k.table, np.concatenate([f.components[i].blocks for f in frames])) for i, k in enumerate(frames[0].components)], frames[0].quantisers))
    assert np.array_equal(j.pixels(whole), np.concatenate([j.pixels(s) for s in strips]))


def test_blank_restart_intervals_and_joined_strips(spark):
    data = j.encode(picture(32, 32))
    flat = j.blank(data, 0.5)
    assert (j.pixels(flat) == j.pixels(flat)[0, 0, 0]).all() and abs(int(j.pixels(flat)[0, 0, 0]) - 128) <= 1
    with pytest.raises(ValueError):
        c.blank_frame(data, 0.5)  # tables made for this picture have no code for no change
    # tables of the flat frame have all that a flat frame needs, its restart markers included
    value = j.read(flat).components[0].blocks[0, 0, 0]
    again = c.with_header(c.blank_frame(flat, (value * 2 + 1024) / 2047), restart=None)
    assert np.array_equal(j.pixels(again), j.pixels(flat))
    two = c.join_scans([flat, flat])
    assert j.pixels(two).shape == (64, 32, 3) and np.array_equal(j.pixels(two)[32:], j.pixels(flat)) and np.array_equal(by_java(spark, two), by_java(spark, two)[::-1])


def test_cut_off_and_foreign_data():
    data = j.encode(picture(64, 64))
    assert j.pixels(data[: len(data) * 2 // 3]).shape == (64, 64, 3)
    for bad in (b"", b"no", data[:100]):
        with pytest.raises(ValueError):
            j.read(bad)


def test_code_lengths():
    lengths = j.code_lengths({i: 2**i for i in range(40)})
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    assert j.code_lengths({7: 3}) == {7: 1}


def test_repair_and_half():
    flat = [[j.encode(np.full((16, 16, 3), 10 * (2 * r + q), np.uint8)) for q in range(2)] for r in range(2)]
    flat[1][1] = None
    got = j.pixels(j.repaired(flat, 16, 16))
    assert got.shape == (16, 16, 3) and abs(int(got[2, 2, 0])) <= 3 and abs(int(got[13, 13, 0]) - 255) <= 3
    assert np.array_equal(j.half(np.full((8, 8, 3), 77, np.uint8)), np.full((4, 4, 3), 77))


def test_jobs(spark):
    data = j.encode(picture(32, 64))
    rows = [(1, bytearray(data), [(0, 0, 32, 32), (32, 0, 32, 32)]), (2, None, [(0, 0, 8, 8)]), (3, bytearray(b"x"), [(0, 0, 8, 8)]), (4, bytearray(data), None)]
    df = spark.createDataFrame(rows, "id int, frame binary, boxes array<struct<x:int,y:int,w:int,h:int>>")
    got = {r.id: r.crops for r in j.crop_jobs(df, "frame", "boxes").collect()}
    assert [got[i] for i in (2, 3, 4)] == [None] * 3
    assert np.array_equal(j.pixels(bytes(got[1][1])), j.pixels(data)[:, 32:])
