import numpy as np

from slidelake.functions import codestream as c
from slidelake.functions import jpeg_codec as j
from slidelake.operators.retile import Layout, serve
from tests.test_jpeg_codec import picture


def test_restart_markers_change_nothing():
    frame = j.read(j.encode(picture(24, 40)))
    data = j.write(frame, 5)
    assert b"\xff\xd1" in data and np.array_equal(j.pixels(data), j.pixels(j.write(frame)))


def test_tiles_of_striped_level(spark):
    # 64 x 32 pixels in stripes of 32 x 8: two across, four down
    data = j.write(j.read(j.encode(picture(32, 64))), 4)
    whole = j.pixels(data)
    scan = next(s for s in c.segments(data) if s.marker == c.SOS)
    stripes, at = [], scan.end
    for i in range(8):
        end = data.index(bytes([0xFF, 0xD0 + i % 8 if i < 7 else 0xD9]), at) + 2
        stripes.append(data[at:end])
        at = end
    level = Layout(64, 32, 32, 8, 2, 4, 16)
    stored = spark.createDataFrame([("p", i, bytearray(s)) for i, s in enumerate(stripes)] + [("q", 0, bytearray(stripes[0]))], "path string, frame_index int, data binary")
    headers = spark.createDataFrame([("p", bytearray(data[: scan.end])), ("q", bytearray(data[: scan.end]))], "path string, header binary")
    places = [(x, y) for y in range(2) for x in range(4)] + [(3, 1), (4, 0), (-1, 0)]
    asked = spark.createDataFrame([("p", n, x, y) for n, (x, y) in enumerate(places)] + [("q", 99, 0, 0)], "path string, request int, x int, y int")
    got = {(r.path, r.request): r for r in serve(asked, stored, headers, level).collect()}
    assert len(got) == len(places) + 1
    for n, (x, y) in enumerate(places[:9]):
        assert np.array_equal(j.pixels(bytes(got["p", n].data)), whole[16 * y : 16 * y + 16, 16 * x : 16 * x + 16])
    assert got["p", 9].data is None and got["p", 10].data is None and got["q", 99].data is None
