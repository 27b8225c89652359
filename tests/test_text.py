import pytest
from pyspark.sql import functions as F

from slidelake.functions import formats as f
from slidelake.functions import geometry as g
from slidelake.functions import text as x


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).collect()[0].r


@pytest.mark.parametrize("text, expected", [("", {}), (" | ", {}), ("no bars at all", {}), ("top|Lens = 4|gap|Lens = 9|Sum = a = b|Tight=1", {"Lens": "9", "Sum": "a = b"}), (None, None)])
def test_pipe(spark, text, expected):
    assert one(spark, x.pipe_properties, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Rack=7\r\nTray=left=upper\r\nLamp=\r\n", {"": {"Rack": "7", "Tray": "left=upper", "Lamp": ""}}),
        ("Rack=7\r\n;Shutter Log\r;Opened=12\r;Stuck=no\r;Colour=teal", {"": {"Rack": "7"}, "Shutter Log": {"Opened": "12", "Stuck": "no", "Colour": "teal"}}),
        (";Only\n;Rule=p=q*r\n;Only\n;Rule=last\n", {"Only": {"Rule": "last"}}),
        ("", {}),
    ],
)
def test_sections(spark, text, expected):
    assert one(spark, x.sections, text) == expected


@pytest.mark.parametrize("code, expected", [("VHJheSA0Mi9i", "Tray 42/b"), ("w6nDqQ==", "éé"), ("tray no. 42", "tray no. 42"), (" \0", None), (None, None), ("////", "////")])
def test_barcode(spark, code, expected):
    assert one(spark, x.barcode, code) == expected


@pytest.mark.parametrize("zone, expected", [("GMT+09:30", 570), ("GMT-0330", -210), ("GMT+9:30", None), ("GMT+093000", None), ("UTC+09:30", None), (None, None)])
def test_zone(spark, zone, expected):
    assert one(spark, x.zone_minutes, zone) == expected


@pytest.mark.parametrize("value, expected", [("20x", 20.0), ("X40", None), ("5.0", 5.0), (None, None)])
def test_magnification(spark, value, expected):
    assert one(spark, x.magnification, value) == expected


def test_vendor(spark):
    df = spark.createDataFrame([("Aperio Image, Grundium Ocus20", None), ("Aperio Leica GT450 DX", "S1"), ("Aperio GT450", "S1"), ("Aperio v10", "S"), ("Aperio v10", None)], "h string, s string")
    got = [tuple(r.v) for r in df.select(x.vendor(F.col("h"), F.col("s"), F.lit(None).cast("string")).alias("v")).collect()]
    assert got == [("Grundium", "Ocus20"), ("Leica Biosystems", "GT450 DX"), ("Leica Biosystems", "GT450"), ("Leica Biosystems", "Aperio"), (None, None)]


def test_grid_is_empty_for_no_size(spark):
    df = spark.createDataFrame([(0, 5), (2, 1), (-1, 3)], "w int, h int")
    assert [len(r.t) for r in df.select(g.grid(F.col("w"), F.col("h")).alias("t")).collect()] == [0, 2, 0]


def test_arithmetic_like_python(spark):
    pairs = [(a, b) for a in range(-9, 10) for b in (1, 2, 3, 7)]
    df = spark.createDataFrame(pairs, "a int, b int")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", g.trunc_div(a, b).alias("t"), g.modulo(a, b).alias("m"), g.ceil_div(a, b).alias("c"), g.round_half_even(a / b).alias("r")).collect():
        assert (r.t, r.m, r.c, r.r) == (int(r.a / r.b), r.a % r.b, -(-r.a // r.b), round(r.a / r.b))
    assert spark.range(1).select(g.ceil_div(F.lit(4), F.lit(0)).alias("z"), g.trunc_div(F.lit(4), F.lit(0)).alias("t")).collect()[0] == (None, None)


def test_detect_nulls(spark):
    df = spark.createDataFrame([(None, None, None)], "d string, s string, t map<int,string>")
    assert df.select(f.detect(F.col("d"), F.col("s"), F.col("t"), F.lit(False), F.lit(False)).alias("f")).collect()[0].f is None
