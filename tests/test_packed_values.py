from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slidelake.operators.packed_values import explode_packed, split_packed

CASES = {
    '"Viewer ""Lite"" 15.1 (build 324, rev A)" ; v8.20 ; TileWriter 5.7': ['Viewer "Lite" 15.1 (build 324, rev A)', "v8.20", "TileWriter 5.7"],
    "'a 9' 'b, c'  'd'": ["a 9", "b, c", "d"],
    '["P 1", "C, 2", "V \\"L\\" 3"]': ["P 1", "C, 2", 'V "L" 3'],
    "a;;b; ": ["a", "b"],
    "/ x / y /": ["x", "y"],
    "FW 2012/02/06 / 3.1": ["FW 2012/02/06", "3.1"],
    "v5.15 9.2.4 0.10.19": ["v5.15", "9.2.4", "0.10.19"],
    "1.2.3.4.5.6.7.8.9 2.0": ["1.2.3.4.5.6.7.8.9", "2.0"],
    "1.20240131123456789-rc1 12345678901234.5": ["1.20240131123456789-rc1", "12345678901234.5"],
    "Barcode Reader 4.1": ["Barcode Reader 4.1"],
    '14.9\\"5.6"\\v': ["14.9", "5.6", "v"],
    '5" screen; x': ['5" screen', "x"],
    "O'Neil; b": ["O'Neil", "b"],
    "a\r\n\r\nb\tc": ["a", "b", "c"],
    "a, b) c; (d, e": ["a", "b) c", "(d", "e"],
    '"a" ;  ; "a"': ["a", "a"],
    "": [],
    " ; , ": [],
}


def split(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", split_packed(F.col("v")).alias("x")).orderBy("i").collect()]


def test_cases(spark):
    assert split(spark, list(CASES)) == list(CASES.values())


def test_null_long_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "a;b", "x"), (2, "a;b", "x"), (3, ";".join(["v"] * 50_000), "x"), (4, "one", "x")]
    df = spark.createDataFrame(rows, "meta_id bigint, v string, pos string")
    out = explode_packed(df, "meta_id", "v", "f", 2)
    assert out.columns == ["record_id", "field", "pos", "item"]
    assert sorted(tuple(r) for r in out.where("record_id = 2").collect()) == [(2, "f", 1, "a"), (2, "f", 1, "a"), (2, "f", 2, "b"), (2, "f", 2, "b")]
    assert out.where("record_id = 3").count() == 50_000 and out.where("record_id in (1, 4)").count() == 0
    assert explode_packed(df.limit(0), "meta_id", "v", "f").count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.text("abc ,;|/()", min_size=1, max_size=8).map(lambda s: s.strip()).filter(bool), min_size=2, max_size=5), min_size=1, max_size=8))
def test_quoted_round_trip(spark, values):
    packed = ["; ".join('"' + i.replace('"', '""') + '"' for i in items) for items in values]
    assert split(spark, packed) == values
