from datetime import datetime, timezone

import pytest

from slidelake.operators.instants import extend_dictionary, normalise_instants, parse_instant

us = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)
BERLIN, CHICAGO = "Europe/Berlin", "America/Chicago"
CASES = [
    ("2015-01-30T16:17:23.002878000 +01:00", "", None, us(2015, 1, 30, 15, 17, 23) + 2878),
    ("19. Januar 2015, 22:37:01 Uhr", "", BERLIN, us(2015, 1, 19, 21, 37, 1)),
    ("2015:01:09 06:13:01", "", BERLIN, us(2015, 1, 9, 5, 13, 1)),
    ("20150130014236.953", "", BERLIN, us(2015, 1, 30, 0, 42, 36) + 953000),
    ("1421135004691", "", None, 1421135004691000),
    ("1425996695.839", "", None, 1425996695839000),
    ("01/02/2020 10:00:00", "mdy", "UTC", us(2020, 1, 2, 10)),
    ("01/02/20 10:00:00", "dmy", "UTC", us(2020, 2, 1, 10)),
    ("01/02/2020 10:00:00", "", "UTC", None),
    ("12/31/2023 18:10:57 GMT+1100", "mdy", None, us(2023, 12, 31, 7, 10, 57)),
    ("Fri, 01 Jan 2021 14:40:48 +1100", "", None, us(2021, 1, 1, 3, 40, 48)),
    ("Fri Apr 1 21:49:16 AEDT 2016", "", "Australia/Sydney", us(2016, 4, 1, 10, 49, 16)),
    ("Apr 11, 2018 12:13:21 a.m.", "", "UTC", us(2018, 4, 11, 0, 13, 21)),
    ("2017-10-29 02:30:00", "", BERLIN, None),  # twice
    ("2017-10-29 02:30:00 CEST", "", BERLIN, us(2017, 10, 29, 0, 30)),
    ("2017-10-29 02:30:00 CET", "", BERLIN, us(2017, 10, 29, 1, 30)),
    ("2017-03-26 02:30:00", "", BERLIN, None),  # never
    ("2015-11-01 01:30:00 CST", "", CHICAGO, us(2015, 11, 1, 7, 30)),
    ("2015-01-29", "", BERLIN, None),
    ("2021-13-45 10:00:00", "", BERLIN, None),
    ("0000:00:00 00:00:00", "", BERLIN, None),
    ("2015-01-01 10:00:00", "", None, None),
    ("2015-01-01 10:00:00 UTC", "", None, us(2015, 1, 1, 10)),
    ("2015-01-30 10:00:00.123456789012345 +00:00", "", None, us(2015, 1, 30, 10) + 123456),
    ("20150130100000.1234567890123456", "", "UTC", us(2015, 1, 30, 10) + 123456),
    ("1421135004691.123456789012", "", None, 1421135004691123),
    ("", "", BERLIN, None),
    (None, "", BERLIN, None),
    ("x" * 100_000, "", BERLIN, None),
]


@pytest.mark.parametrize("raw, order, tz, expected", CASES)
def test_parse(raw, order, tz, expected):
    assert parse_instant(raw, order, tz) == expected


def test_join_back_and_incremental_dictionary(spark, tmp_path):
    rows = [(1, "2015:01:09 06:13:01", "ndpi", BERLIN, "q"), (1, "2015:01:09 06:13:01", "ndpi", BERLIN, "q"), (2, None, None, None, "q"), (3, "  ", "svs", BERLIN, "q"), (4, "01/02/2020 10:00:00", "svs", "UTC", "q")]
    df = spark.createDataFrame(rows, "meta_id bigint, raw string, format string, tz string, date_order string")
    path = f"file://{tmp_path}/dictionary"
    got = sorted((r.meta_id, r.utc_us) for r in normalise_instants(df, "raw", "format", "tz", path).collect() if r.utc_us)
    assert got == [(1, us(2015, 1, 9, 5, 13, 1))] * 2 + [(4, us(2020, 1, 2, 10))]
    assert normalise_instants(df, "raw", "format", "tz", path).columns == [*df.columns, "utc_us"]
    assert spark.read.parquet(path).count() == 2  # nothing parsed again
    more = spark.createDataFrame([("2016:01:09 06:13:01", "", BERLIN)], "raw string, date_order string, tz string")
    assert extend_dictionary(more, path).count() == 3
    spark.read.parquet(path).write.mode("append").parquet(f"{path}")  # two runs at once
    assert normalise_instants(df, "raw", "format", "tz", path).count() == 5
    assert normalise_instants(df.limit(0), "raw", "format", "tz").count() == 0
