"""Mixed timestamp notations, precisions and zones, normalised to instants in UTC.

Raw texts are deduplicated with what decides their meaning (source format, zone) into a dictionary of distinct
values. Each distinct value is parsed once, in Arrow batches; the dictionary is a table in the shared folder, and
with a path of the caller's only values that it lacks are parsed and appended. The instants are joined back to the rows.

Defined results (``utc_us`` is null unless the text denotes exactly one instant)
* null, blank, placeholder and unreadable texts, dates without time, impossible dates and times: null;
* an offset, ``Z``, ``UTC`` or ``GMT`` fixes the zone; a letter abbreviation means the row's own zone and tells its two hours apart;
* without zone: wall-clock time at the row's zone; null where that zone is unknown or the time occurs twice or never;
* a number alone counts from 1970 in UTC: 10 digits seconds, 13 milli-, 16 micro-, 19 nanoseconds, 14 digits yyyymmddhhmmss;
* all-numeric slash and dot dates have the order of the row's format; two-digit years are 20yy; digits past µs are cut off;
* repeated rows keep their number; a column ``utc_us`` of the rows is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.common import blank, materialise, shared_dir, table

#: Order of an all-numeric date in the formats that write one (slashes, or dots for argos).
DATE_ORDER = {"svs": "mdy", "mikroscan": "mdy", "argos": "mdy", "3dhistech": "dmy"}
#: Month names by their first letters, in English, German, French and Spanish.
MONTHS = {
    "jan": 1, "jän": 1, "ene": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "avr": 4, "abr": 4,
    "may": 5, "mai": 5, "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "aou": 8, "ago": 8, "sep": 9,
    "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12, "déc": 12, "dic": 12,
}
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
ORDER_MATTERS = r"^\s*\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\D"
RULES = 2  # to be raised with every change of what a text means
SCHEMA = "raw string, date_order string, tz string, utc_us bigint"

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2}):(?P<S>\d{2})(?:[.,](?P<f>\d+))?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?(?:\s*Uhr)?"
_ZONE = r"(?:\s*(?P<z>Z|(?:GMT|UTC)?\s*[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?"
_COMPACT = r"(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?:\.(?P<f>\d+))?"
PATTERNS = [
    re.compile(p)
    for p in (
        rf"(?P<y>\d{{4}})([-:/])(?P<m>\d{{1,2}})\2(?P<d>\d{{1,2}})(?:T|\s+){_TIME}{_ZONE}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T?{_COMPACT}{_ZONE}",
        rf"(?P<n1>\d{{1,2}})([/.])(?P<n2>\d{{1,2}})\2(?P<y>\d{{4}}|\d{{2}})[,T\s]\s*{_TIME}{_ZONE}",
        rf"(?P<d>\d{{1,2}})\.\s*(?P<b>[^\W\d]+)\.?\s+(?P<y>\d{{4}}),?\s+{_TIME}{_ZONE}",
        rf"(?:[A-Za-z]+,\s*)?(?P<d>\d{{1,2}})\s+(?P<b>[^\W\d]+)\.?\s+(?P<y>\d{{4}}|\d{{2}}),?\s+{_TIME}{_ZONE}",
        rf"(?P<b>[^\W\d]+)\.?\s+(?P<d>\d{{1,2}}),\s*(?P<y>\d{{4}}),?\s+{_TIME}{_ZONE}",
        rf"(?:[A-Za-z]+)\s+(?P<b>[A-Za-z]+)\s+(?P<d>\d{{1,2}})\s+{_TIME}{_ZONE}\s+(?P<y>\d{{4}})",
    )
]
EPOCH = re.compile(r"(\d{9,10})(?:\.(\d+))?|(\d{13})(?:\.(\d+))?|(\d{16})|(\d{19})")
_BEGIN = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _month(name: str) -> int | None:
    low = name.lower()
    return MONTHS.get(low[:4]) or MONTHS.get(low[:3])


def _at_zone(wall: datetime, tz: str | None, abbreviation: str | None) -> int | None:
    """Microseconds of a wall-clock time at a zone, if it occurs there exactly once (under that abbreviation, if one is given)."""
    zone = _zone(tz) if tz else None
    if zone is None:
        return None
    first, second = wall.replace(tzinfo=zone, fold=0), wall.replace(tzinfo=zone, fold=1)
    before, after = first.utcoffset(), second.utcoffset()
    if before < after:  # the clock was put forward past it
        return None
    if before > after:
        named = [x for x in (first, second) if abbreviation and x.tzname() == abbreviation.upper()]
        if len(named) != 1:
            return None
        before = named[0].utcoffset()
    return (wall - before - _BEGIN) // _US


def parse_instant(raw: str | None, date_order: str | None, tz: str | None) -> int | None:
    """Microseconds since 1970 in UTC of the one instant that ``raw`` denotes, else None."""
    text = (raw or "").strip(" \t\r\n\x00 ")
    number = EPOCH.fullmatch(text)
    if number:
        s, f, ms, mf, us, ns = number.groups()
        if s:
            return int(s) * 10**6 + int((f or "0").ljust(6, "0")[:6])
        if ms:
            return int(ms) * 10**3 + int((mf or "0").ljust(3, "0")[:3])
        return int(us) if us else int(ns) // 1000
    for pattern in PATTERNS:
        match = pattern.fullmatch(text)
        if match:
            break
    else:
        return None
    g = match.groupdict()
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    if g.get("b"):
        month, day = _month(g["b"]), int(g["d"])
    elif "n1" in g:
        if date_order not in ("mdy", "dmy"):
            return None
        one, two = int(g["n1"]), int(g["n2"])
        month, day = (one, two) if date_order == "mdy" else (two, one)
    else:
        month, day = int(g["m"]), int(g["d"])
    hour = int(g["H"])
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
    try:
        wall = datetime(year, month or 0, day, hour, int(g["M"]), int(g["S"]), int((g["f"] or "0").ljust(6, "0")[:6]))
    except ValueError:
        return None
    zone = (g.get("z") or "").strip()
    offset = re.fullmatch(r"(?:GMT|UTC)?\s*([+-])(\d{2}):?(\d{2})?", zone, re.I)
    if offset:
        sign, hours, minutes = offset.groups()
        if int(hours) > 18 or int(minutes or 0) > 59:
            return None
        shift = timedelta(hours=int(hours), minutes=int(minutes or 0)) * (1 if sign == "+" else -1)
        return (wall - shift - _BEGIN) // _US
    if zone.upper() in ("Z", "UTC", "GMT"):
        return (wall - _BEGIN) // _US
    return _at_zone(wall, tz, zone or None)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, order, tz = (b.column(i).to_pylist() for i in range(3))
        found = pa.array([parse_instant(*x) for x in zip(raw, order, tz)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), found], ["raw", "date_order", "tz", "utc_us"])


def date_order_of(fmt: Column, raw: Column) -> Column:
    """The order of an all-numeric date, empty where the text doesn't depend on it (so that formats share dictionary entries)."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in DATE_ORDER.items() for x in kv]), F.coalesce(fmt, F.lit("")))
    return F.when(raw.rlike(ORDER_MATTERS), F.coalesce(order, F.lit(""))).otherwise(F.lit(""))


def extend_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """The dictionary at ``path`` after parsing every distinct ``raw, date_order, tz`` of ``keys`` that it lacks.

    Runs at once may append a value twice; the dictionary is read with one row per value.
    """
    spark = keys.sparkSession
    fresh = keys.select("raw", "date_order", "tz").distinct()
    known = spark._jvm.org.apache.hadoop.fs.Path(path)
    if known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known):
        fresh = fresh.join(spark.read.schema(SCHEMA).parquet(path).select("raw", "date_order", "tz"), ["raw", "date_order", "tz"], "left_anti")
    fresh.mapInArrow(_parse_batches, SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path).groupBy("raw", "date_order", "tz").agg(F.max("utc_us").alias("utc_us"))


def normalise_instants(rows: DataFrame, raw: str, fmt: str, tz: str, dictionary: str | None = None) -> DataFrame:
    """``rows`` with ``utc_us``; ``raw``, ``fmt`` and ``tz`` name the columns of text, source format and IANA zone.

    The dictionary is kept at ``dictionary``, else in the shared folder under the number of the parsing rules, so that every value
    is parsed once for all runs. The dictionary may be as long as the rows, so it is not repeated for salts: a text that a third
    of the rows hold is one entry, and adaptive execution splits the rows that meet it.
    """
    text, zone = F.col(f"`{raw}`"), F.coalesce(F.col(f"`{tz}`"), F.lit(""))
    rows = rows.drop("utc_us")
    # written once: the keys and the rows come from the same joins
    keyed = materialise(rows.withColumns({"__raw": text, "__order": date_order_of(F.col(f"`{fmt}`"), text), "__tz": zone}), "keyed")
    keys = keyed.where(~blank(F.col("__raw"))).select(F.col("__raw").alias("raw"), F.col("__order").alias("date_order"), F.col("__tz").alias("tz"))
    parsed = extend_dictionary(keys, dictionary or f"{shared_dir(rows.sparkSession)}/instants-rules-{RULES}")
    entries = parsed.where("utc_us is not null").withColumnsRenamed({"raw": "__raw", "date_order": "__order", "tz": "__tz"})
    return keyed.join(entries, ["__raw", "__order", "__tz"], "left").select(*rows.columns, "utc_us")


def site_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, tz``: one row per slide."""
    slides = table(spark, sf_dir, "slides").groupBy("slide_id").agg(F.min("site_id").alias("site_id"))
    sites = table(spark, sf_dir, "sites").groupBy("site_id").agg(F.min("tz").alias("tz"))
    return slides.join(sites, "site_id", "left").select("slide_id", "tz")


def instants_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every acquisition time that denotes exactly one and is not in the common notation yet."""
    text = F.col("acquisition_datetime")
    rows = table(spark, sf_dir, "slide_metadata").select("meta_id", "slide_id", "format", "acquisition_datetime")
    rows = rows.where(~blank(text) & ~text.rlike(CANONICAL)).join(site_zone(spark, sf_dir), "slide_id", "left")
    return normalise_instants(rows, "acquisition_datetime", "format", "tz").where("utc_us is not null").select("meta_id", "utc_us")
