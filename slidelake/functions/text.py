"""Scanner text to values: key-value descriptions, XML scalars, dates and zones, barcodes, names (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slidelake.common import let

STRIP = " \t\r\n\x0b\f\x00"
#: Date notations by format, tried in turn.
DATE_PATTERNS = {
    "ndpi": ["yyyy:MM:dd HH:mm:ss"],
    "qptiff": ["yyyy:MM:dd HH:mm:ss"],
    "huron": ["yyyy:MM:dd HH:mm:ss"],
    "philips": ["yyyyMMddHHmmss.SSSSSS"],
    "argos": ["MM.dd.yyyy HH:mm:ss", "MM.dd.yyyy"],
    "3dhistech": ["dd/MM/yyyy HH:mm:ss"],
    "mikroscan": ["MM/dd/yy HH:mm:ss"],
    "svs": ["MM/dd/yyyy HH:mm:ss", "MM/dd/yy HH:mm:ss"],
}


def clean(s: Column) -> Column:
    """Text without white space and NUL at its ends; null if nothing is left."""
    return F.nullif(F.btrim(s, F.lit(STRIP)), F.lit(""))


def last_wins(entries: Column) -> Column:
    """``map`` of an array of ``struct<key, value>`` in which the last of equal keys counts."""

    def unique(e: Column) -> Column:
        later = lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y.key == x.key)
        return F.map_from_entries(F.filter(e, later))

    return let(entries, unique)


def pairs(items: Column, sep: str) -> Column:
    """Array of ``struct<key, value>`` of the items that hold ``sep``, parted at its first occurrence, both stripped."""

    def pair(i: Column) -> Column:
        at = F.instr(i, sep)
        return F.struct(F.btrim(F.substr(i, F.lit(1), at - 1), F.lit(STRIP)).alias("key"), F.btrim(F.substr(i, at + len(sep)), F.lit(STRIP)).alias("value"))

    return F.transform(F.filter(items, lambda i: F.contains(i, F.lit(sep))), pair)


def pipe_properties(description: Column) -> Column:
    """Properties of a description parted by ``|`` after its header; ``key = value``, the last of equal keys counts."""
    items = F.split(description, r"\|")
    return last_wins(pairs(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), " = "))


def pipe_header(description: Column) -> Column:
    """First line of the first item of a description parted by ``|``."""
    return F.get(F.split(F.get(F.split(description, r"\|"), F.lit(0)), r"\R"), F.lit(0))


def semicolon_properties(description: Column) -> Column:
    """Properties parted by ``;``; ``key=value`` at the first ``=``."""
    return last_wins(pairs(F.split(description, ";"), "="))


def line_properties(description: Column) -> Column:
    """Properties one per line; ``key = value``."""
    return last_wins(pairs(F.split(description, r"\R"), " = "))


def line(text: Column, number: int) -> Column:
    """A line of a text, from 1; empty if it has fewer."""
    return F.coalesce(F.try_element_at(F.split(text, r"\R"), F.lit(number)), F.lit(""))


def element_text(xml: Column, name: str) -> Column:
    """Text of the first element of a name; null if blank."""
    return F.nullif(F.trim(F.regexp_extract(xml, rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))


def barcode(value: Column) -> Column:
    """A barcode in base64 as text, or as it is where it isn't base64 of valid UTF-8; null if blank."""
    stripped = clean(value)
    strict = stripped.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    decoded = let(F.when(strict, F.try_to_binary(stripped, F.lit("base64"))).cast("string"), lambda d: F.when(F.is_valid_utf8(d), d))
    return F.coalesce(clean(decoded), stripped)


def decimal(value: Column) -> Column:
    """A number with decimal point or comma; null if it is none."""
    return F.replace(F.btrim(value), F.lit(","), F.lit(".")).try_cast("double")


def mpp_of_header(properties_mpp: Column, header: Column) -> Column:
    """Pixel size of a property, else the one that the header states as scan resolution; null if neither."""
    stated = F.nullif(F.regexp_extract(header, r"Scan resolution\s+([0-9.,]+)", 1), F.lit(""))
    return F.coalesce(decimal(properties_mpp), decimal(stated))


def name_and_version(value: Column) -> Column:
    """``struct<name, version>``: a last word that starts with a digit is a version."""
    v = F.btrim(value)
    version = F.nullif(F.regexp_extract(v, r"^(.+) (\d\S*)$", 2), F.lit(""))
    return F.struct(F.when(version.isNotNull(), F.regexp_extract(v, r"^(.+) (\d\S*)$", 1)).otherwise(v).alias("name"), version.alias("version"))


def magnification(objective: Column) -> Column:
    """``20x`` as 20.0; null if it is no number."""
    return F.rtrim(F.lower(F.btrim(objective)), F.lit("x")).try_cast("double")


#: Fixed value: how headers of Grundium scanners begin.
GRUNDIUM = "Aperio Image, Grundium"


def vendor(header: Column, serial: Column, scanner_type: Column) -> Column:
    """``struct<manufacturer, model>`` of an Aperio-like header; without a serial number only what the file states."""
    grundium = header.startswith(GRUNDIUM)
    rest = F.nullif(F.btrim(header.substr(F.lit(len(GRUNDIUM) + 1), F.length(header))), F.lit(""))
    maker = F.when(grundium, "Grundium").when(serial.isNotNull(), "Leica Biosystems")
    known = F.when(F.contains(header, F.lit("GT450 DX")), "GT450 DX").when(F.contains(header, F.lit("GT450")), "GT450").otherwise("Aperio")
    model = F.coalesce(scanner_type, F.when(grundium, rest).when(serial.isNotNull(), known))
    return F.struct(maker.alias("manufacturer"), model.alias("model"))


def software_list(header: Column) -> Column:
    """Software names of a header: parts between ``;``, the first line of each, stripped, blanks dropped; null for Grundium."""
    items = F.transform(F.filter(F.split(header, ";"), lambda x: F.btrim(x, F.lit(STRIP)) != ""), lambda x: F.btrim(F.get(F.split(x, r"\R"), F.lit(0)), F.lit(STRIP)))
    return F.when(~header.startswith(GRUNDIUM), items)


def quoted_numbers(value: Column, kind: str = "double") -> Column:
    """Numbers of a list in quotes, parted by blanks."""
    parts = F.filter(F.split(F.btrim(F.replace(value, F.lit('"'), F.lit(""))), r"\s+"), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast(kind))


def acquisition_time(raw: Column, fmt: Column) -> Column:
    """The wall-clock time that a format's own notation gives; null if the text isn't in it."""
    text = F.btrim(raw)
    out = F.lit(None).cast("timestamp_ntz")
    for name, patterns in DATE_PATTERNS.items():
        for p in reversed(patterns):
            # digits are checked first: a pattern alone would let shorter or longer fields pass
            shape = "^" + "".join(r"\d" if c in "yMdHmsS" else ("\\" + c if c in "./" else c) for c in p) + "$"
            out = F.when((fmt == name) & text.rlike(shape), F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz")).otherwise(out)
    return out


def zone_minutes(zone: Column) -> Column:
    """Minutes of ``GMT+hh:mm`` or ``GMT+hhmm``; null for anything else."""
    g = lambda i: F.regexp_extract(zone, r"^GMT([+-])(\d{2}):?(\d{2})$", i)
    minutes = g(2).try_cast("int") * 60 + g(3).try_cast("int")
    return F.when(g(1) == "-", -minutes).when(g(1) == "+", minutes)


def sections(comments: Column) -> Column:
    """``map<section, map<key, value>>`` of comments of ``key=value`` records; a record without ``=`` opens a section.

    Records before any section are under the empty name; a ``;`` before a record is dropped.
    """
    lines = F.filter(F.transform(F.split(comments, r"\R"), lambda x: F.btrim(x, F.lit(STRIP))), lambda x: x != "")
    plain = F.transform(lines, lambda x: F.when(x.startswith(";"), x.substr(F.lit(2), F.length(x))).otherwise(x))
    marked = F.transform(plain, lambda x: F.when(F.contains(x, F.lit("=")), F.concat(F.lit("\x1f"), x)).otherwise(F.concat(F.lit("\x1e"), x)))
    parts = F.split(F.array_join(marked, ""), "\x1e")

    def section(p: Column) -> Column:
        rows = F.split(p, "\x1f")
        return F.struct(F.btrim(F.get(rows, F.lit(0)), F.lit(STRIP)).alias("key"), last_wins(pairs(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), "=")).alias("value"))

    found = F.transform(parts, section)
    return last_wins(F.filter(found, lambda e: (e.key != "") | (F.cardinality(e.value) > 0)))


def pixelsize(description: Column) -> Column:
    """``struct<x, y>`` in mm of ``pixelsize=(a,b)`` in micrometres."""
    g = lambda i: F.regexp_extract(description, r'pixelsize=\("?([0-9.]+)"?,\s*"?([0-9.]+)"?\)', i).try_cast("double") / 1000
    return F.struct(g(1).alias("x"), g(2).alias("y"))
