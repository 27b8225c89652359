"""Several values packed in one field: one row per value, with its position.

A value is split on its quote character: odd pieces are literals, even pieces are split on delimiters.
An array fold puts the pieces together again, and ``posexplode`` gives the ordinals. Everything is built-in
SQL on one row at a time: no shuffle, no Python, no state, so a hot value or a hot source cannot skew it.

Defined results
* null, blank and empty values, and values of delimiters alone, hold no items;
* delimiters are ``;  ,  |  \\``, tab, line break, two or more blanks, and ``/`` between blanks (or at an end);
* one blank parts two bare version numbers, and blanks part two quoted items; other single blanks belong to the item;
* a doubled quote inside quotes, or one behind a backslash in a list, is one quote character;
* a list written in square brackets is its content; apostrophes quote only where they enclose the whole value;
* what parts items elsewhere does not part them inside quotes or a closed pair of round brackets;
* an odd last quote character (a value cut off, an inch mark) is ordinary text;
* empty pieces are no items and take no position; repeated items and repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.common import let, table

SEP = "\x1f"
MASKED = "\x1e"
VERSION = r"v?\d+(?:\.[A-Za-z0-9-]+)+"
#: What parts items outside quotes and brackets: a slash only between blanks, one blank only between two bare versions.
DELIMITER = r"[;,|\\\t\r\n]|[  ]{2,}|(?<![^  ])/(?![^  ])"
BETWEEN_VERSIONS = rf"(?<![^\s;,|\\])({VERSION})[  ](?={VERSION}(?:$|[\s;,|\\]))"
#: Closed brackets, or what lies between them.
SECTION = r"(\([^()]*\)|[^(]+|\()"
BLANKS = " \t\r\n\x0b\f\x00 "


def _normal_quotes(value: Column) -> Column:
    """The value with quoting in one style: list brackets off, escaped and odd quote characters masked, apostrophes made quotes."""

    def bracketed(v: Column) -> Column:
        inner = F.replace(F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit(MASKED))
        return F.when(v.rlike(r"^\[[\s\S]*\]$"), F.btrim(inner, F.lit(BLANKS))).otherwise(v)

    def apostrophes(v: Column) -> Column:
        apart = F.regexp_replace(F.translate(v, '"', MASKED), r"(?<![^\s;,|\\])'|'(?![^\s;,|\\])", '"')
        return F.when(v.rlike(r"^'[\s\S]*'$"), F.replace(apart, F.lit("''"), F.lit("'"))).otherwise(v)

    def even(v: Column) -> Column:
        odd = (F.length(v) - F.length(F.replace(v, F.lit('"'), F.lit("")))) % 2 == 1
        return F.when(odd, F.regexp_replace(v, r'"(?=[^"]*$)', MASKED)).otherwise(v)

    return let(let(let(F.btrim(F.translate(value, SEP + MASKED, "  "), F.lit(BLANKS)), bracketed), apostrophes), even)


def _outside(piece: Column) -> Column:
    """An even piece: its delimiters, but for those in closed round brackets, become separators."""
    piece = F.regexp_replace(piece, BETWEEN_VERSIONS, "$1" + SEP)
    sections = F.regexp_extract_all(piece, F.lit(SECTION), F.lit(1))
    return F.array_join(
        F.transform(sections, lambda t: F.when(t.rlike(r"^\([^()]*\)$"), t).otherwise(F.regexp_replace(t, DELIMITER, SEP))), ""
    )


def split_packed(value: Column) -> Column:
    """``array<string>``: the items of a packed text in order, without blanks and quotes; empty for null and blank."""

    def fold(pieces: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            inner = (i > 0) & (i < F.size(pieces) - 1)
            blank_between = F.when(p == "", F.lit('"')).when(p.rlike(r"^\s+$"), F.lit(SEP))
            return F.when(i % 2 == 1, p).when(inner & p.rlike(r"^\s*$"), blank_between).otherwise(_outside(p))

        return F.array_join(F.transform(pieces, part), "")

    joined = let(F.split(_normal_quotes(value), '"'), fold)
    items = F.transform(F.split(joined, SEP), lambda x: F.btrim(F.translate(x, MASKED, '"'), F.lit(BLANKS)))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def explode_packed(df: DataFrame, record_id: str, value: str, field: str, least: int = 1) -> DataFrame:
    """``record_id, field, pos, item`` of every value of column ``value`` that holds at least ``least`` items; ``pos`` from 1."""
    # enough items or none, in one expression: a filter on the array would make Spark split every value once more
    items = F.flatten(F.filter(F.array(split_packed(F.col(f"`{value}`"))), lambda a: F.size(a) >= least))
    return df.select(F.col(f"`{record_id}`").alias("record_id"), F.lit(field).alias("field"), F.posexplode_outer(items).alias("_p", "item")).where(
        "item is not null"
    ).select("record_id", "field", (F.col("_p") + 1).cast("int").alias("pos"), "item")


def packed_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of every software-version list and device model that holds at least two."""
    meta = explode_packed(table(spark, sf_dir, "slide_metadata"), "meta_id", "scanner_software_versions", "scanner_software_versions", 2)
    tags = table(spark, sf_dir, "philips_attributes").where(F.col("attr_name") == "DICOM_SOFTWARE_VERSIONS")
    dicom = explode_packed(tags, "attr_id", "attr_value", "dicom_software_versions", 2)
    leica = explode_packed(table(spark, sf_dir, "leica_images"), "image_id", "device_model", "scanner_model", 2)
    return meta.unionByName(dicom).unionByName(leica)
