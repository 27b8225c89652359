"""The same quantity recorded in different units: every value in picometres.

A *source* is a field as one scanner format at one site writes it, with a known unit, with an unknown one or bare; what a
source writes may mix several conversions. Records of the same slide link sources: every value with several open conversions
is compared with the centre of the surest other source of its slide. Per pair of sources and conversion the quantiles of the
log ratio give scale and spread, a line through two medians the offset; a tight scale without offset snaps to the known
conversion. What snaps in one round anchors further slides in the next, so that knowledge spreads through the source graph,
round by round until no further conversion of any source snaps.

A record's unit is, in this order: the one written with it; the one plausible conversion; of several plausible ones that
of its note, the commonest one that its source snapped to where a unit is written but unknown, that which agrees with its
slide, the commonest one of its source (of its format at any site, of its field, where the source has none), the first of a fixed order.

Only mergeable sketches (``percentile_approx``) are kept per slide and source, so one slide or source may hold any share
of the rows. Links go from each value to one centre of its slide, never between all pairs of rows; only slides with values that
are open go into the graph. No table is collected or broadcast by hint.

Defined results
* null, blank, placeholder, unreadable, zero and negative numbers, and values past 64 bits of picometres: no row (per axis);
* decimal comma, decimal point, thousands separators (blank, apostrophe, comma, point) and exponents are read; of two
  readings the plausible one counts, the decimal one if both are;
* a written, known unit holds even where the value is implausible; both axes of a record have one unit;
* no unit and no plausible conversion: no row; repeated rows stay; empty tables give an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.common import blank, let, materialise, table

#: Picometres in a unit.
PM = {"nm": 1e3, "µm": 1e6, "mm": 1e9, "cm": 1e10, "in": 2.54e10, "m": 1e12}
#: Spellings of the units of length, as regular expressions on lower-case text.
SPELLED = {
    "nm": r"nm|nanomet(?:er|re)[ns]?",
    "µm": r"[µμu]m|microns?|mikron|mi[ck]romet(?:er|re)[ns]?",
    "mm": r"mm|millimet(?:er|re)[ns]?",
    "cm": r"cm|[cz]entimet(?:er|re)[ns]?",
    "in": r"in|inch(?:es)?|zoll",
    "m": r"m|met(?:er|re)[ns]?",
}
#: Common unit, and the least and greatest plausible picometres of each field.
FIELDS = {"mpp": ("µm", 1e5, 3e6), "pixel_spacing": ("mm", 1e5, 3e6), "view_size": ("nm", 3e9, 7.6e10)}
#: Conversions tried, first choice first: (unit, reciprocal). Reciprocals are pixels per length.
STRAIGHT = [(u, False) for u in ("µm", "mm", "nm", "m", "cm", "in")]
RECIPROCAL = [(u, True) for u in ("cm", "in", "mm", "m")]
MIN_LINKS, SNAP, SPREAD, AGREE = 5, 0.02, 0.05, 0.05  # links a source needs; log10 distance to a conversion, range of nine tenths, distance to a slide
SPLIT, OFFSET = 4e5, 0.05  # picometres that part links into two halves for the offset; greatest offset as a share of the median

_GAP = "[ \u00a0\u2009\u202f']"
_NUMBER = rf"[+-]?\d{{1,3}}(?:{_GAP}\d{{3}})+(?![\d])(?:[.,]\d+)?|[+-]?\d[\d.,]*(?:[eE][+-]?\d+)?"
_AXES = r"\\|;|\s+/\s+|\"\s+\"|,\s+|\s+[x×]\s+"


def number_readings(text: Column) -> Column:
    """``struct<decimal, other>``: the decimal reading of a number text, and the other one if the text has two; only positive numbers."""

    def read(t: Column) -> Column:
        no_dot, no_comma = F.replace(t, F.lit("."), F.lit("")), F.replace(t, F.lit(","), F.lit(""))
        dots, commas = F.length(t) - F.length(no_dot), F.length(t) - F.length(no_comma)
        comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
        decimal = (
            F.when((dots > 0) & (commas > 0), F.when(comma_last, F.replace(no_dot, F.lit(","), F.lit("."))).otherwise(no_comma))
            .when(dots > 1, no_dot)
            .when(commas > 1, no_comma)
            .otherwise(F.replace(t, F.lit(","), F.lit(".")))
        )
        other = F.when((dots + commas == 1) & t.rlike(r"^[1-9]\d{0,2}[.,]\d{3}$"), F.regexp_replace(t, "[.,]", ""))
        positive = lambda c: let(c.try_cast("double"), lambda x: F.when(x > 0, x))
        return F.struct(positive(decimal).alias("decimal"), positive(other).alias("other"))

    return let(F.regexp_replace(text, _GAP, ""), read)


def _length_unit(text: Column, pattern: str) -> Column:
    """The unit of length whose spelling fills ``pattern`` in a lower-case text, else null."""
    none = F.lit(None).cast("string")
    return reduce(lambda c, kv: F.when(text.rlike(pattern.format(kv[1])), F.lit(kv[0])).otherwise(c), SPELLED.items(), none)


def unit_of(text: Column) -> Column:
    """``struct<unit, recip, spelled>`` of a written unit; ``spelled`` is the cleaned text of an unknown one."""
    per = r"^(?:px|pixels?|dots?|1)?\s*(?:/|\b(?:per|pro|je)\b)\s*"
    clean = F.regexp_replace(F.lower(F.translate(text, "()[]", "")), r"^[\s\"]+|[\s\"]+$", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?:\s*/\s*|\s+(?:per|pro|je)\s+)(?:px|pixels?)$", ""), r"\.$", "")
    clean = F.regexp_replace(F.regexp_replace(clean, "^(?:dpi|ppi)$", "/in"), "^(?:dpcm|ppcm)$", "/cm")

    def parts(t: Column) -> Column:
        unit = let(F.regexp_replace(t, per, ""), lambda bare: _length_unit(bare, "^(?:{})$"))
        return let(unit, lambda u: F.struct(u.alias("unit"), F.when(u.isNotNull(), t.rlike(per)).alias("recip"), F.when(u.isNull(), t).alias("spelled")))

    return let(clean, parts)


def hint_of(note: Column) -> Column:
    """``struct<unit, recip>`` that a note states for lengths or resolution; notes with numbers of their own state none."""

    def parts(n: Column) -> Column:
        about = n.rlike(r"resol|auflös|pixel|length|maße|dimension|dicom|spacing|units?\b") & ~n.rlike(r"\d")
        unit = F.when(n.rlike("dpi|ppi"), F.lit("in")).otherwise(_length_unit(n, r"(?<![\p{{L}}])(?!in\b|m\b)(?:{})(?![\p{{L}}])"))
        recip = n.rlike(r"resol|auflös") & n.rlike(r"\bper\b|\bje\b|\bpro\b|dpi|ppi|resolutionunit")
        return F.struct(F.when(about, unit).alias("unit"), F.when(about, recip).alias("recip"))

    return let(F.lower(F.coalesce(note, F.lit(""))), parts)


def _observation(df: DataFrame, field: str, record: str, one: Column, two: Column | None, unit: Column, note: Column, pixels: list | None = None) -> DataFrame:
    """One row per record: numbers of both axes with their readings, unit, hint, source."""
    number = lambda c: F.nullif(F.regexp_extract(c, rf"^[\s\"\[]*({_NUMBER})", 1), F.lit(""))
    rest = lambda c: F.regexp_replace(F.regexp_replace(c, rf"^[\s\"\[]*(?:{_NUMBER})", ""), r"^[\s\"\]]+|[\s\"]+$", "")
    named = lambda c: let(c, lambda x: F.when(~blank(x), x))
    nothing = F.lit(None).cast("double")
    written = F.coalesce(*[named(rest(c)) for c in (two, one) if c is not None], named(unit))
    p1, p2 = pixels or [nothing, nothing]
    read = df.select(
        F.col(f"`{record}`").alias("record_id"), F.col("slide_id"), F.lit(field).alias("field"), p1.alias("p1"), p2.alias("p2"),
        number_readings(number(one)).alias("_1"), number_readings(number(two) if two is not None else F.lit(None).cast("string")).alias("_2"),
        unit_of(written).alias("_u"), hint_of(note).alias("_h"),
    )
    return read.select(
        "record_id", "slide_id", "field", F.col("_1.decimal").alias("n1"), F.col("_1.other").alias("a1"), F.col("_2.decimal").alias("n2"), F.col("_2.other").alias("a2"),
        "p1", "p2", "_u.*", F.col("_h.unit").alias("hint"), F.col("_h.recip").alias("hint_recip"),
    )


def _choices(field: Column) -> Column:
    """The conversions open to a row, those of its own unit or all plausible ones, best reading first."""
    low = F.create_map(*[F.lit(x) for k, v in FIELDS.items() for x in (k, v[1])])
    high = F.create_map(*[F.lit(x) for k, v in FIELDS.items() for x in (k, v[2])])
    low, high = F.element_at(low, field), F.element_at(high, field)

    def choice(unit: str, recip: bool, rank: int) -> Column:
        pm = lambda n: (F.lit(PM[unit]) / F.col(n)) if recip else (F.col(n) * PM[unit])
        fits = lambda c: F.coalesce(c.between(low, high), F.lit(True))
        decimal = fits(pm("n1")) & fits(pm("n2"))
        other = lambda n, a: F.coalesce(pm(a), pm(n))
        grouped = (F.col("a1").isNotNull() | F.col("a2").isNotNull()) & fits(other("n1", "a1")) & fits(other("n2", "a2"))
        use = grouped & ~decimal
        return F.struct(
            F.when(decimal, 0).when(grouped, 1).otherwise(2).alias("reading"), F.lit(rank).alias("rank"), F.lit(unit).alias("unit"), F.lit(recip).alias("recip"),
            F.when(use, other("n1", "a1")).otherwise(pm("n1")).alias("pm1"), F.when(use, other("n2", "a2")).otherwise(pm("n2")).alias("pm2"),
        )

    every = F.array(*[choice(u, r, i) for i, (u, r) in enumerate(STRAIGHT + RECIPROCAL)])
    allowed = F.array_sort(F.filter(every, lambda c: ~c.recip | (field == "mpp")))

    def pick(cs: Column) -> Column:
        # a bare unit of length beside a resolution names its unit of reference: the reciprocal, if only that is plausible
        own = F.filter(cs, lambda c: (c.unit == F.col("unit")) & ((c.recip == F.col("recip")) | ((c.reading < 2) & ~F.col("recip"))))
        least = F.get(cs, F.lit(0)).reading
        return F.when(F.col("unit").isNotNull(), F.slice(own, 1, 1)).otherwise(F.filter(cs, lambda c: (c.reading < 2) & (c.reading == least)))

    return let(allowed, pick)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded pixel size and view size with its open conversions.

    Rows without any stay in: a filter on what is computed here would make Spark compute it once more for the filter.
    """
    meta, leica = table(spark, sf_dir, "slide_metadata"), table(spark, sf_dir, "leica_images")
    digit = lambda *names: F.coalesce(*[F.when(F.col(n).rlike(r"\d"), F.lit(True)) for n in names], F.lit(False))
    none = F.lit(None).cast("string")
    mpp = _observation(meta.where(digit("mpp")), "mpp", "meta_id", F.col("mpp"), None, F.col("mpp_unit"), F.col("scan_note"))
    axes = F.split(F.col("pixel_spacing"), _AXES)
    # row spacing (y) comes first; here the first number is x
    spacing = _observation(meta.where(digit("pixel_spacing")), "pixel_spacing", "meta_id", F.try_element_at(axes, F.lit(2)), F.try_element_at(axes, F.lit(1)), none, F.col("scan_note"))
    macro = F.coalesce(F.col("image_name").rlike("(?i)macro"), F.lit(False))
    pixels = [F.when(~macro & (F.col(c) > 0), F.col(c).cast("double")) for c in ("pixel_size_x", "pixel_size_y")]
    view = _observation(leica.where(digit("view_size_x", "view_size_y")), "view_size", "image_id", F.col("view_size_x"), F.col("view_size_y"), F.col("view_unit"), none, pixels)
    obs = mpp.unionByName(spacing).unionByName(view).withColumn("open", _choices(F.col("field")))
    return obs.withColumn("how", F.when(F.col("unit").isNotNull(), "named").otherwise(F.coalesce(F.concat(F.lit("?"), F.nullif("spelled", F.lit(""))), F.lit("bare"))))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, format, site``: where a slide was scanned, one row per slide."""
    slides = table(spark, sf_dir, "slides")
    return slides.groupBy("slide_id").agg(F.min("format").alias("format"), F.min("site_id").cast("string").alias("site"))


def _pixel(pm: Column, pixels: Column) -> Column:
    """Picometres of a pixel: of a pixel size itself, or of a view by its pixels; null for views without."""
    return F.when(F.col("field") == "view_size", pm / pixels).otherwise(pm)


def _centres(rows: DataFrame, sureness: Column) -> DataFrame:
    """``slide_id, node, sureness, centre``: the median pixel of each of a slide's ways of writing, of rows with a ``chosen`` conversion."""
    chosen = F.col("chosen")
    pixel = F.coalesce(_pixel(chosen.pm1, F.col("p1")), _pixel(chosen.pm2, F.col("p2")))
    per = rows.where("slide_id is not null").groupBy("slide_id", F.concat_ws("|", "field", "how").alias("node"), sureness.alias("sureness"))
    return per.agg(F.percentile_approx(pixel, 0.5, 100).alias("centre")).where("centre > 0")


def _hubs(centres: DataFrame) -> DataFrame:
    """``slide_id, hubs``: the two surest of a slide's centres (a list of ways of writing, not of rows, is sorted)."""
    return centres.groupBy("slide_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("sureness", "node", "centre"))), 1, 2).alias("hubs"))


def _linked(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Rows with the surest ``hub`` of their slide that isn't their own way of writing, so that no source confirms itself."""
    own = F.concat_ws("|", "field", "how")
    return rows.join(hubs, "slide_id", "left").withColumn("hub", F.get(F.filter("hubs", lambda h: h.node != own), F.lit(0))).drop("hubs")


def _off() -> Column:
    """The open conversion that agrees with the hub best, as ``struct<away, choice>``; null if none does."""

    def away(c: Column) -> Column:
        pixel = F.coalesce(_pixel(c.pm1, F.col("p1")), _pixel(c.pm2, F.col("p2")))
        return F.abs(F.log10(pixel / F.col("hub.centre")))

    return F.array_min(F.filter(F.transform("open", lambda c: F.struct(away(c).alias("away"), c.alias("choice"))), lambda x: x.away < AGREE))


def source_graph(linked: DataFrame) -> DataFrame:
    """Per pair of sources and conversion: links, robust scale, offset and spread, and whether the source snaps to it.

    The scale is the median log ratio of the numbers to what the other source says, its spread the range of the middle nine
    tenths. The offset is where the line through the medians of the links below and above ``SPLIT`` meets zero, as a share of the
    median number; known conversions have none, so a pair with an offset snaps to none.
    """
    number = F.coalesce(F.col("n1"), F.col("n2"))
    pixels = F.when(F.col("field") == "view_size", F.coalesce(F.when(F.col("n1").isNotNull(), F.col("p1")), F.col("p2"))).otherwise(F.lit(1.0))
    links = linked.where("hub is not null").withColumn("best", _off().choice).where(F.col("best").isNotNull() & pixels.isNotNull())
    ratio = F.when(F.col("best.recip"), F.log10("n") + F.log10("c")).otherwise(F.log10("n") - F.log10("c"))
    each = links.select(F.explode("sources").alias("source"), F.col("hub.node").alias("anchor"), "best.unit", "best.recip", (number / pixels).alias("n"), F.col("hub.centre").alias("c"), "best").withColumn("ratio", ratio)
    below, x = F.col("c") < SPLIT, F.when(F.col("recip"), 1 / F.col("c")).otherwise(F.col("c"))
    half = lambda side, v, name: F.percentile_approx(F.when(side, v), 0.5, 1000).alias(name)
    parts = each.groupBy("source", "anchor", "unit", "recip").agg(
        F.count("*").alias("links"), F.percentile_approx("ratio", [0.05, 0.5, 0.95], 1000).alias("q"), F.percentile_approx("n", 0.5, 1000).alias("middle"),
        half(below, F.col("n"), "n_low"), half(~below, F.col("n"), "n_high"), half(below, x, "x_low"), half(~below, x, "x_high"),
    )
    slope = (F.col("n_high") - F.col("n_low")) / F.nullif(F.col("x_high") - F.col("x_low"), F.lit(0.0))
    offset = (F.col("n_low") - slope * F.col("x_low")) / F.col("middle")
    exact = F.element_at(F.create_map(*[F.lit(v) for u, p in PM.items() for v in (u, math.log10(p))]), F.col("unit"))
    known = F.abs(F.col("q")[1] - F.when(F.col("recip"), exact).otherwise(-exact))
    measured = parts.select("source", "anchor", "unit", "recip", "links", F.pow(F.lit(10.0), F.col("q")[1]).alias("scale"), offset.alias("offset"), (F.col("q")[2] - F.col("q")[0]).alias("spread"), known.alias("away"))
    sure = (F.col("links") >= MIN_LINKS) & (F.col("spread") < SPREAD) & (F.col("away") < SNAP) & (F.coalesce(F.abs("offset"), F.lit(0.0)) < OFFSET)
    return measured.withColumn("snaps", sure)


def _modes(graph: DataFrame) -> DataFrame:
    """``source, modes``: the conversions that a source snaps to, the one with most links first."""
    total = graph.where("snaps").groupBy("source", "unit", "recip").agg(F.sum("links").alias("links"))
    return total.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("links")).alias("less"), "unit", "recip"))), lambda m: F.struct(m.unit.alias("unit"), m.recip.alias("recip"))).alias("modes"))


def _with_modes(rows: DataFrame, modes: DataFrame) -> DataFrame:
    """Rows with ``likely``: the open conversions that their source snaps to, commonest first; of the first of ``sources`` that has any."""
    for i in range(3):
        rows = rows.withColumn("_s", F.get("sources", F.lit(i))).join(modes.select(F.col("source").alias("_s"), F.col("modes").alias(f"_m{i}")), "_s", "left").drop("_s")
    fitting = lambda i: F.flatten(F.transform(f"_m{i}", lambda m: F.filter("open", lambda c: (c.unit == m.unit) & (c.recip == m.recip))))
    some = lambda c: let(c, lambda a: F.when(F.size(a) > 0, a))
    return rows.withColumn("likely", F.coalesce(*[some(fitting(i)) for i in range(3)])).drop("_m0", "_m1", "_m2")


def _hinted() -> Column:
    """The open conversion that the note names, if it is open."""
    return F.get(F.filter("open", lambda c: (c.unit == F.col("hint")) & (c.recip == F.col("hint_recip"))), F.lit(0))


def _kept_observations(obs: DataFrame) -> DataFrame:
    return materialise(obs, "units").where((F.size("open") > 0) & F.expr("n1 is not null or n2 is not null"))


def spread_knowledge(obs: DataFrame, where: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open rows, ``slide_id, hubs`` and the source graph, after rounds of snapping sources and anchoring slides until nothing more snaps.

    Every round but the last snaps a conversion of a source that hadn't snapped before, so the rounds end.
    """
    levels = [["field", "how", "format", "site"], ["field", "how", "format"], ["field", "how"]]
    placed = obs.where(F.size("open") > 1).join(where, "slide_id", "left")
    names = [F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in level]) for level in levels]
    rows = materialise(placed.withColumn("sources", F.array(*names)), "open")
    asked = rows.where("slide_id is not null").select("slide_id").distinct()
    only = obs.where(F.size("open") == 1).withColumn("chosen", F.get("open", F.lit(0))).join(asked, "slide_id", "left_semi")
    sure = materialise(_centres(only, F.when(F.col("unit").isNotNull(), 0).otherwise(1)), "sure")
    modes, snapped = None, -1
    while True:
        chosen = _hinted() if modes is None else F.coalesce(_hinted(), F.when(F.size("likely") == 1, F.get("likely", F.lit(0))))
        known = (rows if modes is None else _with_modes(rows, modes)).withColumn("chosen", chosen).where("chosen is not null")
        hubs = materialise(_hubs(sure.unionByName(_centres(known, F.lit(2)))), "hubs")
        graph = materialise(source_graph(_linked(rows, hubs)), "graph")
        modes = materialise(_modes(graph), "modes")
        found = modes.agg(F.sum(F.size("modes"))).collect()[0][0] or 0
        if found <= snapped:
            return rows, hubs, graph
        snapped = found


def common_units(obs: DataFrame, where: DataFrame) -> DataFrame:
    """``record_id, field, unit, recip, pm1, pm2`` of every observation; ``where`` has the ``format`` and ``site`` of each ``slide_id``."""
    obs = _kept_observations(obs)
    rows, hubs, graph = spread_knowledge(obs, where)
    likely = F.get("likely", F.lit(0))
    pick = F.coalesce(_hinted(), F.when(F.col("how").startswith("?"), likely), _off().choice, likely, F.get("open", F.lit(0)))
    told = _with_modes(_linked(rows, hubs), materialise(_modes(graph), "modes")).withColumn("chosen", pick)
    picked = told.select("record_id", "field", "chosen").unionByName(obs.where(F.size("open") == 1).select("record_id", "field", F.get("open", F.lit(0)).alias("chosen")))
    return picked.select("record_id", "field", "chosen.unit", "chosen.recip", "chosen.pm1", "chosen.pm2")


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source graph: every pair of sources and conversion that values with several open ones link, and what the links say."""
    return spread_knowledge(_kept_observations(observations(spark, sf_dir)), places(spark, sf_dir))[2]


def units_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable positive value whose number isn't in the common unit of its field, in picometres."""
    values = common_units(observations(spark, sf_dir), places(spark, sf_dir))
    common = F.element_at(F.create_map(*[F.lit(x) for k, v in FIELDS.items() for x in (k, v[0])]), F.col("field"))
    other = values.where((F.col("unit") != common) | F.col("recip"))
    first = F.when(F.col("field") == "mpp", "xy").otherwise("x")
    axes = F.array(F.struct(first.alias("axis"), F.col("pm1").alias("pm")), F.struct(F.lit("y").alias("axis"), F.col("pm2").alias("pm")))
    return other.select("record_id", "field", F.inline(axes)).select("record_id", "field", "axis", F.round("pm").try_cast("bigint").alias("value_pm")).where("value_pm is not null")
