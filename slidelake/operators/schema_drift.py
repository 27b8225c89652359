"""Schemas that drift between files: one consistent table, and every change reported.

Ingestion parses each JSON record once and enforces a target schema: a value goes to its field's column if it casts; fields
that the target lacks, and values that don't cast, are kept as JSON in a rescue column. Approved fields are promoted to typed
columns and the rescued values are replayed into them, those of renamed fields under the name they go by now. Nothing is
lost on the way. Which kind a field is approved with, the values tell: the one most of them have.

Changes come from the rescue column: its values are replayed into the approved kinds (a table of names, joined, however many
there are), and per file and field a small profile of what went in and what stayed (type, share of records, range, a bit set
of value shapes) is aggregated map-side; only profiles, never records, are compared between a file and the one before it.
A removed field and an added one of the same type are one renamed property if they never occur in one file anywhere and
their profiles, shares and names agree better than those of any other pair of that step. Only pairs that have a word of
their names or a shape of their values in common are looked at.

Defined results
* null, empty, cut off or otherwise unreadable records, and JSON that is no object, have no fields; their text stays in ``_unreadable``;
* null values count as absent; exact duplicate rows change nothing; files are ordered by number, whenever they were delivered;
* a file without readable records has no fields, so all of its predecessor's are removed; the first file of a feed has no changes;
* strings that hold numbers or truth values cast to them; numbers cast to truth values (0 is false); nothing else casts to another kind;
* ties between equally good renames: the alphabetically first pair; empty tables give empty results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from slidelake.common import let, materialise, table

#: Column type of a promoted field by kind; lists and objects stay JSON text.
TYPES = {"number": "double", "boolean": "boolean", "string": "string", "array": "string", "object": "string"}
MAX_FIELDS = 2000  # names of fields that become columns
ACCEPT = 0.55  # least agreement of a rename
EXPECTED = 4.0  # joint occurrences expected by chance from which their absence speaks for one property


def kind_of(json: Column) -> Column:
    """The JSON kind of a JSON text; it shows in the first character."""
    first = F.substring(json, 1, 1)
    kinds = F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(first.isin("t", "f"), "boolean").when(first == "n", "null")
    return kinds.when(first.isNotNull(), "number")


def ingest(records: DataFrame, text: str, target: dict[str, str] | None = None, names: dict[str, list[str]] | None = None) -> DataFrame:
    """``records`` with a typed column per field of ``target``, ``_rescued`` (map of field to JSON text), ``_readable`` and ``_unreadable``.

    A value goes to its column if it casts; every other field, and every value that doesn't cast, is rescued.
    ``names`` lists other names that a target field goes by; the first name with a value that casts counts, the rest is rescued.
    """
    value = F.try_parse_json(F.col(f"`{text}`"))
    fields = let(value, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v.try_cast("map<string,variant>")))
    rescued = F.transform_values(fields, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    held = records.withColumn("_rescued", rescued).withColumn("_readable", F.col("_rescued").isNotNull())
    held = held.withColumn("_unreadable", F.when(~F.col("_readable"), F.col(f"`{text}`")))
    return promote(held, target, names) if target else held


def _number(json: Column) -> Column:
    first = F.substring(json, 1, 1)
    return F.when(first.isin(*"-0123456789"), json).when(first == '"', json.substr(F.lit(2), F.length(json) - 2)).try_cast("double")


def _truth(json: Column) -> Column:
    inner = F.when(F.substring(json, 1, 1) == '"', json.substr(F.lit(2), F.length(json) - 2)).try_cast("boolean")
    return F.when(json.isin("true", "false"), json == "true").when(inner.isNotNull(), inner).otherwise(_number(json) != 0)


def replayed(json: Column, kind: Column) -> Column:
    """A rescued JSON text as JSON of a kind; null if it doesn't cast (or is null)."""
    same = F.when(kind_of(json) == kind, json)
    finite = let(_number(json), lambda n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), F.regexp_extract(F.to_json(F.struct(n.alias("n"))), ":(.*)}$", 1)))
    return F.when(kind == "number", F.coalesce(same, finite)).when(kind == "boolean", _truth(json).cast("string")).otherwise(same)


def promote(ingested: DataFrame, fields: dict[str, str], names: dict[str, list[str]] | None = None) -> DataFrame:
    """Approve ``fields`` (name to kind): typed columns, into which rescued values under the field's name or any of its ``names`` are replayed.

    The first name with a value that casts wins; its rescued value is taken out, all others stay. Each rescued value is looked at
    once and the columns are parsed from what casts, so the plan doesn't grow with the fields.
    Columns that clash with a field are kept where they are typed already, and only their gaps filled; others are replaced.
    """
    known = {n: (f, i) for f in reversed(fields) for i, n in reversed(list(enumerate(dict.fromkeys([f, *(names or {}).get(f, [])]))))}
    types = dict(ingested.dtypes)
    typed = [f for f, kind in fields.items() if types.get(f) == TYPES[kind]]
    about = F.create_map(*[x for n, (f, i) in known.items() for x in (F.lit(n), F.struct(F.lit(json.dumps(f)).alias("field"), F.lit(i).alias("rank"), F.lit(fields[f]).alias("kind")))])
    filled = F.array_compact(F.array(*[F.when(F.col(f"`{f}`").isNotNull(), F.lit(json.dumps(f))) for f in typed])).cast("array<string>")

    def entry(e: Column) -> Column:
        return let(F.element_at(about, e.key), lambda a: F.struct(a.field.alias("field"), a.rank.alias("rank"), F.when(~F.array_contains("_filled", a.field), replayed(e.value, a.kind)).alias("cast"), e.key.alias("key"), e.value.alias("value")))

    def chosen(es: Column) -> Column:
        first = lambda e: e["cast"].isNotNull() & ~F.exists(es, lambda o: (o.field == e.field) & o["cast"].isNotNull() & (o.rank < e["rank"]))
        return F.transform(es, lambda e: F.struct(F.coalesce(first(e), F.lit(False)).alias("in"), e.field.alias("field"), e["cast"].alias("cast"), e.key.alias("key"), e.value.alias("value")))

    each = ingested.withColumn("_filled", filled).withColumn("_entries", let(F.transform(F.map_entries("_rescued"), entry), chosen))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.filter("_entries", lambda e: e["in"]), lambda e: F.concat(e.field, F.lit(":"), e["cast"])), ","), F.lit("}"))
    schema = StructType([StructField(f, _parse_datatype_string(TYPES[kind])) for f, kind in fields.items()])
    rest = F.map_from_entries(F.transform(F.filter("_entries", lambda e: ~e["in"]), lambda e: F.struct(e.key.alias("key"), e.value.alias("value"))))
    parsed = each.withColumn("_new", F.from_json(text, schema)).withColumn("_rescued", rest)
    columns = {f"_typed_{i}": F.coalesce(F.col(f"`{f}`"), F.col(f"_new.`{f}`")) if f in typed else F.col(f"_new.`{f}`") for i, f in enumerate(fields)}
    return parsed.withColumns(columns).drop("_filled", "_entries", "_new", *fields).withColumnsRenamed({f"_typed_{i}": f for i, f in enumerate(fields)})


def _shapes(json: Column) -> Column:
    """A bit set of the shapes of the words and numbers in a JSON text."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(63)).cast("int"))
    digits = lambda n: F.concat(F.lit("#"), F.length(F.substring_index(n, ".", 1)), F.lit("."), F.when(F.contains(n, F.lit(".")), F.length(F.substring_index(n, ".", -1))).otherwise(0))
    words = F.transform(F.regexp_extract_all(json, F.lit(r"([A-Za-z_][A-Za-z0-9_+-]*)"), F.lit(1)), lambda w: F.regexp_replace(w, r"\d", "9"))
    numbers = F.transform(F.regexp_extract_all(json, F.lit(r"(?<![A-Za-z0-9_.-])(-?\d+(?:\.\d+)?)"), F.lit(1)), digits)
    each = F.aggregate(F.concat(words, numbers), F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseOR(bit(w)))
    # a lone number or truth value has one shape: no search for words
    plain = F.substring(json, 1, 1).isin(*"-0123456789") & ~F.contains(json, F.lit("E"))
    return F.when(plain, bit(digits(json))).when(json.isin("true", "false"), bit(json)).otherwise(each)


def rescued_values(ingested: DataFrame) -> DataFrame:
    """``feed_id, file_seq, field, value, kind`` of every rescued value that isn't null."""
    rows = ingested.select("feed_id", "file_seq", F.explode("_rescued").alias("field", "value"))
    return rows.where("value != 'null'").withColumn("kind", kind_of(F.col("value")))


def approved_kinds(values: DataFrame) -> DataFrame:
    """``field, approved, records``: the kind that most of a field's values have, the alphabetically last of equally frequent ones."""
    per_kind = values.groupBy("field", "kind").agg(F.count("*").alias("n"))
    return per_kind.groupBy("field").agg(F.max_by("kind", F.struct("n", "kind")).alias("approved"), F.sum("n").alias("records"))


def file_profiles(ingested: DataFrame) -> DataFrame:
    """Per feed, file and field of ``_rescued``: kind, records, share, range and shapes, and how many values stay rescued when replayed into the approved kind."""
    values = rescued_values(ingested)
    approved = materialise(approved_kinds(values), "approved")
    # the table of names joins the values; a promoted field takes what casts to its kind
    rows = values.join(approved.select("field", "approved"), "field")
    value, kind = F.col("value"), F.col("approved")
    number = F.when(F.col("kind") == "number", value.try_cast("double"))
    yes = F.when(value == "true", 1.0).when(value == "false", 0.0)
    fits = F.when(kind == F.col("kind"), True).when(kind == "number", _number(value).isNotNull()).when(kind == "boolean", _truth(value).isNotNull()).otherwise(False)
    per_kind = rows.groupBy("feed_id", "file_seq", "field", "kind").agg(
        F.count("*").alias("records"), F.count_if(~fits).alias("kept"), F.avg(F.coalesce(yes, number)).alias("mean"), F.min(number).alias("low"), F.max(number).alias("high"), F.bit_or(_shapes(value)).alias("shapes")
    )
    top = F.max_by(F.struct("kind", "records", "mean", "low", "high", "shapes"), F.struct("records", "kind"))
    merged = per_kind.groupBy("feed_id", "file_seq", "field").agg(top.alias("p"), F.sum("records").alias("n"), F.sum("kept").alias("kept"))
    sizes = ingested.groupBy("feed_id", "file_seq").agg(F.count_if("_readable").alias("readable"))
    return merged.join(sizes, ["feed_id", "file_seq"]).select(
        "feed_id", "file_seq", "field", "p.kind", F.col("n").alias("records"), "kept", (F.col("n") / F.col("readable")).alias("share"), "p.mean", "p.low", "p.high", "p.shapes"
    )


def _name_words(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != ""))


def _agreement(r: str, a: str) -> Column:
    """0 to 1: how well the profiles, shares and names of a removed and an added field agree."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both, either = c(r, "shapes").bitwiseAND(c(a, "shapes")), c(r, "shapes").bitwiseOR(c(a, "shapes"))
    shapes = F.when(F.bit_count(either) == 0, 1.0).otherwise(F.bit_count(both) / F.bit_count(either))
    width = F.greatest(c(r, "high"), c(a, "high")) - F.least(c(r, "low"), c(a, "low"))
    overlap = F.greatest(F.lit(0.0), F.least(c(r, "high"), c(a, "high")) - F.greatest(c(r, "low"), c(a, "low")))
    ranges = F.when(c(r, "kind") != "number", shapes).when(width == 0, 1.0).otherwise(overlap / width)
    rates = F.when(c(r, "kind") == "boolean", 1 - F.least(F.lit(1.0), 2 * F.abs(c(r, "mean") - c(a, "mean")))).otherwise((shapes + ranges) / 2)
    spread = F.sqrt(c(r, "share") * (1 - c(r, "share")) / c(r, "records") + c(a, "share") * (1 - c(a, "share")) / c(a, "records")) + 0.03
    share = F.exp(-F.pow((c(r, "share") - c(a, "share")) / (2 * spread), 2) / 2)
    rw, aw = _name_words(c(r, "field")), _name_words(c(a, "field"))
    names = F.coalesce(F.size(F.array_intersect(rw, aw)) / F.nullif(F.least(F.size(rw), F.size(aw)), F.lit(0)), F.lit(0.0))
    return 0.5 * rates + 0.3 * share + 0.2 * F.least(F.lit(1.0), names)


def rename_candidates(removed: DataFrame, added: DataFrame, profiles: DataFrame) -> DataFrame:
    """Removed and added fields of one kind and step with their agreement; pairs that occur together in any file are out."""
    bits = F.transform(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.col("shapes").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0), lambda i: i.cast("string"))
    blocks = lambda df, step: df.select("feed_id", F.col(step).alias("step"), "kind", "field", F.explode(F.concat(_name_words(F.col("field")), bits)).alias("block"))
    old, new = blocks(removed, "next_seq"), blocks(added, "file_seq").withColumnRenamed("field", "new_field")
    met = old.join(new, ["feed_id", "step", "kind", "block"]).select("feed_id", "step", "field", "new_field").distinct()
    side = lambda df, step, name, which: df.select("feed_id", F.col(step).alias("step"), F.col("field").alias(name), F.struct(*df.columns).alias(which))
    pairs = met.join(side(removed, "next_seq", "field", "r"), ["feed_id", "step", "field"]).join(side(added, "file_seq", "new_field", "a"), ["feed_id", "step", "new_field"]).select("r", "a")
    scored = pairs.select(
        F.col("a.feed_id").alias("feed_id"), F.col("a.file_seq").alias("file_seq"), F.col("r.field").alias("field"), F.col("a.field").alias("new_field"), _agreement("r", "a").alias("agreement")
    )
    scored = materialise(scored, "pairs")
    # how often two names of the vocabulary share a file, for the pairs at hand only
    names = scored.select("field", "new_field").distinct()
    present = profiles.select("feed_id", "file_seq", F.col("field").alias("f"))
    first = names.join(present, names.field == present.f).drop("f")
    joint = first.join(present.withColumnRenamed("f", "new_field"), ["feed_id", "file_seq", "new_field"]).groupBy("field", "new_field").agg(F.count("*").alias("joint"))
    feeds = profiles.groupBy(F.col("field").alias("f")).agg(F.count_distinct("feed_id").alias("feeds"))
    total = profiles.agg(F.count_distinct("feed_id").alias("all_feeds"))
    steps = scored.groupBy("field", "new_field").agg(F.count("*").alias("seen"))
    known = (
        names.join(joint, ["field", "new_field"], "left")
        .join(steps, ["field", "new_field"])
        .join(feeds.select(F.col("f").alias("field"), F.col("feeds").alias("feeds_r")), "field")
        .join(feeds.select(F.col("f").alias("new_field"), F.col("feeds").alias("feeds_a")), "new_field")
        .join(total, how="cross")  # one row
        .select("field", "new_field", F.coalesce("joint", F.lit(0)).alias("joint"), "seen", (F.col("feeds_r") * F.col("feeds_a") / F.col("all_feeds")).alias("expected"))
    )
    apart = F.when(F.col("expected") >= EXPECTED, F.lit(0.2)).otherwise(0.2 * F.col("expected") / EXPECTED)
    return scored.join(known, ["field", "new_field"]).where("joint = 0").withColumn("score", F.col("agreement") + apart)


def schema_changes(profiles: DataFrame, files: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``feed_id, file_seq, change_kind, field, new_field``: each change between a file of ``files`` and the one before it in its feed."""
    order = Window.partitionBy("feed_id").orderBy("file_seq")
    steps = files.select("feed_id", "file_seq").distinct().withColumns({"next_seq": F.lead("file_seq").over(order), "previous_seq": F.lag("file_seq").over(order)})
    now = profiles.join(steps, ["feed_id", "file_seq"])
    before = now.where("next_seq is not null").select(F.col("feed_id").alias("b_feed"), F.col("next_seq").alias("b_next"), F.col("field").alias("b_field"), F.col("kind").alias("b_kind"))
    after = now.where("previous_seq is not null")
    same = (F.col("feed_id") == F.col("b_feed")) & (F.col("file_seq") == F.col("b_next")) & (F.col("field") == F.col("b_field"))
    met = after.join(before, same, "left")
    retyped = met.where("b_kind is not null and b_kind != kind").select("feed_id", "file_seq", F.lit("retyped").alias("change_kind"), "field", F.lit("").alias("new_field"))
    # what follows names these several times; written once, they keep the plan (and the driver's memory) small
    added = materialise(met.where("b_kind is null").drop("b_feed", "b_next", "b_field", "b_kind"), "added")
    gone = now.where("next_seq is not null").alias("x").join(
        profiles.alias("y"), (F.col("x.feed_id") == F.col("y.feed_id")) & (F.col("x.next_seq") == F.col("y.file_seq")) & (F.col("x.field") == F.col("y.field")), "left_anti"
    )
    gone = materialise(gone, "removed")
    candidates = rename_candidates(gone, added, profiles).where(F.col("score") >= accept)
    best = lambda c: F.row_number().over(Window.partitionBy("feed_id", "file_seq", c).orderBy(F.desc("score"), "field", "new_field"))
    mutual = candidates.withColumns({"_r": best("field"), "_a": best("new_field")}).where("_r = 1 and _a = 1")
    renamed = materialise(mutual.select("feed_id", "file_seq", F.lit("renamed").alias("change_kind"), "field", "new_field"), "renamed")
    old, new = renamed.select("feed_id", "file_seq", "field"), renamed.select("feed_id", "file_seq", F.col("new_field").alias("field"))
    key = ["feed_id", "file_seq", "field"]
    row = lambda df, kind: df.select(*key[:2], F.lit(kind).alias("change_kind"), "field", F.lit("").alias("new_field"))
    removed_only = gone.select("feed_id", F.col("next_seq").alias("file_seq"), "field").join(old, key, "left_anti")
    return renamed.unionByName(retyped).unionByName(row(added.join(new, key, "left_anti"), "added")).unionByName(row(removed_only, "removed"))


def target_schema(profiles: DataFrame, changes: DataFrame, most: int = MAX_FIELDS) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Approved fields with their kinds, and the other names of each: names joined by renames are one field.

    The columns of a table have to be known to the driver: it works on the vocabulary of field names and refuses one of more
    than ``most``. All renames between them are followed.
    A field goes by its most frequent name and kind. Names that differ in case alone are one column.
    """
    per_kind = profiles.groupBy("field", "kind").agg(F.sum("records").alias("n"))
    vocabulary = per_kind.groupBy("field").agg(F.collect_list(F.struct("kind", "n")).alias("kinds")).limit(most + 1).collect()
    if len(vocabulary) > most:
        raise ValueError(f"the records have more than {most} field names")
    counts = sorted((Row(field=v.field, kind=k.kind, n=k.n) for v in vocabulary for k in v.kinds), key=lambda r: (-r.n, r.field, r.kind))
    pairs = changes.where("change_kind = 'renamed'").select("field", "new_field").distinct().collect()
    leader = {r.field: r.field for r in counts}

    def top(n: str) -> str:
        while leader[n] != n:
            n = leader[n]
        return n

    lower: dict[str, str] = {}
    joins = [(r.field, r.new_field) for r in pairs] + [(lower.setdefault(n.lower(), n), n) for n in list(leader)]
    for a, b in joins:
        leader[top(b)] = top(a)
    groups: dict[str, list] = {}
    for r in counts:
        groups.setdefault(top(r.field), []).append(r)
    fields, names = {}, {}
    for rows in groups.values():
        best = max(rows, key=lambda r: (r.n, r.field))
        fields[best.field], names[best.field] = best.kind, sorted({r.field for r in rows} - {best.field})
    return fields, names


def rescue_table(records: DataFrame, text: str) -> DataFrame:
    """``records`` parsed once and written: keys, ``_rescued``, ``_readable``, ``_unreadable``."""
    keys = [c for c in ("record_id", "slide_id", "feed_id", "file_seq") if c in records.columns]
    return materialise(ingest(records.select(*keys, text), text).drop(text), "rescued")


def consistent_table(records: DataFrame, text: str = "properties") -> DataFrame:
    """Every record in one table: its keys, a typed column per field (renames followed), the rest rescued as JSON."""
    rescue = rescue_table(records, text)
    profiles = materialise(file_profiles(rescue), "profiles")
    fields, names = target_schema(profiles, schema_changes(profiles, rescue))
    wide = promote(rescue, fields, names)
    rescued = F.when(F.cardinality("_rescued") > 0, F.to_json("_rescued"))
    columns = [F.col(f"`{f}`") for f in sorted(fields)]
    return wide.select("record_id", "slide_id", "feed_id", "file_seq", *columns, rescued.alias("_rescued"), "_unreadable")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "slide_properties")


def records_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All property records in one consistent table."""
    return consistent_table(_records(spark, sf_dir))


def changes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change between a file of a feed and the one before it."""
    rescue = rescue_table(_records(spark, sf_dir), "properties")
    profiles = materialise(file_profiles(rescue), "profiles")
    return schema_changes(profiles, rescue).select("feed_id", "file_seq", "change_kind", "field", "new_field")
