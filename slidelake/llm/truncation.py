"""Texts cut off by a field limit or a broken transfer, and how often each source cuts.

Word trigrams are counted inside the texts and at their ends. The last trigram of a text, joined to those counts, tells a
text that stops where texts go on: frequent inside, almost never last. A last word that is a fragment counts as the words
it begins. The share of its occurrences that end a text is estimated with a prior: ``PRIOR`` occurrences at the share of its
last two words, theirs at that of the last word, that one's at that of the kind of the last character. So a trigram decides
as far as it has evidence, whatever the size of the corpus. Lines that almost only ever stand last (headings, votes,
signatures) close a record and are left out. Lengths at which a source has far more texts than around them, most of them
unfinished, are field limits; texts of such a length are cut.

All of it is SQL. Copies of a text count as one: each weighs one over their number, so that texts are counted from a scan and
never sorted or grouped themselves; what is shuffled are digests, hashes of n-grams and line beginnings, and single words.
Last trigrams are aggregated before they meet the counts, and joins back to the texts are salted. No limit, sample or prefix
of a text is taken; words of any length count whole.

Defined results
* null, empty and blank texts are never cut; copies of a cut text are cut; white space at the end doesn't count;
* a dash at the end is a speech broken off in the chamber and complete, unless the length is a field limit;
* a text without blanks is one word, judged by its last character; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.common import let, materialise, salted_join, table

PRIOR = 100.0  # occurrences that the share of a shorter n-gram stands for
SURE = 1.5  # standard errors by which the share must lie below ``RARELY``
RARELY = 0.012  # least share of its occurrences that an n-gram ends texts with, if texts may end there
CLOSING, CLOSING_LINES = 0.9, 4  # share of last lines among the lines that begin alike, and least number, for closing lines
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_AROUND, LIMIT_UNFINISHED = 4, 8.0, 50, 0.5
BLOCK = 32  # characters by which the beginnings of longer words are found
LEVELS = ["trigram", "bigram", "word"]
BLANKS = " \t\r\n\x0b\f"
#: What a cut leaves of an escape sequence, never more than 9 characters.
DEBRIS = r"(?:\\u?[0-9a-fA-F]{0,3}|&#?[A-Za-z0-9]{0,7}|=[0-9A-F]?)$"
DEBRIS_MOST, DEBRIS_BEGINS = 9, "\\&="
#: The marks that a field's software puts at a cut, and the sign for an unreadable character.
MARKS = ["...", "…"]
UNREADABLE = "\ufffd"


def _bare(text: Column) -> Column:
    """``text`` without white space at its end; looks at the last character first, as most texts need nothing."""
    return F.when(F.substring(text, -1, 1).isin(*BLANKS), F.rtrim(text, F.lit(BLANKS))).otherwise(text)


def _less(text: Column, n: int) -> Column:
    """``text`` without its last ``n`` characters."""
    return text.substr(F.lit(1), F.length(text) - n)


def with_core(texts: DataFrame) -> DataFrame:
    """``marked`` (whether a text ends in the mark of a cut, in brackets or not) and ``core``, the text without what a cut left at its end."""
    col = F.col
    t = texts.withColumn("_b", _bare(col("text")))
    t = t.withColumn("_c", F.when(col("_b").endswith("]"), _bare(_less(col("_b"), 1))).otherwise(col("_b")))
    t = t.withColumn("marked", reduce(lambda x, y: x | y, [col("_c").endswith(m) for m in MARKS]))
    # nothing below is computed for a text without mark and debris
    unmarked = reduce(lambda c, m: F.when(col("_c").endswith(m), _bare(_less(col("_c"), len(m)))).otherwise(c), MARKS, col("_c"))
    t = t.withColumn("_r", F.when(col("marked"), unmarked).otherwise(col("_b")))
    t = t.withColumn("_o", F.when(col("marked") & col("_r").endswith("["), _bare(_less(col("_r"), 1))).otherwise(col("_r")))
    t = t.withColumn("_u", F.when(col("_o").endswith(UNREADABLE), F.rtrim("_o", F.lit(UNREADABLE))).otherwise(col("_o")))
    short = F.length("_u") <= DEBRIS_MOST
    clean = F.concat(F.when(short, "").otherwise(_less(col("_u"), DEBRIS_MOST)), F.regexp_replace(F.right("_u", F.lit(DEBRIS_MOST)), DEBRIS, ""))
    escaped = reduce(lambda x, y: x | y, [F.contains("_u", F.lit(c)) for c in DEBRIS_BEGINS])
    return t.withColumn("core", F.when(escaped, _bare(clean)).otherwise(col("_u"))).drop("_c", "_r", "_o", "_u").withColumnRenamed("_b", "bare")


def _plain(words: Column) -> Column:
    """Lower-case, digits as 0."""
    return F.regexp_replace(F.lower(words), r"\d+", "0")


def _beginning(line: Column) -> Column:
    """The first two words of a line."""
    return F.regexp_extract(line, r"^\s*(\S+(?:\s+\S+)?)", 1)


def _line_keys(line: Column) -> Column:
    """Hashes of what a line begins with: its first character if that is no letter or digit, else two words; and of their shapes."""

    def keys(t: Column) -> Column:
        exact = F.when(t.rlike(r"^[^\p{L}\d]"), F.substring(t, 1, 1)).otherwise(_plain(t))
        shape = F.regexp_replace(F.regexp_replace(t, r"\p{L}+", "w"), r"\d+", "0")
        return F.struct(F.xxhash64(F.lit("exact"), exact).alias("exact"), F.xxhash64(F.lit("shape"), shape).alias("shape"))

    return let(_beginning(line), keys)


def _key3(w1: Column, w2: Column) -> Column:
    return F.xxhash64(F.lit(3), w1, w2)


def _key2(w2: Column) -> Column:
    return F.xxhash64(F.lit(2), w2)


def _key1() -> Column:
    """The one key of words without anything before them."""
    return F.lit(1).cast("bigint")


def _kind(word: Column) -> Column:
    last = F.substring(word, -1, 1)
    return F.when(last.rlike(r"[\p{L}\d]"), F.lit("w")).otherwise(last)


def weighted(documents: DataFrame) -> DataFrame:
    """``doc_id, source, text, digest, weight`` of the texts that aren't blank; the copies of a text weigh 1 together."""
    texts = documents.where(F.col("text").rlike(r"\S")).select("doc_id", "source", "text", F.md5("text").alias("digest"))
    copies = materialise(texts.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    return salted_join(texts, copies, ["digest"], "doc_id").withColumn("weight", 1.0 / F.coalesce("copies", F.lit(1))).drop("copies")


def text_ends(texts: DataFrame) -> DataFrame:
    """``marked``, the last words as ``k3, k2, f``, the keys of all ``lines`` behind the first, ``chars`` and ``bytes`` of every text."""
    lines = F.filter(F.split("bare", r"[\r\n]+"), lambda x: F.btrim(x) != "")
    keys = F.when(F.contains("bare", F.lit("\n")) | F.contains("bare", F.lit("\r")), let(lines, lambda a: F.when(F.size(a) > 1, F.transform(F.slice(a, F.lit(2), F.size(a)), _line_keys))))
    t = with_core(texts).withColumn("w", F.split("core", r"\s+"))
    t = t.withColumns({f"w{i}": F.coalesce(_plain(F.try_element_at("w", F.lit(-i))), F.lit("")) for i in (1, 2, 3)})
    sizes = [F.length("text").alias("chars"), F.octet_length("text").alias("bytes")]
    return t.select("doc_id", "source", "digest", "weight", *sizes, "marked", keys.alias("lines"), _key3(F.col("w3"), F.col("w2")).alias("k3"), _key2(F.col("w2")).alias("k2"), F.col("w1").alias("f"))


def closing_lines(ends: DataFrame) -> DataFrame:
    """``line``: beginnings of lines that are nearly always a text's last line."""
    lines = ends.where("lines is not null").select("weight", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    each = lines.select(F.explode(F.array("line.exact", "line.shape")).alias("line"), "weight", (F.col("i") + 1 == F.col("n")).alias("is_last"))
    counts = each.groupBy("line").agg(F.round(F.sum("weight"), 6).alias("all"), F.round(F.sum(F.when(F.col("is_last"), F.col("weight")).otherwise(0.0)), 6).alias("last"))
    return counts.where((F.col("last") >= CLOSING * F.col("all")) & (F.col("last") >= CLOSING_LINES)).select("line")


def inner_counts(texts: DataFrame) -> DataFrame:
    """``k3, k2, word, n``: trigrams inside the texts, all but the last."""
    t = with_core(texts).select("weight", F.array_remove(F.split(_plain(F.col("core")), r"\s+"), "").alias("w"))
    w, n = F.col("w"), F.size("w") - 1
    before = lambda k: F.slice(F.concat(F.array(*[F.lit("")] * k), w), F.lit(1), n)
    # no filter on what is computed here: it would be computed once more for the filter, at every step again
    inside = F.when(n > 0, F.arrays_zip(before(2).alias("w1"), before(1).alias("w2"), F.slice(w, F.lit(1), n).alias("word")))
    rows = t.select("weight", F.inline_outer(inside)).where("word is not null")
    rows = rows.select(_key3(F.col("w1"), F.col("w2")).alias("k3"), _key2(F.col("w2")).alias("k2"), "word", "weight")
    return rows.groupBy("k3", "k2", "word").agg(F.sum("weight").alias("n"))


def _beginnings(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, f, inner``: how often words that ``f`` begins, as a word or before a letter, occur inside after a key.

    Beginnings of up to ``BLOCK`` characters are spelt out; longer ones only at lengths that are asked for behind the same first ``BLOCK``.
    """
    size, word = F.length("word"), F.col("word")
    ends_there = lambda i: (i == size) | word.substr(i + 1, F.lit(1)).rlike(r"\p{L}")
    short = F.transform(F.filter(F.sequence(F.lit(1), F.least(size, F.lit(BLOCK))), ends_there), lambda i: word.substr(F.lit(1), i))
    begun = counts.select("key", F.explode(short).alias("f"), "n")
    first = lambda c: F.xxhash64(F.substring(c, 1, BLOCK)).alias("block")
    lengths = asked.where(F.length("f") > BLOCK).select("key", first("f"), F.length("f").alias("size")).distinct()
    long = counts.where(size > BLOCK).withColumn("block", first("word")).join(lengths, ["key", "block"]).where((F.col("size") <= size) & ends_there(F.col("size")))
    both = begun.unionByName(long.select("key", word.substr(F.lit(1), F.col("size")).alias("f"), "n"))
    return both.groupBy("key", "f").agg(F.sum("n").alias("inner"))


def end_rates(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """``k3, k2, f, rate, most, level``: the share of its occurrences with which each last trigram ends a text, the most that it may be, and the longest n-gram whose evidence outweighs its prior.

    ``ends`` are those of texts without a closing line; a text's own end doesn't count as evidence that texts end there.
    """
    last = materialise(ends.groupBy("k3", "k2", "f").agg(F.sum("weight").alias("last")), "last")
    levels = F.array(*[F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate((F.col("k3"), F.col("k2"), _key1()))])
    per_level = last.select("k3", "k2", "f", "last", F.inline(levels))
    asked = per_level.groupBy("key", "f").agg(F.sum("last").alias("last"))
    # contexts that are asked for, by the first character too, so that the one key of all words isn't one task
    wanted = asked.select("key", F.substring("f", 1, 1).alias("c")).distinct()
    words = counts.select(F.explode(F.array("k3", "k2", _key1())).alias("key"), "word", "n").groupBy("key", "word").agg(F.sum("n").alias("n"))
    inner = _beginnings(words.withColumn("c", F.substring("word", 1, 1)).join(wanted, ["key", "c"], "left_semi").select("key", "word", "n"), asked)
    told = asked.join(inner, ["key", "f"], "left").select("key", "f", (F.coalesce("inner", F.lit(0.0)) + F.col("last") - 1).alias("seen"), (F.col("last") - 1).alias("ended"))
    seen = per_level.select("k3", "k2", "f", "level", "key").join(told, ["key", "f"]).groupBy("k3", "k2", "f").agg(*[F.max(F.when(F.col("level") == i, F.struct("seen", "ended"))).alias(f"l{i}") for i in range(3)])
    kinds_in = counts.groupBy(_kind(F.col("word")).alias("kind")).agg(F.sum("n").alias("kind_inner"))
    kinds_last = last.groupBy(_kind(F.col("f")).alias("kind")).agg(F.sum("last").alias("kind_last"))
    kinds = kinds_last.join(kinds_in, "kind", "left").select("kind", (F.col("kind_last") / (F.col("kind_last") + F.coalesce("kind_inner", F.lit(0.0)))).alias("kind_rate"))
    known = seen.withColumn("kind", _kind(F.col("f"))).join(kinds, "kind", "left")
    rate = F.col("kind_rate")
    for i in (2, 1, 0):
        rate = (F.col(f"l{i}.ended") + PRIOR * rate) / (F.col(f"l{i}.seen") + PRIOR)
    level = F.lit("character")
    for i in (2, 1, 0):
        level = F.when(F.col(f"l{i}.seen") >= PRIOR, LEVELS[i]).otherwise(level)
    least = F.col("l0.seen") + PRIOR
    most = let(rate, lambda r: r + SURE * F.sqrt(r * (1 - r) / least))
    return known.select("k3", "k2", "f", rate.alias("rate"), most.alias("most"), level.alias("level"))


def field_limits(sized: DataFrame) -> DataFrame:
    """``source, unit, size`` of field limits: lengths (characters or bytes) with far more texts than those around, most of them unfinished.

    ``sized`` has ``source, unit, size, cut``; it is aggregated to one row per length before any window.
    """
    lengths = sized.groupBy("source", "unit", "size").agg(F.count("*").alias("n"), F.count_if("cut").alias("cuts"))
    near = lengths.select("source", "unit", F.explode(F.sequence(F.col("size") - LIMIT_AROUND, F.col("size") + LIMIT_AROUND)).alias("size"), F.col("n").alias("m"))
    around = near.groupBy("source", "unit", "size").agg(F.sum("m").alias("all"))
    own = lengths.where(F.col("n") >= LIMIT_TEXTS).join(around, ["source", "unit", "size"])
    usual = (F.col("all") - F.col("n")) / (2 * LIMIT_AROUND)
    limits = own.where((F.col("n") >= LIMIT_TIMES * F.greatest(usual, F.lit(0.25))) & (F.col("cuts") >= LIMIT_UNFINISHED * F.col("n")))
    # a source counts in characters or in bytes: the unit that explains more of its texts
    units = limits.groupBy("source", "unit").agg(F.sum("n").alias("explained")).groupBy("source").agg(F.max_by("unit", F.struct("explained", "unit")).alias("unit"))
    return limits.join(units, ["source", "unit"]).select("source", "unit", "size")


def truncated(documents: DataFrame) -> DataFrame:
    """``doc_id, source, cut, told_by`` of every document; ``told_by`` is the n-gram that decided, or ``limit``."""
    texts = weighted(documents)
    ends = materialise(text_ends(texts), "ends")
    closing = materialise(closing_lines(ends), "closing")
    line = F.element_at("lines", -1)
    marked = ends.withColumns({"exact": line.exact, "shape": line.shape}).drop("lines")
    for key in ("exact", "shape"):
        marked = salted_join(marked, closing.select(F.col("line").alias(key), F.lit(True).alias(f"closed_{key}")), [key], "doc_id")
    marked = materialise(marked.select("doc_id", "source", "digest", "weight", "chars", "bytes", "marked", "k3", "k2", "f", F.coalesce("closed_exact", "closed_shape", F.lit(False)).alias("closed")), "closed")
    rates = end_rates(marked.where("not closed and f != ''"), materialise(inner_counts(texts), "trigrams"))
    rare = materialise(rates.where(F.col("most") < RARELY), "rare").select("k3", "k2", "f", "level")
    told = salted_join(marked, rare, ["k3", "k2", "f"], "doc_id").withColumn("unfinished", F.col("level").isNotNull() & ~F.col("closed"))
    told = materialise(told.select("doc_id", "source", "digest", "marked", "closed", "unfinished", "level", "chars", "bytes"), "unfinished")
    sizes = lambda df, *more: df.select("source", *more, F.inline(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")])))
    limits = field_limits(sizes(told.select("source", "digest", "chars", "bytes", F.col("unfinished").alias("cut")).distinct(), "cut"))
    wide = materialise(limits, "limits").withColumn("full", F.lit(True))
    result = told
    for unit in ("chars", "bytes"):
        own = wide.where(F.col("unit") == unit).select("source", F.col("size").alias(unit), F.col("full").alias(f"full_{unit}"))
        result = salted_join(result, own, ["source", unit], "doc_id")
    full = F.coalesce("full_chars", "full_bytes", F.lit(False)) & ~F.col("closed")
    by_end = F.col("unfinished") & ~F.col("marked")
    known = result.select("doc_id", "source", (full | by_end).alias("cut"), F.when(by_end, F.col("level")).when(full, "limit").alias("told_by"))
    blank = documents.where(F.coalesce(~F.col("text").rlike(r"\S"), F.lit(True))).select("doc_id", "source", F.lit(False).alias("cut"), F.lit(None).cast("string").alias("told_by"))
    return known.unionByName(blank)


def truncated_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose text was cut."""
    return truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def truncation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, cut ones, their share, and how many of them each n-gram or a field limit told."""
    cut = truncated(table(spark, sf_dir, "documents"))
    told = [F.count_if(F.col("told_by") == n).alias(f"by_{n}") for n in [*LEVELS, "character", "limit"]]
    return cut.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"), (F.count_if("cut") / F.count("*")).alias("cut_rate"), *told)
