"""Records of several sources mixed to target weights.

Weighted fair queueing: the records of a source stand in shuffled order, once per permitted pass; a record's virtual finish
time is the source's tokens up to and with it, divided by the source's weight. In the order of finish times every source has
its share at every moment, so cutting that order at the plan's budget gives the mix.

Running sums are made in two steps, so that no source, whatever its share of the rows, is summed in one task: tokens per
source, pass and slot of the shuffled order first (partial aggregation), then running sums over the slots' totals, then
within each slot. The number of slots follows from the number of records.

Defined results
* records of null or empty text have no tokens and are in no mix; a record may come up to ``max_repeats`` times, numbered by ``pass``;
* without a ``budget`` it is the largest for which every source at hand reaches its share within its repeats; sources without
  tokens are reported with share 0 and the others keep their weights; with a larger budget, sources that run out are reported as such;
* a record that would pass the budget is left out, so a source falls short of its share by less than its largest record;
* null or non-positive shares and repeats count as no target; several rows for one plan and source: shares are added, the largest repeats count;
* order is by hash of ``doc_id``, pass and ``seed``; equal finish times by source and doc_id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidelake.common import materialise, table
from slidelake.llm.bpe import count_tokens

SLOT_RECORDS = 20_000  # records of a source in one slot, about


def plan_budgets(targets: DataFrame, totals: DataFrame, budget: int | None = None) -> DataFrame:
    """Per plan and source: weight, repeats, tokens at hand, the plan's budget, and the passes that the budget needs."""
    good = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull() & F.col("plan").isNotNull())
    merged = good.groupBy("plan", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = merged.join(totals, "source", "left").fillna(0, ["available", "records"])
    most = F.floor(F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share"))).over(Window.partitionBy("plan")))
    with_budget = held.withColumn("budget", F.lit(budget).cast("bigint") if budget is not None else most.cast("bigint"))
    needed = F.ceil(F.col("budget") * F.col("target_share") / F.nullif("available", F.lit(0)))
    return with_budget.withColumn("passes", F.when(F.col("available") > 0, F.least(needed, F.col("max_repeats").cast("bigint"))).otherwise(F.lit(0)).cast("int"))


def _slots(records: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(records / SLOT_RECORDS)).cast("bigint")


def queue(sized: DataFrame, budgets: DataFrame, seed: int = 0) -> DataFrame:
    """``plan, source, doc_id, pass, tokens, finish_time`` of every record in each pass that its plan needs, cut at the budget."""
    wanted = budgets.where("passes > 0").select("plan", "source", "target_share", "budget", "records", "available", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
    # the order within a pass is the same for all plans
    passes = wanted.groupBy("source", "records", "available").agg(F.max("pass").alias("most"))
    rows = sized.join(passes, "source").select("source", "doc_id", "tokens", "available", _slots(F.col("records")).alias("slots"), F.explode(F.sequence(F.lit(1), F.col("most"))).alias("pass"))
    place = F.xxhash64(F.lit(seed), "pass", "doc_id")
    rows = rows.withColumns({"place": place, "slot": F.floor((place / F.lit(2.0**64) + 0.5) * F.col("slots")).cast("bigint")})
    sums = rows.groupBy("source", "pass", "slot").agg(F.sum("tokens").alias("slot_tokens"))
    earlier = F.sum("slot_tokens").over(Window.partitionBy("source", "pass").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "pass", "slot", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "pass", "slot").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    run = rows.withColumn("inside", inside).join(offsets, ["source", "pass", "slot"])
    upto = (F.col("pass") - 1) * F.col("available") + F.col("before") + F.col("inside")
    stood = run.select("source", "doc_id", "tokens", "pass", upto.alias("upto"))
    timed = stood.join(wanted.select("plan", "source", "pass", "target_share", "budget"), ["source", "pass"])
    return timed.select("plan", "source", "doc_id", "pass", "tokens", (F.col("upto") / F.col("target_share")).alias("finish_time"), "budget").where("finish_time <= budget").drop("budget")


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixes of all plans in queueing order, and per plan and source the share reached. ``sized``: ``doc_id, source, tokens``."""
    totals = sized.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("records"))
    budgets = plan_budgets(targets, totals, budget)
    queued = queue(sized.where("tokens > 0"), budgets, seed)
    used = queued.groupBy("plan", "source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("used_records"), F.max("pass").alias("used_passes"))
    report = budgets.join(used, ["plan", "source"], "left").fillna(0, ["used_tokens", "used_records", "used_passes"])
    share = F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(Window.partitionBy("plan")), F.lit(0))
    report = report.select(
        "plan", "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), "budget", "used_tokens", "used_records",
        F.col("used_passes").cast("int").alias("used_passes"), F.coalesce(share, F.lit(0.0)).alias("actual_share"),
        ((F.col("available") > 0) & (F.col("available") * F.col("max_repeats") >= F.floor(F.col("budget") * F.col("target_share")))).alias("met"),
    )
    return queued.orderBy("plan", "finish_time", "source", "doc_id"), report


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted once."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return materialise(count_tokens(documents, "text").select("doc_id", "source", "tokens"), "sizes")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of every plan in order."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def mix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source in every plan."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]
