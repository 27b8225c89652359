import random
from collections import defaultdict

import pytest

from slidelake.llm import mixing as mx

SIZED, TARGETS = "doc_id bigint, source string, tokens int, plan string", "plan string, source string, target_share double, max_repeats int"


def data(spark, n=900, seed=3):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, rnd.choices(["big", "mid", "small"], [7, 2, 1])[0], rnd.randint(0, 60), "x") for i in range(n)], SIZED)


def check(rows, sized, targets, budgets):
    """Brute force: per source and pass every record at most once, running sums give the finish times, all before the budget are there."""
    tokens = {r.doc_id: r.tokens for r in sized}
    by = defaultdict(list)
    for r in rows:
        by[r.plan, r.source].append(r)
    for (plan, source), own in by.items():
        share = targets[plan, source][0]
        own.sort(key=lambda r: r.finish_time)
        upto = 0
        for r in own:
            upto += r.tokens
            assert r.tokens == tokens[r.doc_id] and abs(r.finish_time - upto / share) < 1e-6
        assert len({(r.doc_id, r["pass"]) for r in own}) == len(own) and max(r["pass"] for r in own) <= targets[plan, source][1]
        assert upto / share <= budgets[plan] < (upto + 60) / share + 60 / share


@pytest.mark.parametrize("slot", [20_000, 25])
def test_against_brute_force(spark, monkeypatch, slot):
    monkeypatch.setattr(mx, "SLOT_RECORDS", slot)
    sized = data(spark)
    rows = [("p", "big", 0.5, 1), ("p", "mid", 0.3, 2), ("p", "small", 0.2, 3), ("q", "big", 0.9, 1), ("q", "small", 0.1, 1)]
    queued, report = mx.mix(sized, spark.createDataFrame(rows, TARGETS))
    shares = {(r.plan, r.source): r for r in report.collect()}
    budgets = {k[0]: r.budget for k, r in shares.items()}
    check(queued.collect(), sized.collect(), {(p, s): (w, m) for p, s, w, m in rows}, budgets)
    assert all(abs(r.actual_share - r.target_share) < 0.02 and r.met for r in shares.values())
    order = [(r.plan, r.finish_time) for r in queued.collect()]
    assert order == sorted(order)
    assert queued.collect() == mx.mix(sized, spark.createDataFrame(rows, TARGETS))[0].collect()


def test_source_that_runs_out_and_missing_source(spark):
    rows = [("p", "big", 0.5, 1), ("p", "small", 0.4, 1), ("p", "none", 0.1, 4), ("p", None, 0.5, 1), ("p", "mid", None, 1)]
    report = {r.source: r for r in mx.mix(data(spark), spark.createDataFrame(rows, TARGETS), budget=10_000)[1].collect()}
    assert set(report) == {"big", "small", "none"}
    assert report["big"].met and not report["small"].met and not report["none"].met and report["none"].used_tokens == 0
    assert report["small"].used_tokens == report["small"].available_tokens


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a", 10, "x"), (1, "a", 10, "x"), (2, None, 10, "x"), (3, "a", 0, "x"), (4, "a", None, "x")]
    targets = spark.createDataFrame([("p", "a", 1.0, 2)], TARGETS)
    queued, report = mx.mix(spark.createDataFrame(rows, SIZED), targets)
    assert queued.count() == 4 and report.collect()[0].used_tokens == 40
    empty = spark.createDataFrame([], SIZED)
    queued, report = mx.mix(empty, targets)
    assert queued.count() == 0 and report.collect()[0].actual_share == 0
    assert mx.mix(empty, targets.limit(0))[1].count() == 0
