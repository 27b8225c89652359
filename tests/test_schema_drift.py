import json
import random

import pytest

from slidelake.operators import schema_drift as sd

RECORDS = "record_id bigint, slide_id bigint, feed_id bigint, file_seq int, properties string, field string"


def build(spark, files):
    rows, n = [], 0
    for (feed, seq), records in files.items():
        for r in records:
            n += 1
            rows.append((n, n, feed, seq, r if r is None or isinstance(r, str) else json.dumps(r), "extra"))
    return spark.createDataFrame(rows, RECORDS)


def changes(df):
    profiles = sd.file_profiles(sd.ingest(df, "properties"))
    return sorted(tuple(r) for r in sd.schema_changes(profiles, df).select("feed_id", "file_seq", "change_kind", "field", "new_field").collect())


def test_every_kind(spark):
    rnd = random.Random(1)
    rec = lambda name, **more: {name: round(rnd.random(), 4), "stain": rnd.choice(["PAS", "H+E"]), **more}
    files = {
        (1, 1): [rec("FocusScore") for _ in range(40)],
        (1, 2): [rec("focus_score") for _ in range(40)] + [None, "", "{cut", "[1]"],
        (1, 4): [rec("focus_score", gamma="1.8") for _ in range(40)],  # 3 never came
        (1, 5): [{"focus_score": 0.1, "gamma": 1.8, "stain": None} for _ in range(40)],
        (2, 1): [{"a": 1}],
        (2, 2): [None],
    }
    df = build(spark, files)
    expected = [(1, 2, "renamed", "FocusScore", "focus_score"), (1, 4, "added", "gamma", ""), (1, 5, "removed", "stain", ""), (1, 5, "retyped", "gamma", ""), (2, 2, "removed", "a", "")]
    assert changes(df) == expected
    assert changes(df.union(df)) == expected  # exact duplicates
    assert changes(df.limit(0)) == []


def test_fields_that_meet_are_not_renamed(spark):
    both = {"low": 0.5, "high": 0.5}
    files = {(1, 1): [{"low": 0.5}] * 20, (1, 2): [{"high": 0.5}] * 20, (2, 1): [both] * 20}
    assert changes(build(spark, files)) == [(1, 2, "added", "high", ""), (1, 2, "removed", "low", "")]


def test_ingest_rescues_and_promotes(spark):
    df = build(spark, {(1, 1): [{"a": 1.5, "b": True, "c": {"x": 1}}, {"a": "many", "B2": False}, "{", None]})
    got = [r.asDict() for r in sd.ingest(df, "properties", {"a": "number"}).orderBy("record_id").collect()]
    assert [r["a"] for r in got] == [1.5, None, None, None]
    assert got[0]["_rescued"] == {"b": "true", "c": '{"x":1}'} and got[1]["_rescued"] == {"a": '"many"', "B2": "false"}
    assert got[2]["_unreadable"] == "{" and got[3]["_rescued"] is None
    p = [r.asDict() for r in sd.promote(sd.ingest(df, "properties", {"a": "number"}), {"b": "boolean"}, {"b": ["B2"]}).orderBy("record_id").collect()]
    assert [r["b"] for r in p] == [True, False, None, None] and p[1]["_rescued"] == {"a": '"many"'}


def test_consistent_table(spark):
    old, new = [{"Score": 0.1 + i / 100} for i in range(30)], [{"score_value": 0.1 + i / 100} for i in range(30)]
    t = sd.consistent_table(build(spark, {(1, 1): old, (1, 2): [*new, {"score_value": "none"}]}))
    assert "score_value" in t.columns and "Score" not in t.columns
    assert t.where("score_value is not null").count() == 60 and t.where("_rescued is not null").collect()[0]["_rescued"] == '{"score_value":"\\"none\\""}'


def test_bound_counts_names_and_is_no_cut(spark):
    df = build(spark, {(1, 1): [{"a": 1, "b": 1}, {"a": 2}, {"a": 3}], (1, 2): [{"a": "x"}, {"a": "y"}]})
    profiles = sd.file_profiles(sd.ingest(df, "properties"))
    renamed = sd.schema_changes(profiles, df)
    assert sd.target_schema(profiles, renamed, most=2)[0] == {"a": "number", "b": "number"}  # a's kinds don't use up the bound
    with pytest.raises(ValueError, match="more than 1 field names"):
        sd.target_schema(profiles, renamed, most=1)


def test_values_that_cast_are_replayed(spark):
    rows = [{"n": "2.5", "b": "yes", "s": 'q"x', "o": {"k": [1]}}, {"n": True, "b": 0, "s": 7, "o": 1}, {"n": None, "b": None}]
    target = {"n": "number", "b": "boolean", "s": "string", "o": "object"}
    got = [r.asDict() for r in sd.ingest(build(spark, {(1, 1): rows}), "properties", target).orderBy("record_id").collect()]
    assert [(r["n"], r["b"], r["s"], r["o"]) for r in got] == [(2.5, True, 'q"x', '{"k":[1]}'), (None, False, None, None), (None, None, None, None)]
    assert got[0]["_rescued"] == {} and got[1]["_rescued"] == {"n": "true", "s": "7", "o": "1"} and got[2]["_rescued"] == {"n": "null", "b": "null"}


def test_many_fields_and_a_replaced_schema(spark):
    """2,500 fields: all changes are reported, the table refuses aloud; pairs without a common word or shape aren't renames."""
    wide = {f"field_{i}": i for i in range(1250)}, {f"column{i}": f"w{chr(97 + i % 26)}" for i in range(1250)}
    df = build(spark, {(1, 1): [wide[0]], (1, 2): [wide[1]]})
    found = changes(df)
    assert len(found) == 2500 and {c[2] for c in found} == {"added", "removed"}
    with pytest.raises(ValueError, match="more than 2000 field names"):
        sd.consistent_table(df)
