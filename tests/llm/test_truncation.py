import random

import pytest

from slidelake.llm import truncation as tr

DOCS = "doc_id bigint, source string, text string, cut string"
SENTENCES = ["The committee wants to protect the water supply.", "Nobody disputes that the harbour board promised to extend the road toll.", "That is not an answer!", "We have waited for many years to see the housing register."]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(SENTENCES) for _ in range(rnd.randint(3, 15))) for _ in range(600)]
    docs = [(i, "hall", t, "x") for i, t in enumerate(texts)]
    docs += [(1000 + i, "hall", texts[i] + rnd.choice(["\nAgenda item 7: the road toll", "\nAyes 10, Noes 4"]), "x") for i in range(40)]
    docs += [(2000 + i, "hall", texts[100 + i] + " The committee wants to –", "x") for i in range(10)]
    whole = [" ".join(rnd.choice(SENTENCES) for _ in range(25)) for _ in range(30)]
    limited = [(3000 + i, "scan", t[:400], "x") for i, t in enumerate(whole)]
    broken = [(4000, "hall", texts[0] + " Nobody disputes that the har", "x"), (4001, "hall", texts[1] + " The committee wants to protect", "x"), (4002, "hall", texts[2] + " The committee wants to prot\\u00", "x")]
    copies = [(5000, "other", limited[0][2], "x"), (5001, "other", limited[0][2], "x")]
    blank = [(6000, "hall", None, "x"), (6001, "hall", "", "x"), (6002, "hall", " \n", "x"), (6003, None, texts[5], "x"), (6004, "hall", "word " * 30_000 + "end.", "x")]
    return docs, limited + broken + copies, blank


def test_cut_texts_are_found(spark, corpus):
    whole, cut, blank = corpus
    out = {r.doc_id: r.cut for r in tr.truncated(spark.createDataFrame([*whole, *cut, *blank], DOCS)).collect()}
    assert len(out) == len(whole) + len(cut) + len(blank)
    assert {i for i, c in out.items() if c} == {r[0] for r in cut}


def test_repeated_rows_and_empty(spark, corpus):
    whole, cut, _ = corpus
    df = spark.createDataFrame([*whole, *cut], DOCS)
    assert tr.truncated(df.union(df)).where("cut").count() == 2 * len(cut)
    assert tr.truncated(df.limit(0)).count() == 0


def test_counts_against_brute_force(spark):
    texts = ["a b c. a b d", "a b c. x", "one", "a b c. x", "7 x" + "y" * 70 + " 88 z"]
    w = tr.weighted(spark.createDataFrame([(i, "s", t, "") for i, t in enumerate(texts)], DOCS))
    got = sorted((r.word, round(r.n, 6)) for r in tr.inner_counts(w).groupBy("word").sum("n").toDF("word", "n").collect())
    assert got == [("0", 2), ("a", 3), ("b", 3), ("c.", 2), ("x" + "y" * 70, 1)]


def test_long_words_and_texts_without_blanks(spark):
    """The last character decides, however far behind: of a word of 60 characters, of a text that is one word."""
    rnd = random.Random(7)
    long = "https://records.example.org/sessions/"
    texts = [" ".join(rnd.choice(SENTENCES) for _ in range(rnd.randint(3, 15))) for _ in range(500)]
    linked = [f"{t} See {long}{'x' * 40}{i % 7}/annex." for i, t in enumerate(texts)]
    inside = [f"See {long}{'x' * 40}{i % 7}/annexes here. {t}" for i, t in enumerate(texts)]
    docs = [(i, "hall", t, "x") for i, t in enumerate(linked + inside)]
    cut = [(5000, "hall", texts[3] + f" See {long}{'x' * 40}3/ann", "x"), (5001, "hall", "議" * 3000, "x"), (5002, "hall", texts[4] + " Nobody" + "\ufffd" * 90, "x"), (5003, "hall", texts[5] + " The committee wants [" + " " * 80 + "... ", "x")]
    whole = [(6000, "hall", "議" * 3000 + ".", "x"), (6001, "hall", texts[6] + " [" + " " * 80 + "...]", "x")]
    out = {r.doc_id for r in tr.truncated(spark.createDataFrame([*docs, *cut, *whole], DOCS)).where("cut").collect()}
    # 5003 and 6001 say themselves that something is left out
    assert out == {5000, 5001, 5002}


def test_beginnings_against_brute_force(spark):
    words = [(1, "annex", 2.0), (1, "annexes", 3.0), (1, "a" * 50 + "bc.", 5.0), (2, "a" * 50, 7.0), (1, "x.", 1.0)]
    asked = [(1, "ann"), (1, "annex"), (1, "a" * 40), (1, "a" * 50 + "b"), (1, "a" * 50 + "bc."), (2, "a" * 49), (1, "x")]
    counts = spark.createDataFrame(words, "key bigint, word string, n double")
    got = {(r.key, r.f): r.inner for r in tr._beginnings(counts, spark.createDataFrame(asked, "key bigint, f string")).collect()}
    begins = lambda w, f: w.startswith(f) and (w == f or w[len(f)].isalpha())
    for key, f in asked:
        assert got.get((key, f), 0) == sum(n for k, w, n in words if k == key and begins(w, f)), f


def test_rates_and_what_told(spark, corpus):
    whole, cut, blank = corpus
    out = tr.truncated(spark.createDataFrame([*whole, *cut, *blank], DOCS)).where("cut").groupBy("told_by").count().collect()
    told = {r.told_by: r["count"] for r in out}
    assert told["trigram"] > 20 and sum(told.values()) == len(cut)
