import random
import time

import pytest

from slidelake.llm import canonical as cn

ENTRIES = [
    (1, "manufacturer", "Orvanta Imaging", "Castellune Optical Works"),
    (2, "manufacturer", "Kesselbrück Optik", None),
    (3, "manufacturer", "Halvånd Mikro", None),
    (4, "manufacturer", "Delphanor", "Old Del; Del Bros"),
    (101, "model", "OV-Scan 240", None),
    (102, "model", "OV-Scan 240 FL", None),
    (103, "model", "Skjold 40", None),
    (104, "model", "Skjold 400", None),
    (105, "model", "Fjordlinse Mk II", None),
    (106, "model", "Weathercock 50", "Field Bird"),
    (107, "model", "Beacon Duo", None),
    (108, "model", "Ironbloom", None),
    (109, "model", "Panoptera P250", None),
]
CASES = [
    ("manufacturer", "orvanta imaging GmbH", 1), ("manufacturer", "Imaging Orvanta", 1), ("manufacturer", "castellune optical works", 1), ("manufacturer", "Orvanta", 1),
    ("manufacturer", "Kesselbrueck Optik", 2), ("manufacturer", "KesselbrÃ¼ck Optik", 2), ("manufacturer", "Kesselbr. Optik", 2), ("manufacturer", "Keselbrück Optik", 2),
    ("manufacturer", "Halvaand Mikrosk.", 3), ("manufacturer", "Delfanor", 4), ("manufacturer", "Del Bros", 4), ("manufacturer", "Lumbrecht Instruments", 0), ("manufacturer", "unknown", 0),
    ("model", "OV-Scan 24O FL scanner", 102), ("model", "ov scan_240", 101), ("model", "OV-Scan 480", 0), ("model", "Skjold400", 104), ("model", "Skjold 4000", 0),
    ("model", "Skjold 40 (s/n 10271)", 103), ("model", "Fjordlinse 2", 105), ("model", "FjordlinseMkII", 105), ("model", "Fjordlinse Mark III", 0), ("model", "W'cock 50", 106),
    ("model", "Field Bird", 106), ("model", "bracon duo", 107), ("model", "Halvånd Skjold 40", 103), ("model", "Iron Blum", 108), ("model", "Panopt. 250", 109), ("model", "???", 0), ("model", "x" * 50_000, 0),
]


@pytest.mark.parametrize("kind, text, expected", CASES)
def test_find(kind, text, expected):
    assert cn.Catalogue(ENTRIES).find(kind, text) == expected


def test_longest_mentions_do_not_overlap():
    kept, rest = cn.Catalogue(ENTRIES).mentions(cn.tokens("Orvanta Imaging: OV-Scan 240 FL beside Skjold 40"))
    assert sorted(number for _, meant in kept for _, number in meant) == [1, 102, 103] and rest == ["beside"]


def test_ties_give_nothing():
    """Two equally long mentions of different entries; one alias of two entries; a name that is one of each kind."""
    known = cn.Catalogue([(1, "manufacturer", "Abcdef", "Shared Works"), (2, "manufacturer", "Ghijkl", "Shared Works"), (3, "model", "Abcdef", None)])
    assert [known.find("manufacturer", t) for t in ("Abcdef / Ghijkl", "shared works", "ABCDEF", "Abcdef Ltd / Abcdef")] == [0, 0, 1, 1]
    assert known.find("model", "abcdef") == 3 and known.find("model", "Ghijkl") == 0


def test_index_against_brute_force():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    index = cn.Words(words)
    for least in (0.6, 0.75):
        for asked in [*words[:40], "edcba" * 3, "z"]:
            assert index.near(asked, least) == pytest.approx({w: cn._ratio(asked, w) for w in words if cn._ratio(asked, w) >= least})


def test_large_list_is_searched_by_index():
    rnd = random.Random(1)
    parts = [a + b + c for a in "bdfgklmnprstv" for b in "aeiou" for c in ("", "n", "r", "l", "s")]
    name = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(2, 4))).title()
    entries = [(i, "manufacturer" if i % 2 else "model", f"{name()} {name()}" + ("" if i % 2 else f" {rnd.randint(1, 99)}"), None) for i in range(1, 5001)]
    known = cn.Catalogue(entries)
    asked = rnd.sample(entries, 100)
    began = time.perf_counter()
    found = [known.find(kind, text[:2] + "z" + text[3:]) for _, kind, text, _ in asked]
    assert (time.perf_counter() - began) / len(asked) < 0.05
    assert sum(f == e[0] for f, e in zip(found, asked)) > 90


def test_words_that_say_nothing_are_learnt(spark):
    catalog = spark.createDataFrame(ENTRIES, "catalog_id int, entry_kind string, entry_name string, former_names string")
    makers = ["Orvanta Imaging", "Kesselbrück Optik", "Halvånd Mikro", "Delphanor"]
    rows = [("manufacturer", f"{m} Klinikgeräte") for m in makers] + [("manufacturer", "Delfanor Klinikgeräte"), ("manufacturer", "Delfanor Zubehör")]
    values = spark.createDataFrame(rows, "kind string, value string")
    out = {r.value: r.catalog_id for r in cn.map_to_catalog(values, catalog).collect()}
    assert out["Delfanor Klinikgeräte"] == 4 and out["Delfanor Zubehör"] == 0


def test_distance_against_brute_force():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(slow(a[:-1], b) + 1, slow(a, b[:-1]) + 1, slow(a[:-1], b[:-1]) + (a[-1] != b[-1]))
        if len(a) > 1 and len(b) > 1 and a[-1] == b[-2] and a[-2] == b[-1]:
            best = min(best, slow(a[:-2], b[:-2]) + 1)
        return best

    for a, b in [("abc", "acb"), ("kitten", "sitting"[:6]), ("", "ab"), ("duo", "two"), ("abcd", "badc")]:
        assert cn._distance(a, b) == slow(a, b)


def test_dataframe(spark):
    catalog = spark.createDataFrame(ENTRIES, "catalog_id int, entry_kind string, entry_name string, former_names string")
    rows = [(1, "manufacturer", "orvanta", 7), (1, "manufacturer", "orvanta", 7), (2, "model", None, 7), (3, "model", " \t", 7), (4, "model", "what", None)]
    values = spark.createDataFrame(rows, "meta_id bigint, kind string, value string, entry_kind int")
    out = cn.map_to_catalog(values, catalog)
    assert out.columns == ["meta_id", "kind", "value", "entry_kind", "catalog_id"]
    assert sorted((r.meta_id, r.catalog_id) for r in out.collect()) == [(1, 1), (1, 1), (4, 0)]
    assert cn.map_to_catalog(values.limit(0), catalog).count() == 0
    assert {r.catalog_id for r in cn.map_to_catalog(values, catalog.limit(0)).collect()} == {0}


def test_size_of_list_is_checked(spark, monkeypatch):
    monkeypatch.setattr(cn, "MAX_ENTRIES", 3)
    with pytest.raises(ValueError):
        cn.load_entries(spark.createDataFrame(ENTRIES, "catalog_id int, entry_kind string, entry_name string, former_names string"))
