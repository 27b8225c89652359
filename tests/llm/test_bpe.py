import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slidelake.llm import bpe

PATH = bpe.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoders():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def slow_merge(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=80))
def test_segment_tree_equals_brute_force(encoders, word):
    assert bpe.merge_word(word, encoders[2]) == slow_merge(word, encoders[2])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_library_and_round_trip(encoders, text):
    text = text.encode("utf-8", "replace").decode()
    own, library, _ = encoders
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text) and library.decode(ids) == text


def test_special_strings_are_ordinary(encoders):
    assert encoders[0].encode("<|endoftext|>") == encoders[1].encode_ordinary("<|endoftext|>")


def test_very_long_word(encoders):
    text = "ab" * 100_000
    assert encoders[1].decode(encoders[0].encode(text)) == text


def test_memo_is_bounded(encoders, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    e = bpe.Encoder(encoders[2])
    e.encode(" ".join(f"word{i}x{i}" for i in range(100)))
    assert len(e.memo) <= 11


def test_dataframe(spark, encoders):
    rows = [(1, None, "a"), (2, "", "a"), (3, "Hello there", "a"), (3, "Hello there", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids0 string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_column(df, "text").collect())
    assert got == [(1, []), (2, []), (3, encoders[0].encode("Hello there")), (3, encoders[0].encode("Hello there"))]
    assert sorted(r.tokens for r in bpe.count_tokens(df, "text").collect()) == [0, 0, 2, 2]
    assert bpe.encode_column(df.limit(0), "text").count() == 0
