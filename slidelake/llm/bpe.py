"""Encoding of texts with a public byte-level BPE vocabulary.

A text is parted into words by the tokenizer's pattern; each word's bytes are merged. Merging keeps the ranks of adjacent
pairs in a segment tree whose root is the leftmost pair of lowest rank; a merge updates two leaves, so a word of n bytes
takes O(n log n) however long it is. Distinct words are kept in a bounded memo per worker. The vocabulary (a file of fixed
size, its path a parameter) is read on the driver and sent to the workers once.

Defined results
* null and empty texts: an empty list; strings of special tokens in a text are ordinary text;
* no length limit; lone surrogates cannot occur in Parquet text; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from slidelake.common import table

#: Fixed value: the pattern that parts a text into words, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 30
MEMO = 200_000  # words kept per worker
MEMO_LENGTH = 64  # longer words are merged anew each time


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a vocabulary file of the public collection."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, which is also the rank of the merge that makes it."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the leftmost pair of lowest rank until none can be merged."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(word[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left <= right else right
    while tree[1] != NONE:
        lowest, i = tree[1], 1
        while i < size:  # down to the leftmost leaf of that rank
            i *= 2
            if tree[i] != lowest:
                i += 1
        i -= size
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        changed = [(i, ranks.get(parts[i] + parts[k], NONE) if k < n else NONE), (j, NONE)]
        if before[i] >= 0:
            changed.append((before[i], ranks.get(parts[before[i]] + parts[i], NONE)))
        for leaf, rank in changed:
            at = size + leaf
            if at >= 2 * size or tree[at] == rank:
                continue
            tree[at] = rank
            at //= 2
            while at:
                left, right = tree[2 * at], tree[2 * at + 1]
                now = left if left <= right else right
                if tree[at] == now:
                    break
                tree[at] = now
                at //= 2
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Texts to ids with one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty."""
        ids: list[int] = []
        memo = self.memo
        for word in self.split(text) if text else ():
            known = memo.get(word)
            if known is None:
                known = merge_word(word.encode(), self.ranks)
                if len(word) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = known
            ids += known
        return ids


_ENCODERS: dict[int, Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """The worker's encoder of a vocabulary, made once."""
    key = hash((data, pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(data), pattern)
    return _ENCODERS[key]


def _with_encoded(df: DataFrame, text: str, name: str, kind, make, vocabulary: str | None, pattern: str) -> DataFrame:
    """``df`` with a column computed from the encoded texts, in Arrow batches; no shuffle."""
    df = df.drop(name)
    with open(vocabulary or vocabulary_path(), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, pattern).encode
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                values = make(encode, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, kind)]))


def encode_column(df: DataFrame, text: str, name: str = "ids", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the ids of column ``text`` as ``array<int>``."""
    make = lambda encode, column: pa.array([encode(t) for t in column.to_pylist()], pa.list_(pa.int32()))
    return _with_encoded(df, text, name, ArrayType(IntegerType()), make, vocabulary, pattern)


def count_tokens(df: DataFrame, text: str, name: str = "tokens", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the number of tokens of column ``text``."""
    make = lambda encode, column: pa.array([len(encode(t)) for t in column.to_pylist()], pa.int32())
    return _with_encoded(df, text, name, IntegerType(), make, vocabulary, pattern)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_column(documents, "text").select("doc_id", F.col("ids"))
