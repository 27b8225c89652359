"""Free-entered values mapped to the entries of a reference list, the unmatched ones reported.

One automaton over all names and aliases (former names, distinctive first words) finds the mentions embedded in a
normalised text; the longest non-overlapping mentions win. What names no entry goes to a token-set similarity: all words
of the text must be explained by words of one entry (spelling, consonants, abbreviation), and numbers must be equal. Its
candidates come from an inverted index: similar words of the list by letter counts, the entries that hold one for every word.

Words that say nothing (legal forms, "scanner") are learnt from the values: those that stand beside mentions of many different
entries. Distinct values are mapped once, each worker building the index once, and joined back with salt, so a value
that fills a third of the rows is one look-up and no single task. The list is shipped to executors, its size checked
(``MAX_ENTRIES``), as are the learnt words (``MAX_NOISE``).

Defined results
* null and blank values: no row; values that are literally an entry's name: no row in ``canonical_found``;
* ``catalog_id`` 0: nothing named, a firm or model not listed, another number or generation of a listed series, or a tie:
  two equally long mentions of different entries, one name or alias that several entries share, two equally similar entries;
* serial numbers, brackets and separators don't count; mis-decoded UTF-8 is repaired;
* extra columns pass through, but for a ``catalog_id``, which is replaced; repeated rows stay; an empty list matches nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from slidelake.common import blank, materialise, salted_join, table

MAX_ENTRIES = 50_000
MAX_NOISE = 10_000
ACCEPT = 0.75  # least similarity of all words together
WORD = 0.6  # least similarity of each word
BESIDE, BESIDE_SHARE = 3, 0.05  # entries, and share of all entries mentioned, beside which a word that says nothing stands
#: Articles and words for "and", which names hold or leave out.
SMALL = set("and et of the u und y".split())
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
VOWELS = "aeiouy"
_SERIAL = re.compile(r"\(?\b(?:s/n|sn|serial|ser\.?)[\s.:#-]*\w*\d\w*\)?|#\s*\d+", re.I)
_DIGITS = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{0,2}?)([0-9OoIl]*[0-9][0-9OoIl]*)(?![A-Za-z0-9]{2})")


def repair(text: str) -> str:
    """Text that was UTF-8, read as Latin-1, put right."""
    try:
        return text.encode("cp1252").decode("utf-8") if re.search("[ÃÂ]", text) else text
    except UnicodeError:
        return text


def tokens(text: str, fold: bool = False) -> list[str]:
    """Lower-case words and numbers without accents; numerals and look-alike digits as digits, small words left out.

    ``fold`` also takes ae, oe, ue and aa for the letters that they stand in for.
    """
    t = _SERIAL.sub(" ", repair(text))
    t = re.sub(r"\b[LlDd]['’](?=\w)", "", t)
    t = re.sub(r"(?:\b[A-Z]\.){2,}", lambda m: m[0].replace(".", ""), t).replace("'", "").replace("’", "")
    t = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])", " ", t)
    t = re.sub(r"(?<=[a-zß-ÿ])(?=(?:I{1,3}|I?V|VI{1,3}|IX)\b)", " ", t)
    t = _DIGITS.sub(lambda m: f"{m[1]} {m[2].translate(str.maketrans('OoIl', '0011'))} ", t)
    t = re.sub(r"(?<=\d)(?=[^\W\d_])|(?<=[^\W\d_])(?=\d)", " ", t)
    t = t.casefold().replace("ø", "o").replace("&", " und ")
    if fold:
        t = t.replace("ae", "a").replace("oe", "o").replace("ue", "u").replace("aa", "a")
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    words = re.findall(r"[^\W_]+", t)
    if len(words) > 1:
        words = [*(ROMAN.get(w, w) if i else w for i, w in enumerate(words[:-1])), ROMAN.get(words[-1], "1" if words[-1] == "l" else words[-1])]
    kept = [w for i, w in enumerate(words) if w not in SMALL and not (w == "x" and i and words[i - 1].isdigit())]
    return [str(int(w)) if w.isdecimal() and len(w) < 18 else w for w in kept]


@lru_cache(maxsize=65536)
def _sound(word: str) -> str:
    """The first letter and the consonants behind it, doubled ones once."""
    return re.sub(r"(.)\1+", r"\1", word[:1] + "".join(c for c in word[1:] if c not in VOWELS))


def _distance(a: str, b: str) -> int:
    """Edits between two words; two neighbours swapped are one."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def _ratio(a: str, b: str, least: float = 0.0) -> float:
    """1 less the share of edits; 0 without counting them where lengths or letters alone leave less than ``least``."""
    longest = max(len(a), len(b), 1)
    if least and min(len(a), len(b)) < least * longest or least and sum((Counter(a) & Counter(b)).values()) < least * longest:
        return 0.0
    return 1 - _distance(a, b) / longest


def _shortened(short: str, long: str) -> bool:
    """An abbreviation: a beginning, or letters of the word in order from the first on, the last included where it drops vowels."""
    if len(short) >= len(long) or short[:1] != long[:1]:
        return False
    if long.startswith(short):
        return True
    rest = iter(long)
    return len(short) >= 2 and len(short) * 3 >= len(long) and short[-1] == long[-1] and all(c in rest for c in short)


def _abbreviates(a: str, b: str) -> bool:
    """Whether a word of a text and one of the list are one word, one of them shortened."""
    return _shortened(a, b) or _shortened(b, a) and (a.startswith(b) if len(b) > 2 else len(b) == 2)


class Words:
    """An index of distinct words that finds those within a ratio of edits: by letter counts first, then by edits, all at once."""

    LETTERS, FEW = 32, 12

    def __init__(self, words: Iterable[str]) -> None:
        self.in_order = sorted(set(words))
        self.words = sorted(self.in_order, key=len)
        self.sizes = np.array([len(w) for w in self.words], np.int32)
        letters = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32).astype(np.int32)
        rows = np.repeat(np.arange(len(self.words)), self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.zeros((len(self.words), int(self.sizes.max(initial=1))), np.int32)
        self.codes[rows, np.arange(len(letters)) - np.repeat(starts, self.sizes)] = letters
        self.counts = np.bincount(rows * self.LETTERS + letters % self.LETTERS, minlength=len(self.words) * self.LETTERS).reshape(-1, self.LETTERS).astype(np.int16)

    def near(self, word: str, least: float) -> dict[str, float]:
        """Words whose share of letters left unedited is at least ``least``, with that share."""
        if not self.words or not word:
            return {}
        # words of other lengths need more edits for that alone
        low, high = np.searchsorted(self.sizes, [math.ceil(least * len(word) - 1e-9), math.floor(len(word) / least + 1e-9) + 1])
        own = np.bincount([ord(c) % self.LETTERS for c in word], minlength=self.LETTERS).astype(np.int16)
        shared = np.minimum(self.counts[low:high], own).sum(1, dtype=np.int32)
        some = low + np.flatnonzero(shared >= least * np.maximum(self.sizes[low:high], len(word)) - 1e-9)
        longest = np.maximum(self.sizes, len(word))
        if some.size <= self.FEW:
            near = ((self.words[i], _ratio(word, self.words[i])) for i in some)
            return {w: r for w, r in near if r >= least}
        ratio = 1 - self._edits(word, some) / longest[some]
        return {self.words[i]: float(r) for i, r in zip(some, ratio) if r >= least}

    def _edits(self, word: str, some: np.ndarray) -> np.ndarray:
        """Edits between a word and each of ``some``; two neighbours swapped are one."""
        codes = self.codes[some, : int(self.sizes[some].max())]
        n, width = codes.shape
        along = np.arange(width + 1, dtype=np.int32)
        older, before, previous = None, np.tile(along, (n, 1)), 0
        for i, x in enumerate(map(ord, word), 1):
            row = np.empty_like(before)
            row[:, 0] = i
            row[:, 1:] = np.minimum(before[:, :-1] + (codes != x), before[:, 1:] + 1)
            if i > 1:
                swapped = (codes[:, :-1] == x) & (codes[:, 1:] == previous)
                row[:, 2:] = np.where(swapped, np.minimum(row[:, 2:], older[:, :-2] + 1), row[:, 2:])
            # a letter put in after the cheapest place before it
            row = np.minimum.accumulate(row - along, axis=1) + along
            older, before, previous = before, row, x
        return before[np.arange(n), self.sizes[some]]

    def beginning(self, start: str) -> list[str]:
        """Words that begin with ``start``."""
        at, out = bisect_left(self.in_order, start), []
        while at < len(self.in_order) and self.in_order[at].startswith(start):
            out.append(self.in_order[at])
            at += 1
        return out


class Names:
    """The names of one kind, with or without folded letters, by their words."""

    def __init__(self, names: list[tuple[int, tuple[str, ...]]]) -> None:
        self.entries = [(number, [w for w in words if not w.isdigit()], tuple(sorted(w for w in words if w.isdigit()))) for number, words in names]
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.by_numbers: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.by_joined: dict[str, set[int]] = defaultdict(set)
        sounds: dict[str, set[str]] = defaultdict(set)
        joined_sounds: dict[str, set[str]] = defaultdict(set)
        self.by_ends: dict[str, list[str]] = defaultdict(list)
        for i, (_, own, numbers) in enumerate(self.entries):
            self.by_numbers[numbers].add(i)
            if own:
                self.by_joined["".join(own)].add(i)
            for w in own:
                self.by_word[w].add(i)
        for w in self.by_word:
            sounds[_sound(w)].add(w)
            self.by_ends[w[0] + w[-1]].append(w)
        for w in self.by_joined:
            joined_sounds[_sound(w)].add(w)
        self.words, self.sounds, self.sound_words = Words(self.by_word), Words(sounds), sounds
        self.joined, self.joined_sounds, self.joined_words = Words(self.by_joined), Words(joined_sounds), joined_sounds
        self.like = lru_cache(maxsize=65_536)(self._like)

    def _like(self, word: str) -> dict[str, float]:
        """Words of the list that are alike, with their similarity."""
        scored = self.words.near(word, WORD)
        if len(word) > 3:
            for s, x in self.sounds.near(_sound(word), WORD).items():
                for w in self.sound_words[s]:
                    if len(w) > 3:
                        scored[w] = max(scored.get(w, 0.0), 0.98 * x)
        short = {*self.words.beginning(word), *(word[:n] for n in range(2, len(word)) if word[:n] in self.by_word), *self.by_ends.get(word[0] + word[-1], ())}
        for w in short:
            if scored.get(w, 0.0) < 0.85 and _abbreviates(word, w):
                scored[w] = 0.85
        return {w: x for w, x in scored.items() if x >= WORD}

    def whole(self, joined: str) -> dict[int, float]:
        """Entries whose words written together are alike."""
        scored = dict(self.joined.near(joined, ACCEPT))
        for s, x in self.joined_sounds.near(_sound(joined), ACCEPT).items():
            for w in self.joined_words[s]:
                scored[w] = max(scored.get(w, 0.0), 0.98 * x)
        if len(joined) > 5:
            for w in self.joined.beginning(joined):
                if len(joined) * 3 > 2 * len(w):
                    scored[w] = max(scored.get(w, 0.0), 0.85)
        out: dict[int, float] = {}
        for w, x in scored.items():
            for i in self.by_joined[w]:
                out[i] = x
        return out

    def similar(self, words: tuple[str, ...], numbered: bool) -> tuple[float, int]:
        """Best similarity and its entry; (0, 0) below the thresholds or if two entries tie."""
        names = [w for w in words if not w.isdigit()]
        if not names:
            return 0.0, 0
        allowed = self.by_numbers.get(tuple(sorted(w for w in words if w.isdigit())), set()) if numbered else None
        if numbered and not allowed:
            return 0.0, 0
        likes = [self.like(w) for w in names]
        sets = sorted(([set().union(*(self.by_word[o] for o in like)) for like in likes]), key=len)
        candidates = set(sets[0])
        for more in sets[1:]:
            candidates &= more
        scored: dict[int, float] = {}
        for i in candidates if allowed is None else candidates & allowed:
            number, own, _ = self.entries[i]
            score = self._words(names, own, likes)
            if score >= ACCEPT:
                scored[number] = max(score, scored.get(number, 0.0))
        joined = "".join(names)
        if len(joined) > 4:
            for i, score in self.whole(joined).items():
                if score >= ACCEPT and (allowed is None or i in allowed):
                    number = self.entries[i][0]
                    scored[number] = max(score, scored.get(number, 0.0))
        top = sorted(((s, -n) for n, s in scored.items()), reverse=True)[:2]
        if not top or len(top) == 2 and top[0][0] == top[1][0]:
            return 0.0, 0
        return top[0][0], -top[0][1]

    @staticmethod
    def _words(names: list[str], own: list[str], likes: list[dict[str, float]]) -> float:
        """How well the words of an entry explain those of a text, a little less for each of its words that is missing."""
        total, used = 0.0, set()
        for w, like in zip(names, likes):
            alike, k = max((like.get(o, 0.0), -j) for j, o in enumerate(own))
            if alike < WORD:
                return 0.0
            used.add(-k)
            total += alike * len(w)
        heavy = max(range(len(own)), key=lambda j: (len(own[j]), -j))
        if heavy not in used and 0 not in used:
            return 0.0
        missing = sum(len(own[j]) for j in range(len(own)) if j not in used) / sum(map(len, own))
        return total / sum(map(len, names)) - 0.1 * missing


class Catalogue:
    """Names of one or several kinds, ready to be found in texts. Entries: ``(catalog_id, kind, name, former names)``."""

    def __init__(self, entries: list[tuple[int, str, str, str | None]], noise: Iterable[str] = ()) -> None:
        import ahocorasick

        self.noise = frozenset(noise)
        names: dict[tuple[str, bool], list[tuple[int, tuple[str, ...]]]] = defaultdict(list)
        patterns: dict[str, set[tuple[str, int]]] = defaultdict(set)
        read = [(number, kind, [(tokens(c), tokens(c, True)) for c in (name, *re.split(r"\s*;\s*", former or ""))]) for number, kind, name, former in entries]
        firsts = Counter((kind, called[0][0][0]) for _, kind, called in read if called[0][0])
        for number, kind, called in read:
            for i, ways in enumerate(called):
                for fold, words in enumerate(ways):
                    if not words:
                        continue
                    names[kind, bool(fold)].append((number, tuple(words)))
                    patterns[f" {' '.join(words)} "].add((kind, number))
                    # a maker goes by its first word where no other has it
                    if i == 0 and kind == "manufacturer" and len(words[0]) > 4 and firsts[kind, ways[0][0]] == 1:
                        patterns[f" {words[0]} "].add((kind, number))
        self.names = {k: Names(v) for k, v in names.items()}
        self.automaton = ahocorasick.Automaton()
        for pattern, meant in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), frozenset(meant)))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns
        self.find = lru_cache(maxsize=100_000)(self._find)

    def mentions(self, words: list[str]) -> tuple[list[tuple[int, frozenset[tuple[str, int]]]], list[str]]:
        """Longest non-overlapping mentions as (length, kinds and ids meant), and the words outside them."""
        text = f" {' '.join(words)} "
        found = [] if self.empty else [(n, end, meant) for end, (n, meant) in self.automaton.iter(text)]
        taken, kept = [False] * len(text), []
        for n, end, meant in sorted(found, key=lambda x: (-x[0], x[1])):
            start = end + 1 - n
            if not any(taken[start + 1 : end]):  # neighbours share the blank between them
                taken[start + 1 : end] = [True] * (n - 2)
                kept.append((n, meant))
        rest = "".join(" " if t else c for c, t in zip(text, taken)).split()
        return kept, rest

    def beside(self, kind: str, text: str) -> list[tuple[str, int]]:
        """Words outside the mentions of a text that names exactly one entry of ``kind``, each with that entry."""
        kept, rest = self.mentions(tokens(text))
        own = {number for _, meant in kept for k, number in meant if k == kind}
        return [(w, number) for number in own for w in dict.fromkeys(rest) if not w.isdigit()] if len(own) == 1 else []

    def _find(self, kind: str, text: str) -> int:
        """The id of the entry of ``kind`` that ``text`` means, else 0."""
        readings = [(False, self._heard(text, False)), (True, self._heard(text, True))]
        found = [(fold, words, *self.mentions(words)) for fold, words in readings if not fold or words != readings[0][1]]
        own = [(n, {number for k, number in meant if k == kind}, rest) for _, _, kept, rest in found for n, meant in kept]
        own = [x for x in own if x[1]]
        if own:
            longest = max(x[0] for x in own)
            meant = set().union(*(x[1] for x in own if x[0] == longest))
            # a number beside a mentioned model makes it another one
            other = kind == "model" and any(w.isdigit() for w in next(x[2] for x in own if x[0] == longest))
            return 0 if other or len(meant) > 1 else meant.pop()
        gloss = re.search(r"\(([^()]*[^\W\d_]{4,}[^()]*)\)", text)
        best = (0.0, 0)
        for fold, words, _, rest in found:
            ways = [rest, words]
            if gloss:
                numbers = [w for w in words if w.isdigit()]
                ways += [self._heard(text.replace(gloss[0], " "), fold), [*[w for w in self._heard(gloss[1], fold) if not w.isdigit()], *numbers]]
            if (kind, fold) in self.names:
                best = max([best, *(self.names[kind, fold].similar(w, kind == "model") for w in dict.fromkeys(map(tuple, ways)) if w)])
        return best[1]

    def _heard(self, text: str, fold: bool) -> list[str]:
        words = tokens(text, fold)
        return [w for w in words if w not in self.noise]


_BUILT: dict[tuple, Catalogue] = {}


def _catalogue(entries: tuple, noise: tuple) -> Catalogue:
    """The index of a list, built once for a worker process."""
    key = (entries, noise)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Catalogue(list(entries), noise)
    return _BUILT[key]


def load_entries(catalog: DataFrame) -> list[tuple[int, str, str, str | None]]:
    """The reference list for the executors; refuses one of more than ``MAX_ENTRIES`` entries."""
    rows = catalog.select("catalog_id", "entry_kind", "entry_name", "former_names").where("entry_name is not null").orderBy("catalog_id").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    return [tuple(r) for r in rows]


def _pairs(b: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    return zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "value")))


def learn_noise(values: DataFrame, entries: tuple) -> tuple[str, ...]:
    """Words that stand beside mentions of many different entries; refuses more than ``MAX_NOISE``. ``values``: distinct ``kind, value``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _catalogue(entries, ())
        for b in batches:
            found = [(k, w, n) for k, v in _pairs(b) for w, n in known.beside(k, v)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["kind", "word", "entry"])

    pairs = materialise(values.mapInArrow(run, "kind string, word string, entry int").distinct(), "beside")
    mentioned = pairs.groupBy("kind").agg(F.count_distinct("entry").alias("entries"))
    per_word = pairs.groupBy("kind", "word").agg(F.count("*").alias("beside")).join(mentioned, "kind")
    often = per_word.where((F.col("beside") >= BESIDE) & (F.col("beside") >= BESIDE_SHARE * F.col("entries"))).select("word").distinct()
    words = sorted(r.word for r in often.limit(MAX_NOISE + 1).collect())
    if len(words) > MAX_NOISE:
        raise ValueError(f"more than {MAX_NOISE} words stand beside many entries")
    own = {w for _, _, name, former in entries for called in (name, *(former or "").split(";")) for w in tokens(called)}
    return tuple(w for w in words if w not in own)


def map_to_catalog(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """``values`` (``field``, ``kind``, ``value`` and any others) with ``catalog_id``, the entry meant or 0; blank values left out."""
    entries = tuple(load_entries(catalog))
    rows = values.drop("catalog_id").where(~blank(F.col("value")))
    distinct = materialise(rows.select("kind", "value").distinct(), "values")
    noise = learn_noise(distinct, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _catalogue(entries, noise)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([known.find(*x) for x in _pairs(b)], pa.int32())], [*b.schema.names, "catalog_id"])

    mapped = materialise(distinct.mapInArrow(run, StructType([*distinct.schema.fields, StructField("catalog_id", IntegerType())])), "mapped")
    return salted_join(rows, mapped, ["kind", "value"]).select(*rows.columns, "catalog_id")


def _typed(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """``field, kind, value`` of every maker and model as typed, beside ``keys``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f).alias("value")) for f, k in (("scanner_manufacturer", "manufacturer"), ("scanner_model", "model"))])
    return table(spark, sf_dir, "slide_metadata").select(*keys, F.inline(pairs))


def canonical_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry meant by every maker and model that isn't literally an entry of the list, 0 for none."""
    catalog = table(spark, sf_dir, "scanner_catalog")
    literal = catalog.select(F.col("entry_kind").alias("kind"), F.col("entry_name").alias("value")).distinct()
    typed = _typed(spark, sf_dir, "meta_id").join(literal, ["kind", "value"], "left_anti")
    return map_to_catalog(typed, catalog).select("meta_id", "field", "catalog_id")


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, value, records``: every value for which the list has no entry, and how many records hold it."""
    catalog = table(spark, sf_dir, "scanner_catalog")
    counted = _typed(spark, sf_dir).groupBy("field", "kind", "value").agg(F.count("*").alias("records"))
    return map_to_catalog(counted, catalog).where("catalog_id = 0").select("field", "value", "records")
