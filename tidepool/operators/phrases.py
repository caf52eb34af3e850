"""Many phrases in many texts: one automaton of all phrases, run along each text once.

Whole phrases are found by an Aho-Corasick automaton, longest shared runs of words by a suffix automaton. Both go to the
tasks in slices of a stated size, so a text is read once for each slice and never shuffled, and no word is a join key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

c = F.col
#: Code points of phrases in one automaton (some 100 bytes each), and how many automata are worth a pass over the texts each.
SLICE_CHARS, MOST_SLICES = 4_000_000, 8
#: Words of items in one suffix automaton (some 500 bytes each).
SLICE_WORDS = 400_000


def _sliced(rows: DataFrame, size: str, limit: int) -> tuple[DataFrame, int]:
    """The rows with `slice`, numbered so that a slice's sizes add up to about the limit, and the number of slices."""
    whole = rows.agg(F.sum(size)).first()[0] or 0
    count = -(-whole // limit)
    return rows.withColumn("slice", F.pmod(F.xxhash64(*rows.columns), F.lit(max(count, 1)))), count


def occurrences(phrases: DataFrame, docs: DataFrame, slice_chars: int = SLICE_CHARS, most_slices: int = MOST_SLICES) -> DataFrame:
    """The rows (a, *key) of phrases `a` and documents (*key, t) whose text holds the phrase whole, both being words joined by one
    space. Phrases that fill more than `most_slices` automata are found by their rarest word instead."""
    key = [k for k in docs.columns if k != "t"]
    asked = phrases.where("a <> ''").select("a").distinct().withColumn("size", F.length("a") + 2)
    asked, count = _sliced(asked, "size", slice_chars)
    if count > most_slices:
        return _by_rarest_word(asked.select("a"), docs, key)
    spark, found = docs.sparkSession, None
    schema = ", ".join(["a string", *[f"{k} {t}" for k, t in docs.select(*key).dtypes]])
    for number in range(max(count, 1)):
        words = spark.sparkContext.broadcast([r["a"] for r in asked.where(c("slice") == number).select("a").collect()])  # about slice_chars
        some = docs.select(*key, "t").mapInArrow(_matches(words, key), schema)
        found = some if found is None else found.unionByName(some)
    return found


def _matches(phrases, key: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in phrases.value:
            automaton.add_word(f" {phrase} ", phrase)
        automaton.make_automaton()
        for batch in batches:
            row, hit = [], []
            if len(automaton):
                for i, text in enumerate(batch.column("t")):
                    held = {phrase for _, phrase in automaton.iter(f" {text.as_py()} ")} if text.is_valid else ()
                    row += [i] * len(held)
                    hit += held
            rows = batch.select(key).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string()), *rows.columns], ["a", *key])

    return run


def _by_rarest_word(phrases: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """As occurrences(), by shuffles: documents that hold the word of a phrase that the fewest documents hold are read again."""
    parts = phrases.select("a", F.explode(F.array_distinct(F.split("a", " "))).alias("word"))
    held = docs.select(*key, F.explode(F.array_distinct(F.split("t", " "))).alias("word")).join(parts.select("word").distinct(), "word", "left_semi")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    # a phrase with a word that no document holds is nowhere
    rarest = parts.join(counts, "word", "left").groupBy("a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("x")).where("x.n > 0").select("a", c("x.word").alias("word"))
    met = held.join(rarest, "word").select("a", *key).join(docs, key)
    return met.where(F.contains(F.concat(F.lit(" "), c("t"), F.lit(" ")), F.concat(F.lit(" "), c("a"), F.lit(" ")))).select("a", *key)


@dataclass
class SuffixAutomaton:
    """All runs of words of some texts. A state stands for runs that end at the same places; `length` is its longest run and
    `link` the state of the longest run that ends at more places."""

    follows: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    last: int = 0

    def _state(self, length: int, follows: dict) -> int:
        self.follows.append(follows)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def add(self, word: object) -> int:
        """Takes one more word; the state of the whole text so far."""
        new, p = self._state(self.length[self.last] + 1, {}), self.last
        while p != -1 and word not in self.follows[p]:
            self.follows[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.follows[p][word]
            if self.length[p] + 1 != self.length[q]:  # runs of q that end here too get a state of their own
                twin = self._state(self.length[p] + 1, dict(self.follows[q]))
                self.link[twin] = self.link[q]
                while p != -1 and self.follows[p].get(word) == q:
                    self.follows[p][word] = twin
                    p = self.link[p]
                self.link[q] = twin
                q = twin
            self.link[new] = q
        self.last = new
        return new

    def matched(self, words: Iterable) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest run that ends at each word of a text and is a run of the automaton's texts."""
        at, n = 0, 0
        follows, link, length = self.follows, self.link, self.length
        for word in words:
            while at and word not in follows[at]:
                at = link[at]
                n = length[at]
            if word in follows[at]:
                at, n = follows[at][word], n + 1
            yield at, n


def longest_run(a: list[str], b: list[str]) -> int:
    """Words in the longest run that both have, in time linear in the two."""
    runs = SuffixAutomaton()
    for word in a:
        runs.add(word)
    return max((n for _, n in runs.matched(b)), default=0)


class ItemRuns:
    """The suffix automaton of many items, and the best that texts have matched of each of its states."""

    def __init__(self, items: list[tuple[object, list[str]]]) -> None:
        self.runs, self.ends = SuffixAutomaton(), []
        for number, (item, words) in enumerate(items):
            self.ends.append((item, [self.runs.add(word) for word in words]))
            self.runs.add(number)  # a number is no word, so no run goes on into the next item
        self.best: dict[int, tuple[int, tuple]] = {}

    def read(self, words: list[str], key: tuple) -> None:
        """Notes the longest matches of one text. Of texts that match as much the one with the smaller key counts."""
        own: dict[int, int] = {}
        at, n = 0, 0
        follows, link, length = self.runs.follows, self.runs.link, self.runs.length
        for word in words:  # as matched() does, without a call for each word
            while at and word not in follows[at]:
                at = link[at]
                n = length[at]
            after = follows[at].get(word)
            if after is None:
                continue
            at, n = after, n + 1
            if n > own.get(at, 0):
                own[at] = n
        for state, n in own.items():
            held = self.best.get(state)
            if held is None or (-n, key) < (-held[0], held[1]):
                self.best[state] = n, key

    def result(self) -> Iterator[tuple[object, int, tuple]]:
        """(item, run, key) for the items of which any word has been seen."""
        link, length = self.runs.link, self.runs.length
        order = sorted(range(1, len(link)), key=length.__getitem__)
        best = dict(self.best)
        better = lambda x, y: y if x is None or (y is not None and (-y[0], y[1]) < (-x[0], x[1])) else x
        for state in reversed(order):  # what matches a state matches the shorter runs that end there too
            if (own := best.get(state)) and link[state] > 0:
                up = min(own[0], length[link[state]]), own[1]
                best[link[state]] = better(best.get(link[state]), up)
        down: dict[int, tuple[int, tuple] | None] = {0: None}
        for state in order:
            down[state] = better(down[link[state]], best.get(state))
        for item, ends in self.ends:
            top = None
            for state in ends:
                top = better(top, down[state])
            if top:
                yield item, top[0], top[1]


def longest_shared(items: DataFrame, docs: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(item_id, run, surface, id): the longest run of words that an item (item_id, w) shares with any document (surface, id, w), from
    one word on, and the first document that holds it. Documents may have text `t`, words joined by one space, instead of w.
    Each task hands on one row for each item."""
    words_of = (lambda x: (x.as_py() or "").split()) if "t" in docs.columns else (lambda x: x.as_py() or [])
    told = "t" if "t" in docs.columns else "w"
    asked, count = _sliced(items.where(F.size("w") > 0).select("item_id", "w", F.size("w").cast("long").alias("size")), "size", slice_words)
    kinds = dict(items.dtypes) | dict(docs.dtypes)
    spark, found = docs.sparkSession, None
    for number in range(max(count, 1)):
        held = spark.sparkContext.broadcast([(r["item_id"], r["w"]) for r in asked.where(c("slice") == number).select("item_id", "w").collect()])  # about slice_words

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            runs = ItemRuns(held.value)
            for batch in batches:
                for surface, key, words in zip(batch.column("surface").to_pylist(), batch.column("id").to_pylist(), batch.column(told), strict=True):
                    runs.read(words_of(words), (surface, key))
            out = [{"item_id": item, "run": n, "surface": key[0], "id": key[1]} for item, n, key in runs.result()]
            if out:
                yield pa.RecordBatch.from_pylist(out)

        some = docs.select("surface", "id", told).mapInArrow(run, f"item_id {kinds['item_id']}, run long, surface {kinds['surface']}, id {kinds['id']}")
        found = some if found is None else found.unionByName(some)
    best = F.min(F.struct((-c("run")).alias("less"), "surface", "id")).alias("x")
    return found.groupBy("item_id").agg(best).select("item_id", (-c("x.less")).cast("int").alias("run"), "x.surface", "x.id")


def pair_runs(pairs: DataFrame) -> DataFrame:
    """(pair_id, run): words in the longest run that a and b of pairs (pair_id, a, b), lists of words, share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [longest_run(a or [], b or []) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(runs, pa.int32())], ["pair_id", "run"])

    return pairs.select("pair_id", "a", "b").mapInArrow(run, f"pair_id {dict(pairs.dtypes)['pair_id']}, run int")


#: Shingles of items that a task may hold (some 100 bytes each).
LOCAL_SHINGLES = 2_000_000


class WordHashes(dict):
    """64-bit hash of a word, remembered between texts up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return value


def placed_shingles(words: list[str], n: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the runs of n words, by place."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    mixed = np.zeros(len(own) - n + 1, dtype=np.uint64)
    for k in range(n):
        mixed = (mixed ^ own[k : len(own) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _shingles(words: list[str], n: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the runs of n words, in order."""
    return np.unique(placed_shingles(words, n, hashes))


def shared_shingles(items: DataFrame, docs: DataFrame, n: int, local_shingles: int = LOCAL_SHINGLES) -> DataFrame | None:
    """(item_id, *key, shared, size): how many of an item's `size` distinct n-word shingles a document has, for those that share
    any; items are (item_id, a), documents (*key, t), words joined by one space. None where the items' words are too many for
    a task. Documents are read once; nothing but hits leaves a task."""
    key = [k for k in docs.columns if k != "t"]
    if (items.agg(F.sum(F.size(F.split("a", " ")))).first()[0] or 0) > local_shingles:
        return None
    asked = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["a"]) for r in items.select("item_id", "a").where("a is not null").collect()])  # at most local_shingles words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own = [(item, _shingles(a.split(), n, hashes)) for item, a in asked.value]
        grams = np.concatenate([np.zeros(0, dtype=np.uint64), *[g for _, g in own]])
        of = np.repeat(np.arange(len(own)), [len(g) for _, g in own])
        order = np.argsort(grams, kind="stable")
        grams, of = grams[order], of[order]
        for batch in batches:
            row, item, shared = [], [], []
            for i, text in enumerate(batch.column("t")):
                held = _shingles((text.as_py() or "").split(), n, hashes)
                low, high = np.searchsorted(grams, held), np.searchsorted(grams, held, side="right")
                some = high > low
                if some.any():
                    hit, count = np.unique(np.concatenate([of[lo:hi] for lo, hi in zip(low[some], high[some], strict=True)]), return_counts=True)
                    row += [i] * len(hit)
                    item += hit.tolist()
                    shared += count.tolist()
            rows = batch.select(key).take(pa.array(row, pa.int64()))
            columns = [pa.array([own[x][0] for x in item], items_type), *rows.columns, pa.array(shared, pa.int64()), pa.array([len(own[x][1]) for x in item], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", *key, "shared", "size"])

    kind = dict(items.dtypes)["item_id"]
    items_type = to_arrow_type(items.schema["item_id"].dataType)
    return docs.select(*key, "t").mapInArrow(run, ", ".join([f"item_id {kind}", *[f"{k} {t}" for k, t in docs.select(*key).dtypes], "shared long", "size int"]))


def held_shingles(items: DataFrame, docs: DataFrame, n: int, once: bool = False, local_shingles: int = LOCAL_SHINGLES) -> tuple[DataFrame, DataFrame] | None:
    """((item_id, g, p), (*key, g, p)): the n-word shingles of items (item_id, a) by place, and of documents (*key, t) those that
    an item has; words are joined by one space. once: of the documents (g) alone, each at most once a task. None where the
    items' words are too many for a task. Documents are read once; shingles that no item has never leave a task."""
    key = [k for k in docs.columns if k != "t"]
    if (items.agg(F.sum(F.size(F.split("a", " ")))).first()[0] or 0) > local_shingles:
        return None
    asked = docs.sparkSession.sparkContext.broadcast([r["a"] for r in items.select("a").where("a is not null").distinct().collect()])  # at most local_shingles words

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [placed_shingles((text.as_py() or "").split(), n, hashes) for text in batch.column("a")]
            yield _rows(batch, ["item_id"], found, [np.arange(len(g)) for g in found])

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        grams = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *[_shingles(a.split(), n, hashes) for a in asked.value]]))
        new = np.ones(len(grams), dtype=bool)
        for batch in batches:
            found, places = [], []
            for text in batch.column("t"):
                mine = placed_shingles((text.as_py() or "").split(), n, hashes)
                spot = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
                at = np.flatnonzero(grams[spot] == mine) if len(grams) else np.zeros(0, dtype=np.int64)
                if once:
                    spot = np.unique(spot[at])
                    mine, at = grams, spot[new[spot]]
                    new[at] = False
                found.append(mine[at])
                places.append(at)
            yield _rows(batch, [] if once else key, found, places)

    kinds = [] if once else [f"{k} {t}" for k, t in docs.select(*key).dtypes]
    one = items.select("item_id", "a").mapInArrow(own, f"item_id {dict(items.dtypes)['item_id']}, g long, p int")
    return one, docs.select(*key, "t").mapInArrow(held, ", ".join([*kinds, "g long, p int"]))


def _rows(batch: pa.RecordBatch, key: list[str], found: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
    """The rows (*key, g, p) of what each row of a batch was found to hold."""
    at = np.repeat(np.arange(batch.num_rows), [len(g) for g in found])
    rows = [batch.column(k).take(pa.array(at, pa.int64())) for k in key]
    flat = lambda parts, kind: np.concatenate([np.zeros(0, dtype=kind), *parts])
    return pa.RecordBatch.from_arrays([*rows, pa.array(flat(found, np.uint64).view(np.int64)), pa.array(flat(places, np.int64).astype(np.int32))], [*key, "g", "p"])
