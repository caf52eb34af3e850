"""Benchmark decontamination by winnowing.

Fingerprints of a text are the minimal k-gram hashes of its sliding windows; with k = 5 and nine k-grams a window, every
13 words hold one. Around each document fingerprint that benchmark items have too, the 13-word windows that hold it are
looked up among the items' windows; a run of windows that occur is a hit of its whole length. Items of fewer than 13 words
are one window each: their whole n-gram is looked up at every position, once per length that occurs. Equal grams and long
runs of one word cost no more than other text.

Benchmark sets whose words fit `local_words` go to the tasks as one index of some 24 bytes a word, so documents are read
once and never shuffled. Beyond that size, documents and items meet in shuffle joins on fingerprints and windows.

Defined results: null or wordless documents have no words and no hits; null or wordless items never occur; repeated item
rows count once per item_id; items are compared as strings in the digest; an empty benchmark gives clean documents and
an empty table no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, materialize, window_hashes

GRAM = 5
#: Upper case to lower, ASCII letters and digits and all other code points kept, the rest to a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the minimal gram of every window. Of equals the rightmost counts, unless one that was chosen
    before lies in the window: a run of one word has a position for each window length, not for each word."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    chosen = np.arange(n) + window - 1 - views.argmin(axis=1)
    last = np.flatnonzero(np.append(np.diff(chosen) != 0, True))  # of the windows that chose a position
    at = chosen[last]
    if len(at) < 2 or (grams[at[1:]] != grams[at[:-1]]).all():
        return at
    kept = [at[0]]
    for position, end in zip(at[1:], last[1:], strict=True):
        if grams[position] != grams[kept[-1]] or end > kept[-1]:
            kept.append(position)
    return np.array(kept)


class _Windows:
    """Item windows of one length by their hash: the items (by number) that hold each."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray) -> None:
        order = np.lexsort((items, hashes))
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.first, self.items = np.append(first, len(order)), items[order]

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes are windows of items, and the numbers of those items."""
        spot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[spot] == hashes
        own = np.unique(spot[hit])
        return hit, np.unique(np.concatenate([np.zeros(0, np.int64), *[self.items[self.first[k] : self.first[k + 1]] for k in own]]))


class Index:
    """Fingerprints of the long items, and the windows of all items by length (`run` words, or all of a shorter item)."""

    def __init__(self, items: list[tuple[object, list[bytes]]], run: int = 13) -> None:
        self.run, hashes = run, WordHashes()
        self.names = list(dict.fromkeys(i for i, w in items if w))
        number = {name: at for at, name in enumerate(self.names)}
        prints: list[np.ndarray] = []
        windows: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for name, words in items:
            if not words:
                continue
            h = hashes.of(words)
            n = min(len(h), run)
            windows[n].append((np.unique(window_hashes(h, n)), number[name]))
            if n == run:
                grams = window_hashes(h, GRAM)
                prints.append(grams[winnow(grams, run - GRAM + 1)])
        self.keys = np.unique(np.concatenate(prints)) if prints else np.zeros(0, dtype=np.uint64)
        self.windows = {n: _Windows(np.concatenate([w for w, _ in found]), np.repeat([i for _, i in found], [len(w) for w, _ in found])) for n, found in windows.items()}

    def hits(self, h: np.ndarray) -> tuple[int, set[object]]:
        """Words of a document (by hash) inside any occurrence of an item window, and the items that occur.

        A window that occurs holds a fingerprint of the document that is one of the items' too; so only the windows around
        shared fingerprints are looked up.
        """
        edges = np.zeros(len(h) + 1, dtype=np.int64)
        found: set[object] = set()
        for n, windows in self.windows.items():
            if len(h) < n:
                continue
            if n == self.run:
                starts = shared_windows(h, self.keys, n)
                hashes = window_hashes(np.ascontiguousarray(h[starts[:, None] + np.arange(n)]).T, n)[0] if len(starts) else np.zeros(0, np.uint64)
            else:
                starts, hashes = np.arange(len(h) - n + 1), window_hashes(h, n)
            if not len(starts):
                continue
            hit, items = windows.found(hashes)
            edges[starts[hit]] += 1
            edges[starts[hit] + n] -= 1
            found.update(self.names[i] for i in items)
        return int((np.cumsum(edges[:-1]) > 0).sum()), found


def shared_windows(h: np.ndarray, keys: np.ndarray, run: int) -> np.ndarray:
    """Starts of the windows of a document that hold one of its fingerprints that is among the keys."""
    grams = window_hashes(h, GRAM)
    marks = winnow(grams, run - GRAM + 1)
    marks = marks[np.isin(grams[marks], keys)]
    starts = np.unique((marks[:, None] - np.arange(run - GRAM + 1)).ravel())
    return starts[(starts >= 0) & (starts <= len(h) - run)]


def _digest(found: set[object]) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _result(ids: pa.Array, rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    n, hit, items, digest = ([r[i] for r in rows] for i in range(4))
    bad = [b > 0 and 20 * b >= a for a, b in zip(n, hit, strict=True)]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())], [c.split()[0] for c in _OUT.split(", ")])


def contamination(docs: DataFrame, benchmark: DataFrame, local_words: int = 2_000_000, run: int = 13) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper = F.regexp_count(F.lower("text"), F.lit(pattern))
    size = benchmark.agg(F.coalesce(F.sum(upper), F.lit(0)).alias("n")).first()["n"]
    if size > local_words:
        return _joined(docs, benchmark, run)
    spark = docs.sparkSession
    items = [(r.item_id, words_of(r.text)) for r in benchmark.select("item_id", "text").distinct().toLocalIterator()]  # at most local_words
    shared = spark.sparkContext.broadcast(Index(items, run))

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = shared.value, WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hit, found = index.hits(hashes.of(words)) if words else (0, set())
                rows.append((len(words), hit, len(found), _digest(found)))
            yield _result(batch.column("doc_id"), rows)

    return docs.select("doc_id", "text").mapInArrow(go, _OUT)


def _joined(docs: DataFrame, benchmark: DataFrame, run: int, cuts: int = 16) -> DataFrame:
    """The same rows by shuffle joins: neither side is held whole anywhere, and no text travels.

    Documents give their fingerprints with the hashes of the windows around them. Those whose fingerprint the items have
    are exploded to windows, which meet the items' windows by hash. Both joins deal a key's documents to `cuts` slices.
    """
    window = "array<struct<at:int,w:bigint>>"
    kind = pa.list_(pa.struct([("at", pa.int32()), ("w", pa.int64())]))
    lengths = [n for n in range(1, run)]

    def of_docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                h = hashes.of(words_of(text.as_py()))
                grams, all_windows = window_hashes(h, GRAM), window_hashes(h, run)
                marks = winnow(grams, run - GRAM + 1)
                spans = [np.arange(max(p - run + GRAM, 0), min(p, len(h) - run) + 1) for p in marks]
                near = [[{"at": int(i), "w": int(all_windows[i].view(np.int64))} for i in span] for span in spans]
                parts = [pa.array([doc], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([grams[marks].view(np.int64)], pa.list_(pa.int64())), pa.array([near], pa.list_(kind))]
                yield pa.RecordBatch.from_arrays([*parts, pa.array([h.view(np.int64)], pa.list_(pa.int64()))], ["doc_id", "n_words", "keys", "near", "words"])

    def of_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                h = hashes.of(words_of(text.as_py()))
                if n := min(len(h), run):
                    grams = window_hashes(h, GRAM) if n == run else h[:0]
                    prints = np.unique(grams[winnow(grams, run - GRAM + 1)]) if n == run else grams
                    lists = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (prints, np.unique(window_hashes(h, n)))]
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([n], pa.int32()), *lists], ["item", "n", "prints", "windows"])

    numbered = materialize(docs.select("doc_id", "text").mapInArrow(of_docs, f"doc_id long, n_words long, keys array<long>, near array<{window}>, words array<long>").withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    items = materialize(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").distinct().mapInArrow(of_items, "item string, n int, prints array<long>, windows array<long>"), "items")
    cut = F.pmod(F.col("row"), F.lit(cuts)).cast("int")
    cut_all = F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))
    prints = items.select(F.explode("prints").alias("key")).distinct().withColumn("cut", cut_all)
    marked = numbered.select("row", cut.alias("cut"), F.inline(F.arrays_zip("keys", "near"))).withColumnRenamed("keys", "key").join(prints, ["key", "cut"], "left_semi")
    long = marked.select("row", "cut", F.inline("near")).select("row", "cut", "at", F.lit(run).alias("n"), "w").distinct()
    used = sorted(r.n for r in items.select("n").distinct().where(F.col("n").isin(lengths)).collect())  # fewer than `run` values

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in zip(batch.column("row").to_pylist(), batch.column("words").to_pylist(), strict=True):
                h = np.array(words, dtype=np.int64).view(np.uint64)
                for n in used:
                    w = window_hashes(h, n).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), row)), pa.array(np.arange(len(w), dtype=np.int32)), pa.array(np.full(len(w), n, dtype=np.int32)), pa.array(w)], ["row", "at", "n", "w"])

    if used:
        long = long.union(numbered.select("row", "words").mapInArrow(short, "row long, at int, n int, w long").select("row", cut.alias("cut"), "at", "n", "w"))
    held = items.select("item", "n", F.explode("windows").alias("w")).withColumn("cut", cut_all)
    met = materialize(long.join(held, ["n", "w", "cut"]).select("row", "at", "n", "item"), "met")
    # words inside any window: starts and ends summed along each document's touched places
    steps = met.select("row", "at", "n").distinct().select("row", F.inline(F.array(F.struct(F.col("at").alias("p"), F.lit(1).alias("d")), F.struct((F.col("at") + F.col("n")).alias("p"), F.lit(-1).alias("d")))))
    line = Window.partitionBy("row").orderBy("p")
    depth = steps.groupBy("row", "p").agg(F.sum("d").alias("d")).select("row", "p", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lead("p").over(line).alias("to"))
    hits = depth.where("depth > 0").groupBy("row").agg(F.sum(F.col("to") - F.col("p")).cast("long").alias("n_hit"))
    names = met.select("row", "item").distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = numbered.select("row", "doc_id", "n_words").join(hits, "row", "left").join(names, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    digest = F.coalesce("items_sha256", F.lit(_digest(set())))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), digest.alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))
