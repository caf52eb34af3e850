"""Held-out items against a corpus: what leaked, how closely, and over how much the scan looked.

Candidates come from a join on shingle hashes, so items and documents never meet all against all. Items are few; whether
their side is broadcast is left to Spark, which measures it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.scalars import leak_normal
from tidepool.operators.phrases import WordHashes, held_shingles, longest_shared, occurrences, pair_runs, placed_shingles, shared_shingles
from tidepool.sources.shared import kept, pieces

c = F.col


def words(text: Column) -> Column:
    return F.filter(F.split(leak_normal(text), " "), lambda w: w != "")


def _grams(w: Column, n: int) -> Column:
    """Hashes of the n-word shingles with their places, from 0: the words' hashes, shifted against each other and combined.

    Linear in the text: no slice of a long array is copied for each place.
    """
    h = F.transform(w, lambda x: F.xxhash64(x))
    size = F.size(w) - n + 1
    parts = [F.slice(h, k + 1, F.greatest(size, F.lit(0))) for k in range(n)]
    zipped = F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)])
    combined = F.transform(zipped, lambda z, i: F.struct(F.xxhash64(*[z[f"w{k}"] for k in range(n)]).alias("g"), i.alias("p")))
    return F.when(size < 1, F.array().cast("array<struct<g:bigint,p:int>>")).otherwise(combined)


def verbatim(items: DataFrame, docs: DataFrame, **how: int) -> DataFrame:
    """(item_id, surface, id): documents that hold an item's normalised text whole."""
    asked = items.select("item_id", leak_normal(c("stem")).alias("a"))
    told = docs.select("surface", "id", leak_normal(c("text")).alias("t"))
    return occurrences(asked, told, **how).join(asked, "a").select("item_id", "surface", "id").distinct()


def contained(items: DataFrame, docs: DataFrame, n: int = 5, least: float = 0.6, **how: int) -> DataFrame:
    """(item_id, surface, id, shared, containment): share of an item's shingles that a document has, from `least` on.

    Items that a task can hold go to the documents; more of them meet in a join on shingle hashes.
    """
    told = docs.select("surface", "id", leak_normal(c("text")).alias("t"))
    met = shared_shingles(items.select("item_id", leak_normal(c("stem")).alias("a")), told, n, **how)
    if met is None:
        asked = items.select("item_id", F.array_distinct(F.transform(_grams(words(c("stem")), n), lambda x: x["g"])).alias("gs")).where(F.size("gs") > 0).select("item_id", F.size("gs").alias("size"), F.explode("gs").alias("g"))
        held = docs.select("surface", "id", F.explode(F.array_distinct(F.transform(_grams(words(c("text")), n), lambda x: x["g"]))).alias("g"))
        met = held.join(asked, "g").groupBy("item_id", "surface", "id", "size").agg(F.count("*").alias("shared"))
    return met.withColumn("containment", c("shared") / c("size")).where(c("containment") >= least).select("item_id", "surface", "id", "shared", "containment")


def best_windows(candidates: DataFrame, items: DataFrame, docs: DataFrame, least: float = 0.6, n: int = 1) -> DataFrame:
    """(item_id, surface, id, best): the best Jaccard of the item's n-word shingles with those of a window of its own length, for candidates only.

    A document that is shorter than the item is one window. A window's distinct shingles are counted by position: a shingle
    counts in a window where it is the first of its kind, that is where its previous place lies before the window. So each
    place of a shingle covers a range of windows, and running sums over window starts give both set sizes.
    """
    candidates = kept(candidates.select("item_id", "surface", "id"))  # few, so that texts need not move to find theirs
    named = docs.join(candidates.select("surface", "id").distinct(), ["surface", "id"], "left_semi").select("surface", "id", leak_normal(c("text")).alias("t"))
    met = candidates.join(items.select("item_id", leak_normal(c("stem")).alias("a")), "item_id").join(named, ["surface", "id"]).where("a is not null and t is not null")
    kinds, key = dict(met.dtypes), ["item_id", "surface", "id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            own = [(placed_shingles(a.as_py().split(), n, hashes), placed_shingles(t.as_py().split(), n, hashes)) for a, t in zip(batch.column("a"), batch.column("t"), strict=True)]
            some = [i for i, (item, doc) in enumerate(own) if len(item) and len(doc)]
            best = [_best_window(np.unique(own[i][0]), own[i][1], len(own[i][0])) for i in some]
            yield pa.RecordBatch.from_arrays([*batch.select(key).take(pa.array(some, pa.int64())).columns, pa.array(best, pa.float64())], [*key, "best"])

    return met.select(*key, "a", "t").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), "best double"])).where(c("best") >= least)


def _best_window(item: np.ndarray, doc: np.ndarray, n: int) -> float:
    """The best Jaccard of an item's distinct shingles with a window of n of a document's, which are not none."""
    at = np.arange(len(doc))
    order = np.argsort(doc, kind="stable")
    before = np.full(len(doc), -1)
    again = doc[order[1:]] == doc[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    last = max(len(doc) - n, 0)
    first, end = np.maximum(np.maximum(at - n + 1, before + 1), 0), np.minimum(at, last) + 1
    some = first < end
    first, end, held = first[some], end[some], np.isin(doc[some], item).astype(np.float64)
    running = lambda weight: np.cumsum(np.bincount(first, weight, last + 2) - np.bincount(end, weight, last + 2))[: last + 1]
    size, shared = running(np.ones(len(first))), running(held)
    return float((shared / (len(item) + size - shared)).max())


def longest_runs(items: DataFrame, docs: DataFrame, n: int = 3, **how: int) -> DataFrame:
    """(item_id, surface, id, run): the longest common run of words of pairs that share n words in a row.

    Shared shingles lie on diagonals (place in document minus place in item); a run of words is an island on one. Shingles
    of items that a task can hold go to the documents, so that only those found there are joined.
    """
    told = docs.select("surface", "id", leak_normal(c("text")).alias("t"))
    found = held_shingles(items.select("item_id", leak_normal(c("stem")).alias("a")), told, n, **how)
    if found is None:
        found = [t.select(*key, F.explode(_grams(words(c(text)), n)).alias("x")).select(*key, "x.g", "x.p") for t, key, text in ((items, ["item_id"], "stem"), (docs, ["surface", "id"], "text"))]
    asked, held = found[0].withColumnRenamed("p", "ip"), found[1].withColumnRenamed("p", "dp")
    met = held.join(asked, "g").select("item_id", "surface", "id", "dp", (c("dp") - c("ip")).alias("diagonal"))
    line = Window.partitionBy("item_id", "surface", "id", "diagonal").orderBy("dp")
    islands = met.withColumn("island", c("dp") - F.row_number().over(line)).groupBy("item_id", "surface", "id", "diagonal", "island").agg(F.count("*").alias("length"))
    return islands.groupBy("item_id", "surface", "id").agg((F.max("length") + n - 1).cast("int").alias("run"))


def longest_shared_runs(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, run, surface, id): how many words in a row an item shares with the corpus at most, and where first."""
    return longest_shared(items.select("item_id", words(c("stem")).alias("w")), docs.select("surface", "id", leak_normal(c("text")).alias("t")))


def graded(hits: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with flags: the document is the item's own source, only the answer or only the id was found."""
    met = hits.join(items.select("item_id", "answer", *[x for x in ("source_id",) if x in items.columns]), "item_id")
    own = (c("source_id") == c("id")) if "source_id" in items.columns else F.lit(False)
    return met.withColumn("own_source", own).withColumn("counts", ~own)


def answer_hits(items: DataFrame, docs: DataFrame, least_length: int = 4, **how: int) -> DataFrame:
    """(item_id, n): documents that hold an item's answer as a word or run of words; counted, not graded."""
    asked = items.select("item_id", leak_normal(c("answer")).alias("a")).where(F.length("a") >= least_length)
    told = docs.select("surface", "id", leak_normal(c("text")).alias("t"))
    hits = occurrences(asked, told, **how).groupBy("a").agg(F.count("*").alias("n"))
    return asked.join(hits, "a").select("item_id", "n")


def denominators(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Per surface: documents, words, and item-document pairs that the scan stood for."""
    n = items.agg(F.count("*").alias("items"))
    sums = docs.groupBy("surface").agg(F.count("*").alias("docs"), F.sum(F.size(words(c("text")))).alias("words"))
    return sums.join(F.broadcast(n), F.lit(True), "left").select("surface", "docs", "words", (c("docs") * c("items")).alias("comparisons"))


def windows_shared(items: DataFrame, docs: DataFrame, n: int = 8, **how: int) -> DataFrame:
    """(item_id, windows): an item's n-word windows that occur anywhere in the documents. Windows of items that a task can hold go
    to the documents; more of them meet in a join."""
    told = docs.select("surface", "id", leak_normal(c("text")).alias("t"))
    found = held_shingles(items.select("item_id", leak_normal(c("stem")).alias("a")), told, n, once=True, **how)
    if found is None:
        found = [t.select(*key, F.explode(F.transform(_grams(words(c(text)), n), lambda x: x["g"])).alias("g")) for t, key, text in ((items, ["item_id"], "stem"), (docs, [], "text"))]
    asked, held = found[0].select("item_id", "g").distinct(), found[1].select("g").distinct()
    return asked.join(held, "g", "left_semi").groupBy("item_id").agg(F.count("*").alias("windows"))


#: Words that carry no content in the wording comparison.
STOP = tuple("a an and are as at be by for from in is it of on or that the this to was were which with".split())


def rewording(pairs: DataFrame) -> DataFrame:
    """(pair_id, run, overlap, distinct): pairs (pair_id, a, b, answer) share a run of words and a share of content words.

    The answer's words are left out of the overlap; a pair is reworded with a run of at most three and an overlap below half.
    """
    w = pairs.select("pair_id", words(c("a")).alias("aw"), words(c("b")).alias("bw"), words(c("answer")).alias("xw"))
    stop = F.array(*[F.lit(s) for s in STOP])
    content = lambda name: F.array_distinct(F.filter(name, lambda t: ~F.array_contains(F.concat(stop, c("xw")), t)))
    a, b = content("aw"), content("bw")
    overlap = F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    runs = pair_runs(w.select("pair_id", c("aw").alias("a"), c("bw").alias("b")))
    met = w.select("pair_id", overlap.alias("overlap")).join(runs, "pair_id", "left").withColumn("run", F.coalesce("run", F.lit(0)))
    return met.select("pair_id", "run", "overlap", ((c("run") <= 3) & (c("overlap") < 0.5)).alias("reworded"))
