"""Toxicity: nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Terms are the words of a text (ASCII lower-cased; letters, digits and all non-ASCII characters) and the 4- and 5-letter
pieces of them, so that inflected and misspelt forms meet. A term weighs TF-IDF, the document frequencies taken over all
documents, times what the labelled examples prove of it (`proven_lift`): the logarithm of how much more frequent it is in toxic
ones, shrunk by what chance explains at `errors` standard errors. Terms whose proven lift is below `least_lift` (1.42 times as
frequent) weigh nothing and so take no part in any cosine: function words that longer toxic texts have somewhat more often
would stand in every text. No term is left out by its rank or by a share. (Without that factor a few insults vanish among hundreds of other words, and the nearest
examples are those of the same language and length; README has the figures.)

Every text is compared with the examples: posting blocks have the largest weight they hold, blocks are visited in the order of
their upper bounds, and the search ends when no block left can reach the k-th neighbour, so the k nearest are exact; all
that tie with the last vote as well. Votes weigh by similarity; a prior of `prior_weight` votes at the base rate keeps
scores calibrated where neighbours are few or far.

The examples are a bounded sample: at most `most_examples` labelled rows for each label, the first in a hash order, of which
near copies (equal minwise shingle) count once. Everything else covers all rows.

Defined results: null, empty and termless texts get the prior's share of examples without terms; labels that are null are
ignored; with no labelled examples every score is 0; repeated label rows count once; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, window_hashes
from .decontamination import words_of
from .lm_scoring import held_out

BLOCK = 256


def pieces(word: bytes) -> set[bytes]:
    """The terms of a word: itself (marked), and its pieces of four and five characters."""
    text = word.decode("utf-8", "replace")
    out = {b"=" + word}
    for n in (4, 5):
        out.update(text[i : i + n].encode() for i in range(len(text) - n + 1))
    return out


class Terms(dict):
    """The chosen terms of a word, remembered between texts."""

    def __init__(self, chosen: dict[bytes, int]) -> None:
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = tuple(self.chosen[p] for p in pieces(word) if p in self.chosen)
        return got

    def counts(self, text: str | None) -> Counter[int]:
        out: Counter[int] = Counter()
        for word, n in Counter(words_of(text)).items():
            for term in self[word]:
                out[term] += n
        return out


class Index:
    """Block-max inverted index of unit vectors. Postings lie by term and example; an entry is a term's stretch of postings in
    one block of examples, with the largest weight there."""

    def __init__(self, vectors: list[dict[int, float]], labels: np.ndarray) -> None:
        sizes = [len(v) for v in vectors]
        term = np.fromiter((t for v in vectors for t in v), dtype=np.int32, count=sum(sizes))
        weight = np.fromiter((w for v in vectors for w in v.values()), dtype=np.float64, count=sum(sizes))
        self._fill(np.repeat(np.arange(len(vectors), dtype=np.int32), sizes), term, weight, labels)

    @classmethod
    def of_counts(cls, example: np.ndarray, term: np.ndarray, n: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> Index:
        """The index of rows (example, term, count) under term weights, as `unit` has them."""
        raw = (1 + np.log(n)) * weight[term]
        size = np.sqrt(np.bincount(example, raw * raw, len(labels)))
        out = cls.__new__(cls)
        out._fill(example, term, raw / size[example], labels)
        return out

    def _fill(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> None:
        self.labels, self.n = labels, len(labels)
        self.blocks = -(-self.n // BLOCK)
        order = np.lexsort((example, term))
        term, self.at, self.weight = term[order], example[order], weight[order]
        new = (np.diff(term, prepend=-1) != 0) | (np.diff(self.at // BLOCK, prepend=-1) != 0)
        first = np.flatnonzero(new).astype(np.int32)
        self.entry = np.append(first, np.int32(len(term)))  # where the postings of each entry begin
        self.block = self.at[first] // BLOCK
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.terms, of_term = np.unique(term[first], return_index=True)
        self.of_term = np.append(of_term, len(first))  # where the entries of each term begin

    def nearest(self, query: dict[int, float], k: int, first: int = 8) -> list[tuple[float, int]]:
        """(similarity, example) of what search() finds."""
        return list(zip(*(x.tolist() for x in self.search(query, k, first)), strict=True))

    def search(self, query: dict[int, float], k: int, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and numbers of the k most similar examples with a positive cosine, and of all that tie with the last of them.

        The blocks with the highest bounds are scored first; of the others only those whose bound reaches the k-th best so
        far are read, `first` and then four times as many at a time.
        """
        asked = np.fromiter(query, dtype=np.int64, count=len(query))
        weight = np.fromiter(query.values(), dtype=np.float64, count=len(query))
        spot = np.searchsorted(self.terms, asked)
        known = spot < len(self.terms)
        known[known] = self.terms[spot[known]] == asked[known]
        spot, weight = spot[known], weight[known]
        entries, by = _ranges(self.of_term[spot], self.of_term[spot + 1])
        if not len(entries):
            return np.zeros(0), np.zeros(0, dtype=np.int64)
        weight = weight[by]
        bound = np.bincount(self.block[entries], weight * self.top[entries], self.blocks)
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        score, done, least = np.zeros(self.n), 0, 0.0
        while done < len(order) and bound[order[done]] >= least - 1e-9:
            some = np.zeros(self.blocks, dtype=bool)
            some[order[done : done + first]] = True
            some &= bound >= least - 1e-9
            score += self._scored(entries, weight, some)
            done, first = done + first, 4 * first
            positive = score[score > 0]
            least = np.partition(positive, -k)[-k] if len(positive) >= k else 0.0
        hits = np.flatnonzero((score > 0) & (score >= least - 1e-9))
        hits = hits[np.lexsort((hits, -score[hits]))]
        return score[hits], hits

    def _scored(self, entries: np.ndarray, weight: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What these entries give to the examples of these blocks; no other postings are read."""
        inside = blocks[self.block[entries]]
        own = entries[inside]
        postings, by = _ranges(self.entry[own], self.entry[own + 1])
        return np.bincount(self.at[postings], weight[inside][by] * self.weight[postings], self.n)


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges first..end-1, one after another, and the range each belongs to."""
    sizes = end - first
    by = np.repeat(np.arange(len(first)), sizes)
    return np.arange(sizes.sum()) + (first - (np.cumsum(sizes) - sizes))[by], by


def unit(counts: Counter[int], weight: np.ndarray) -> dict[int, float]:
    raw = {t: (1 + math.log(n)) * weight[t] for t, n in counts.items()}
    size = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / size for t, w in raw.items()} if size else {}


def _examples(docs: DataFrame, labels: DataFrame, most_examples: int) -> DataFrame:
    """(doc_id, label) of the bounded sample (at most 2 * most_examples rows), near copies once."""
    known = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * most_examples ids

    def shape(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for value in batch.column("text"):
                own = hashes.of(words_of(value.as_py()))
                out.append(int(window_hashes(own, min(5, len(own))).min().view(np.int64)) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.int64())], ["doc_id", "label", "shape"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shapes = texts.mapInArrow(shape, f"doc_id {kind}, label int, shape long")
    return shapes.groupBy("label", "shape").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label")


def proven_lift(in_toxic: Column, in_clean: Column, toxic: int, clean: int, errors: float) -> Column:
    """What the examples prove of a term: the logarithm of how much more frequent it is in toxic ones, shrunk by the share of it
    that chance explains; zero or less if chance can explain all. By the likelihood ratio against one rate for both, which
    holds for terms that clean examples do not have at all. Terms that are rarer in toxic examples get a negative one."""
    rate = (in_toxic + in_clean) / F.lit(max(toxic + clean, 1))

    def part(count: Column, size: int, own: Column) -> Column:
        return F.when(count > 0, count * F.log(own / rate)).otherwise(0.0) + F.when(size - count > 0, (size - count) * F.log((1 - own) / F.greatest(1 - rate, F.lit(1e-300)))).otherwise(0.0)

    ratio = 2 * (part(in_toxic, toxic, in_toxic / max(toxic, 1)) + part(in_clean, clean, in_clean / max(clean, 1)))
    log_lift = F.log((in_toxic + 0.5) / (toxic + 1) * (clean + 1) / (in_clean + 0.5))
    return log_lift * F.greatest(1 - errors / F.sqrt(F.greatest(ratio, F.lit(1e-9))), F.lit(0.0))


def scores(
    docs: DataFrame, labels: DataFrame, k: int = 15, most_examples: int = 4_000, errors: float = 3.5, least_lift: float = 0.35, prior_weight: float = 0.25, threshold: float = 0.7
) -> DataFrame:
    """doc_id, held_out, score, predicted, n_votes (the k nearest examples and all that tie with the last), and evidence: the
    first k of them (doc_id, label, similarity)."""
    spark = docs.sparkSession
    one = materialize(_examples(docs, labels, most_examples), "examples")
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(one), "doc_id").dropDuplicates(["doc_id"]), "sample")  # bounded, as above

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, set[bytes]] = {}
        counts: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[0][t] for t in keys], pa.int64()), pa.array([counts[1][t] for t in keys], pa.int64())], ["term", "clean", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                own: set[bytes] = set()
                for word in set(words_of(text.as_py())):
                    if word not in seen:
                        seen[word] = pieces(word)
                    own |= seen[word]
                counts[label].update(own)
                if len(counts[0]) + len(counts[1]) > 1_000_000:
                    yield flush()
                    counts[0].clear()
                    counts[1].clear()
                    seen.clear()
        yield flush()

    sizes = {r.label: r.n for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    by_term = sample.mapInArrow(terms, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = proven_lift(F.col("toxic"), F.col("clean"), toxic, clean, errors)
    picked = by_term.withColumn("lift", lift).where(F.col("lift") >= least_lift).select("term", "lift").toArrow().sort_by("term")  # terms of the bounded sample
    chosen = {term: i for i, term in enumerate(picked.column("term").to_pylist())}
    lifts = picked.column("lift").to_numpy()
    shared = spark.sparkContext.broadcast(chosen)

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, df = Terms(shared.value), np.zeros(len(shared.value), dtype=np.int64)
        n = 0
        for batch in batches:
            for text in batch.column("text"):
                n += 1
                for t in own.counts(text.as_py()):
                    df[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(df))], pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["term", "df"])

    counted = docs.select("text").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # one row for each term
    df = np.zeros(len(chosen) + 1, dtype=np.int64)  # the last one is -1: all texts
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1) * lifts

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(shared.value)
        for batch in batches:
            counts = [own.counts(t.as_py()) for t in batch.column("text")]
            lists = [pa.array([list(x) for x in c], pa.list_(pa.int32())) for c in ([c.keys() for c in counts], [c.values() for c in counts])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), *lists], ["doc_id", "label", "terms", "n"])

    held = sample.mapInArrow(vectors, "doc_id long, label int, terms array<int>, n array<int>").where("size(terms) > 0 or label = 1").toArrow().sort_by("doc_id")  # bounded by most_examples
    full = pc.greater(pc.list_value_length(held.column("terms")), 0)
    examples = held.filter(full).combine_chunks()
    marks = examples.column("label").to_numpy().astype(np.int64)
    sizes = pc.list_value_length(examples.column("terms")).to_numpy()
    flat = lambda name: pc.list_flatten(examples.column(name)).to_numpy()
    found = Index.of_counts(np.repeat(np.arange(len(marks), dtype=np.int32), sizes), flat("terms"), flat("n"), idf, marks)
    index = spark.sparkContext.broadcast((found, examples.column("doc_id").to_pylist(), idf))
    base = float(marks.mean()) if len(marks) else 0.0
    bare_clean = clean - int((marks == 0).sum())
    bare_toxic = held.num_rows - len(marks)
    none = bare_toxic / max(bare_clean + bare_toxic, 1)
    del held, examples, flat, found

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(shared.value)
        found, ids, weights = index.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))
        for batch in batches:
            out, evidence, votes = [], [], []
            for text in batch.column("text"):
                counts = own.counts(text.as_py())
                near, who = found.search(unit(counts, weights), k) if counts and found.n else (np.zeros(0), np.zeros(0, dtype=np.int64))
                out.append(float((near @ found.labels[who] + prior_weight * base) / (near.sum() + prior_weight)) if len(near) else none)
                evidence.append([{"doc_id": ids[i], "label": int(found.labels[i]), "similarity": float(s)} for s, i in zip(near[:k], who[:k], strict=True)])
                votes.append(len(near))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32()), pa.array(votes, pa.int32()), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "predicted", "n_votes", "evidence"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return rows.mapInArrow(vote, "doc_id long, held_out boolean, score double, predicted int, n_votes int, evidence array<struct<doc_id:long,label:int,similarity:double>>")
