"""MinHash near-dedup by chosen-path set similarity join.

Every text becomes its set of distinct 5-word shingles and 128 minwise values of it. Texts with equal sets form one
class, held by its smallest doc_id. The classes then run through independent trees: a node branches on the minwise
values at coordinates drawn from the node itself (1/lambda of them on average, as the chosen-path join prescribes), the
first node that is looked at is a path of two values (many texts share one, few share two without being near), a node of
at most `leaf_rows` classes is compared exhaustively on minwise sketches, and a node whose classes are all known to
belong together is dropped. A first batch of trees only seeds that knowledge, so that large groups of near copies
collapse before the second batch looks for everything else. A node that is still large at the last level is compared
block against block, each text first within the largest such node it is in; what two texts of one such node are to each
other is known from then on. What the trees connect is a superset of the groups (a pair is missed by a sketch with a
chance near 1e-5, by all trees with less than the documented recall allows); inside each such group the links are then
confirmed on the full shingle sets, every pair being either compared or already connected.

Defined results: null or wordless text has an empty set and links with nothing; a text of fewer than five words has one
shingle; repeated rows are in the same group; a table without rows gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_rows, ascii_lower_words, components, discard, materialize, window_hashes

COORDINATES = 128
_rng = np.random.default_rng(20_240_131)
_XOR = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)


def shingle_set(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; a shorter text is one shingle."""
    words = hashes.of(ascii_lower_words(text))
    return np.unique(window_hashes(words, min(k, len(words)))) if len(words) else words


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of 128 permutations of a set that is not empty."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        mixed = (low[at : at + 512, None] ^ _XOR) * _MULTIPLY
        np.minimum(out, mixed.min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, sketch): digest identifies the whole set, sig holds its 128 minwise values and
    sketch their last bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, digests, sigs, sketches = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), hashes, k)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig = minwise(s) if len(s) else None
                sigs.append(None if sig is None else sig.view(np.int32))
                sketches.append(None if sig is None else sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "digest", "sig", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig array<int>, sketch binary")


def sketch_threshold(similarity: float) -> int:
    """Equal sketch bytes that all but about one in 300,000 pairs of this similarity reach."""
    return math.floor(COORDINATES * similarity - 4.5 * math.sqrt(COORDINATES * similarity * (1 - similarity)))


def _agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """(a, b) of the pairs (rep, pivot, sketch, pivot_sketch) with at least this many equal sketch bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES) for c in ("sketch", "pivot_sketch"))
            near = pa.array((one == other).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(near), batch.column("pivot").filter(near)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _leaf_links(leaves: DataFrame, least: int) -> DataFrame:
    """Compares the members of each node exhaustively on sketches; a spanning forest of what agrees, per node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, rows in arrow_rows(batches, "node"):
            m = rows.num_rows
            if m < 2:
                continue
            reps, label = rows.column("rep").to_numpy(), rows.column("label").to_numpy().copy()
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(m, COORDINATES)
            for i in range(m - 1):
                apart = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                if not len(apart):
                    continue
                near = apart[(sketch[apart] == sketch[i]).sum(axis=1) >= least]
                for j in near:
                    if label[j] != label[i]:
                        a.append(reps[i])
                        b.append(reps[j])
                        label[label == label[j]] = label[i]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return leaves.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _children(node: Column, sig: Column, extra: float) -> Column:
    """The nodes that a class goes on to: one coordinate always, a second one in `extra` of the nodes."""

    def child(n: int) -> Column:
        at = F.pmod(F.xxhash64(node, F.lit(n)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(node, at, F.get(sig, at))

    second = F.pmod(F.xxhash64(node, F.lit(7)), F.lit(1000)) < int(1000 * extra)
    return F.array_distinct(F.when(second, F.array(child(0), child(1))).otherwise(F.array(child(0))))


def _blocks(rows: DataFrame, key: str, weight: Column, block: int) -> DataFrame:
    """Deals the members of each large group to blocks and pairs the blocks that can hold an unknown link.

    The most frequent label of a group holds no unknown link within itself, so its blocks only meet those of the other
    members. Adds `node`, the pair of blocks a row goes to; each row goes to as many as it has to meet.
    """
    per = rows.groupBy(key, "label").agg(F.sum(weight).alias("w"))
    main = per.groupBy(key).agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("all"))
    sized = main.select(
        F.col(key), F.col("top.label").alias("top_label"), F.ceil(F.col("top.w") / block).cast("int").alias("n_top"), F.ceil((F.col("all") - F.col("top.w")) / block).cast("int").alias("n_rest")
    ).where("n_rest > 0")
    dealt = rows.join(sized, key).withColumn("is_top", F.col("label") == F.col("top_label"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.when(F.col("is_top"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int"))
    rest = F.sequence(F.lit(0), F.col("n_rest") - 1)
    with_top = F.transform(rest, lambda j: F.xxhash64(F.lit("t"), F.col(key), F.col("own"), j))
    from_rest = F.transform(F.sequence(F.lit(0), F.col("n_top") - 1), lambda i: F.xxhash64(F.lit("t"), F.col(key), i, F.col("own")))
    among = F.transform(rest, lambda j: F.xxhash64(F.lit("r"), F.col(key), F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    # the blocks of the other members meet each other as well; a pair of them is needed once even if they are the same block
    return dealt.withColumn("node", F.explode(F.when(F.col("is_top"), with_top).otherwise(F.concat(from_rest, among)))).drop("top_label", "n_top", "n_rest", "is_top", "own")


def _sized(level: DataFrame, cuts: int = 64) -> DataFrame:
    """Adds to the rows (node, rep, label) of nodes that hold an unknown link their size n, least label (pivot) and the
    rows of their most frequent label (top). Joined by (node, slice of the members): a hot node stays dealt over tasks."""
    rows = level.withColumn("cut", F.pmod(F.xxhash64("rep"), F.lit(cuts)).cast("int"))
    each = rows.groupBy("node", "label").agg(F.count("*").alias("c"))
    per = each.groupBy("node").agg(F.sum("c").alias("n"), F.min("label").alias("pivot"), F.max("label").alias("high"), F.max("c").alias("top")).where("pivot < high")
    found = rows.select("node", "cut").distinct().join(per.drop("high"), "node")  # at most `cuts` rows of a node
    return rows.join(found, ["node", "cut"]).select("node", "rep", "label", "n", "pivot", "top")


def _shared(level: DataFrame) -> DataFrame:
    """The rows (node, rep) of nodes that hold two classes, and few others: most nodes hold one, whose row does not move again."""
    held = level.groupBy("node").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    return _likely(level, materialize(held.select("node"), "shared"), "node")


def _dense_links(ready: DataFrame, sketches: DataFrame, leaf_rows: int, least: int) -> list[DataFrame]:
    """Links inside nodes (node, rep, label, n) too large for one task, block against block.

    A text is often in many such nodes together with the same others. So each text is compared first within the largest
    of its nodes, its home; after that, two texts that share a home are as good as known to each other in every node.
    """
    homes = materialize(ready.groupBy("rep").agg(F.max_by("node", F.struct("n", "node")).alias("home"), F.first("label").alias("label")), "homes")
    within = _blocks(homes.select(F.col("home").alias("large"), "rep", "label"), "large", F.lit(1), leaf_rows)
    first = materialize(_leaf_links(within.join(sketches, "rep").select("node", "rep", "label", "sketch"), least), "links")
    across = ready.select(F.col("node").alias("large"), "rep").join(homes.select("rep", F.col("home").alias("label")), "rep")
    rest = _blocks(across, "large", F.lit(1), leaf_rows)
    return [first, materialize(_leaf_links(rest.join(sketches, "rep").select("node", "rep", "label", "sketch"), least), "links")]


def _relabelled(rows: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The rows with labels that the links found so far have joined replaced by one of them."""
    known = rows.select("rep", "label").distinct()
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    one, other = (known.withColumnRenamed("rep", end).withColumnRenamed("label", f"{end}_label") for end in ("a", "b"))
    edges = found.join(one, "a").join(other, "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    joined = components(edges).select(F.col("node").alias("label"), "root")
    return rows.join(joined, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def _trees(reps: DataFrame, labels: DataFrame | None, first: int, count: int, levels: int, leaf_rows: int, least: int, extra: float) -> DataFrame:
    """Candidate links (a, b) of `count` trees. Without labels only a seed: large nodes link with their smallest member."""
    if labels is None:
        known = reps.select("rep", F.col("rep").alias("label"))
    else:
        known = reps.select("rep").join(labels.select(F.col("node").alias("rep"), F.col("root").alias("label")), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    sigs, sketches = reps.select("rep", "sig"), reps.select("rep", "sketch")
    below = F.flatten(F.array(*[_children(F.xxhash64(F.lit(tree)), F.col("sig"), extra) for tree in range(first, first + count)]))
    of_root = F.explode(F.array_distinct(F.flatten(F.transform(below, lambda node: _children(node, F.col("sig"), extra))))).alias("node")
    level = _shared(sigs.select("rep", of_root))
    level = level.join(known, "rep") if labels is not None else level.withColumn("label", F.col("rep"))
    found: list[DataFrame] = []
    for depth in range(levels):
        live = materialize(_sized(level), "nodes")
        leaves = live.where(F.col("n") <= leaf_rows)
        found.append(materialize(_leaf_links(leaves.join(_likely(sketches, leaves, "rep"), "rep").select("node", "rep", "label", "sketch"), least), "links"))
        large = live.where(F.col("n") > leaf_rows)
        if large.isEmpty():
            break
        if labels is None:
            star = large.where("rep <> pivot").select("rep", "pivot").distinct().join(sketches, "rep").join(sketches.select(F.col("rep").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
            found.append(_agreeing(star.select("rep", "pivot", "sketch", "pivot_sketch"), least))
            break
        # a node that one label fills but for a few rows is compared now: those rows against all; so is what is left at the end
        last = depth == levels - 1
        ready = large if last else large.where(F.col("n") - F.col("top") <= leaf_rows)
        if not ready.isEmpty():
            found += _dense_links(ready, sketches, leaf_rows, least)
        more = large.where(F.col("n") - F.col("top") > leaf_rows)
        if last or more.isEmpty():
            break
        more = _relabelled(more.select("node", "rep", "label"), found)
        level = more.join(sigs, "rep").select("rep", "label", F.explode(_children(F.col("node"), F.col("sig"), extra)).alias("node"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def _confirm(groups: DataFrame, threshold: int, k: int) -> DataFrame:
    """True links of the rows (node, rep, label, text) of each node: every pair with different labels is compared on full
    sets or is connected already. Returns a spanning forest (a, b)."""

    def links(sets: list[np.ndarray], label: np.ndarray, reps: np.ndarray) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(np.unique(label, return_counts=True)[1][np.unique(label, return_inverse=True)[1]], kind="stable")
        label, reps, sizes, sets = label[order], reps[order], sizes[order], [sets[i] for i in order]
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(values), dtype=np.int32)
        for i in range(len(sets) - 1):
            apart = label[i + 1 :] != label[i]
            apart &= (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= threshold * np.maximum(sizes[i + 1 :], sizes[i])) & (sizes[i + 1 :] > 0) & (sizes[i] > 0)
            if not apart.any():
                continue
            own = flat[starts[i] : starts[i + 1]]
            mark[own] = 1
            if apart.sum() * 8 < len(apart):
                rows = np.flatnonzero(apart)
                shared = np.array([mark[flat[starts[i + 1 + r] : starts[i + 2 + r]]].sum() for r in rows])
            else:
                rows = np.arange(len(apart))
                shared = np.add.reduceat(mark[flat[starts[i + 1] :]], np.minimum(starts[i + 1 : -1] - starts[i + 1], len(flat) - starts[i + 1] - 1))
            mark[own] = 0
            both = sizes[i] + sizes[i + 1 + rows] - shared
            for r in rows[apart[rows] & (100 * shared >= threshold * both)]:
                if label[i + 1 + r] != label[i]:
                    yield int(reps[i]), int(reps[i + 1 + r])
                    label[label == label[i + 1 + r]] = label[i]
            if (label == label[0]).all():
                break

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, rows in arrow_rows(batches, "node"):
            if rows.num_rows < 2:
                continue
            sets = [shingle_set(t.as_py(), hashes, k) for t in rows.column("text")]
            found = list(links(sets, rows.column("label").to_numpy().copy(), rows.column("rep").to_numpy()))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _likely(rows: DataFrame, ids: DataFrame, key: str, bits: int = 2**24) -> DataFrame:
    """The rows whose key is among the ids, and few others: by a map of this many bits, broadcast as at most bits / 64 rows. What it
    lets through by chance, the join that follows drops."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    word, at = F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("at")
    held = ids.select(word, at).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits"))
    return rows.select("*", word, at).join(F.broadcast(held), "word").where(F.getbit("bits", F.col("at")) == 1).select(*rows.columns)


def near_duplicates(
    docs: DataFrame, threshold: int = 85, k: int = 5, seed_trees: int = 4, trees: int = 12, levels: int = 5, leaf_rows: int = 2048, block_shingles: int = 1_500_000
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    threshold: percentage of similarity from which on two sets link. trees: with 12 trees of mean branching 1/0.8 a link at
    the threshold is missed by all of them with a chance below 1 in 1000 (measured recall: README).
    """
    similarity = threshold / 100
    least, extra = sketch_threshold(similarity), 1 / 0.8 - 1
    signed = materialize(signatures(docs, k), "signatures")
    full = signed.where("digest is not null")
    reps = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.max("n_shingles").alias("n")), "reps")
    seeds = components(_trees(reps, None, 0, seed_trees, 1, leaf_rows, least, extra))
    more = _trees(reps, seeds, seed_trees, trees, levels, leaf_rows, least, extra)
    grouped = components(more.union(seeds.select(F.col("node").alias("a"), F.col("root").alias("b")))).select(F.col("node").alias("rep"), F.col("root").alias("grp"))
    grouped = materialize(grouped.join(reps.select("rep", "n"), "rep"), "grouped")
    weight = F.col("n") + 300  # many short texts make a large block as well
    sized = grouped.groupBy("grp").agg(F.ceil(F.sum(weight) / block_shingles).cast("int").alias("blocks"))
    told = _likely(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), grouped, "rep")  # texts outside groups do not move
    texts = told.join(grouped.join(sized, "grp").hint("merge"), "rep")  # the same plan at every size
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(0)
    pivot = (F.col("blocks") > 1) & (F.col("rep") == F.col("grp"))
    nodes = F.when(pivot, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("grp", b.cast("long")))).otherwise(F.array(F.xxhash64("grp", own.cast("long"))))
    texts = materialize(texts.select("rep", "text", "grp", "n", "blocks"), "texts")
    within = materialize(_confirm(texts.select(F.explode(nodes).alias("node"), "rep", F.col("rep").alias("label"), "text"), threshold, k), "within")
    links = components(within)
    large = texts.where("blocks > 1")
    if not large.isEmpty():
        labelled = large.join(links.withColumnRenamed("node", "rep"), "rep", "left").select("grp", "rep", F.coalesce("root", "rep").alias("label"), "n", "text")
        across = _confirm(_blocks(labelled, "grp", weight, block_shingles).select("node", "rep", "label", "text"), threshold, k)
        links = components(within.union(across))
    discard(texts)
    classes = reps.select("digest", "rep").join(links.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
