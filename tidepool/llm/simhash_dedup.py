"""SimHash near-dedup by anchor-point covering.

A text's fingerprint has 64 bits; two link where at most `distance` of them differ. The bits are cut into three parts, so
two linked fingerprints differ in at most distance // 3 bits of one part. The anchors of a part are the 4,096 words of the
binary Golay code: every 23-bit word is within covering radius 3 of exactly one of them, its home. Each fingerprint goes, in
every part, to all anchors within 3 + distance // 3 (some five each); at an anchor those at home there are compared with
all that came. If x and y are alike in a part, y comes to x's home, so no link is missed; all 64 bits decide.

Equal fingerprints are one class before anything is copied. A class takes about 16 short rows whatever the table; anchors
with many rows are compared block by block, the blocks dealt over all tasks, and a block hands on a spanning forest of
its links. The comparisons number n * n / 256 for n classes that lie evenly.

Defined results: a null or wordless text has fingerprint zero and links like any other; a text of fewer than four words is
one shingle; repeated rows are in one component; rows without a doc_id take part and a component of such rows alone has a
null component_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, ascii_lower_words, components, materialize

#: First bit and width of the three parts of a fingerprint.
PARTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS, CODE_DIMENSION, CODE_RADIUS = 23, 12, 3
#: Generator of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str | None, k: int = 4, step: int = 1 << 16) -> int:
    """The SimHash of a text, unsigned: a bit is 1 if it is set in over half the hashes of the text's k-word shingles."""
    words = ascii_lower_words(text)
    if not words:
        return 0
    joined, n = b" ".join(words), max(len(words) - k + 1, 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(k, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, step):
        some = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + step], ends[at : at + step], strict=True)], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp), fp the 64 bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders of polynomials over two elements by the generator: the syndromes."""
    left = words.copy()
    for bit in range(CODE_BITS - 1, CODE_BITS - CODE_DIMENSION - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - CODE_BITS + CODE_DIMENSION), 0)
    return left


@cache
def _patterns(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the bit patterns of at most `reach` ones that lead from a word to an anchor, lightest first, as rows
    padded with -1; the first of a row leads home. Also the syndromes of all words."""
    flips = np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(CODE_BITS), n)])
    syndromes = _remainder(flips)
    order = np.argsort(syndromes, kind="stable")
    counts = np.bincount(syndromes, minlength=1 << (CODE_BITS - CODE_DIMENSION))
    table = np.full((len(counts), counts.max()), -1, dtype=np.int64)
    inside = np.arange(len(flips)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[syndromes[order], inside] = flips[order]
    return table, _remainder(np.arange(1 << CODE_BITS))


def anchors(fps: np.ndarray, part: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, at home) for every anchor of the part that the unsigned fingerprints go to."""
    first, width = PARTS[part]
    words = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
    table, syndromes = _patterns(CODE_RADIUS + distance // len(PARTS))
    flips = table[syndromes[words]]
    row, column = np.nonzero(flips >= 0)
    return row, words[row] ^ flips[row, column], column == 0


def _cell(anchor: np.ndarray, part: int) -> np.ndarray:
    """The number of an anchor of a part: a word of a cyclic code is told by as many bits in a row as its dimension."""
    return anchor >> CODE_BITS - CODE_DIMENSION << 2 | part


def _cells(distance: int, split: dict[int, tuple[int, int]], block_rows: int):
    """Rows (cell, home, fp) of fingerprints at their anchors. A cell in `split` (its rows, those at home) becomes one cell for
    each pair of a block of its rows and a block of those at home."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                fps = whole.column("fp")[at : at + 8192].to_numpy().view(np.uint64)
                for part in range(len(PARTS)):
                    row, anchor, home = anchors(fps, part, distance)
                    cell = _cell(anchor, part) << 32
                    if split:
                        large = np.isin(cell >> 32, list(split))
                        made = [(cell[~large], home[~large], row[~large])]
                        for c in np.unique(cell[large] >> 32):
                            total, homes = split[int(c)]
                            here = np.flatnonzero(cell >> 32 == c)
                            n, m = -(-total // block_rows), -(-homes // block_rows)
                            dealt = (fps[row[here]] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
                            for i in range(m):  # a row of its own kind for every block at home
                                made.append((cell[here] | 1 + (dealt % n) * m + i, np.zeros(len(here), bool), row[here]))
                            own = here[home[here]]
                            for j in range(n):
                                made.append((cell[own] | 1 + j * m + dealt[home[here]] % m, np.ones(len(own), bool), row[own]))
                        cell, home, row = (np.concatenate(x) for x in zip(*made, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), pa.array(fps[row].view(np.int64))], ["cell", "home", "fp"])

    return run


def _linked(distance: int):
    """A spanning forest (a, b) of the links in each cell of the rows (cell, home, fp), which come sorted by cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for _, rows in arrow_rows(batches, "cell"):
            fps, home = rows.column("fp").to_numpy().view(np.uint64), rows.column("home").to_numpy()
            label = np.unique(fps, return_inverse=True)[1]  # a row at home may also be among those that came
            for i in np.flatnonzero(home):
                near = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= distance) & (label != label[i]))
                if len(near):
                    joined, first = np.unique(label[near], return_index=True)
                    a.append(np.full(len(first), fps[i]))
                    b.append(fps[near[first]])
                    label[np.isin(label, joined)] = label[i]
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return run


def links(classes: DataFrame, distance: int = 4, block_rows: int = 8192) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints `fp` that differ in at most `distance` bits."""
    if distance // len(PARTS) + CODE_RADIUS >= CODE_BITS - CODE_DIMENSION:
        raise ValueError("the distance is too large for this code")

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 4 << CODE_DIMENSION), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                for part in range(len(PARTS)):
                    _, anchor, home = anchors(whole.column("fp")[at : at + 8192].to_numpy().view(np.uint64), part, distance)
                    cell = _cell(anchor, part)
                    found[0] += np.bincount(cell, minlength=found.shape[1])
                    found[1] += np.bincount(cell[home], minlength=found.shape[1])
        used = np.flatnonzero(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[0][used]), pa.array(found[1][used])], ["cell", "n", "m"])

    each = classes.select("fp").mapInArrow(sizes, "cell long, n long, m long")
    # at most 3 * 4,096 cells, whatever the table
    split = {r["cell"]: (r["n"], max(r["m"], 1)) for r in each.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("n") > block_rows).collect()}
    cells = classes.select("fp").mapInArrow(_cells(distance, split, block_rows), "cell long, home boolean, fp long")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linked(distance), "a long, b long")


def simhash_duplicates(docs: DataFrame, distance: int = 4, k: int = 4, block_rows: int = 8192) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    signed = materialize(fingerprints(docs, k), "fingerprints")
    classes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, distance, block_rows)).select(F.col("node").alias("fp"), "root")
    rooted = materialize(classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
