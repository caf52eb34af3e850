"""Target-distribution importance resampling over hashed word runs.

An untrained pre-tokenisation (one regex Split over the text with A-Z lower-cased) gives the words with their offsets. The
words of a text are laid end to end with one space between; every run of one to three words is then a window from one
word's start to another's end. The CRC-32 of a window follows from the running CRC at both offsets, since CRCs are linear:
no run is ever cut out. Windows fall into buckets by CRC; one histogram of the documents and one of the target texts give
each bucket its gain, and a document's weight is the sum of its windows' gains. Weights plus Gumbel noise from a hash of
doc_id rank the documents; the best five per cent are drawn without replacement.

Texts are read once; their windows' buckets, two bytes each, are written to the shared folder and read for the histogram
and again for the weights. Nothing but (doc_id, counts, weight, score) is shuffled; what reaches the driver are 10,000 counts. Ranks come from range partitions and their offsets.

Defined results: a null or wordless text has no features and weight 0; such rows and all of fewer than 20 words are never
drawn; rows that repeat a doc_id share its noise and are ranked one after the other (more weight first); without a doc_id
the noise is that of the empty id; an empty target gives gains against no counts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words of a text whose A-Z are lower-cased: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What ends a word in a text not yet lower-cased.
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
RUN = 3
BUCKETS = 10_000
LEAST_WORDS = 20
#: Code points of a text given to the pre-tokenizer at once; a piece ends where no word does not.
PIECE = 1 << 14


def _zero_bytes() -> np.ndarray:
    """Tables [n, k, v]: what n zero bytes make of a CRC whose byte k is v, for n up to 256."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    tables = np.empty((257, 4, 256), dtype=np.uint32)
    tables[0] = np.array([byte << np.uint32(8 * k) for k in range(4)])
    for n in range(1, 257):
        tables[n] = tables[n - 1] >> 8 ^ one[tables[n - 1] & 255]
    return tables


_SHIFT = _zero_bytes()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _SHIFT[n, 0, crc & 255] ^ _SHIFT[n, 1, crc >> 8 & 255] ^ _SHIFT[n, 2, crc >> 16 & 255] ^ _SHIFT[n, 3, crc >> 24]


class Splitter:
    """The pre-tokenizer: words of a text of any length, in pieces."""

    def __init__(self) -> None:
        from tokenizers import PreTokenizedString, Regex
        from tokenizers.pre_tokenizers import Split

        self._of, self._split = PreTokenizedString, Split(Regex(WORD), behavior="removed", invert=True)

    def pieces(self, text: str) -> Iterator[list[bytes]]:
        at = 0
        while at < len(text):
            end = len(text)
            if at + PIECE < end and (gap := _BREAK.search(text, at + PIECE)):
                end = gap.start()
            lowered = text[at:end].encode("utf-8").lower()  # bytes.lower() knows A-Z alone
            found = self._of(lowered.decode("utf-8"))
            self._split.pre_tokenize(found)
            yield [lowered[s:e] for _, (s, e), _ in found.get_splits("original", "byte")]
            at = end


def run_crcs(words: list[bytes], longest: int = RUN, first: int = 0) -> np.ndarray:
    """CRC-32 of every run of 1 to `longest` consecutive words, joined by one space, that ends at word `first` or later."""
    if not words:
        return np.zeros(0, dtype=np.uint32)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    crc32, crc, after = zlib.crc32, 0, []
    for word in words:  # the running CRC at the end of each word
        crc = crc32(word, crc)
        after.append(crc)
        crc = crc32(b" ", crc)
    at_end = np.array(after, dtype=np.uint32)
    space = np.uint32(zlib.crc32(b" "))
    at_start = np.concatenate([np.zeros(1, dtype=np.uint32), _shifted(at_end[:-1], np.ones(len(words) - 1, dtype=np.int64)) ^ space])
    found = []
    for n in range(1, min(longest, len(words)) + 1):
        lo, hi = np.arange(max(first - n + 1, 0), len(words) - n + 1), np.arange(max(first - n + 1, 0) + n - 1, len(words))
        size = ends[hi] - starts[lo]
        short = np.minimum(size, len(_SHIFT) - 1)
        value = at_end[hi] ^ _shifted(at_start[lo], short)
        for i in np.flatnonzero(size > short):
            value[i] = crc32(joined[starts[lo[i]] : ends[hi[i]]])
        found.append(value)
    return np.concatenate(found)


def features(text: str | None, split: Splitter) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the buckets of all its runs."""
    before: list[bytes] = []
    count, found = 0, []
    for piece in split.pieces(text or ""):
        if piece:
            words = before + piece
            count += len(piece)
            found.append((run_crcs(words, RUN, len(before)) % BUCKETS).astype("<u2"))
            before = words[-RUN + 1 :]
    return count, np.concatenate(found) if found else np.zeros(0, dtype="<u2")


def bucketed(texts: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, n_words and buckets: two bytes for each feature of the text."""
    names = [*keep, "n_words", "buckets"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter()
        for batch in batches:
            counts, found = zip(*(features(t.as_py(), split) for t in batch.column("text")), strict=True) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(counts, pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names)

    return texts.select(*keep, "text").mapInArrow(run, ", ".join([*[f"{k} {t}" for k, t in texts.select(*keep).dtypes], "n_words long", "buckets binary"]))


def histogram(rows: DataFrame) -> np.ndarray:
    """Counts of features by bucket over all rows of `buckets`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for x in batch.column("buckets"):
                counts += np.bincount(np.frombuffer(x.as_buffer(), dtype="<u2"), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, dtype=np.int64)
    for row in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]  # one row a bucket
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in target and source, rounded down."""
    s_all, t_all = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of rows (doc_id, n_words, buckets)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column("buckets")]
            counts, weights = [len(x) for x in found], [int(gain[x].sum()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(counts, pa.int64()), pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank, null for what is not drawn."""
    rows = materialize(bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "buckets")
    gain = gains(histogram(rows), histogram(bucketed(target)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share)))
    order = [(F.col("n_words") >= LEAST_WORDS).desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").desc(), F.col("n_features").asc()]
    scored = materialize(weighed(rows, gain).withColumn("score", score), "scored")
    # a place in the order is the place in a range partition plus the sizes of the partitions before it
    placed = materialize(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part, here = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum((F.col("n_words") >= LEAST_WORDS).cast("long")).alias("m")).collect()}
    drawn = percent * sum(r["m"] for r in sizes.values()) // 100
    starts = [0]
    for number in range(max(sizes, default=0)):  # one row a partition
        starts.append(starts[-1] + (sizes[number]["n"] if number in sizes else 0))
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), part.cast("int"))
    place = here + offset + 1
    return placed.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
