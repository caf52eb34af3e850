"""LM scoring with a probabilistic suffix tree over the words of texts.

A text is its words (A-Z lower-cased) and one end, each a symbol. The states of the tree are contexts of one to `longest`
words, the root, and, below the root, the contexts of up to five letters by which a symbol is spelled:

* A context's next symbols count if they follow it at least twice in the training texts. The context is retained if the
  divergence of these from the root's distribution, times its count, reaches `gain` nats.
* A longer context counts likewise against the context one word shorter. It is looked at only if some longer context can reach
  `gain` at all: the divergence of no extension of a context s passes the sum of c * log(n(s) / c) over its counts c.
* The root mixes the count of every training word with the spelling of a symbol, weighted by the number of distinct words.
* Spelling contexts are learned from the distinct training words, letter by letter; they too are retained by divergence.

Every distribution is smoothed by that of its state's parent, the longest retained suffix, and sums to one. A symbol is
scored in the longest retained suffix of what precedes it. Words, pairs and longer grams are counted over all training texts, at any size: the tree grows with the
corpus. Counts of words are exact; pairs stand by 40 bits of their words' hashes, so of 1e9 distinct words about one in 2,000
shares its bits with another; contexts of more words stand by 48 bits. Only the spelling contexts are bounded, since they are broadcast: at most 1 / least_share next letters for each
length of context, 16 bytes each (40 MB in all at the default), beside at most 1 / word_share frequent words.

The plan: texts are packed into chunks of some million tokens, each with its own vocabulary. The distinct pairs of
neighbours of a chunk go to buckets by a hash of the second word (by the pair, if that is frequent), packed into arrays.
A bucket adds up the pairs of all chunks, answers each chunk with the counts that matter, and sums what the
divergence of its contexts needs. Words and contexts are ordinary tables. Chunks are scored once answers have joined them.
Contexts of two words, then of three and so on, take a round each: a chunk sends its grams to buckets by the context, which
holds all that the context's state needs. Tables of chunks and of questions are written in slices; a slice is shuffled and then
removed, before the next one is, so that none of them lies on the disk twice. A context too frequent for a bucket is dealt by its grams; its sums are collected (at
most 1 / word_share contexts a round). A place whose context can have no longer state leaves the rounds with its score.

Defined results: null and empty texts are the end symbol alone; a null doc_id counts as training; repeated rows are trained
on and scored each; with no training rows only the spelling of an empty tree is left; an empty table gives no rows; a text
is held whole by one task, however long; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidepool.sources.shared import removed

from .common import discard, materialize, shared_dir

ORDER = 5
_END = b"\n"
_SYMBOL = np.uint64(8)


def _mask(symbols: int) -> int:
    return (1 << (8 * symbols)) - 1


def grams(buffer: bytes, starts: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-grams that end at each symbol of the texts in a buffer, and where each text's first one is.

    Each text in the buffer stands behind ORDER end symbols, its context; `starts` are the places of those.
    """
    raw = np.frombuffer(buffer, dtype=np.uint8)
    n = len(raw) - ORDER
    out = np.zeros(n, dtype=np.uint64)
    for j in range(ORDER + 1):
        out <<= _SYMBOL
        out |= raw[j : j + n]
    keep = np.ones(n, dtype=bool)
    for at in range(1, ORDER + 1):  # those that end inside the next text's context
        rest = np.asarray(starts[1:], dtype=np.int64) - at
        keep[rest[rest >= 0]] = False
    first = np.asarray(starts, dtype=np.int64) - ORDER * np.arange(len(starts))
    return out[keep], first


class Tree:
    """The retained spelling contexts and their next letters, as sorted arrays per length of context."""

    def __init__(self, root: np.ndarray, contexts: list[tuple[np.ndarray, np.ndarray]], entries: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.root, self.contexts, self.entries = root, contexts, entries

    def log10(self, found: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last symbol of each gram after the others."""
        encoded = pa.array(found).dictionary_encode()
        sort = np.argsort(encoded.dictionary.to_numpy())
        keys, number = encoded.dictionary.to_numpy()[sort], np.empty(len(sort), dtype=np.int32)
        number[sort] = np.arange(len(sort), dtype=np.int32)
        at, out = number[encoded.indices.to_numpy()], np.zeros(len(keys))
        left = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            (contexts, back), (entries, chance) = self.contexts[order], self.entries[order]
            if not len(contexts) or not len(left):
                continue
            key = keys[left] & np.uint64(_mask(order + 1))
            spot = np.minimum(np.searchsorted(entries, key), len(entries) - 1)
            hit = entries[spot] == key
            out[left[hit]] += chance[spot[hit]]
            left, key = left[~hit], key[~hit]
            own = key >> _SYMBOL
            spot = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            out[left] += np.where(contexts[spot] == own, back[spot], 0.0)
        out[left] += self.root[(keys[left] & np.uint64(0xFF)).astype(np.int64)]
        return out[at]


def _column(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [got.column(c).to_numpy() for c in names]


def grow(counts: DataFrame, least_share: float, gain: float) -> Tree:
    """The tree of a table of gram counts (key, n)."""
    by: list[DataFrame] = [counts.select(F.col("key").alias("g"), F.col("n").alias("c"))]
    for order in range(ORDER - 1, -1, -1):
        by.insert(0, materialize(by[0].groupBy(F.col("g").bitwiseAND(F.lit(_mask(order + 1)).cast("long")).alias("g")).agg(F.sum("c").alias("c")), f"order{order}"))
    total = by[0].agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]
    root = np.full(256, 0.5)
    g, c = _column(by[0], "g", "c")  # at most 256 rows
    root[g] += c
    root = root / root.sum()
    least = max(1.0, least_share * total)
    context = lambda g: F.shiftright(g, 8)
    shorter = lambda g, symbols: g.bitwiseAND(F.lit(_mask(symbols)).cast("long"))
    sums = [b.groupBy(context(F.col("g")).alias("s")).agg(F.sum("c").alias("sum")) for b in by]
    kept: list[DataFrame] = []
    wanted: list[DataFrame] = []
    for order in range(1, ORDER + 1):
        often = by[order].where(F.col("c") >= least).withColumn("s", context(F.col("g")))
        parents = by[order - 1].where(F.col("c") >= least).select(F.col("g").alias("pg"), F.col("c").alias("pc"))
        sized = often.join(sums[order], "s").join(parents, shorter(F.col("g"), order) == F.col("pg")).withColumn("ps", shorter(F.col("s"), order - 1))
        sized = materialize(sized.join(sums[order - 1].select(F.col("s").alias("ps"), F.col("sum").alias("psum")), "ps").select("g", "c", "s", "sum", "pc", "psum"), f"often{order}")
        kept.append(sized)
        divergence = F.sum(F.col("c") * F.log(F.col("c") / F.col("sum") * F.col("psum") / F.col("pc")))
        wanted.append(sized.groupBy("s").agg(divergence.alias("d")).where(F.col("d") >= gain).select("s"))
    for order in range(ORDER, 1, -1):
        wanted[order - 2] = wanted[order - 2].union(wanted[order - 1].select(shorter(F.col("s"), order - 1).alias("s"))).distinct()
    contexts, entries = [(np.zeros(0, np.uint64), np.zeros(0))], [(np.arange(256, dtype=np.uint64), root)]
    for order in range(1, ORDER + 1):
        g, c, s, size = _column(kept[order - 1].join(wanted[order - 1], "s", "left_semi"), "g", "c", "s", "sum")
        by_key = np.argsort(g)
        g, c, s, size = g[by_key].astype(np.uint64), c[by_key], s[by_key].astype(np.uint64), size[by_key]
        own, first, kinds = np.unique(s, return_index=True, return_counts=True)  # g, and so s, is sorted
        seen = np.add.reduceat(c, first) if len(first) else np.zeros(0)
        spare = kinds + size[first] - seen  # what the parent's distribution gets: one for each kind, and what is too rare to list
        back = spare / (size[first] + kinds)
        at = np.searchsorted(own, s)
        above, chance = entries[order - 1]
        spot = np.searchsorted(above, g & np.uint64(_mask(order)))
        entries.append((g, (c + spare[at] * chance[spot]) / (size + kinds[at]) if len(g) else np.zeros(0)))
        contexts.append((own, back))
    logs = lambda pair: (pair[0], np.log10(pair[1]))
    return Tree(np.log10(root), [logs(p) for p in contexts], [logs(p) for p in entries])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (A-Z lower-cased), one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    word = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one there
    before = np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    return words.filter(word).cast(pa.large_binary()), np.diff(before[at])


def _listed(words: pa.Array) -> bytes:
    """Words, of which there is one at least, in one piece with line ends between."""
    words = words.cast(pa.large_binary())
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(b"\n", pa.large_binary()))[0].as_py()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the order of keys, and for each place the number of its key among them."""
    order = np.argsort(keys)
    found = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    of = np.empty(len(keys), dtype=np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], of


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket that keeps the order within a bucket, and the buckets in it. Small numbers are sorted by their digits."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order.astype(np.int32), bucket[order].astype(np.int64)


#: Words stand by 40 bits of their hash where pairs are counted; their own counts are exact, by the words themselves. Of a
#: thousand million words about one in 2,000 shares its bits, and its contexts' sums, with another.
_BYTES = 5
_SHORT = np.uint64((1 << 8 * _BYTES) - 1)


def _pack(values: np.ndarray, size: int = 4) -> bytes:
    """Integers of `size` bytes, byte planes apart, so that bytes that are mostly zero compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unpack(data: bytes, size: int = 4) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """Chunks of texts: ids, folds and sizes of the documents, the words used (an end is the empty word, number 0) and their
    hashes, and all symbols by number."""
    fields = [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("hashes", pa.binary()), ("symbols", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, held, sizes, words, total = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate(sizes)) - 1
            numbered = pa.concat_arrays([pa.array([b""], pa.large_binary()), *words]).dictionary_encode()  # in the order of their first use
            symbols, word = np.zeros(ends[-1] + 1, dtype=np.uint32), np.ones(ends[-1] + 1, dtype=bool)
            word[ends] = False
            symbols[word] = numbered.indices.to_numpy()[1:]
            used = _listed(numbered.dictionary)
            row = [[chunk], [ids], [held], [np.concatenate(sizes)], [_squeezed(used)], [_hashes(used.split(b"\n")).tobytes()], [_squeezed(_pack(symbols))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(row, fields, strict=True)], [n for n, _ in fields])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                own, counts = _split(some.column("text"))
                number, fold, at = some.column("doc_id").to_pylist(), some.column("held_out").to_pylist(), 0
                ends = np.cumsum(counts)
                while at < len(counts):
                    texts = np.cumsum(counts[at:] + 1)
                    to = at + min(int(np.searchsorted(texts, chunk_tokens - total)) + 1, len(texts))
                    first = int(ends[at] - counts[at])
                    ids += number[at:to]
                    held += fold[at:to]
                    sizes.append(counts[at:to] + 1)
                    words.append(own.slice(first, int(ends[to - 1]) - first))
                    total, at = total + int(texts[to - at - 1]), to
                    if total >= chunk_tokens:
                        yield close()
                        chunk, total, ids, held, sizes, words = chunk + 1, 0, [], [], [], []
                        pa.default_memory_pool().release_unused()
        if ids:
            yield close()
        words, own, some = [], None, None
        pa.default_memory_pool().release_unused()  # else idle workers keep it

    return docs.mapInArrow(run, "chunk long, ids array<long>, held array<boolean>, sizes array<long>, vocabulary binary, hashes binary, symbols binary")


def _hashes(words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words))


class _Chunk:
    """The symbols of a chunk and their pairs: `code` lists the distinct pairs (next, previous), `of` the pair of each symbol."""

    def __init__(self, row: dict, pairs: bool = True) -> None:
        self.words = _whole(row["vocabulary"]).split(b"\n") if row.get("vocabulary") else []
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.short = self.hashes & _SHORT
        self.symbols, self.sizes = _unpack(_whole(row["symbols"])).astype(np.int32), np.array(row["sizes"], dtype=np.int64)
        self.training = np.repeat(~np.array(row["held"], dtype=bool), self.sizes)
        if pairs:
            code = self.symbols * np.int64(len(self.hashes))
            code[1:] += self.symbols[:-1]  # a text begins behind an end, symbol 0
            order = np.argsort(code)
            code = code[order]
            new = np.diff(code, prepend=-1) != 0
            self.of = np.empty(len(code), dtype=np.int32)
            self.of[order] = np.cumsum(new, dtype=np.int32) - 1
            code = code[new]
            self.next, self.previous = (code // len(self.hashes)).astype(np.int32), (code % len(self.hashes)).astype(np.int32)

    def dealt(self, frequent: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, its pairs): by the second word, or by the pair if that word is frequent."""
        key = self.short[self.next]
        common = pc.is_in(pa.array(self.short), value_set=pa.array(frequent)).to_numpy(zero_copy_only=False)[self.next]
        key[common] = _mixed(key[common], self.short[self.previous[common]])
        bucket = (_mixed(key, np.array([5], np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order, bucket = _dealt(bucket, buckets)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            yield int(bucket[lo]), order[lo:hi]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def _words(chunks: DataFrame, buckets: int) -> DataFrame:
    """(word, key, n) of the training texts; key is the hash that stands for a word in packed arrays. Chunks send their words by
    bucket, packed; a bucket adds up equal words."""

    def used(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk = _Chunk(batch.slice(at, 1).to_pylist()[0], pairs=False)
                n = np.bincount(chunk.symbols[chunk.training], minlength=len(chunk.words))
                order, bucket = _by_bucket(chunk.hashes, buckets)
                order, bucket = order[n[order] > 0], bucket[n[order] > 0]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = [order[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True)]
                packed = [[b"\n".join([chunk.words[i] for i in some.tolist()]) for some in parts], [_pack(n[some]) for some in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *[pa.array(x, pa.binary()) for x in packed]], ["word_bucket", "words", "n"])

    def added(rows: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        words = pa.concat_arrays([pa.array(x.as_py().split(b"\n"), pa.large_binary()) for x in rows.column("words")]).dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), np.concatenate([_unpack(x.as_py()) for x in rows.column("n")])).astype(np.int64)
        return pa.table({"word": words.dictionary.cast(pa.binary()), "n": n})

    packed = chunks.select("held", "sizes", "vocabulary", "hashes", "symbols").mapInArrow(used, "word_bucket long, words binary, n binary")
    return packed.groupBy("word_bucket").applyInArrow(added, "word binary, n long").select("word", F.xxhash64("word").alias("key"), "n")


def _asked(chunks: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """The distinct pairs of each chunk, packed by bucket: second words with their number of pairs, first words, training counts."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(batch.num_rows):
                row = batch.slice(at_row, 1).to_pylist()[0]
                chunk = _Chunk(row)
                times = np.bincount(chunk.of[chunk.training], minlength=len(chunk.next))
                found, packed = [], []
                for bucket, at in chunk.dealt(shared.value, buckets):
                    seconds = chunk.next[at]  # in order, as the codes are
                    first = np.flatnonzero(np.diff(seconds, prepend=-1))
                    runs = np.diff(np.append(first, len(at)))
                    found.append(bucket)
                    packed.append([_pack(chunk.short[seconds[first]], _BYTES), _pack(runs), _pack(chunk.short[chunk.previous[at]], _BYTES), _pack(times[at])])
                del chunk, times
                columns = [pa.array([x[i] for x in packed], pa.binary()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([row["chunk"]] * len(found), pa.int64()), *columns], ["bucket", "chunk", "next", "runs", "previous", "times"])
                del packed, columns
                pa.default_memory_pool().release_unused()

    return chunks.drop("vocabulary").mapInArrow(run, "bucket long, chunk long, next binary, runs binary, previous binary, times binary")


def _answered(asked: DataFrame, frequent: np.ndarray, frequent_n: np.ndarray, tokens: int) -> DataFrame:
    """Per bucket: for each chunk the counts of its pairs (0 for those seen less than twice), and for each context the sums
    over its next symbols that its divergence needs: count, kinds, count * log(count * tokens / count of the symbol), and
    count * log(count), which bounds the divergence of longer contexts."""
    shared = asked.sparkSession.sparkContext.broadcast((frequent, frequent_n))
    kinds = [("chunk", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("context", pa.list_(pa.int64())), ("kept", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64())), ("part", pa.list_(pa.float64())), ("logs", pa.list_(pa.float64()))]

    def run(rows: pa.Table) -> pa.Table:
        keys, known = shared.value
        bucket = rows.column("bucket")[0].as_py()
        read = lambda name, size: [_unpack(x.as_py(), size) for x in rows.column(name)]
        times = read("times", 4)
        following, runs = np.concatenate(read("next", _BYTES)), np.concatenate(read("runs", 4)).astype(np.int64)
        second = np.repeat(following, runs)
        first, n = np.concatenate(read("previous", _BYTES)), np.concatenate(times)
        example, of = _distinct(_mixed(second, first))
        count = np.bincount(of, n).astype(np.int64)
        words, which = np.unique(following, return_inverse=True)
        which = np.repeat(which, runs)
        total = np.bincount(which, n)
        if len(keys):
            spot = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
            total = np.where(keys[spot] == words, known[spot], total)
        entry = np.flatnonzero(count >= 2)
        contexts, by = np.unique(first[example[entry]], return_inverse=True)
        c = count[entry]
        part = c * np.log(c * tokens / total[which[example[entry]]]) if len(c) else np.zeros(0)
        sums = [contexts.view(np.int64), np.bincount(by, c, len(contexts)).astype(np.int64), np.bincount(by, minlength=len(contexts)), np.bincount(by, part, len(contexts)), np.bincount(by, c * np.log(c), len(contexts))]
        answer, ends = np.where(count >= 2, count, 0)[of], np.cumsum([len(t) for t in times])
        out = [[chunk, bucket, _pack(answer[end - len(t) : end]), None, None, None, None, None] for chunk, t, end in zip(rows.column("chunk").to_pylist(), times, ends, strict=True)]
        out.append([None, bucket, None, *sums])
        return pa.table({name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(kinds)})

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, counts binary, context array<long>, kept array<long>, kinds array<long>, part array<double>, logs array<double>")


#: Bytes of the hash that stands for a context of several words, and of a count.
_CONTEXT, _COUNT = 6, 5
_LONG = np.uint64((1 << 8 * _CONTEXT) - 1)
_ASKED = "bucket long, heavy boolean, context binary, runs binary, own binary, parent binary, next binary, above binary, times binary"
_STATE = f"chunk long, ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, score array<double>, symbols binary, short binary, live binary, of binary, grams binary, sent binary, chance binary, heavies binary, {_ASKED}"
_BELOW = "chunk long, bucket long, heavy boolean, counts binary, size binary, kept binary, kinds binary, open binary, sum_context long, sum_size long, sum_kept long, sum_kinds long, sum_part double, sum_logs double"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class _Texts:
    """The texts of a chunk while their longer contexts are looked up: what is known of the documents, and their symbols."""

    def __init__(self, row: dict, symbols: np.ndarray | None, short: np.ndarray | None) -> None:
        self.row, self.symbols, self.short = row, symbols, short
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~np.array(row["held"], dtype=bool), self.sizes)
        self.inside = np.arange(len(self.training)) - np.repeat(self.first, self.sizes)

    def before(self, values: np.ndarray) -> np.ndarray:
        """At each place what `values` has at the place before it; the first place of a text has no use for it."""
        return np.concatenate([values[:1], values[:-1]])

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first)

    def scored(self, score: np.ndarray) -> pa.Table:
        row = self.row
        out = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), *map(pa.array, (self.sizes, np.array(row["known"], np.int64), np.array(row["base"], np.float64), score))]
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def asked(self, k: int, live: np.ndarray, own: np.ndarray, parent: np.ndarray, above: np.ndarray, chance: np.ndarray, score: np.ndarray, least: float, buckets: int, last: bool) -> pa.Table:
        """What the chunk keeps (no symbols, if this is the last round) and what it asks for the contexts of k words at its `live` places.

        Per place: `own`, how often its context occurs in training (-1: not known); `parent`, the same of the context one word
        shorter; `above`, how often its symbol follows that one; `chance`, log10 of its probability so far. Grams whose `above`
        is 0 are not sent where `own` is known: they count nothing. Contexts of `least` and more go by their grams.
        """
        at, short = np.flatnonzero(live), self.short[self.symbols]
        context = short[at - 1]
        for j in range(2, k + 1):  # the end before a text, or the last one of the chunk, is a text's start
            context = _mixed(context, short[at - j])
        context &= _LONG
        key = _mixed(context, short[at])
        example, of = _distinct(key)
        key, place = key[example], at[example]
        times = np.bincount(of[self.training[at]], minlength=len(key))
        context, heavy = context[example], own[place] >= least
        sliced = lambda x, bits: (((x >> np.uint64(bits - 32)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
        bucket = sliced(context, 8 * _CONTEXT)  # in the order of contexts
        bucket[heavy] = sliced(key[heavy], 64)
        plain, often = np.flatnonzero(~heavy), np.flatnonzero(heavy)
        order = np.concatenate([plain[np.argsort(context[plain])], often[np.lexsort((context[often], bucket[often]))]])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        context, heavy, bucket, place, times = context[order], heavy[order], bucket[order], place[order], times[order]
        sent = (above[place] > 0) | (own[place] < 0)
        still = np.zeros(len(live), dtype=bool)  # places whose gram is sent; the others can only fall back, which adds to their score
        still[at] = sent[rank[of]]
        score = score + self.summed(np.where(live & ~still, chance, 0.0))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1]) | (heavy[1:] != heavy[:-1])
        run = np.flatnonzero(new)
        grams = np.diff(np.append(run, len(order)))
        sent_grams = np.add.reduceat(sent, run, dtype=np.int64) if len(run) else np.zeros(0, np.int64)
        bits = lambda x: _squeezed(np.packbits(x).tobytes())
        kept = {x: self.row[x] for x in ("chunk", "ids", "held", "sizes", "known", "base")} | {"score": score.tolist(), "live": bits(live)}
        if not last:
            kept |= {"symbols": self.row["symbols"], "short": _squeezed(_pack(self.short, _BYTES))}
        kept |= {"of": _squeezed(_pack(rank[of])), "grams": _squeezed(_pack(grams)), "sent": bits(sent), "chance": _squeezed(chance[place[sent]].astype("<f4").tobytes()), "heavies": _pack(context[run[heavy[run]]], _CONTEXT)}
        rows = [kept]
        group = heavy[run] * np.int64(buckets) + bucket[run].astype(np.int64)
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.cumsum(sent_grams)
        symbol, over, times = short[place[sent]], above[place[sent]], times[sent]
        for lo, hi in zip(cuts, [*cuts[1:], len(run)], strict=True):
            some, of_some = run[lo:hi], slice(int(ends[lo] - sent_grams[lo]), int(ends[hi - 1]))
            packed = {"context": _pack(context[some], _CONTEXT), "runs": _pack(sent_grams[lo:hi]), "own": _pack(own[place[some]] + 1, _COUNT), "parent": _pack(parent[place[some]], _COUNT)}
            packed |= {"next": _pack(symbol[of_some], _BYTES), "above": _pack(over[of_some], _COUNT), "times": _pack(times[of_some])}
            rows.append({"chunk": self.row["chunk"], "bucket": int(bucket[some[0]]), "heavy": bool(heavy[some[0]]), **packed})
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
        names = [x.split(" ") for x in _STATE.split(", ")]
        return pa.table({name: pa.array([row.get(name) for row in rows], kinds[kind]) for name, kind in names})


def _below(asked: DataFrame, gain: float) -> DataFrame:
    """Per bucket of contexts of one length: for each chunk the counts of its grams (0 for those seen less than twice) and, of
    each context, its count, what its state holds (0 where it is not retained) and whether it is open to longer ones. Contexts
    dealt by their grams are answered with counts; their sums go out by themselves."""
    kinds = [("chunk", pa.int64()), ("bucket", pa.int64()), ("heavy", pa.bool_()), *[(x, pa.binary()) for x in ("counts", "size", "kept", "kinds", "open")]]
    sums = [("sum_context", pa.int64()), ("sum_size", pa.int64()), ("sum_kept", pa.int64()), ("sum_kinds", pa.int64()), ("sum_part", pa.float64()), ("sum_logs", pa.float64())]

    def run(rows: pa.Table) -> pa.Table:
        bucket, heavy = rows.column("bucket")[0].as_py(), rows.column("heavy")[0].as_py()
        read = lambda name, size: [_unpack(x.as_py(), size) for x in rows.column(name)]
        contexts, times = read("context", _CONTEXT), read("times", 4)
        runs = np.concatenate(read("runs", 4)).astype(np.int64)
        every = np.concatenate(contexts)
        first, which = _distinct(every)
        context, own = every[first], np.concatenate(read("own", _COUNT)).astype(np.int64)[first] - 1
        parent = np.concatenate(read("parent", _COUNT)).astype(np.int64)[first]
        by_gram, n, above = np.repeat(which, runs), np.concatenate(times), np.concatenate(read("above", _COUNT)).astype(np.int64)
        example, of = _distinct(_mixed(context[by_gram], np.concatenate(read("next", _BYTES))))
        count = np.bincount(of, n, len(example)).astype(np.int64)
        size = np.where(own >= 0, own, np.bincount(by_gram, n, len(context)).astype(np.int64))
        entry = np.flatnonzero(count >= 2)
        by, c = by_gram[example[entry]], count[entry]
        summed = lambda values: np.bincount(by, values, len(context)) if len(by) else np.zeros(len(context))
        kept, some = summed(c).astype(np.int64), summed(None).astype(np.int64)
        part, logs = summed(c * np.log(c * parent[by] / np.maximum(above[example[entry]], c))), summed(c * np.log(c))
        answer = np.where(count >= 2, count, 0)[of]
        retained, open_ = _judged(size, kept, part, logs, gain)
        told = [x[which] for x in (np.where(retained | open_, size, 0), np.where(retained, kept, 0), np.where(retained, some, 0), open_)]
        out, a, b = [], 0, 0
        for chunk, mine, grams in zip(rows.column("chunk").to_pylist(), contexts, times, strict=True):
            s = slice(b, b + len(mine))
            states = [None] * 4 if heavy else [*[_pack(x[s], _COUNT) for x in told[:3]], np.packbits(told[3][s]).tobytes()]
            out.append([chunk, bucket, heavy, _pack(answer[a : a + len(grams)], _COUNT), *states])
            a, b = a + len(grams), b + len(mine)
        table = pa.table({name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(kinds)})
        values = [pa.array(x) for x in ((context.view(np.int64), size, kept, some, part, logs) if heavy else [np.zeros(0, t.to_pandas_dtype()) for _, t in sums])]
        states = pa.table(values, schema=pa.schema(sums))
        both = pa.schema(kinds + sums)
        return pa.concat_tables([table, states], promote_options="default").select(both.names).cast(both)

    return asked.groupBy("bucket", "heavy").applyInArrow(run, _BELOW)


def _judged(size: np.ndarray, kept: np.ndarray, part: np.ndarray, logs: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether contexts of these sums are retained, and whether longer ones can be."""
    log = np.log(np.maximum(size, 1))
    fine = (kept > 0) & (kept <= size)
    return fine & (part - kept * log >= gain), fine & (kept * log - logs >= gain)


def _heavies(answers: DataFrame, gain: float) -> tuple[np.ndarray, ...]:
    """Contexts dealt by their grams, in order, with size, kept, kinds and whether they are open."""
    rows = answers.where("sum_context is not null").groupBy("sum_context")
    sums = rows.agg(F.max("sum_size").alias("size"), F.sum("sum_kept").alias("kept"), F.sum("sum_kinds").alias("kinds"), F.sum("sum_part").alias("part"), F.sum("sum_logs").alias("logs"))
    context, size, kept, kinds, part, logs = _column(sums, "sum_context", "size", "kept", "kinds", "part", "logs")
    retained, open_ = _judged(size, kept, part, logs, gain)
    order = np.argsort(context)
    return context[order].astype(np.uint64), size[order], np.where(retained, kept, 0)[order], np.where(retained, kinds, 0)[order], open_[order]


def _advanced(k: int, longest: int, heavies: tuple[np.ndarray, ...], least: float, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Scores the live places of a chunk in their contexts of k words and asks for those of k + 1, if there are any to come."""

    def run(rows: pa.Table) -> pa.Table:
        row = rows.filter(pc.is_valid(rows.column("ids"))).to_pylist()[0]
        answers = rows.filter(pc.is_valid(rows.column("bucket"))).sort_by([("heavy", "ascending"), ("bucket", "ascending")])
        texts = _Texts(row, *(None, None) if k == longest else (_unpack(_whole(row["symbols"])).astype(np.int32), _unpack(_whole(row["short"]), _BYTES)))
        bits = lambda name, n: np.unpackbits(np.frombuffer(_whole(row[name]), np.uint8), count=n).astype(bool)
        live, of, grams = bits("live", len(texts.training)), _unpack(_whole(row["of"])).view(np.int64), _unpack(_whole(row["grams"])).view(np.int64)
        sent = bits("sent", int(grams.sum()))
        chance, count = np.zeros(len(sent)), np.zeros(len(sent), dtype=np.int64)
        chance[sent] = np.frombuffer(_whole(row["chance"]), "<f4")
        joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        count[sent] = joined([_unpack(x.as_py(), _COUNT).astype(np.int64) for x in answers.column("counts")])
        plain = answers.filter(pc.invert(answers.column("heavy")))
        told = [joined([_unpack(x.as_py(), _COUNT).astype(np.int64) for x in plain.column(name)]) for name in ("size", "kept", "kinds")]
        told.append(joined([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(n.as_py()) // _COUNT) for x, n in zip(plain.column("open"), plain.column("size"), strict=True)]).astype(bool))
        spot = np.searchsorted(heavies[0], _unpack(row["heavies"], _CONTEXT))
        size, kept, kinds, open_ = [np.concatenate([a, b[spot]]) if len(spot) else a for a, b in zip(told, heavies[1:], strict=True)]
        by = np.repeat(np.arange(len(grams)), grams)
        whole = np.where(kept > 0, size + kinds, 1)
        chance += np.where(kept > 0, np.log10((whole - kept) / whole), 0.0)[by]
        hit = np.flatnonzero((count > 0) & (kept > 0)[by])
        chance[hit] = np.log10(count[hit] / whole[by[hit]] + 10.0 ** chance[hit])
        at = np.flatnonzero(live)
        spread = lambda values, none: _spread(len(live), at, values[of], none)
        now, counted = spread(chance, 0.0), spread(count, -1)
        own = texts.before(counted)
        more = live & (texts.inside >= k) & spread(open_[by], False) & ((own < 0) | (own >= 2)) if k < longest else np.zeros(len(live), dtype=bool)
        score = np.array(row["score"]) + texts.summed(np.where(more, 0.0, now))
        if k == longest:
            return texts.scored(score)
        return texts.asked(k + 1, more, own, spread(size[by], 0), counted, now, score, least, buckets, k + 1 == longest)

    return run


def _spread(n: int, at: np.ndarray, values: np.ndarray, none: float) -> np.ndarray:
    out = np.full(n, none, dtype=values.dtype)
    out[at] = values
    return out


#: Tables by chunk or by bucket lie in so many slices, which large inputs shuffle one by one.
_SLICES = 6


class _Sliced:
    """A written table whose rows lie apart by slice, so that each slice can be read and removed by itself."""

    def __init__(self, spark: SparkSession, schema: StructType) -> None:
        self.spark, self.at, self.writes = spark, shared_dir(spark), 0
        self.columns, self.schema = schema.names, StructType([*schema.fields, StructField("slice", IntegerType())])

    def add(self, rows: DataFrame, number: Column) -> None:
        rows.withColumn("slice", number).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").partitionBy("slice").parquet(f"{self.at}/write={self.writes}")
        self.writes += 1

    def read(self, *numbers: int) -> DataFrame:
        """The rows of these slices, or of all."""
        rows = self.spark.read.schema(self.schema).parquet(self.at)
        return (rows.where(F.col("slice").isin(*numbers)) if numbers else rows).select(*self.columns)

    def remove(self, *numbers: int) -> None:
        for write in range(self.writes):
            for number in numbers:
                removed(self.spark, f"{self.at}/write={write}/slice={number}")


def _slice(by: str) -> Column:
    """The slice of a chunk (those of a task are dealt in turn) or of a bucket."""
    number = F.col(by)
    return F.pmod(F.shiftright(number, 32) + number.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(_SLICES)).cast("int")


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that wrote them is done, as what is read again lies in tables. Rows of a sliced table are not
    sorted before they are written, since a task has a file open for each slice."""
    names = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": str(4 * _SLICES)}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of words by bucket, and the buckets in that order."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return _dealt(bucket, buckets)


def _told(chunks: DataFrame, states: DataFrame, buckets: int) -> DataFrame:
    """What is known of the words of each chunk, packed by bucket of words: n, kept, kinds, open."""

    def used(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes in zip(batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                own = np.frombuffer(hashes, np.uint64)
                order, bucket = _by_bucket(own, buckets)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                keys = [own[order[lo:hi]].tobytes() for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), chunk)), pa.array(bucket[cuts]), pa.array(keys, pa.binary())], ["chunk", "word_bucket", "keys"])

    def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("key").to_numpy()
        order = np.argsort(key)
        key, values = key[order], {x: np.asarray(known.column(x).to_numpy(), dtype=np.int64)[order] for x in ("n", "kept", "kinds", "open")}
        out: dict[str, list[bytes]] = {x: [] for x in values}
        for keys in asked.column("keys"):
            own = np.frombuffer(keys.as_py(), np.int64)
            by_key, spot = np.argsort(own), np.empty(len(own), dtype=np.int64)
            spot[by_key] = np.searchsorted(key, own[by_key])  # in order, near places follow each other
            hit = np.flatnonzero(spot < len(key))
            hit = hit[key[spot[hit]] == own[hit]]
            for x, has in values.items():
                got = np.zeros(len(own), dtype=np.int64)
                got[hit] = has[spot[hit]]
                out[x].append(_pack(got, _COUNT))
        return pa.table({"chunk": asked.column("chunk"), "word_bucket": asked.column("word_bucket"), **{x: pa.array(v, pa.binary()) for x, v in out.items()}})

    asked = chunks.select("chunk", "hashes").mapInArrow(used, "chunk long, word_bucket long, keys binary")
    known = states.withColumn("word_bucket", F.pmod(F.shiftrightunsigned("key", 32), F.lit(buckets)))
    return asked.groupBy("word_bucket").cogroup(known.groupBy("word_bucket")).applyInArrow(tell, "chunk long, word_bucket long, n binary, kept binary, kinds binary, open binary")


def _spelled(words: DataFrame) -> DataFrame:
    """(key, n): how often each (ORDER + 1)-gram of letters occurs in the distinct words, ends included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in chain(batches, [None]):
            held += _listed(batch.column("word")).split(b"\n") if batch is not None and batch.num_rows else []
            if held and (batch is None or len(held) >= 100_000):
                keys, n = np.unique(grams(*_spelling(held))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
                held = []

    return words.select("word").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _spelling(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """A buffer of words (one at least), each behind its context of ends, and where each begins."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + ORDER + 1
    return _END * ORDER + (_END * (ORDER + 1)).join(words) + _END, np.cumsum(sizes) - sizes


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls into a fold; never for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def scored(
    docs: DataFrame, gain: float = 3.0, least_share: float = 2e-6, word_share: float = 1e-6, chunk_tokens: int = 1_500_000, bucket_tokens: int = 2_000_000, longest: int = 1, turn_tokens: int = 16_000_000
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, in contexts of up to `longest`
    words. Texts of more than `turn_tokens` are shuffled in several turns, up to one for each slice."""
    with _tidied(docs.sparkSession):
        return _scored(docs, gain, least_share, word_share, chunk_tokens, bucket_tokens, longest, turn_tokens)


def _scored(docs: DataFrame, gain: float, least_share: float, word_share: float, chunk_tokens: int, bucket_tokens: int, longest: int, turn_tokens: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), 10, 0).alias("held_out"))
    made = _chunks(rows, chunk_tokens)
    chunked = _Sliced(spark, made.schema)
    chunked.add(made, _slice("chunk"))
    chunks = chunked.read()
    all_tokens = chunks.select(F.explode("sizes").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    words = materialize(_words(chunks, 1 + all_tokens // bucket_tokens), "words")
    size = words.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    tokens, kinds = size["tokens"], size["kinds"]
    key, n = _column(words.where(F.col("n") >= max(2.0, word_share * tokens)), "key", "n")  # at most 1 / word_share rows, or few tokens
    frequent, first = np.unique(key.view(np.uint64) & _SHORT, return_index=True)
    frequent_n = n[first]
    counted = _answered(_asked(chunks, frequent, 1 + all_tokens // bucket_tokens), frequent, frequent_n, tokens)
    answered = _Sliced(spark, counted.schema)
    answered.add(counted, F.coalesce(_slice("chunk"), F.lit(_SLICES)))
    # contexts: divergence from the root by the sums of all buckets
    each = answered.read(_SLICES).select(F.inline(F.arrays_zip("context", "kept", "kinds", "part", "logs")))
    sums = each.groupBy(F.col("context").alias("short")).agg(F.sum("kept").alias("kept"), F.sum("kinds").alias("kinds"), F.sum("part").alias("part"), F.sum("logs").alias("logs"))
    short = F.col("key").bitwiseAND(F.lit(int(_SHORT)).cast("long"))
    states = words.select("key", "n", short.alias("short")).join(sums, "short", "left").withColumn("retained", F.coalesce((F.col("part") - F.col("kept") * F.log("n") >= gain) & (F.col("kept") <= F.col("n")), F.lit(False)))
    open_ = F.coalesce((F.col("kept") * F.log("n") - F.col("logs") >= gain) & (F.col("kept") <= F.col("n")), F.lit(False))
    states = states.select("key", "n", open_.alias("open"), F.when(F.col("retained"), F.col("kept")).otherwise(0).cast("int").alias("kept"), F.when(F.col("retained"), F.col("kinds")).otherwise(0).cast("int").alias("kinds"))
    tree = spark.sparkContext.broadcast(grow(materialize(_spelled(words), "spelled"), least_share, gain))

    about = _told(chunks, states, 1 + kinds // 200_000)
    told = _Sliced(spark, about.schema)
    told.add(about, _slice("chunk"))
    if longest > 1:
        discard(words)
        answered.remove(_SLICES)

    def parts(*numbers: int) -> DataFrame:
        counts = answered.read(*numbers).where("chunk is not null").select("chunk", "bucket", "counts")
        return chunked.read(*numbers).unionByName(counts, allowMissingColumns=True).unionByName(told.read(*numbers), allowMissingColumns=True)

    def score(rows: pa.Table) -> pa.Table:
        row = rows.filter(pc.is_valid(rows.column("symbols"))).to_pylist()[0]
        chunk = _Chunk(row)
        word = {x: np.zeros(len(chunk.words)) for x in ("n", "kept", "kinds", "open")}
        known = rows.filter(pc.is_valid(rows.column("word_bucket"))).sort_by("word_bucket")
        order = _by_bucket(chunk.hashes, 1 + kinds // 200_000)[0]
        for x, values in word.items():
            values[order] = np.concatenate([_unpack(part.as_py(), _COUNT) for part in known.column(x)])
        packed = rows.filter(pc.is_valid(rows.column("bucket")))
        found = dict(zip(packed.column("bucket").to_pylist(), packed.column("counts"), strict=True))
        count = np.zeros(len(chunk.next), dtype=np.int32)
        for bucket, at in chunk.dealt(frequent_shared.value, buckets):
            count[at] = _unpack(found[bucket].as_py())
        spelling = np.zeros(len(chunk.words))
        for lo in range(0, len(chunk.words), 100_000):
            letters, first = grams(*_spelling(chunk.words[lo : lo + 100_000]))
            spelling[lo : lo + 100_000] = np.add.reduceat(tree.value.log10(letters), first)
        pa.default_memory_pool().release_unused()
        root = (word["n"] + spare * 10.0**spelling) / (tokens + spare)
        root = np.where(root > 0, np.log10(np.where(root > 0, root, 1.0)), math.log10(spare / (tokens + spare)) + spelling)  # long words fall below the smallest number
        # per word as a context: what it leaves to the root, and what its counts are divided by
        size = np.where(word["kept"] > 0, word["n"] + word["kinds"], 1.0)
        back = np.where(word["kept"] > 0, np.log10((size - word["kept"]) / size), 0.0)
        chance = back[chunk.previous] + root[chunk.next]
        hit = np.flatnonzero((count > 0) & (word["kept"] > 0)[chunk.previous])
        chance[hit] = np.log10(count[hit] / size[chunk.previous[hit]] + 10.0 ** chance[hit])
        base = np.log10((word["n"] + 0.1) / (tokens + 0.1 * (kinds + 1)))
        texts = _Texts(row, chunk.symbols, chunk.short)
        del packed, found, known, rows
        row["known"], row["base"] = (texts.summed(x[chunk.symbols]) for x in ((word["n"] > 0).astype(np.int64), base))
        if longest == 1:
            return texts.scored(texts.summed(chance[chunk.of]))
        now, own = chance[chunk.of], texts.before(count[chunk.of]).astype(np.int64)
        before = chunk.previous[chunk.of]
        more = (texts.inside >= 1) & (word["open"] > 0)[before] & (own >= 2)
        parent, above = word["n"].astype(np.int64)[before], count[chunk.of].astype(np.int64)
        del chunk, count, chance, before, hit
        return texts.asked(2, more, own, parent, above, now, texts.summed(np.where(more, 0.0, now)), heavy_least, buckets, longest == 2)

    spare, buckets = max(kinds, 1), 1 + all_tokens // bucket_tokens
    frequent_shared = spark.sparkContext.broadcast(frequent)
    heavy_least = max(bucket_tokens // 50, word_share * tokens)
    asked, kept = [x.split(" ")[0] for x in f"chunk long, {_ASKED}".split(", ")], [x.split(" ")[0] for x in _STATE[: -len(_ASKED) - 2].split(", ")]
    n_turns = min(_SLICES, 1 + all_tokens // turn_tokens)
    turns = [range(i, _SLICES, n_turns) for i in range(n_turns)]
    out, sources, advance = parts, [chunked, answered, told], score
    for k in range(2, longest + 1):
        texts = _Sliced(spark, StructType.fromDDL(_STATE))
        for turn in turns:
            texts.add(out(*turn).groupBy("chunk").applyInArrow(advance, _STATE), F.when(F.col("ids").isNull(), _SLICES + _slice("bucket")).otherwise(_slice("chunk")))
            for table in sources:
                table.remove(*turn)
        below = _Sliced(spark, StructType.fromDDL(_BELOW))
        for turn in turns:
            questions = [_SLICES + i for i in turn]
            below.add(_below(texts.read(*questions).select(*asked), gain), F.coalesce(_slice("chunk"), F.lit(_SLICES)))
            texts.remove(*questions)
        sources, advance = [texts, below], _advanced(k, longest, _heavies(below.read(_SLICES), gain), heavy_least, buckets)
        out = partial(_with_answers, texts, kept, below)
    return out().groupBy("chunk").applyInArrow(advance, _SCORED).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _with_answers(texts: _Sliced, kept: list[str], below: _Sliced, *numbers: int) -> DataFrame:
    """What chunks of these slices, or of all, have kept, and the answers to them."""
    answers = below.read(*numbers).where("chunk is not null")
    told = texts.read(*numbers).where("ids is not null").select(*kept)
    return told.unionByName(answers.drop(*[x for x in answers.columns if x.startswith("sum_")]), allowMissingColumns=True)
