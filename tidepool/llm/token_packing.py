"""Token-ID / binary output: best-fit-decreasing packing into rows of a fixed number of ids.

Each task tokenizes its documents and packs them window by window: the pieces of a window are sorted by length, the
longest first, and each goes to the open row with the least room that still holds it, found in a segment tree over free
capacities. A document longer than a row is split without loss into full rows and a rest; every piece keeps its document
and its offset there. Nothing is shuffled and a window bounds memory.

A packed row is `ids` (little-endian uint16, or uint32 for large vocabularies, padded), `n_ids`, `doc_ids`, `offsets`,
`cu_seqlens` (cumulative segment lengths from 0) and `resets` (places where positions start at 0 again).

Defined results: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives no rows;
other columns are ignored; `row_id` is unique and, for equal partitions of the input, the same in every run.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: How the rank files' vocabulary splits text before merging (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space (as the vocabulary's pattern knows it) that are too long for the pattern: it backtracks over each.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")


def encoded(encoding, text: str) -> list[int]:
    """The ids of a text of any kind and length. The pattern takes a run of white space but for its last character as one
    piece, or all of it at the end of a text; long runs are cut out so and merged without the pattern."""
    ids: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


class Capacities:
    """Segment tree over free capacities 0..size: which of them open rows have, and the least one of at least n."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.has = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.leaves
        while at:
            self.has[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, row) of the fullest row with at least this much room."""
        at, has = least + self.leaves, self.has
        if not has[at]:
            while at > 1 and (at & 1 or not has[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if has[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        row = self.rows[capacity].pop()
        while at:
            has[at] -= 1
            at >>= 1
        return capacity, row


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows as lists of piece numbers; every length is 1..size."""
    rows: list[list[int]] = []
    free = Capacities(size)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        got = free.take(n) if n < size else None
        if got is None:
            rows.append([piece])
            got = size, len(rows) - 1
        else:
            rows[got[1]].append(piece)
        if got[0] > n:
            free.add(got[0] - n, got[1])
    return rows


_SCHEMA = "row_id long, n_ids int, doc_ids array<long>, offsets array<int>, cu_seqlens array<int>, resets array<int>, ids binary"


def packed(docs: DataFrame, row_ids: int = 2048, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", end_id: int = 50_256, pad_id: int = 50_256, window_ids: int = 2_000_000, wide: bool = False) -> DataFrame:
    """One row per packed row of `row_ids` ids."""
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(tokenizer)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces]), row_ids)
            for at in range(0, len(rows), 512):
                some = rows[at : at + 512]
                cuts = [np.cumsum([0] + [len(pieces[p][2]) for p in row]) for row in some]
                data = np.full((len(some), row_ids), pad_id, dtype=kind)
                for r, row in enumerate(some):
                    data[r, : cuts[r][-1]] = np.concatenate([pieces[p][2] for p in row])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(first, first + len(some)), pa.int64()), pa.array([int(c[-1]) for c in cuts], pa.int32()),
                        pa.array([[pieces[p][0] for p in row] for row in some], pa.list_(pa.int64())), pa.array([[pieces[p][1] for p in row] for row in some], pa.list_(pa.int32())),
                        pa.array([c.tolist() for c in cuts], pa.list_(pa.int32())), pa.array([c[:-1].tolist() for c in cuts], pa.list_(pa.int32())), pa.array([r.tobytes() for r in data], pa.binary()),
                    ],
                    [c.split()[0] for c in _SCHEMA.split(", ")],
                )
                first += len(some)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encoded(encoding, text.as_py() or ""), end_id], dtype=kind)
                for at in range(0, len(ids), row_ids):
                    pieces.append((doc_id, at, ids[at : at + row_ids]))
                held += len(ids)
                if held >= window_ids:
                    yield from flush()
                    pieces, held = [], 0
        if pieces:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def segments(rows: DataFrame) -> DataFrame:
    """(doc_id, offset, row_id, start, length) of every piece, unpacked from packed rows."""
    each = F.arrays_zip("doc_ids", "offsets", "resets", F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("ends"))
    return rows.select("row_id", F.inline(each)).select(F.col("doc_ids").alias("doc_id"), F.col("offsets").alias("offset"), "row_id", F.col("resets").alias("start"), (F.col("ends") - F.col("resets")).alias("length"))


def token_file(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)
