"""Exact nearest vectors by cells: angles to pivots bound what a cell can hold, so cells out of reach are not read.

Angles between unit vectors obey the triangle inequality. Every vector belongs to the cell of its nearest pivot; a cell knows the
least and the largest angle of its vectors to the pivot. A query is compared with its own cell first; the angle of its k-th
best there is a limit, and only cells that can hold a smaller angle are compared after that. Queries go to cells, never all
vectors to all queries; a cell is compared slice by slice, and queries stream past a slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.sources.shared import kept

c = F.col


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.arccos(np.clip(vectors @ pivots.T / np.maximum(size, 1e-300), -1.0, 1.0))


def _placed(rows: DataFrame, pivots, key: str) -> DataFrame:
    """The rows (key, embedding) with their cell and all angles to the pivots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_matrix(batch.column("embedding")), pivots.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(list(angles), pa.list_(pa.float64()))], [*batch.schema.names, "cell", "angles"])

    kinds = dict(rows.dtypes)
    return rows.select(key, "embedding").mapInArrow(run, f"{key} {kinds[key]}, embedding {kinds['embedding']}, cell int, angles array<double>")


def compared(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best in each slice of a cell, of vectors (cell, slice, vec_id, embedding) for queries
    (cell, slice, query_id, embedding)."""
    shape = ["cell", "slice", "asks", "id", "embedding"]
    one = vectors.select("cell", "slice", F.lit(False).alias("asks"), c("vec_id").alias("id"), "embedding")
    other = asked.select("cell", "slice", F.lit(True).alias("asks"), c("query_id").alias("id"), "embedding")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, held, size = None, [], [], None
        for batch in batches:
            at = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "slice", "asks")])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                here = int(at[0, lo]), int(at[1, lo])
                if here != place:
                    place, ids, held, size = here, [], [], None
                own, matrix = np.array(part.column("id").to_pylist()), _matrix(part.column("embedding"))
                if not at[2, lo]:
                    ids.append(own)
                    held.append(matrix)
                    continue
                if not held:
                    continue
                if size is None:  # all vectors of the slice are here once its first query is
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    size = np.sqrt((held[0] * held[0]).sum(axis=1))
                query, found, score = [], [], []
                for some in range(0, len(own), 512):
                    q = matrix[some : some + 512]
                    cosines = np.round(q @ held[0].T / np.maximum(np.sqrt((q * q).sum(axis=1))[:, None] * size, 1e-300), 9)
                    cosines[own[some : some + 512, None] == ids[0]] = -np.inf
                    for row, who in zip(cosines, own[some : some + 512], strict=True):
                        limit = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        near = np.flatnonzero((row >= limit) & (row > -np.inf))
                        near = near[np.lexsort((ids[0][near], -row[near]))][:k]
                        query += [who] * len(near)
                        found += ids[0][near].tolist()
                        score += row[near].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    rows = one.unionByName(other).select(*shape).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "asks")
    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest_by_cells(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 64, slice_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """((query_id, vec_id, score, rank), (pairs, computed)): the k nearest by cosine of each query among vectors (vec_id, embedding),
    not counting itself, equal ones by vec_id; and how many pairs there are and how many were computed. cells: how many
    vectors, the first in a hash order, serve as pivots."""
    spark = vectors.sparkSession
    seeds = vectors.orderBy(F.md5(c("vec_id").cast("string")), "vec_id").limit(cells).select("embedding").collect()  # a stated number
    if not seeds:
        return queries.select(c("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0), spark.range(1).select(F.lit(0).alias("pairs"), F.lit(0).alias("computed"))
    pivots = np.array([r["embedding"] for r in seeds], dtype=np.float64).reshape(len(seeds), -1)
    shared = spark.sparkContext.broadcast(pivots / np.maximum(np.sqrt((pivots * pivots).sum(axis=1, keepdims=True)), 1e-300))
    placed = kept(_placed(vectors, shared, "vec_id").withColumn("own", F.get("angles", c("cell"))).drop("angles"))
    sizes = kept(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("own").alias("least"), F.max("own").alias("most")))  # a row for each cell
    sliced = placed.join(F.broadcast(sizes.select("cell", F.ceil(c("n") / slice_rows).alias("slices"))), "cell").withColumn("slice", F.pmod(F.xxhash64("vec_id"), "slices").cast("int"))
    asked = kept(_placed(queries, shared, "vec_id").withColumnRenamed("vec_id", "query_id").withColumnRenamed("cell", "home"))
    reach = asked.select("query_id", "home", "embedding", F.posexplode("angles").alias("cell", "angle")).join(F.broadcast(sizes), "cell")
    reach = reach.withColumn("bound", F.greatest(c("angle") - c("most"), c("least") - c("angle"), F.lit(0.0)))
    to_slices = lambda rows: rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.ceil(c("n") / slice_rows).cast("int") - 1)))

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), "vec_id"))).where(c("rank") <= k)

    early = kept(best(compared(sliced, to_slices(reach.where("cell = home")), k)))
    limit = early.where(c("rank") == k).select("query_id", F.acos(F.greatest(F.least("score", F.lit(1.0)), F.lit(-1.0))).alias("limit"))
    # cosines are rounded to nine places; an angle near nought moves by the root of that
    more = reach.where("cell <> home").join(limit, "query_id", "left").where(c("limit").isNull() | (c("bound") <= c("limit") + 1e-4))
    more = kept(more.select("query_id", "cell", "n", "embedding"))
    late = compared(sliced, to_slices(more), k)
    count = lambda rows: rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    computed = count(reach.where("cell = home")).unionByName(count(more)).agg(F.sum("n").alias("computed"))
    pairs = count(reach).select(c("n").alias("pairs")).join(computed, F.lit(True))  # one row each
    return best(early.drop("rank").unionByName(late)), pairs
