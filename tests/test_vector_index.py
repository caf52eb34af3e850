"""Nearest vectors by cells against all pairs, and how many pairs they take."""

from __future__ import annotations

import time

import numpy as np
import pytest
from tidepool.operators import retrieval as R
from tidepool.operators.vector_index import nearest_by_cells


def plain(ids, rows, asked, k):
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    out = {}
    for q in asked:
        scores = np.round(unit @ unit[ids.index(q)], 9)
        out[q] = [v for _, v in sorted((-s, v) for s, v in zip(scores, ids, strict=True) if v != q)[:k]]
    return out


@pytest.mark.parametrize("slice_rows", [20_000, 30])
def test_cells_give_the_nearest(spark, slice_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 4
    rows = np.repeat(centres, 50, axis=0) + rng.normal(size=(600, 8)) * 0.2
    rows[100:130] = rows[100]  # ties
    ids = [int(i) for i in rng.permutation(5000)[:600]]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
    asked = ids[::9]
    found, pairs = nearest_by_cells(df, df.where(df.vec_id.isin(asked)), 5, cells=24, slice_rows=slice_rows)
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == plain(ids, rows, asked, 5)
    whole, computed = pairs.first()
    assert whole == len(asked) * 600 and computed < 0.5 * whole


def test_cells_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in nearest_by_cells(df, df, 5)[0].collect()} == {(1, 2, 0.0, 1), (2, 1, 0.0, 1)}
    assert nearest_by_cells(df.limit(0), df, 5)[0].count() == 0 and nearest_by_cells(df, df.limit(0), 5)[0].count() == 0


def test_nearest_by_slices(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(500, 8))
    rows[40:70] = rows[40]  # ties
    ids = [int(i) for i in rng.permutation(3000)[:500]]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, rows, strict=True)] + [(5000, None)], "vec_id long, embedding array<double>")
    asked = [*ids[::9], 5000]
    found = R.nearest(df, df.where(df.vec_id.isin(asked)), 6, slice_rows=60)
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.pop(5000) == sorted(ids)[:6]  # a null query scores nothing
    assert got == plain(ids, rows, asked[:-1], 6)
    few = df.where(df.vec_id.isin([ids[0], ids[1], 5000]))
    assert [(r["vec_id"], r["rank"]) for r in R.nearest(few, few.where(few.vec_id == ids[0]), 5).collect()] == [(ids[1], 1), (5000, 2)]


def test_nearest_joins_no_pair_of_rows(spark):
    """All pairs as rows or lists of a join are what took too long; they are compared as matrices."""
    rows = [(i, [float(i % 97), float(i % 89), 1.0]) for i in range(40_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8).cache()
    df.count()
    start = time.perf_counter()
    R.nearest(df, df.where("vec_id % 20 = 0"), 10).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - start < 30
