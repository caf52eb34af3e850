"""Phrases and shared runs against plain Python."""

from __future__ import annotations

import random
import time

import pytest
from tidepool.operators import leakage as L
from tidepool.operators import phrases as PH
from tidepool.operators import retrieval as R


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    words = ["the"] * 20 + [f"w{i}" for i in range(30)] + ["é", "日本"]
    docs = [(i % 2, i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 300])))) for i in range(80)] + [(0, 90, None)]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 5]))) for _ in range(60)] + ["", "the", "the the", "w1 nowhere", "w"]
    return docs, phrases, spark.createDataFrame(docs, "surface int, id long, t string"), spark.createDataFrame([(p,) for p in phrases], "a string")


@pytest.mark.parametrize("how", [{}, {"slice_chars": 60}, {"slice_chars": 10, "most_slices": 0}])
def test_occurrences_equal_plain(texts, how):
    docs, phrases, told, asked = texts
    want = {(a, s, i) for a in phrases if a for s, i, t in docs if f" {a} " in f" {t} " and t is not None}
    found = PH.occurrences(asked, told, **{"most_slices": 1000, **how}).collect()
    assert len(found) == len(want) and {(r["a"], r["surface"], r["id"]) for r in found} == want
    assert PH.occurrences(asked.where("false"), told, **how).count() == 0 and PH.occurrences(asked, told.where("false"), **how).count() == 0


def plain_run(a, b):
    best, before = 0, {}
    for x in a:
        now = {j: before.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y}
        best, before = max([best, *now.values()]), now
    return best


def test_longest_run_equals_plain():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(14))] for _ in "ab")
        assert PH.longest_run(a, b) == plain_run(a, b)
    start = time.perf_counter()
    assert PH.longest_run(["a"] * 100_000, ["a"] * 100_000) == 100_000 and PH.longest_run(["a", "b"] * 50_000, ["b", "a"] * 50_000) == 99_999
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("slice_words", [400_000, 40])
def test_longest_shared_equals_plain(spark, slice_words):
    rng = random.Random(slice_words)
    words = [f"w{i}" for i in range(12)]
    items = [(i, [rng.choice([*words, f"own{i}"]) for _ in range(rng.randrange(12))]) for i in range(30)] + [(50, ["nowhere"]), (51, None), (52, ["w1"])]
    docs = [(s, i, [rng.choice(words) for _ in range(rng.choice([0, 3, 40]))]) for s in "pd" for i in range(25)] + [("p", 99, None)]
    got = {r["item_id"]: (r["run"], r["surface"], r["id"]) for r in PH.longest_shared(spark.createDataFrame(items, "item_id long, w array<string>"), spark.createDataFrame(docs, "surface string, id long, w array<string>").repartition(5), slice_words).collect()}
    want = {}
    for item, w in items:
        best = min(((-plain_run(w or [], d or []), s, i) for s, i, d in docs))
        if best[0]:
            want[item] = (-best[0], best[1], best[2])
    assert got == want


def test_leak_and_grounding_use_phrases(spark):
    items = spark.createDataFrame([(1, "Where, is the cat?", "the cat"), (2, "No such thing here", "dog"), (3, None, None)], "item_id long, stem string, answer string")
    docs = spark.createDataFrame([("d", 1, "so: where is THE CAT now"), ("d", 2, "the cat. The cat!"), ("d", 3, None)], "surface string, id long, text string")
    for how in ({}, {"most_slices": 0}):
        assert [tuple(r) for r in L.verbatim(items, docs, **how).collect()] == [(1, "d", 1)]
        assert [tuple(r) for r in L.answer_hits(items, docs, **how).collect()] == [(1, 2)]
        chunks = docs.selectExpr("id AS chunk_id", "text")
        assert [r["query_id"] for r in R.grounded(items.selectExpr("item_id AS query_id", "answer"), chunks, **how).collect()] == [1]
    pairs = spark.createDataFrame([(1, "one two three four", "zero one two three", "none"), (2, "one", "", "x"), (3, None, "one", "x")], "pair_id long, a string, b string, answer string")
    assert {r["pair_id"]: r["run"] for r in L.rewording(pairs).collect()} == {1: 3, 2: 0, 3: 0}


def test_contained_is_the_same_by_tasks_and_by_join(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(25)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 5, 6, 20])))) for i in range(40)] + [(90, None)]
    docs = [("d", i, " ".join([*(word() for _ in range(rng.randrange(40))), *items[i % 40][1].split()[: rng.randrange(30)], "x Y"])) for i in range(90)] + [("p", 1, None), ("p", 2, "")]
    one, other = spark.createDataFrame(items, "item_id long, stem string"), spark.createDataFrame(docs, "surface string, id long, text string")
    local, joined = (sorted(map(tuple, L.contained(one, other, local_shingles=n).collect())) for n in (2_000_000, 0))
    assert local == joined and len(local) > 20


def test_runs_and_windows_are_the_same_by_tasks_and_by_join(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(12)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 3, 6, 20])))) for i in range(30)] + [(90, None)]
    docs = [("d", i, " ".join([*(word() for _ in range(rng.randrange(40))), *items[i % 30][1].split()[: rng.randrange(30)]])) for i in range(60)] + [("p", 1, None), ("p", 2, "")]
    one, other = spark.createDataFrame(items, "item_id long, stem string"), spark.createDataFrame(docs, "surface string, id long, text string").repartition(4)
    for found in (L.longest_runs, L.windows_shared):
        local, joined = (sorted(map(tuple, found(one, other, 3, local_shingles=n).collect())) for n in (2_000_000, 0))
        assert local == joined and len(local) > 10
    seen = {tuple(w[i : i + 3]) for _, _, t in docs for w in [(t or "").split()] for i in range(len(w) - 2)}
    windows = {i: len({tuple(w[k : k + 3]) for k in range(len(w) - 2)} & seen) for i, t in items for w in [(t or "").split()]}
    assert dict(map(tuple, L.windows_shared(one, other, 3).collect())) == {i: n for i, n in windows.items() if n}


def test_only_texts_of_candidates_are_shingled(spark):
    """Shingles of every document before the join were what took the time."""
    docs = spark.range(5).selectExpr("'d' AS surface", "id", "concat('a b c d ', id) AS text")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, stem string")
    found = L.best_windows(docs.where("id = 3").selectExpr("1L AS item_id", "surface", "id"), items, docs, 0.0)
    assert [(r["id"], r["best"]) for r in found.collect()] == [(3, 1.0)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
