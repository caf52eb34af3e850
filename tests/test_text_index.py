"""The stored index against plain BM25, with and without a category, and what it reads."""

from __future__ import annotations

import collections
import math
import random

import pytest
from tidepool.operators import retrieval as R
from tidepool.operators.text_index import TextIndex
from tidepool.sources.shared import scratch


def plain(docs, queries, k, category=None):
    words = {d: (t or "").split() for d, t, _ in docs}
    kinds = {d: x for d, _, x in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in queries:
        scores = []
        for d, ws in words.items():
            tf = collections.Counter(ws)
            s = sum(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(text.split()) if tf[w])
            if any(tf[w] for w in set(text.split())) and category in (None, kinds[d]):
                scores.append((-round(s, 9), d))
        out[q] = [d for _, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("category", [None, "x"])
def test_search_equals_plain_and_skips_ranges(spark, category):
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(15)], [f"r{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randrange(60))), rng.choice("xy")) for i in range(3000)] + [(9000, None, "x"), (9001, "", "y")]
    queries = [(q, " ".join([rng.choice(common), *rng.sample(rare, 3)])) for q in range(12)] + [(50, "nowhere"), (51, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, category string")
    index = TextIndex.build(df, f"{scratch(spark)}/index", range_docs=16)
    found, report = index.search(spark.createDataFrame(queries, "query_id int, text string"), 5, category)
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    assert dict(got) == {q: d for q, d in plain(docs, queries, 5, category).items() if d}
    blocks, read = report.groupBy().sum("blocks", "read").first()
    assert read < 0.8 * blocks
    again = TextIndex.build(df, f"{scratch(spark)}/index", spark.createDataFrame(queries, "q int, text string").selectExpr("explode(split(text, ' ')) AS term"), range_docs=16)
    some, _ = again.search(spark.createDataFrame(queries, "query_id int, text string"), 5, category)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, found.collect()))


def test_scores_of_tasks_equal_those_of_the_index(spark):
    rng = random.Random(6)
    words = [f"c{i}" for i in range(12)] + [f"r{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(words[:12]) if rng.random() < 0.7 else rng.choice(words) for _ in range(rng.randrange(40))), "x") for i in range(600)] + [(900, None, "x"), (901, "", "x")]
    queries = [(q, " ".join(rng.choices(words, k=5))) for q in range(15)] + [(50, "nowhere"), (51, ""), (52, None)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string, category string").repartition(5), spark.createDataFrame(queries, "query_id int, text string")
    local = R.bm25(df, asked, 4)
    assert not any(x in local._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Generate"))  # postings are neither joined nor spread
    got = collections.defaultdict(list)
    for r in local.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    assert dict(got) == {q: d for q, d in plain(docs, [(q, t or "") for q, t in queries], 4).items() if d}
    assert sorted(map(tuple, R.bm25(df, asked, 4, local_words=0).collect())) == sorted(map(tuple, local.collect()))
    assert R.bm25(df.where("false"), asked, 4).count() == 0 and R.bm25(df, asked.where("false"), 4).count() == 0


@pytest.mark.parametrize("category", ["x", "nowhere"])
def test_scores_of_tasks_within_a_category(spark, category):
    rng = random.Random(8)
    words = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(20))), rng.choice(["x", "y", None])) for i in range(300)]
    queries = [(q, " ".join(rng.sample(words, 3))) for q in range(8)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string, category string").repartition(4), spark.createDataFrame(queries, "query_id int, text string")
    local = R.bm25(df, asked, 5, category=category)
    got = collections.defaultdict(list)
    for r in local.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["doc_id"])
    assert dict(got) == {q: d for q, d in plain(docs, queries, 5, category).items() if d}
    assert sorted(map(tuple, R.bm25(df, asked, 5, local_words=0, category=category).collect())) == sorted(map(tuple, local.collect()))
