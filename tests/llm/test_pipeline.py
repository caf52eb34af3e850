"""The corpus pipeline, stage by stage, on a small input."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm import brute_components, sets_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{n}")
        out = spark.read.parquet(f"file://{tmp_path}/{n}")
        if n < 4:
            assert out.columns == columns, name
        before, after = (None if n == 4 else {r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, out))
        if n == 1:
            roots = brute_components(sets_of(docs), 80)
            assert after == {i for i, r in roots.items() if i == r}
        if n == 3:
            sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
            times = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
            assert max(times.values()) <= 3 and set(times) <= before and sum(sizes[i] * k for i, k in times.items()) > 0
        if n == 4:
            packed = {r["doc_ids"] for r in out.select(F.explode("doc_ids").alias("doc_ids")).collect()}
            assert packed == {r["doc_id"] for r in docs.select("doc_id").collect()}
        kept.append(out.count())
        docs = out
    assert kept[0] > kept[1] >= kept[2] > 0


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_rows_are_judged_each(spark, tmp_path):
    """Null and repeated doc_ids: every row by its own text, one of each group of copies, none lost, none multiplied."""
    rng = __import__("random").Random(4)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(80))
    bench = text()
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a, "s"), (None, b, "s"), (1, c, "s"), (1, d, None), (1, c, "s"), (2, a, "s"), (3, bench, "s"), (None, bench, "s"), (None, None, None), (4, "short", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf, got = f"file://{tmp_path}", []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        got.append(collections.Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    assert got[0] == collections.Counter((i, t) for i, t, _ in rows if t and t != "short")
    assert got[1] == collections.Counter([(None, b), (1, c), (1, d), (2, a), (3, bench)])
    assert got[2] == collections.Counter([(None, b), (1, c), (1, d), (2, a)])
    mixed = corpus_pipeline.source_mixing(spark, docs, sf).collect()
    times = collections.Counter((r["doc_id"], r["text"]) for r in mixed)
    assert set(times) <= set(got[2]) and max(times.values()) <= 3 and len(mixed) >= 2
