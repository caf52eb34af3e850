"""A stored BM25 index with bounds: postings by term and range of documents, each block with the largest weight it holds.

Documents are dealt to ranges of about `range_docs`. For a query the sum of its terms' largest weights in a range bounds every
score there. The ranges with the highest bounds are scored first; their k-th best score is a threshold, and of the others
only those whose bound reaches it are read. Scores are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.scalars import leak_normal

c = F.col


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, category, length, term, tf) of documents (doc_id, text[, category]): counted where a text is read, so no word is
    shuffled. Each document has a row without a term, which shows its length."""
    kinds = dict(docs.dtypes)
    category = c("category") if "category" in kinds else F.lit(None).cast("string").alias("category")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lengths, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column("t")):
                words = (text.as_py() or "").split()
                own = Counter(words)
                at += [i] * (len(own) + 1)
                lengths += [len(words)] * (len(own) + 1)
                terms += [None, *own]
                counts += [0, *own.values()]
            rows = batch.select(["doc_id", "category"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lengths, pa.int32()), pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "category", "length", "term", "tf"])

    texts = docs.select("doc_id", category, leak_normal(c("text")).alias("t"))
    return texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, category {kinds.get('category', 'string')}, length int, term string, tf int")


@dataclass
class TextIndex:
    """blocks: (term, part, top, postings), sorted by term, so that a scan for some terms skips the rest of the files."""

    blocks: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, path: str, vocabulary: DataFrame | None = None, range_docs: int = 256, k1: float = 1.2, b: float = 0.75) -> TextIndex:
        """Writes an index of documents (doc_id, text[, category]) under `path`. vocabulary: index these terms (term) only."""
        spark = docs.sparkSession
        counted = term_counts(docs)
        if vocabulary is not None:
            counted = counted.join(vocabulary.select("term").distinct().withColumn("known", F.lit(True)), "term", "left").where("known or term is null").drop("known")
        counted.write.parquet(f"{path}/counts")
        counted = spark.read.schema(counted.schema).parquet(f"{path}/counts")
        n, mean = counted.where("term is null").agg(F.count("*"), F.avg("length")).first()
        tf = counted.where("term is not null")
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log((F.lit(n) - c("df") + 0.5) / (c("df") + 0.5) + 1)
        weight = idf * c("tf") * (k1 + 1) / (c("tf") + k1 * (1 - b + b * c("length") / F.lit(mean or 1.0)))
        part = F.pmod(F.xxhash64("doc_id"), F.lit(max(-(-n // range_docs), 1)))
        posting = F.struct("doc_id", weight.alias("w"), "category")
        made = tf.join(df, "term").select("term", part.alias("part"), posting.alias("p")).groupBy("term", "part").agg(F.max("p.w").alias("top"), F.collect_list("p").alias("postings"))
        made.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/blocks")
        return cls(spark.read.schema(made.schema).parquet(f"{path}/blocks"))

    def search(self, queries: DataFrame, k: int, category: object = None, first: int = 4) -> tuple[DataFrame, DataFrame]:
        """((query_id, doc_id, score, rank), (query_id, blocks, read)): the k best documents of each query (query_id, text), terms
        OR-ed, of one category if given; and how many blocks hold a query's terms, and how many of them were scored."""
        asked = queries.select("query_id", F.explode(F.array_distinct(F.split(leak_normal(c("text")), " "))).alias("term")).where("term <> ''")
        fits = F.filter("postings", lambda p: p["category"] == F.lit(category))
        blocks = self.blocks if category is None else self.blocks.withColumn("postings", fits).where(F.size("postings") > 0).withColumn("top", F.array_max(F.transform("postings", lambda p: p["w"])))
        bounds = blocks.select("term", "part", "top").join(asked, "term").groupBy("query_id", "part").agg(F.sum("top").alias("bound"), F.count("*").alias("blocks"))
        ranked = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(c("bound").desc(), "part")))

        def scored(parts: DataFrame) -> DataFrame:
            met = parts.select("query_id", "part").join(asked, "query_id").join(blocks, ["term", "part"])
            return met.select("query_id", F.inline("postings")).groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 9).alias("score"))

        def best(rows: DataFrame) -> DataFrame:
            return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), "doc_id"))).where(c("rank") <= k)

        early = best(scored(ranked.where(c("place") <= first)))
        least = early.where(c("rank") == k).select("query_id", c("score").alias("least"))
        # a bound is a sum of floating point numbers in another order than a score, which is rounded
        worth = ranked.join(least, "query_id", "left").withColumn("read", (c("place") <= first) | c("least").isNull() | (c("bound") >= c("least") - 1e-6))
        late = scored(worth.where(c("read") & (c("place") > first)))
        report = worth.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(c("read"), c("blocks")).otherwise(0)).alias("read"))
        return best(early.drop("rank").unionByName(late)), report
