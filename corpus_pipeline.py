"""A training corpus from `documents`: quality rules, near-dedup, decontamination, source mixing, packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Null texts fail the quality rules. Decisions are about rows,
told apart by a key of their own: rows that repeat a doc_id, and rows without one, are judged each by its own text. Of
rows alike in text, near-dedup keeps one. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import discard, keyed, materialize, table
from tidepool.llm.decontamination import contamination
from tidepool.llm.near_dedup import near_duplicates
from tidepool.llm.quality_rules import POLICIES, judged
from tidepool.llm.source_mixing import mix
from tidepool.llm.token_packing import packed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the active policy keeps."""
    whole = docs.withColumn("__row", F.struct(*[c for c in docs.columns if c != "text"]))
    return judged(whole, POLICIES["v1"], "__row", "text").where("kept").select("__row.*", "text").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies (similarity 0.8 or more)."""
    rows = keyed(docs)
    groups = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), threshold=80).select(F.col("doc_id").alias("__row"), "component_id")
    named = groups.join(rows.select("__row", "doc_id"), "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "__row")).alias("first")).select("first.__row")
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    rows = keyed(docs)
    bad = contamination(rows.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated")
    return rows.join(bad.select(F.col("doc_id").alias("__row")), "__row", "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: taken / size times, the fraction rounded by a hash of the document."""
    rows = keyed(docs)
    took = mix(rows.withColumn("__tie", F.xxhash64("text")), carry=("__row", "__tie")).where("taken > 0")
    share = F.col("taken") / F.nullif("size", F.lit(0))
    chance = F.pmod(F.xxhash64("doc_id", "__tie", F.lit("round")), F.lit(1_000_000)) / 1_000_000
    times = (F.floor(share) + F.when(chance < share - F.floor(share), 1).otherwise(0)).cast("int")
    copies = took.select("__row", times.alias("__times")).where("__times > 0")
    return rows.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packed token ids."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token packing", token_packing),
]

#: The join's trees, the mix's hashes and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        made = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if number:
            discard(docs)  # the stage before, which nothing reads any more
        docs = made
    return docs
