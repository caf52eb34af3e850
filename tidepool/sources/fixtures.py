"""Review-history tables seen through the given star-schema tables: the same views as DataFrames and as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.context import FIXED

#: name -> (given tables or views it reads, SQL that both engines accept; {x} are the places where they differ)
_EASE = "CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"
_MID = "CASE d.lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END"
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "events_k": (("events",), "SELECT event_id, {millis} AS id, user_id AS cid, event_type, value, {k} AS k FROM events"),
    "reviews": (
        ("events_k",),
        f"SELECT event_id, id, cid, {_EASE} AS ease, CAST(floor(value / 10) AS INT) AS last_ivl, CAST(floor(value / 10) AS INT) + {_EASE} AS ivl, "
        "CASE WHEN k % 7 = 0 THEN 0 ELSE 1300 + 10 * k END AS factor, CAST(floor(value * 100) AS BIGINT) AS time_ms, "
        "CASE WHEN event_type NOT IN ('error', 'view', 'click', 'purchase') THEN 4 WHEN k % 10 < 2 THEN 0 WHEN k % 10 < 8 THEN 1 WHEN k % 10 = 8 THEN 2 ELSE 3 END AS kind, "
        "CAST(cid % 10 AS INT) AS collection_id, (k + 0.5e0) / 100 AS pred, k FROM events_k",
    ),
    "cards_base": (
        ("customer",),
        "SELECT c_custkey AS id, {half} AS nid, CAST(c_custkey % 2 AS INT) AS ord, CAST(c_nationkey + 1 AS BIGINT) AS did, CAST(c_custkey % 4 AS INT) AS type, "
        "CAST(CASE WHEN c_custkey % 11 = 0 THEN -1 WHEN c_custkey % 13 = 0 THEN -2 WHEN c_custkey % 17 = 0 THEN -3 ELSE c_custkey % 4 END AS INT) AS queue, "
        f"CAST(CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN {FIXED.now} + c_custkey % 7200 - 3600 ELSE c_custkey % 60 END AS BIGINT) AS due, "
        "CAST(CASE WHEN c_custkey % 4 IN (2, 3) THEN c_custkey % 90 ELSE 0 END AS INT) AS ivl, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1300 + 50 * (c_custkey % 24) END AS INT) AS factor, "
        "CAST(c_custkey % 12 AS INT) AS reps, CAST(c_custkey % 5 AS INT) AS lapses, CAST(c_custkey % 8 AS INT) AS flags, "
        "CAST(CASE WHEN c_custkey % 19 = 0 THEN (c_nationkey + 7) % 25 + 1 ELSE 0 END AS BIGINT) AS odid, c_custkey % 4 IN (2, 3) AND c_custkey % 3 <> 0 AS has_state FROM customer",
    ),
    "cards": (
        ("cards_base",),
        "SELECT id, nid, ord, did, type, queue, due, ivl, factor, reps, lapses, flags, odid, CASE WHEN odid <> 0 THEN due ELSE 0 END AS odue, "
        f"1704067200 + id * 30 AS mod, CASE WHEN has_state THEN 1 + 1.1e0 * ivl END AS s, CASE WHEN has_state THEN 1 + (id % 90) / 10e0 END AS d, CASE WHEN has_state THEN {FIXED.now} - 86400 * (id % 40) END AS lrt FROM cards_base",
    ),
    "decks": (("nation", "region"), "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, r_name AS parent, n_name AS leaf, r_name || chr(31) || n_name AS name, n_regionkey AS preset, n_regionkey = 2 AS filtered FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "notes": (
        ("documents", "labels"),
        f"SELECT d.doc_id AS id, {_MID} AS mid, split_part(d.text, chr(10), 1) AS front, "
        "substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS back, d.lang || '::' || d.source AS tag, l.quality, l.toxic, 1704067200 + d.doc_id * 60 AS mod, d.doc_id % 2 = 0 AS pending, "
        "{csum} AS csum FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "docs": (("documents", "pages"), "SELECT 'documents' AS surface, doc_id AS id, text FROM documents UNION ALL SELECT 'pages' AS surface, page_id AS id, html AS text FROM pages"),
    "items": (("benchmark",), "SELECT item_id, text AS stem, {last_word} AS answer FROM benchmark"),
}
_SPARK = {
    "millis": "unix_millis(CAST(ts AS TIMESTAMP))", "k": "CAST(get_json_object(props, '$.k') AS INT)", "half": "c_custkey DIV 2",
    "csum": "CAST(conv(substr(sha1(split_part(d.text, chr(10), 1)), 1, 8), 16, 10) AS BIGINT)", "last_word": "regexp_extract(text, '(\\\\S+)\\\\s*$', 1)",
}
_DUCK = {
    "millis": "epoch_us(ts) // 1000", "k": "CAST(json_extract_string(props, '$.k') AS INT)", "half": "c_custkey // 2",
    "csum": "CAST('0x' || substr(sha1(split_part(d.text, chr(10), 1)), 1, 8) AS BIGINT)", "last_word": "regexp_extract(text, '(\\S+)\\s*$', 1)",
}
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _filled(name: str, words: dict[str, str]) -> str:
    text = VIEWS[name][1]
    for key, value in words.items():
        text = text.replace(f"{{{key}}}", value)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the VIEWS, as a DataFrame over the Parquet files."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {n: view(spark, sf_dir, n) for n in VIEWS[name][0]}
    text = _filled(name, _SPARK)
    for n in needs:
        text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **needs)


def note_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, mid, csum and front of the view `notes`. Texts are cut to these before the labels are joined, so no whole text is shuffled."""
    cut = f"SELECT d.doc_id AS id, {_MID} AS mid, substring_index(d.text, chr(10), 1) AS front FROM {{documents}} d"
    keys = f"SELECT id, mid, CAST(conv(substr(sha1(front), 1, 8), 16, 10) AS BIGINT) AS csum, front FROM ({cut})"
    return spark.sql(f"SELECT n.* FROM ({keys}) n LEFT JOIN {{labels}} l ON l.doc_id = n.id", documents=view(spark, sf_dir, "documents"), labels=view(spark, sf_dir, "labels"))


def with_tags(notes: DataFrame) -> DataFrame:
    """Notes with their fields and tags as arrays: language::source, and a tag for each positive label."""
    tags = F.array_compact(F.array(F.col("tag"), F.when(F.col("quality") == 1, "label::good"), F.when(F.col("toxic") == 1, "label::toxic")))
    return notes.withColumn("flds", F.array("front", "back")).withColumn("tags", tags)


def duck(body: str) -> str:
    """SQL for DuckDB: the body, with the views it names in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(" ".join(VIEWS[name][0]))
                if name not in needed:
                    needed.append(name)

    need(body)
    ctes = ", ".join(f"{n} AS ({_filled(n, _DUCK)})" for n in needed)
    if not ctes:
        return body
    head, rest = ("WITH RECURSIVE", body.lstrip()[14:]) if body.lstrip().upper().startswith("WITH RECURSIVE") else ("WITH", body.lstrip()[4:] if body.lstrip().upper().startswith("WITH") else None)
    return f"{head} {ctes}, {rest.lstrip()}" if rest is not None else f"{head} {ctes} {body}"
