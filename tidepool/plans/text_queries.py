"""Text functions, notetype work and file round trips as queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.context import FIXED
from tidepool.functions import scalars as S
from tidepool.operators import merge as M
from tidepool.operators import quality as Q
from tidepool.operators.projections import since_review
from tidepool.plans.registry import register
from tidepool.plans.table_queries import _ELAPSED, _RECALL
from tidepool.sources import notes_io as IO
from tidepool.sources.fixtures import view, with_tags
from tidepool.sources.shared import scratch

c = F.col


def _q(name: str, sql: str, operator, *tables: str) -> None:
    register(name, sql)(lambda spark, d: operator(*[with_tags(view(spark, d, t)) if t == "notes" else view(spark, d, t) for t in tables]))


def _stripped(text: str) -> str:
    """Text between markup: cut at every `<`, a piece loses what stands before its first `>`. Elements of raw text go first."""
    for name in ("style", "script"):
        text = f"regexp_replace({text}, '(?is)<{name}( [^>]*)?>.*?</{name}>', '', 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?-->', '', 'g')"
    pieces = f"string_split({text}, '<')"
    return f"array_to_string(list_transform({pieces}, lambda x, i: CASE WHEN i = 1 THEN x WHEN contains(x, '>') THEN substr(x, strpos(x, '>') + 1) ELSE '<' || x END), '')"


_BREAKS = r"(?i)<br\s*/?>|</?(?:div|p|li|ul|ol|tr|h[1-6])\b[^>]*>|\n"
_MEDIA = r"""(?i)<(?:img|audio|video|object|source)\b[^>]*?\s(?:src|data)=["'']?([^"''>\s]+)["'']?[^>]*>"""
#: A card's side with a picture and a sound, made of a document's columns; the same text in both engines.
_SIDE = "'<p>' || coalesce(lang, '') || ' <img alt=x src=\"pic' || doc_id || '.png\"> [sound:s' || doc_id % 5 || '.mp3]<b>' || coalesce(source, '') || '</b>'"

_q("sf01_stripped", f"SELECT page_id, {_stripped('html')} AS text FROM pages", lambda p: p.select("page_id", S.strip_html(c("html")).alias("text")), "pages")
_q(
    "sf02_html_lines",
    r"SELECT page_id, trim(regexp_replace("
    + _stripped(rf"regexp_replace(regexp_replace(html, '{_BREAKS}', ' ', 'g'), '\[sound:[^\]]*\]', '', 'g')")
    + r", '\s+', ' ', 'g')) AS line FROM pages",
    lambda p: p.select("page_id", S.html_to_line(c("html")).alias("line")),
    "pages",
)
_q(
    "sf03_media_kept",
    "SELECT doc_id, " + _stripped(rf"regexp_replace({_SIDE}, '{_MEDIA}', ' \1 ', 'g')") + " AS text FROM documents",
    lambda d: d.select("doc_id", S.strip_html_keep_media(F.expr(_SIDE)).alias("text")),
    "documents",
)
_q(
    "sf04_media_references",
    "SELECT doc_id, 'pic' || doc_id || '.png|s' || doc_id % 5 || '.mp3' AS files FROM documents",
    lambda d: d.select("doc_id", F.array_join(S.media_references(F.expr(_SIDE)), "|").alias("files")),
    "documents",
)
_q(
    "sf06_fields",
    "SELECT id, back AS second, CAST(2 AS INT) AS n FROM notes WHERE NOT contains(front, chr(31)) AND NOT contains(back, chr(31))",
    lambda n: n.where("not contains(front, '\x1f') and not contains(back, '\x1f')")
    .select("id", S.join_fields(c("flds")).alias("joined"))
    .select("id", S.nth_field(c("joined"), 1).alias("second"), F.size(S.split_fields(c("joined"))).alias("n")),
    "notes",
)
_q(
    "sf08_composed",
    "SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS sum FROM documents",
    lambda d: d.select("doc_id", F.md5(S.nfc(F.replace("text", F.lit("é"), F.lit("é")))).alias("sum")),
    "documents",
)
_MARKED = "translate(text, 'aeos', 'åøħß')"
_q(
    "sf09_without_marks",
    f"SELECT doc_id, md5(strip_accents(replace(replace(replace({_MARKED}, 'ø', 'o'), 'ħ', 'h'), 'ß', 's'))) AS sum FROM documents",
    lambda d: d.select("doc_id", F.md5(S.without_marks(F.expr(_MARKED))).alias("sum")),
    "documents",
)
_q(
    "sf24_shingles",
    "WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark) SELECT item_id, CASE WHEN len(w) < 3 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) END AS shingles FROM w",
    lambda b: b.select("item_id", F.array_sort(S.shingles(F.split(F.lower("text"), " "), 3)).alias("shingles")),
    "benchmark",
)
_q(
    "sf10_without_control",
    "SELECT doc_id, md5(replace(text, ' ', '')) AS sum FROM documents WHERE NOT regexp_matches(text, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]')",
    lambda d: d.where(r"not text rlike '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]'").select("doc_id", F.md5(S.drop_control(F.translate("text", " ", "\x01"))).alias("sum")),
    "documents",
)
_q(
    "sf17_overdueness",
    f"SELECT id, CASE WHEN s IS NOT NULL THEN -(pow(greatest({_RECALL}, 0.0001), -2) - 1) / (pow(0.9, -2) - 1) "
    f"ELSE -(({_ELAPSED}) / 86400 + 0.001) / greatest(ivl, 1) END AS overdue FROM cards",
    lambda k: k.select(
        "id",
        S.relative_overdueness(
            F.when(c("s").isNotNull(), S.forgetting_curve(since_review(FIXED) / S.DAY, c("s"))), F.lit(0.9), since_review(FIXED) / S.DAY, c("ivl")
        ).alias("overdue"),
    ),
    "cards",
)
_q(
    "sf20_card_data",
    "SELECT id, CASE WHEN id % 7 <> 0 THEN s END AS s, CASE WHEN id % 7 <> 0 THEN d END AS d, CASE WHEN id % 7 <> 0 THEN lrt END AS lrt FROM cards",
    lambda k: k.select("id", S.card_data(F.when(c("id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct("s", "d", "lrt")))).alias("x")).select(
        "id", c("x.s").alias("s"), c("x.d").alias("d"), c("x.lrt").alias("lrt")
    ),
    "cards",
)
_q(
    "sf26_typographic",
    "SELECT doc_id, md5(replace(replace(replace(text, '“', '\"'), '–', '-'), '…', '...') || ' \"q\" ''s'' - --...') AS sum FROM documents "
    "WHERE NOT regexp_matches(text, '[‘’‚‛”„‟—−‐‑\\x{2000}-\\x{200D}\\x{202F}\\x{2060}\\x{FEFF}\\x{A0}\\x{AD}]')",
    lambda d: d.where(~c("text").rlike("[‘’‚‛”„‟—−‐‑\\x{2000}-\\x{200D}\\x{202F}\\x{2060}\\x{FEFF}\\x{A0}\\x{AD}]")).select(
        "doc_id", F.md5(S.typographic(F.concat("text", F.lit(" “q” ‘s’ – ——…")))).alias("sum")
    ),
    "documents",
)
_q(
    "sf27_visible",
    "SELECT doc_id, md5(text) AS sum, CAST(3 AS INT) AS lost FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}\\p{Cf}]')",
    lambda d: d.where(~c("text").rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}\p{Cf}]")).select(
        "doc_id", *[x.alias(n) for x, n in zip(_visible(F.concat(F.lit("​"), "text", F.lit("­\u0007"))), ("sum", "lost"), strict=True)]
    ),
    "documents",
)
_SHARES = (
    "WITH n AS (SELECT source, count(*) FILTER (quality = 1) AS x1, count(quality) AS n1, count(*) FILTER (toxic = 1) AS x2, count(toxic) AS n2 "
    "FROM documents JOIN labels USING (doc_id) GROUP BY source), "
    "w AS (SELECT *, x1 / n1 AS p1, x2 / n2 AS p2, 1.96 * sqrt(x1 / n1 * (1 - x1 / n1) / n1 + 0.9604 / (n1 * n1)) AS h1, "
    "1.96 * sqrt(x2 / n2 * (1 - x2 / n2) / n2 + 0.9604 / (n2 * n2)) AS h2 FROM n), "
    "b AS (SELECT source, p1, p2, greatest((p1 + 1.9208 / n1 - h1) / (1 + 3.8416 / n1), 0) AS l1, least((p1 + 1.9208 / n1 + h1) / (1 + 3.8416 / n1), 1) AS u1, "
    "greatest((p2 + 1.9208 / n2 - h2) / (1 + 3.8416 / n2), 0) AS l2, least((p2 + 1.9208 / n2 + h2) / (1 + 3.8416 / n2), 1) AS u2 FROM w) "
    "SELECT source, p1 - p2 - sqrt(pow(p1 - l1, 2) + pow(u2 - p2, 2)) AS low, p1 - p2 + sqrt(pow(u1 - p1, 2) + pow(p2 - l2, 2)) AS high FROM b"
)


def _visible(text):
    clean, lost = S.without_invisible(text)
    return F.md5(clean), lost


def _share_gaps(docs: DataFrame, labels: DataFrame) -> DataFrame:
    n = docs.join(labels, "doc_id").groupBy("source").agg(
        F.count(F.when(c("quality") == 1, 1)).alias("x1"), F.count("quality").alias("n1"), F.count(F.when(c("toxic") == 1, 1)).alias("x2"), F.count("toxic").alias("n2")
    )
    low, high = S.newcombe(c("x1"), c("n1"), c("x2"), c("n2"))
    return n.select("source", low.alias("low"), high.alias("high"))


_q("sf28_share_gaps", _SHARES, _share_gaps, "documents", "labels")

# --- notetypes and tags ------------------------------------------------------------------------------------------------
_q(
    "m15_canonical_tags",
    "SELECT id, upper(tag) || '|label::x' AS tags FROM notes",
    lambda n: n.select("id", F.array_join(M.canonical_tags(F.array(F.lit("label::x"), c("tag"), F.upper("tag"), F.lit(" "))), "|").alias("tags")),
    "notes",
)
_q(
    "m21_rewritten_fields",
    "SELECT id, mid, back || '|' || front || '|' AS flds FROM notes WHERE mid = 3",
    lambda n, k: M.with_rewritten_schema(n.where("mid = 3"), k, [1, 0, None], [1, 0])[0].select("id", "mid", F.array_join("flds", "|").alias("flds")),
    "notes", "cards",
)
_q(
    "m21_rewritten_templates",
    "SELECT id, CAST(0 AS INT) AS ord FROM cards WHERE ord = 1",
    lambda n, k: M.with_rewritten_schema(n.where("mid = 3"), k, [0, 1], [1])[1].select("id", c("ord").cast("int").alias("ord")),
    "notes", "cards",
)
_q(
    "m22_merged_fields",
    "WITH a AS (SELECT n_name AS name, n_nationkey AS o FROM nation WHERE n_regionkey < 2), b AS (SELECT n_name AS name, 100 - n_nationkey AS o FROM nation WHERE n_regionkey BETWEEN 1 AND 2) "
    "SELECT coalesce(a.name, b.name) AS name, a.o AS first_ord, b.o AS second_ord, row_number() OVER (ORDER BY a.o NULLS LAST, b.o) - 1 AS ord FROM a FULL JOIN b ON a.name = b.name",
    lambda n: M.merged_notetypes(
        n.where("n_regionkey < 2").select(c("n_name").alias("name"), c("n_nationkey").alias("ord")),
        n.where("n_regionkey between 1 and 2").select(c("n_name").alias("name"), (100 - c("n_nationkey")).alias("ord")),
    ),
    "nation",
)
_q(
    "q11_cloze_gaps",
    "WITH w AS (SELECT DISTINCT id AS nid, unnest([0, id % 3]) AS ord FROM notes), h AS (SELECT nid, ord FROM cards WHERE nid IN (SELECT id FROM notes)) "
    "SELECT nid, ord, 'missing' AS status FROM w WHERE (nid, ord) NOT IN (SELECT nid, ord FROM h) UNION ALL SELECT nid, ord, 'empty' FROM h WHERE (nid, ord) NOT IN (SELECT nid, ord FROM w)",
    lambda n, k: Q.cloze_gaps(n.select("id", F.array(F.concat(F.lit("{{c1::a}} {{c"), (c("id") % 3 + 1).cast("string"), F.lit("::b}}"))).alias("flds")), k),
    "notes", "cards",
)


# --- files -------------------------------------------------------------------------------------------------------------
@register("io06_sides", "SELECT 'Q ' || item_id AS question, 'A ' || item_id % 7 AS answer FROM benchmark")
def sides(spark: SparkSession, d: str) -> DataFrame:
    """Rendered sides written as text and read back."""
    at, key = f"{scratch(spark)}/sides", c("item_id").cast("string")
    question = F.concat(F.lit("<style>p{}</style>Q "), key, F.lit("[[type:x]]"))
    answer = F.concat(F.lit("<b>Q</b><hr id=answer>A "), (c("item_id") % 7).cast("string"))
    IO.write_sides_csv(view(spark, d, "benchmark").select(question.alias("question"), answer.alias("answer")), at)
    return spark.read.schema("question string, answer string").csv(at, sep="\t", quote='"', escape='"')


@register("io10_collections", "SELECT collection_id, count(*) AS n, sum(time_ms) AS time_ms FROM reviews GROUP BY 1")
def collections(spark: SparkSession, d: str) -> DataFrame:
    """Reviews written by collection and scanned as one corpus."""
    at = f"{scratch(spark)}/collections"
    reviews = view(spark, d, "reviews").withColumn("next_day_at", F.lit(FIXED.next_day_at).cast("long"))
    reviews.write.partitionBy("collection_id").parquet(at)
    return IO.read_corpus(spark, at).groupBy("collection_id").agg(F.count("*").alias("n"), F.sum("time_ms").alias("time_ms"))


@register("io11_items", "SELECT CAST(item_id AS VARCHAR) AS id, text AS stem, item_id % 5 = 0 AS differs FROM benchmark")
def items(spark: SparkSession, d: str) -> DataFrame:
    """Items written as JSON lines, some of them twice and some of those with another answer, and loaded once by id."""
    at = f"{scratch(spark)}/items"
    rows = view(spark, d, "benchmark").select(c("item_id").cast("string").alias("id"), c("text").alias("stem"), F.lit("a").alias("answer"), "item_id")
    again = rows.where("item_id % 3 = 0").union(rows.where("item_id % 5 = 0").withColumn("answer", F.lit("b")))
    rows.union(again).drop("item_id").write.json(at)
    once, differ = IO.read_items(spark, [at])
    return once.join(differ.withColumn("differs", F.lit(True)), "id", "left").select("id", "stem", F.coalesce("differs", F.lit(False)).alias("differs"))
