"""Memory states, calibration and topics as queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.context import FIXED
from tidepool.operators import calibration as K
from tidepool.operators import memory as M
from tidepool.operators import topics as TP
from tidepool.plans import memory_sql as SQL
from tidepool.plans.registry import register
from tidepool.sources.fixtures import view, with_tags

NOW, NEXT, DAYS = FIXED.now, FIXED.next_day_at, FIXED.days_elapsed
c = F.col


def _kept(spark: SparkSession, d: str, **how) -> DataFrame:
    return M.usable(M.histories(view(spark, d, "reviews"), FIXED), **how)


register("f01_histories", f"SELECT cid, list_transform(list_sort(list(struct_pack(id := id, event_id := event_id))), lambda x: x.event_id) AS events, count(*) AS n FROM reviews GROUP BY cid")(
    lambda spark, d: M.histories(view(spark, d, "reviews"), FIXED).select("cid", F.transform("revs", lambda e: e["event_id"]).alias("events"), F.size("revs").cast("long").alias("n"))
)
register("f02_usable_histories", SQL.USABLE)(
    lambda spark, d: _kept(spark, d).select("cid", "complete", F.size("kept").alias("n"), F.transform("kept", lambda e: e["delta_t"]).alias("gaps"))
)


@register("f03_training_items", SQL.TRAINING)
def training_items(spark: SparkSession, d: str) -> DataFrame:
    shown = F.array_join(F.transform("reviews", lambda r: F.concat_ws(":", r["rating"].cast("string"), r["delta_t"].cast("string"))), " ")
    return M.training_items(_kept(spark, d, training=True)).withColumn("reviews", shown)


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


register("f04_memory_states", SQL.STATES)(lambda spark, d: _rounded(M.memory_states(_kept(spark, d)), 6, "stability", "difficulty"))
register("f06_card_memory", SQL.card_memory("(0.85 + 0.02 * preset)"))(
    lambda spark, d: _rounded(
        M.card_memory(view(spark, d, "cards"), view(spark, d, "reviews"), view(spark, d, "decks"), FIXED, {p: (M.DEFAULT_W, 0.85 + 0.02 * p) for p in range(5)}),
        6, "stability", "difficulty",
    )
)
register("f07_predictions", SQL.PREDICTIONS)(lambda spark, d: _rounded(M.predictions(_kept(spark, d)), 9, "p"))
register("f15_chosen_days", SQL.chosen_days((1, 1, 0.5, 1, 1, 1, 0.1)))(lambda spark, d: M.chosen_days(view(spark, d, "cards"), FIXED, (1, 1, 0.5, 1, 1, 1, 0.1)))

_CASES = "SELECT event_id, collection_id, pred AS p, CASE WHEN ease >= 2 THEN 1 ELSE 0 END AS y FROM reviews"
_GRID = f"g AS (SELECT CAST(floor(p * 1000 + 0.5) AS INT) AS g, count(*) AS n, sum(p) AS sum_p, CAST(sum(y) AS BIGINT) AS sum_y FROM ({_CASES}) GROUP BY 1)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "reviews").select("event_id", "collection_id", c("pred").alias("p"), (c("ease") >= 2).cast("int").alias("y"))


_BRIER, _LOG = "(p - y) * (p - y)", "-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END"
register("f08_grid", f"WITH {_GRID} SELECT * FROM g")(lambda spark, d: K.grid(_cases(spark, d)))
register("f08_losses", f"SELECT count(*) AS n, avg(y) AS observed, avg(p) AS predicted, avg({_BRIER}) AS brier, avg({_LOG}) AS log_loss FROM ({_CASES})")(lambda spark, d: K.losses(_cases(spark, d)))
register("f09_fixed_bins", f"WITH {_GRID} SELECT CAST(least(floor(g * 10 / 1000), 9) AS INT) AS bin, sum(n) AS n, sum(sum_p) / sum(n) AS predicted, sum(sum_y) / sum(n) AS observed FROM g GROUP BY 1")(lambda spark, d: K.fixed_bins(K.grid(_cases(spark, d))))
register("f09_equal_bins", f"WITH {_GRID}, b AS (SELECT *, CAST(least(floor(coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10 / (SELECT sum(n) FROM g)), 9) AS INT) AS bin FROM g) SELECT bin, min(g) / 1000 AS low, sum(n) AS n, sum(sum_p) / sum(n) AS predicted, sum(sum_y) / sum(n) AS observed FROM b GROUP BY 1")(lambda spark, d: K.equal_bins(K.grid(_cases(spark, d))))
register("f09_ece", f"WITH {_GRID}, b AS (SELECT CAST(least(floor(g * 10 / 1000), 9) AS INT) AS bin, sum(n) AS n, sum(sum_p) / sum(n) AS p, sum(sum_y) / sum(n) AS o FROM g GROUP BY 1) SELECT sum(n * abs(p - o)) / sum(n) AS ece FROM b")(lambda spark, d: K.calibration_error(K.fixed_bins(K.grid(_cases(spark, d)))))
register("f10_auc", f"WITH {_GRID}, r AS (SELECT sum_y, n - sum_y AS lost, coalesce(sum(n - sum_y) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT sum(sum_y * (below + lost / 2.0)) / (sum(sum_y) * sum(lost)) AS auc FROM r")(lambda spark, d: K.auc(K.grid(_cases(spark, d))))
register("f11_band", f"WITH b AS (SELECT count(*) AS n, sum(y) AS x FROM ({_CASES}) WHERE p >= 0.795 AND p < 0.805) SELECT n, x AS recalled, x / n AS observed, greatest((x / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(x / n * (1 - x / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 0) AS low, least((x / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(x / n * (1 - x / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 1) AS high FROM b")(lambda spark, d: K.band(_cases(spark, d), 0.8))
register("f12_baseline", f"WITH b AS (SELECT avg(y) AS b FROM ({_CASES})) SELECT b * (1 - b) AS brier, -(b * ln(b) + (1 - b) * ln(1 - b)) AS log_loss FROM b")(lambda spark, d: K.baseline(_cases(spark, d)))
register("f13_per_collection", f"WITH e AS (SELECT collection_id, avg({_BRIER}) AS b, avg({_LOG}) AS l FROM ({_CASES}) GROUP BY 1) SELECT quantile_cont(b, 0.1) AS brier_10, quantile_cont(b, 0.5) AS brier_50, quantile_cont(b, 0.9) AS brier_90, quantile_cont(l, 0.1) AS log_loss_10, quantile_cont(l, 0.5) AS log_loss_50, quantile_cont(l, 0.9) AS log_loss_90 FROM e")(lambda spark, d: K.per_collection(_cases(spark, d)))
_U = "CAST('0x' || substr(md5(concat_ws(':', {0}, draw, 7)), 1, 8) AS BIGINT) / 4294967296"
_DRAWN = " + ".join(f"CASE WHEN {_U} >= {t} THEN 1 ELSE 0 END" for t in K.POISSON)


def _drawn(name: str, rows: str, cluster: str, value: str) -> str:
    """CTE: the interval of the mean of `value` in 200 draws of the clusters."""
    return (
        f"{name} AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, count(*) AS draws FROM (SELECT draw, sum(w * s) / nullif(sum(w * n), 0) AS mean "
        f"FROM (SELECT draw, s, n, {_DRAWN.format(cluster)} AS w FROM (SELECT {cluster}, sum({value}) AS s, count(*) AS n FROM {rows} GROUP BY 1) c, range(1, 201) r(draw)) GROUP BY draw))"
    )


register("f14_bootstrap", f"WITH e AS ({_CASES}), {_drawn('b', 'e', 'collection_id', 'y')} SELECT low, high, draws FROM b")(lambda spark, d: K.bootstrap(_cases(spark, d), "collection_id", "y"))

_RULES = [(1, "fr::src1", None, None, None), (2, "fr", None, "BB", "1A"), (3, "en::src0", "ASIA", "BB", "1B"), (4, "en", None, "CP", "4A")]
_SCHEMA = T.StructType([T.StructField("rule_no", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("rule_tag", "rule_deck", "section", "topic")])
_ATTRIBUTED = (
    "a AS (SELECT n.id, CASE WHEN starts_with(tag || '::', 'fr::src1::') THEN 1 WHEN starts_with(tag, 'fr::') THEN 2 WHEN starts_with(tag || '::', 'en::src0::') AND region = 'ASIA' THEN 3 WHEN starts_with(tag, 'en::') THEN 4 END AS rule "
    "FROM notes n JOIN (SELECT id, (SELECT r_name FROM region WHERE r_regionkey = notes.id % 5) AS region FROM notes) r ON r.id = n.id), "
    "t AS (SELECT id, CASE rule WHEN 2 THEN 'BB' WHEN 3 THEN 'BB' WHEN 4 THEN 'CP' END AS section, CASE rule WHEN 2 THEN '1A' WHEN 3 THEN '1B' WHEN 4 THEN '4A' END AS topic, CASE WHEN rule IS NULL THEN 'unmapped' WHEN rule = 1 THEN 'refused' ELSE 'ruled' END AS status FROM a)"
)
_R = f"CASE WHEN s IS NOT NULL THEN pow(greatest({NOW} - lrt, 0) / 86400.0 / s * (pow(0.9, -2) - 1) + 1, -0.5) END"
_MASTERY = (
    f"m AS (SELECT section, topic, count(*) AS cards, count(r) AS with_state, coalesce(sum(reviews), 0) AS reviews, coalesce(sum(r), 0) AS total, coalesce(sum(r * r), 0) AS squares FROM (SELECT t.section, t.topic, g.reviews, {_R} AS r FROM cards k JOIN t ON t.id = k.nid LEFT JOIN (SELECT cid, count(*) AS reviews FROM reviews WHERE ease > 0 GROUP BY 1) g ON g.cid = k.id WHERE topic IS NOT NULL) GROUP BY ALL), "
    "e AS (SELECT *, total / nullif(with_state, 0) AS mu, sqrt(greatest(squares / nullif(with_state, 0) - pow(total / nullif(with_state, 0), 2), 0) / nullif(with_state, 0)) AS se FROM m), "
    "q AS (SELECT section, topic, cards, with_state, reviews, coalesce(mu, 0) AS mean, CASE WHEN with_state < 2 THEN 0 ELSE least(greatest(mu - 1.96 * se, 0), 1) END AS low, CASE with_state WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE least(greatest(mu + 1.96 * se, 0), 1) END AS high, reviews > 0 AS covered FROM e)"
)


def _topics(spark: SparkSession, d: str) -> DataFrame:
    names = view(spark, d, "region").select(c("r_regionkey").cast("long").alias("k"), c("r_name").alias("deck"))
    notes = with_tags(view(spark, d, "notes")).withColumn("k", c("id") % 5).join(names, "k")
    return TP.attributed(notes, spark.createDataFrame(_RULES, _SCHEMA), "mcat")


def _mastery(spark: SparkSession, d: str) -> DataFrame:
    return TP.topic_mastery(view(spark, d, "cards"), _topics(spark, d), view(spark, d, "reviews"), FIXED)


register("f16_native_topics", "SELECT id, split_part(tag, '::', 1) AS section, 'x::' || tag AS topic FROM notes")(lambda spark, d: with_tags(view(spark, d, "notes")).withColumn("own", TP.native_topic(F.transform("tags", lambda t: F.concat(F.lit("x::"), t)), "x")).select("id", "own.section", "own.topic"))
register("f17_attribution", f"WITH {_ATTRIBUTED} SELECT id, section, topic, status FROM t")(_topics)
register("f18_guarded", "SELECT count(*) AS excluded FROM notes WHERE mid = 4")(lambda spark, d: TP.guarded(view(spark, d, "notes"), 4)[1])
register("ag30_topic_mastery", f"WITH {_ATTRIBUTED}, {_MASTERY} SELECT * FROM q")(_mastery)
register("ag31_accounting", f"WITH {_ATTRIBUTED} SELECT count(*) FILTER (mid <> 4) AS considered, count(*) FILTER (mid = 4) AS excluded, count(*) FILTER (mid <> 4 AND topic IS NULL) AS unmapped FROM cards k JOIN notes n ON n.id = k.nid JOIN t ON t.id = k.nid")(lambda spark, d: TP.accounting(view(spark, d, "cards"), _topics(spark, d), view(spark, d, "notes").where("mid = 4")))


@register(
    "ag33_section_scores",
    f"WITH {_ATTRIBUTED}, {_MASTERY}, w AS (SELECT section, sum(reviews) AS reviews, sum(CASE WHEN covered THEN cards ELSE 0 END) AS history_cards, sum(with_state) AS n, sum(with_state * mean) / nullif(sum(with_state), 0) AS estimate, sum(with_state * low) / nullif(sum(with_state), 0) AS low, sum(with_state * high) / nullif(sum(with_state), 0) AS high, count(*) FILTER (covered) AS ct FROM q GROUP BY 1), "
    "x AS (SELECT *, CASE WHEN reviews < 200 THEN 'too few reviews' WHEN history_cards < 30 THEN 'too few cards' WHEN n = 0 THEN 'no memory state' END AS reason, CASE section WHEN 'BB' THEN 9 WHEN 'CP' THEN 10 ELSE 0 END AS ol FROM w) "
    "SELECT section, reviews, history_cards, reason IS NULL AS available, CASE WHEN reason IS NULL THEN estimate END AS estimate, CASE WHEN reason IS NULL THEN low END AS low, CASE WHEN reason IS NULL THEN high END AS high, reason, CASE WHEN reason IS NOT NULL THEN NULL WHEN reviews >= 1000 THEN 'high' WHEN reviews >= 400 THEN 'medium' ELSE 'low' END AS confidence, 'too few topics' AS performance, CASE WHEN reviews < 200 THEN 'too few reviews' WHEN ct * 100.0 / ol < 50 THEN 'too little coverage' ELSE 'mapping not validated' END AS readiness FROM x",
)
def section_scores(spark: SparkSession, d: str) -> DataFrame:
    attempts = view(spark, d, "items").select(F.explode(F.array(F.lit("BB"), F.lit("CP"))).alias("section"), F.lit("one").alias("topic"))
    out = TP.section_scores(_mastery(spark, d), TP.attempts_by_section(attempts), {"BB": 9, "CP": 10})
    return out.select("section", "reviews", "history_cards", "memory.*", "confidence", "performance", "readiness")


register("ag34_attempts", "SELECT role AS section, count(*) AS attempts, count(DISTINCT conv_id) AS topics FROM conversations GROUP BY 1")(lambda spark, d: TP.attempts_by_section(view(spark, d, "conversations").select(c("role").alias("section"), c("conv_id").alias("topic"))))
_WILSON = "greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0.0) AS low, least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1.0) AS high"
_BLOCKS = (
    "r AS (SELECT cid AS card_id, ease = 0 AS skipped, CASE WHEN ease >= 2 THEN 1 ELSE 0 END AS correct, CASE row_number() OVER (PARTITION BY cid ORDER BY id, event_id) WHEN 1 THEN 'card' WHEN 2 THEN 'rset' WHEN 3 THEN 'rset' WHEN 4 THEN 'rset' ELSE 'pset' END AS block FROM reviews), "
    "g AS (SELECT * FROM r WHERE NOT skipped), s AS (SELECT block, count(*) AS n, avg(correct) AS p FROM g GROUP BY 1), w AS (SELECT block, n, p, " + _WILSON + " FROM s), "
    "rs AS (SELECT * FROM g WHERE block = 'rset'), per AS (SELECT card_id, avg(correct) FILTER (block = 'card') - avg(correct) FILTER (block = 'rset') AS d FROM g GROUP BY 1 HAVING d IS NOT NULL)"
)


@register(
    "ag45_block_gaps",
    f"WITH {_BLOCKS}, {_drawn('cb', 'rs', 'card_id', 'correct')}, {_drawn('pb', 'per', 'card_id', 'd')} SELECT CASE block WHEN 'card' THEN 'card' WHEN 'pset' THEN 'held out' ELSE 'reworded, naive' END AS measure, n, p AS point, low, high FROM w "
    "UNION ALL SELECT 'card minus held out', b.n, a.p - b.p, a.p - b.p - sqrt(pow(a.p - a.low, 2) + pow(b.high - b.p, 2)), a.p - b.p + sqrt(pow(a.high - a.p, 2) + pow(b.p - b.low, 2)) FROM w a, w b WHERE a.block = 'card' AND b.block = 'pset' "
    "UNION ALL SELECT 'reworded', (SELECT count(*) FROM rs), (SELECT avg(correct) FROM rs), low, high FROM cb UNION ALL SELECT 'card minus reworded', (SELECT count(*) FROM per), (SELECT avg(d) FROM per), low, high FROM pb",
)
def block_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A card's first answer, the three after it, and the rest stand for the three blocks."""
    place = F.row_number().over(Window.partitionBy("cid").orderBy("id", "event_id"))
    block = F.when(place == 1, "card").when(place <= 4, "rset").otherwise("pset")
    rows = view(spark, d, "reviews").select(c("cid").alias("card_id"), block.alias("block"), (c("ease") >= 2).cast("int").alias("correct"), (c("ease") == 0).alias("skipped"))
    return K.block_gaps(rows)


register("ag45_block_accuracy", "SELECT collection_id % 3 AS block, count(*) AS n, sum(y) AS right, sum(y) / count(*) AS accuracy FROM (" + _CASES + ") GROUP BY 1")(lambda spark, d: _cases(spark, d).groupBy((c("collection_id") % 3).alias("block")).agg(F.count("*").alias("n"), F.sum("y").alias("right"), (F.sum("y") / F.count("*")).alias("accuracy")))
