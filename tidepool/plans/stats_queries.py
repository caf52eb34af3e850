"""Statistics over the fixture views, registered with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.context import FIXED
from tidepool.operators import stats
from tidepool.plans.registry import register
from tidepool.sources.fixtures import view

NOW, NEXT, DAYS = FIXED.now, FIXED.next_day_at, FIXED.days_elapsed
_OFFSET = f"((id // 1000) - {NEXT}) // 86400"
_BUCKET = "CASE kind WHEN 0 THEN 'learn' WHEN 2 THEN 'relearn' WHEN 3 THEN 'filtered' ELSE CASE WHEN last_ivl < 21 THEN 'young' ELSE 'mature' END END"
_DUE = f"CASE WHEN odid <> 0 AND odue <> 0 THEN odue ELSE due END"
_DUE_DAY = f"CASE WHEN ({_DUE}) > 1000000000 THEN (({_DUE}) - {NEXT}) // 86400 ELSE ({_DUE}) - {DAYS} END"
_R = f"pow(greatest({NOW} - lrt, 0) / 86400.0 / s * (pow(0.9, -2) - 1) + 1, -0.5)"
_HOUR = "((id // 1000) // 3600) % 24"
_CARD = "CASE type WHEN 0 THEN 'new' WHEN 1 THEN 'learn' WHEN 3 THEN 'relearn' ELSE CASE WHEN ivl < 21 THEN 'young' ELSE 'mature' END END"


def _five(what: str, ms: bool = True, scale: str = "") -> str:
    parts = []
    for name in ("learn", "relearn", "young", "mature", "filtered"):
        parts.append(f"count(*) FILTER ({_BUCKET} = '{name}') AS {name}")
        parts.append(f"coalesce(sum(time_ms) FILTER ({_BUCKET} = '{name}'), 0){scale} AS {name}_{what}")
    return ", ".join(parts)


def _reviews(name: str, sql: str, operator) -> None:
    register(name, sql)(lambda spark, d: operator(view(spark, d, "reviews")))


def _cards(name: str, sql: str, operator) -> None:
    register(name, sql)(lambda spark, d: operator(view(spark, d, "cards")))


_cards("ag01_added", f"SELECT CAST(ceil(((id // 1000) - {NEXT}) / 86400) AS BIGINT) AS day, count(*) AS n FROM cards GROUP BY 1", lambda t: stats.added(t, FIXED))
_reviews("ag02_daily_reviews", f"SELECT {_OFFSET} AS day, {_five('ms')} FROM reviews WHERE kind NOT IN (4, 5) GROUP BY 1", lambda t: stats.daily_reviews(t, FIXED))
_reviews(
    "ag03_buttons",
    f"SELECT period, CASE WHEN kind <> 1 THEN 'learning' WHEN last_ivl < 21 THEN 'young' ELSE 'mature' END AS bucket, ease AS button, count(*) AS n FROM reviews, (VALUES (30), (90), (365), (0)) p(period) WHERE ease > 0 AND kind IN (0, 1, 2, 3) AND (period = 0 OR id // 1000 >= {NEXT} - period * 86400) GROUP BY ALL",
    lambda t: stats.buttons(t, FIXED),
)
_reviews("ag04_hours", f"SELECT period, {_HOUR} AS hour, count(*) AS total, count(*) FILTER (ease > 1) AS correct FROM reviews, (VALUES (30), (90), (365), (0)) p(period) WHERE kind IN (0, 1, 2) AND (period = 0 OR id // 1000 >= {NEXT} - period * 86400) GROUP BY ALL", lambda t: stats.hours(t, FIXED))
_cards("ag05_card_counts", f"SELECT 'including_inactive' AS view, {_CARD} AS bucket, count(*) AS n FROM cards GROUP BY ALL UNION ALL SELECT 'excluding_inactive', CASE WHEN queue = -1 THEN 'suspended' WHEN queue IN (-2, -3) THEN 'buried' ELSE {_CARD} END, count(*) FROM cards GROUP BY ALL", stats.card_counts)
_cards("ag06_intervals", "SELECT ivl, count(*) AS n FROM cards WHERE type IN (2, 3) GROUP BY 1", stats.intervals)
_cards("ag07_stabilities", "SELECT CAST(round(s) AS INT) AS days, count(*) AS n FROM cards WHERE s IS NOT NULL GROUP BY 1", stats.stabilities)
_cards("ag08_eases", "SELECT factor // 10 AS ease, count(*) AS n, (SELECT median(factor // 10) FROM cards WHERE type IN (2, 3)) AS median FROM cards WHERE type IN (2, 3) GROUP BY 1", stats.eases)
_cards("ag09_difficulties", "SELECT CAST(least(floor((d - 1) / 9 * 100), 99) AS INT) AS percent, count(*) AS n FROM cards WHERE d IS NOT NULL GROUP BY 1", stats.difficulties)
_cards("ag10_retrievability", f"WITH r AS (SELECT nid, CASE WHEN s IS NOT NULL THEN {_R} END AS r FROM cards) SELECT avg(r) AS mean, sum(r) AS sum_by_card, (SELECT sum(m) FROM (SELECT avg(coalesce(r, 0)) AS m FROM r GROUP BY nid)) AS sum_by_note FROM r", lambda t: stats.retrievabilities(t, FIXED))
_cards("ag10_retrievability_histogram", f"SELECT CAST(least(floor({_R} * 100), 99) AS INT) AS percent, count(*) AS n FROM cards WHERE s IS NOT NULL GROUP BY 1", lambda t: stats.retrievability_histogram(t, FIXED))
_cards("ag11_future_due", f"SELECT day, count(*) AS n FROM (SELECT *, {_DUE_DAY} AS day FROM cards WHERE type <> 0 AND queue <> -1) WHERE NOT (queue IN (-2, -3) AND day <= 0) GROUP BY 1", lambda t: stats.future_due(t, FIXED))
_cards("ag11_due_totals", f"SELECT bool_or(day < 0 AND queue NOT IN (-2, -3)) AS have_backlog, CAST(floor(sum(1.0 / greatest(ivl, 1)) + 1e-9) AS INT) AS daily_load FROM (SELECT *, {_DUE_DAY} AS day FROM cards WHERE type <> 0 AND queue <> -1)", lambda t: stats.due_totals(t, FIXED))
_reviews("ag12_today", f"SELECT count(*) AS answers, coalesce(sum(time_ms), 0) AS answer_ms, count(*) FILTER (ease > 1) AS correct, count(*) FILTER (last_ivl >= 21) AS mature, count(*) FILTER (last_ivl >= 21 AND ease > 1) AS mature_correct, count(*) FILTER (kind = 0) AS learn, count(*) FILTER (kind = 1) AS review, count(*) FILTER (kind = 2) AS relearn, count(*) FILTER (kind = 3) AS early FROM reviews WHERE kind NOT IN (4, 5) AND id // 1000 >= {NEXT} - 86400", lambda t: stats.today(t, FIXED))
_reviews(
    "ag13_true_retention",
    f"SELECT period, count(*) FILTER (last_ivl < 21 AND ease > 1) AS young_passed, count(*) FILTER (last_ivl < 21 AND ease = 1) AS young_failed, count(*) FILTER (last_ivl >= 21 AND ease > 1) AS mature_passed, count(*) FILTER (last_ivl >= 21 AND ease = 1) AS mature_failed FROM reviews JOIN (VALUES ('today', 1, 0), ('yesterday', 2, 1), ('week', 7, 0), ('month', 30, 0), ('year', 365, 0), ('all_time', 100000, 0)) p(period, a, b) ON id // 1000 >= {NEXT} - CAST(a AS BIGINT) * 86400 AND id // 1000 < {NEXT} - CAST(b AS BIGINT) * 86400 WHERE ease > 0 AND NOT (kind = 3 AND factor = 0) AND (kind = 1 OR last_ivl >= 1 OR last_ivl <= -86400) GROUP BY 1",
    lambda t: stats.true_retention(t, FIXED),
)
_reviews("ag14_studied_today", f"SELECT count(*) AS n, coalesce(sum(time_ms) / 1000.0, 0) AS seconds FROM reviews WHERE kind NOT IN (4, 5) AND id > {(NEXT - 86400) * 1000}", lambda t: stats.studied_today(t, FIXED))
_cards("ag15_deck_due_counts", "SELECT CASE WHEN odid <> 0 THEN odid ELSE did END AS deck, CASE WHEN odue <> 0 THEN odue ELSE due END AS due, count(*) AS n FROM cards WHERE type = 2 AND queue <> -1 GROUP BY ALL", stats.deck_due_counts)
_cards("ag16_due_tree_counts", f"SELECT did, count(*) FILTER (queue = 0) AS new, count(*) FILTER (queue = 2 AND due <= {DAYS}) AS review, count(*) FILTER (queue = 3 AND due <= {DAYS}) AS interday, count(*) FILTER (queue = 1 AND due < {NOW} + 1200) AS intraday, count(*) AS total FROM cards GROUP BY 1", lambda t: stats.due_tree_counts(t, FIXED, NOW + 1200))
_cards("ag17_finish_line", f"SELECT count(*) FILTER (queue = 0) AS new_remaining, count(*) FILTER (queue = 2 AND due <= {DAYS}) AS review_remaining, count(*) FILTER (queue IN (1, 3) AND due <= {NEXT}) AS learn_remaining, min(due) FILTER (queue = 1) AS next_learn_due, count(*) FILTER (queue = -3) AS user_buried, count(*) FILTER (queue = -2) AS sibling_buried, count(*) FILTER (queue = -1) AS suspended FROM cards", lambda t: stats.finish_line(t, FIXED))
_cards("ag22_due_forecast", f"SELECT CAST(floor((due - {DAYS}) / 7) AS BIGINT) AS chunk, count(*) FILTER (ivl < 21) AS young, count(*) FILTER (ivl >= 21) AS mature FROM cards WHERE queue IN (2, 3) GROUP BY 1", lambda t: stats.due_forecast(t, FIXED, 7))
_reviews("ag23_reviews_by_chunk", f"SELECT CAST(floor(((id // 1000) - {NEXT}) / 86400 / 7) AS BIGINT) AS chunk, {_five('hours', scale=' / 3600000.0')} FROM reviews WHERE kind NOT IN (4, 5) GROUP BY 1", lambda t: stats.reviews_by_chunk(t, FIXED, 7))
_reviews("ag24_days_studied", f"SELECT count(DISTINCT {_OFFSET}) AS days, min({_OFFSET}) AS first_day FROM reviews WHERE kind NOT IN (4, 5)", lambda t: stats.days_studied(t, FIXED))
_cards("ag25_interval_summary", "SELECT ivl // 7 AS chunk, count(*) AS n, (SELECT count(*) FROM cards WHERE queue = 2) AS cards, (SELECT avg(ivl) FROM cards WHERE queue = 2) AS mean_ivl, (SELECT max(ivl) FROM cards WHERE queue = 2) AS max_ivl FROM cards WHERE queue = 2 GROUP BY 1", lambda t: stats.interval_summary(t, 7))
_reviews("ag26_ease_by_class", "SELECT CASE WHEN kind IN (0, 2) THEN 0 WHEN last_ivl < 21 THEN 1 ELSE 2 END AS class, ease AS button, count(*) AS n FROM reviews WHERE kind <> 4 GROUP BY ALL", stats.ease_by_class)
_reviews("ag27_hourly_success", f"SELECT {_HOUR} AS hour, sum(CASE WHEN ease = 1 THEN 0 ELSE 1 END) / count(*) * 100 AS percent, count(*) AS n FROM reviews WHERE kind IN (0, 1, 2) GROUP BY 1 HAVING count(*) > 30", lambda t: stats.hourly_success(t, FIXED))
_cards("ag28_card_totals", "SELECT min(factor / 10.0) FILTER (queue = 2) AS low_ease, avg(factor / 10.0) FILTER (queue = 2) AS mean_ease, max(factor / 10.0) FILTER (queue = 2) AS high_ease, count(*) FILTER (queue = 2 AND ivl >= 21) AS mature, count(*) FILTER (queue IN (1, 3) OR (queue = 2 AND ivl < 21)) AS young, count(*) FILTER (queue = 0) AS new, count(*) FILTER (queue < 0) AS inactive, count(*) AS cards, count(DISTINCT nid) AS notes FROM cards", stats.card_totals)
_reviews("ag29_card_summary", "SELECT cid, min(id) AS first_review, max(id) AS latest_review, count(*) AS reviews, sum(time_ms) / 1000.0 AS total_secs, avg(time_ms) / 1000.0 AS average_secs, count(*) FILTER (ease = 1) AS again FROM reviews WHERE kind NOT IN (4, 5) GROUP BY 1", stats.card_summary)
_reviews("ag39_ignored_before", "SELECT count(DISTINCT cid) AS cards FROM reviews WHERE kind = 0 AND id < 1705276800000", lambda t: stats.ignored_before(t, 1_705_276_800_000))
_reviews("ag41_period_averages", f"SELECT count(DISTINCT {_OFFSET}) / 30 AS share_studied, count(*) / 30 AS per_day, count(*) / count(DISTINCT {_OFFSET}) AS per_studied_day, avg(time_ms) / 1000.0 AS answer_secs FROM reviews WHERE kind NOT IN (4, 5) AND id // 1000 >= {NEXT} - 30 * 86400", lambda t: stats.period_averages(t, FIXED, 30))
_cards("ag42_rebinned_due", f"SELECT CAST(floor(day / 2) AS BIGINT) AS bin, count(*) AS n FROM (SELECT *, {_DUE_DAY} AS day FROM cards WHERE type <> 0 AND queue <> -1) WHERE NOT (queue IN (-2, -3) AND day <= 0) AND day BETWEEN 0 AND 90 GROUP BY 1", lambda t: stats.rebinned(stats.future_due(t, FIXED), 90))
_reviews("ag43_graded_per_card", "SELECT cid, count(*) FILTER (ease > 0) AS graded, count(*) FILTER (ease > 0) >= 20 AS enough FROM reviews GROUP BY 1", lambda t: t.groupBy("cid").agg(stats.count_if(F.col("ease") > 0).alias("graded")).withColumn("enough", F.col("graded") >= 20))
_reviews("w07_running_total", f"SELECT day, n, sum(n) OVER (ORDER BY day) AS total FROM (SELECT {_OFFSET} AS day, count(*) AS n FROM reviews GROUP BY 1)", lambda t: stats.running_total(stats.histogram(t, stats.day_offset(FIXED), "day"), "day", "n"))
_cards("w08_cumulative_share", f"SELECT view, bucket, n, sum(n) OVER (PARTITION BY view ORDER BY bucket) / sum(n) OVER (PARTITION BY view) AS share FROM (SELECT 'including_inactive' AS view, {_CARD} AS bucket, count(*) AS n FROM cards GROUP BY ALL UNION ALL SELECT 'excluding_inactive', CASE WHEN queue = -1 THEN 'suspended' WHEN queue IN (-2, -3) THEN 'buried' ELSE {_CARD} END, count(*) FROM cards GROUP BY ALL)", lambda t: stats.cumulative_share(stats.card_counts(t), ["bucket"], "n", "view"))
_reviews("w13_calendar", f"WITH d AS (SELECT {_OFFSET} AS day, count(*) AS n FROM reviews WHERE kind NOT IN (4, 5) GROUP BY 1), r AS (SELECT *, day - row_number() OVER (ORDER BY day) AS g FROM d) SELECT day, n, count(*) OVER (PARTITION BY g) AS streak FROM r", lambda t: stats.calendar(t, FIXED))
_cards("s11_quantile_trim", "SELECT id, ivl FROM cards WHERE type IN (2, 3) AND ivl <= (SELECT quantile_cont(ivl, 0.95) FROM cards WHERE type IN (2, 3))", lambda t: stats.quantile_trim(t.where("type in (2, 3)").select("id", "ivl"), "ivl", 0.95).select("id", "ivl"))


@register(
    "ag40_preset_load",
    f"WITH h AS (SELECT c.*, d.preset FROM cards c JOIN decks d ON d.id = CASE WHEN c.odid <> 0 THEN c.odid ELSE c.did END), a AS (SELECT preset, count(*) FILTER (queue = 2 AND due <= {DAYS}) AS due_today, coalesce(sum(1.0 / greatest(ivl, 1)) FILTER (type = 2 AND queue <> -1), 0) AS due_per_day FROM h GROUP BY 1), b AS (SELECT preset, count(DISTINCT cid) AS n FROM reviews r JOIN h ON r.cid = h.id WHERE kind NOT IN (4, 5) AND r.id // 1000 >= {NEXT} - 86400 GROUP BY 1) SELECT a.preset, due_today, due_per_day, coalesce(n, 0) AS reviewed_today FROM a LEFT JOIN b ON a.preset = b.preset",
)
def preset_load(spark: SparkSession, d: str) -> DataFrame:
    return stats.preset_load(view(spark, d, "cards"), view(spark, d, "reviews"), view(spark, d, "decks"), FIXED)


@register("ag44_preset_use", "SELECT preset, count(*) AS n FROM decks GROUP BY 1")
def preset_use(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "decks").groupBy("preset").agg(F.count("*").alias("n"))


@register("ag36_review_volume", "SELECT l_linenumber % 4 + 1 AS ease, date_trunc('month', l_shipdate) AS month, count(*) AS n, sum(l_extendedprice) AS time FROM lineitem GROUP BY ALL")
def review_volume(spark: SparkSession, d: str) -> DataFrame:
    """The review log's volume case: monthly answers by button over the largest table."""
    t = view(spark, d, "lineitem")
    return t.groupBy((F.col("l_linenumber") % 4 + 1).alias("ease"), F.date_trunc("month", "l_shipdate").alias("month")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("time"))
