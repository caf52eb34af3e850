"""Review-log and card statistics. Every function takes DataFrames (reviews or cards) and a Clock and returns a DataFrame.

Day offsets count rollovers and truncate toward zero: 0 is today, -1 yesterday. Ratios over nothing are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool import context as C
from tidepool.context import DAY, Clock

c = F.col


def secs() -> Column:
    return F.expr("id div 1000")


def day_offset(clock: Clock, at: Column | None = None) -> Column:
    """(seconds - next rollover) / 86400, truncated toward zero."""
    value = (secs() if at is None else at) - clock.next_day_at
    return (F.signum(value) * F.floor(F.abs(value) / DAY)).cast("long")


def scheduled() -> Column:
    """Reviews that were answered: not set by hand, not rescheduled."""
    return ~c("kind").isin(C.KIND_MANUAL, C.KIND_RESCHEDULED)


def rated() -> Column:
    return c("ease") > 0


def is_reset() -> Column:
    return (c("kind") == C.KIND_MANUAL) & (c("factor") == 0)


def is_cramming() -> Column:
    return (c("kind") == C.KIND_FILTERED) & (c("factor") == 0)


def affects_scheduling() -> Column:
    """Not cramming; together with rated() neither moved by hand."""
    return ~is_cramming()


def bucket() -> Column:
    return F.when(c("kind") == C.KIND_LEARN, "learn").when(c("kind") == C.KIND_RELEARN, "relearn").when(c("kind") == C.KIND_FILTERED, "filtered").when(c("last_ivl") < C.MATURE_DAYS, "young").otherwise("mature")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def added(cards: DataFrame, clock: Clock) -> DataFrame:
    """Cards by the day they were added; card ids are milliseconds, the offset is a ceiling."""
    day = F.ceil((F.expr("id div 1000") - clock.next_day_at) / DAY).cast("long")
    return cards.groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def daily_reviews(reviews: DataFrame, clock: Clock) -> DataFrame:
    """Per day: answers and time in each bucket."""
    b = bucket()
    sums = [x for name in ("learn", "relearn", "young", "mature", "filtered") for x in (count_if(b == name).alias(name), F.coalesce(F.sum(F.when(b == name, c("time_ms"))), F.lit(0)).alias(f"{name}_ms"))]
    return reviews.where(scheduled()).groupBy(day_offset(clock).alias("day")).agg(*sums)


def _in_periods(df: DataFrame, clock: Clock, days: tuple[int, ...]) -> DataFrame:
    """Each review once per period (of so many days up to now; 0: all time) that it falls into."""
    periods = F.array(*[F.lit(d) for d in days])
    return df.withColumn("period", F.explode(F.filter(periods, lambda p: (p == 0) | (secs() >= clock.next_day_at - p * DAY))))


def buttons(reviews: DataFrame, clock: Clock) -> DataFrame:
    graded = reviews.where((c("ease") > 0) & c("kind").isin(C.KIND_LEARN, C.KIND_REVIEW, C.KIND_RELEARN, C.KIND_FILTERED))
    kind = F.when(c("kind") != C.KIND_REVIEW, "learning").when(c("last_ivl") < C.MATURE_DAYS, "young").otherwise("mature")
    return _in_periods(graded, clock, (30, 90, 365, 0)).groupBy("period", kind.alias("bucket"), c("ease").alias("button")).agg(F.count("*").alias("n"))


def hour(clock: Clock) -> Column:
    return F.pmod(F.floor((secs() + clock.utc_offset) / 3600), F.lit(24)).cast("int")


def hours(reviews: DataFrame, clock: Clock) -> DataFrame:
    rated = reviews.where(c("kind").isin(C.KIND_LEARN, C.KIND_REVIEW, C.KIND_RELEARN))
    return _in_periods(rated, clock, (30, 90, 365, 0)).groupBy("period", hour(clock).alias("hour")).agg(F.count("*").alias("total"), count_if(c("ease") > 1).alias("correct"))


def card_bucket() -> Column:
    by_type = F.when(c("type") == C.NEW, "new").when(c("type") == C.LEARN, "learn").when(c("type") == C.RELEARN, "relearn").when(c("ivl") < C.MATURE_DAYS, "young").otherwise("mature")
    return by_type


def card_counts(cards: DataFrame) -> DataFrame:
    """Counts per kind of card, inactive cards once under their kind and once as suspended or buried."""
    inactive = F.when(c("queue") == C.SUSPENDED, "suspended").when(c("queue").isin(C.SIBLING_BURIED, C.USER_BURIED), "buried")
    both = F.array(F.struct(F.lit("including_inactive").alias("view"), card_bucket().alias("bucket")), F.struct(F.lit("excluding_inactive").alias("view"), F.coalesce(inactive, card_bucket()).alias("bucket")))
    return cards.select(F.inline(both)).groupBy("view", "bucket").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def intervals(cards: DataFrame) -> DataFrame:
    return histogram(cards.where(c("type").isin(C.REVIEW, C.RELEARN)), c("ivl"), "ivl")


def stabilities(cards: DataFrame) -> DataFrame:
    return histogram(cards.where(c("s").isNotNull()), F.round("s").cast("int"), "days")


def eases(cards: DataFrame) -> DataFrame:
    """Ease in percent of review and relearn cards, with the exact median on every row."""
    graded = cards.where(c("type").isin(C.REVIEW, C.RELEARN)).select(F.expr("factor div 10").alias("ease"))
    median = graded.agg(F.coalesce(F.median("ease"), F.lit(0.0)).alias("median"))
    return histogram(graded, c("ease"), "ease").join(F.broadcast(median), F.lit(True), "left")


def percent_bin(share: Column) -> Column:
    """Whole percents, 100 joins 99."""
    return F.least(F.floor(share * 100), F.lit(99)).cast("int")


def difficulties(cards: DataFrame) -> DataFrame:
    return histogram(cards.where(c("d").isNotNull()), percent_bin((c("d") - 1) / 9), "percent")


def retrievability(stability: Column, elapsed_secs: Column, decay: float = 0.5) -> Column:
    """Forgetting curve: 0.9 after one stability; elapsed time below zero counts as zero."""
    factor = 0.9 ** (-1 / decay) - 1
    return F.pow(F.greatest(elapsed_secs, F.lit(0)) / DAY / stability * factor + 1, F.lit(-decay))


def retrievabilities(cards: DataFrame, clock: Clock) -> DataFrame:
    """One row: mean and sum over cards with state, and the sum over notes of their cards' mean (no state counts as 0)."""
    r = cards.withColumn("r", retrievability(c("s"), F.lit(clock.now) - c("lrt")))
    per_note = r.groupBy("nid").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("mean"))
    by_card = r.agg(F.avg("r").alias("mean"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("sum_by_card"))
    return by_card.join(F.broadcast(per_note.agg(F.coalesce(F.sum("mean"), F.lit(0.0)).alias("sum_by_note"))), F.lit(True), "left")


def retrievability_histogram(cards: DataFrame, clock: Clock) -> DataFrame:
    known = cards.where(c("s").isNotNull())
    return histogram(known, percent_bin(retrievability(c("s"), F.lit(clock.now) - c("lrt"))), "percent")


_DUE = "CASE WHEN odid <> 0 AND odue <> 0 THEN odue ELSE due END"


def due_day(clock: Clock) -> Column:
    """Days from today until a card is due; learning cards are due by the second, the first due that was set counts."""
    due = F.expr(_DUE)
    return F.when(due > 1_000_000_000, F.expr(f"({_DUE} - {clock.next_day_at}) div {DAY}")).otherwise(due - clock.days_elapsed)


def future_due(cards: DataFrame, clock: Clock) -> DataFrame:
    """Cards by due day; new and suspended ones are left out, buried ones unless due after today."""
    live = cards.where((c("type") != C.NEW) & (c("queue") != C.SUSPENDED)).withColumn("day", due_day(clock))
    shown = live.where(~(c("queue").isin(C.SIBLING_BURIED, C.USER_BURIED) & (c("day") <= 0)))
    return shown.groupBy("day").agg(F.count("*").alias("n"))


def due_totals(cards: DataFrame, clock: Clock) -> DataFrame:
    """One row: whether there is a backlog, and the daily load, the sum of 1 / interval."""
    live = cards.where((c("type") != C.NEW) & (c("queue") != C.SUSPENDED)).withColumn("day", due_day(clock))
    backlog = F.coalesce(F.bool_or((c("day") < 0) & ~c("queue").isin(C.SIBLING_BURIED, C.USER_BURIED)), F.lit(False))
    return live.agg(backlog.alias("have_backlog"), F.floor(F.sum(F.lit(1.0) / F.greatest("ivl", F.lit(1))) + 1e-9).cast("int").alias("daily_load"))


def today(reviews: DataFrame, clock: Clock) -> DataFrame:
    now = reviews.where(scheduled() & (secs() >= clock.day_start))
    mature = c("last_ivl") >= C.MATURE_DAYS
    kinds = [count_if(c("kind") == k).alias(n) for k, n in ((0, "learn"), (1, "review"), (2, "relearn"), (3, "early"))]
    return now.agg(F.count("*").alias("answers"), F.coalesce(F.sum("time_ms"), F.lit(0)).alias("answer_ms"), count_if(c("ease") > 1).alias("correct"), count_if(mature).alias("mature"), count_if(mature & (c("ease") > 1)).alias("mature_correct"), *kinds)


#: Name and days before the next rollover where a retention period starts and ends.
RETENTION_PERIODS = (("today", 1, 0), ("yesterday", 2, 1), ("week", 7, 0), ("month", 30, 0), ("year", 365, 0), ("all_time", 100_000, 0))


def true_retention(reviews: DataFrame, clock: Clock) -> DataFrame:
    """Per period: passed and failed reviews of young and mature cards, in one pass: each review joins its periods as an array."""
    periods = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(clock.next_day_at - a * DAY).cast("long").alias("from"), F.lit(clock.next_day_at - b * DAY).cast("long").alias("to")) for n, a, b in RETENTION_PERIODS])
    interday = (c("kind") == C.KIND_REVIEW) | (c("last_ivl") <= -DAY) | (c("last_ivl") >= 1)
    graded = reviews.where(rated() & affects_scheduling() & interday)
    met = graded.withColumn("p", F.explode(F.filter(periods, lambda p: (secs() >= p["from"]) & (secs() < p["to"]))))
    young, passed = c("last_ivl") < C.MATURE_DAYS, c("ease") > 1
    return met.groupBy(c("p.period").alias("period")).agg(count_if(young & passed).alias("young_passed"), count_if(young & ~passed).alias("young_failed"), count_if(~young & passed).alias("mature_passed"), count_if(~young & ~passed).alias("mature_failed"))


def studied_today(reviews: DataFrame, clock: Clock) -> DataFrame:
    now = reviews.where(scheduled() & (c("id") > clock.day_start * 1000))
    return now.agg(F.count("*").alias("n"), F.coalesce(F.sum("time_ms") / 1000.0, F.lit(0.0)).alias("seconds"))


def home_deck() -> Column:
    return F.when(c("odid") != 0, c("odid")).otherwise(c("did"))


def effective_due() -> Column:
    return F.when(c("odue") != 0, c("odue")).otherwise(c("due"))


def deck_due_counts(cards: DataFrame) -> DataFrame:
    shown = cards.where((c("type") == C.REVIEW) & (c("queue") != C.SUSPENDED))
    return shown.groupBy(home_deck().alias("deck"), effective_due().alias("due")).agg(F.count("*").alias("n"))


def due_tree_counts(cards: DataFrame, clock: Clock, learn_cutoff: int) -> DataFrame:
    """Per deck: what can be studied now."""
    q = c("queue")
    interday = (q == 3) & (c("due") <= clock.days_elapsed)
    return cards.groupBy("did").agg(count_if(q == 0).alias("new"), count_if((q == 2) & (c("due") <= clock.days_elapsed)).alias("review"), count_if(interday).alias("interday"), count_if((q == 1) & (c("due") < learn_cutoff)).alias("intraday"), F.count("*").alias("total"))


def finish_line(cards: DataFrame, clock: Clock) -> DataFrame:
    q = c("queue")
    return cards.agg(
        count_if(q == 0).alias("new_remaining"), count_if((q == 2) & (c("due") <= clock.days_elapsed)).alias("review_remaining"), count_if((q.isin(1, 3)) & (c("due") <= clock.next_day_at)).alias("learn_remaining"),
        F.min(F.when(q == 1, c("due"))).alias("next_learn_due"), count_if(q == -3).alias("user_buried"), count_if(q == -2).alias("sibling_buried"), count_if(q == -1).alias("suspended"),
    )


def due_forecast(cards: DataFrame, clock: Clock, chunk: int) -> DataFrame:
    """Review and interday cards by due chunk (of so many days), young and mature."""
    shown = cards.where(c("queue").isin(2, 3))
    at = F.floor((c("due") - clock.days_elapsed) / chunk).cast("long")
    return shown.groupBy(at.alias("chunk")).agg(count_if(c("ivl") < C.MATURE_DAYS).alias("young"), count_if(c("ivl") >= C.MATURE_DAYS).alias("mature"))


def reviews_by_chunk(reviews: DataFrame, clock: Clock, chunk: int) -> DataFrame:
    at = F.floor((secs() - clock.next_day_at) / DAY / chunk).cast("long")
    b = bucket()
    parts = [x for n in ("learn", "young", "mature", "relearn", "filtered") for x in (count_if(b == n).alias(n), F.coalesce(F.sum(F.when(b == n, c("time_ms"))) / 3_600_000.0, F.lit(0.0)).alias(f"{n}_hours"))]
    return reviews.where(scheduled()).groupBy(at.alias("chunk")).agg(*parts)


def days_studied(reviews: DataFrame, clock: Clock) -> DataFrame:
    day = day_offset(clock)
    return reviews.where(scheduled()).agg(F.countDistinct(day).alias("days"), F.min(day).alias("first_day"))


def interval_summary(cards: DataFrame, chunk: int) -> DataFrame:
    """Interval groups with the overall count, mean and maximum on every row."""
    review = cards.where(c("queue") == 2)
    whole = review.agg(F.count("*").alias("cards"), F.avg("ivl").alias("mean_ivl"), F.max("ivl").alias("max_ivl"))
    return review.groupBy(F.expr(f"ivl div {chunk}").alias("chunk")).agg(F.count("*").alias("n")).join(F.broadcast(whole), F.lit(True), "left")


def ease_by_class(reviews: DataFrame) -> DataFrame:
    """Answers by class (0 learning, 1 young, 2 mature) and button."""
    kind = F.when(c("kind").isin(C.KIND_LEARN, C.KIND_RELEARN), 0).when(c("last_ivl") < C.MATURE_DAYS, 1).otherwise(2)
    return reviews.where(c("kind") != C.KIND_MANUAL).groupBy(kind.alias("class"), c("ease").alias("button")).agg(F.count("*").alias("n"))


def hourly_success(reviews: DataFrame, clock: Clock, least: int = 30) -> DataFrame:
    rated = reviews.where(c("kind").isin(0, 1, 2))
    out = rated.groupBy(hour(clock).alias("hour")).agg((F.sum(F.when(c("ease") == 1, 0).otherwise(1)) / F.count("*") * 100).alias("percent"), F.count("*").alias("n"))
    return out.where(c("n") > least)


def card_totals(cards: DataFrame) -> DataFrame:
    return cards.agg(
        F.min(F.when(c("queue") == 2, c("factor") / 10.0)).alias("low_ease"), F.avg(F.when(c("queue") == 2, c("factor") / 10.0)).alias("mean_ease"), F.max(F.when(c("queue") == 2, c("factor") / 10.0)).alias("high_ease"),
        count_if((c("queue") == 2) & (c("ivl") >= 21)).alias("mature"), count_if(c("queue").isin(1, 3) | ((c("queue") == 2) & (c("ivl") < 21))).alias("young"), count_if(c("queue") == 0).alias("new"), count_if(c("queue") < 0).alias("inactive"),
        F.count("*").alias("cards"), F.countDistinct("nid").alias("notes"),
    )


def card_summary(reviews: DataFrame) -> DataFrame:
    graded = reviews.where(scheduled())
    return graded.groupBy("cid").agg(F.min("id").alias("first_review"), F.max("id").alias("latest_review"), F.count("*").alias("reviews"), (F.sum("time_ms") / 1000.0).alias("total_secs"), (F.avg("time_ms") / 1000.0).alias("average_secs"), count_if(c("ease") == 1).alias("again"))


def ignored_before(reviews: DataFrame, before_ms: int) -> DataFrame:
    return reviews.where((c("kind") == 0) & (c("id") < before_ms)).agg(F.countDistinct("cid").alias("cards"))


def preset_load(cards: DataFrame, reviews: DataFrame, decks: DataFrame, clock: Clock) -> DataFrame:
    """Per preset: cards due today or before, load a day, reviews today."""
    home = cards.withColumn("deck", home_deck()).join(decks.select(c("id").alias("deck"), "preset"), "deck")
    due = home.groupBy("preset").agg(count_if((c("queue") == 2) & (c("due") <= clock.days_elapsed)).alias("due_today"), F.coalesce(F.sum(F.when((c("type") == 2) & (c("queue") != -1), F.lit(1.0) / F.greatest("ivl", F.lit(1)))), F.lit(0.0)).alias("due_per_day"))
    done = reviews.where(scheduled() & (secs() >= clock.day_start)).join(home.select(c("id").alias("cid"), "preset"), "cid").groupBy("preset").agg(F.countDistinct("cid").alias("reviewed_today"))
    return due.join(done, "preset", "left").select("preset", "due_today", "due_per_day", F.coalesce("reviewed_today", F.lit(0)).alias("reviewed_today"))


def period_averages(reviews: DataFrame, clock: Clock, days: int) -> DataFrame:
    shown = reviews.where(scheduled() & (secs() >= clock.next_day_at - days * DAY))
    day = day_offset(clock)
    return shown.agg(
        (F.countDistinct(day) / days).alias("share_studied"), (F.count("*") / days).alias("per_day"), (F.count("*") / F.nullif(F.countDistinct(day), F.lit(0))).alias("per_studied_day"), (F.avg("time_ms") / 1000.0).alias("answer_secs")
    )


def rebinned(days: DataFrame, last_day: int, bins: int = 70) -> DataFrame:
    """(day, n) rows from today to last_day in at most `bins` bins of equal width."""
    width = max(1, -(-(last_day + 1) // bins))
    return days.where(c("day").between(0, last_day)).groupBy(F.floor(c("day") / width).cast("long").alias("bin")).agg(F.sum("n").alias("n"))


def running_total(df: DataFrame, at: str, value: str) -> DataFrame:
    """A histogram's running total. The rows are bins, not records: one window over them is small."""
    return df.withColumn("total", F.sum(value).over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_share(df: DataFrame, order: list[str], value: str, within: str) -> DataFrame:
    run = Window.partitionBy(within).orderBy(*order)
    whole = Window.partitionBy(within)
    return df.withColumn("share", F.sum(value).over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(whole))


def calendar(reviews: DataFrame, clock: Clock) -> DataFrame:
    """Study days with their answers, and the streak (run of days) each belongs to."""
    days = reviews.where(scheduled()).groupBy(day_offset(clock).alias("day")).agg(F.count("*").alias("n"))
    run = days.withColumn("start", c("day") - F.row_number().over(Window.orderBy("day")))
    return run.withColumn("streak", F.count("*").over(Window.partitionBy("start"))).drop("start")


def quantile_trim(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows whose value is within the exact quantile of so large a share."""
    top = df.agg(F.percentile(value, F.lit(share)).alias("top"))
    return df.join(F.broadcast(top), c(value) <= c("top"))
