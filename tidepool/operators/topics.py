"""Topic attribution, mastery per topic, and scores that abstain where evidence is thin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.context import DAY, Clock
from tidepool.functions.scalars import forgetting_curve
from tidepool.operators.projections import since_review
from tidepool.operators.tables import first_rule

c = F.col
#: Evidence a score needs (fixed values).
MIN_REVIEWS, MIN_CARDS, MIN_ATTEMPTS, MIN_COVERAGE = 200, 30, 20, 50.0


def native_topic(tags: Column, prefix: str) -> Column:
    """The first tag prefix::section::topic as (section, topic); null if there is none."""
    tag = F.get(F.filter(tags, lambda t: t.rlike(f"^{prefix}::[^:]+::.+")), 0)
    return F.when(tag.isNotNull(), F.struct(F.get(F.split(tag, "::"), 1).alias("section"), tag.alias("topic")))


def attributed(notes: DataFrame, rules: DataFrame, prefix: str) -> DataFrame:
    """(id, section, topic, status): own tag first, else the first matching rule; a rule without a topic refuses."""
    ruled = first_rule(notes.withColumn("own", native_topic(c("tags"), prefix)), rules)
    status = F.when(c("own").isNotNull(), "own").when(c("rule_no").isNull(), "unmapped").when(c("topic").isNull(), "refused").otherwise("ruled")
    return ruled.select("id", F.coalesce("own.section", F.when(c("topic").isNotNull(), c("section"))).alias("section"), F.coalesce("own.topic", "topic").alias("topic"), status.alias("status"))


def guarded(notes: DataFrame, attempt_type: int) -> tuple[DataFrame, DataFrame]:
    """Notes without the attempts' own type, and how many those were."""
    return notes.where(c("mid") != attempt_type), notes.where(c("mid") == attempt_type).agg(F.count("*").alias("excluded"))


def mean_range(n: Column, total: Column, squares: Column) -> tuple[Column, Column, Column]:
    """Mean and its 95% range in 0..1; nothing known is (0, 0, 0), one value (mean, 0, 1)."""
    mean = total / F.nullif(n, F.lit(0))
    error = F.sqrt(F.greatest(squares / F.nullif(n, F.lit(0)) - mean * mean, F.lit(0.0)) / F.nullif(n, F.lit(0)))
    bound = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    zero = F.lit(0.0)
    return F.coalesce(mean, zero), F.when(n < 2, zero).otherwise(bound(mean - 1.96 * error)), F.when(n == 0, zero).when(n == 1, F.lit(1.0)).otherwise(bound(mean + 1.96 * error))


def topic_mastery(cards: DataFrame, topics: DataFrame, reviews: DataFrame, clock: Clock) -> DataFrame:
    """Per topic, all sections in one aggregation: cards, cards with state, reviews, mean recall and its range."""
    graded = reviews.where("ease > 0").groupBy(c("cid").alias("id")).agg(F.count("*").alias("reviews"))
    of = cards.join(topics.where("topic is not null").select(c("id").alias("nid"), "section", "topic"), "nid").join(graded, "id", "left")
    r = F.when(c("s").isNotNull(), forgetting_curve(since_review(clock) / DAY, c("s")))
    sums = of.withColumn("r", r).groupBy("section", "topic").agg(F.count("*").alias("cards"), F.count("r").alias("with_state"), F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(c("r") * c("r")), F.lit(0.0)).alias("squares"))
    mean, low, high = mean_range(c("with_state"), c("total"), c("squares"))
    return sums.select("section", "topic", "cards", "with_state", "reviews", mean.alias("mean"), low.alias("low"), high.alias("high"), (c("reviews") > 0).alias("covered"))


def accounting(cards: DataFrame, topics: DataFrame, attempt_notes: DataFrame) -> DataFrame:
    """Cards considered, left out as attempts, and without a topic."""
    met = cards.join(topics.select(c("id").alias("nid"), "topic"), "nid", "left").join(attempt_notes.select(c("id").alias("nid"), F.lit(True).alias("attempt")), "nid", "left")
    out = F.coalesce("attempt", F.lit(False))
    return met.agg(F.count(F.when(~out, 1)).alias("considered"), F.count(F.when(out, 1)).alias("excluded"), F.count(F.when(~out & c("topic").isNull(), 1)).alias("unmapped"))


def _score(available: Column, estimate: Column, low: Column, high: Column, reason: Column) -> Column:
    return F.struct(available.alias("available"), F.when(available, estimate).alias("estimate"), F.when(available, low).alias("low"), F.when(available, high).alias("high"), reason.alias("reason"))


def section_scores(mastery: DataFrame, attempts: DataFrame, outline: dict[str, int]) -> DataFrame:
    """Per section: memory as a number or a reason; performance and readiness always abstain, with the first reason that holds.

    attempts: (section, attempts, topics). outline: topics a section has; a section without topics is not modelled.
    """
    weight = c("with_state")
    sums = mastery.groupBy("section").agg(
        F.sum("reviews").alias("reviews"), F.sum(F.when(c("covered"), c("cards")).otherwise(0)).alias("history_cards"), F.sum(weight).alias("weight"), F.sum(weight * c("mean")).alias("m"), F.sum(weight * c("low")).alias("l"), F.sum(weight * c("high")).alias("h"),
        F.count(F.when(c("covered"), 1)).alias("covered_topics"),
    )
    total = F.create_map(*[F.lit(x) for pair in outline.items() for x in pair])
    met = sums.join(attempts, "section", "left").withColumn("outline", F.coalesce(total[c("section")], F.lit(0)))
    n, need = F.coalesce("attempts", F.lit(0)), F.ceil(c("outline") / 3)
    coverage = F.when(c("outline") > 0, c("covered_topics") * 100.0 / c("outline")).otherwise(F.lit(0.0))
    reason = F.when(c("reviews") < MIN_REVIEWS, "too few reviews").when(c("history_cards") < MIN_CARDS, "too few cards").when(c("weight") == 0, "no memory state")
    memory = _score(reason.isNull(), c("m") / F.nullif(c("weight"), F.lit(0)), c("l") / F.nullif(c("weight"), F.lit(0)), c("h") / F.nullif(c("weight"), F.lit(0)), reason)
    performance = F.when(n < MIN_ATTEMPTS, "too few attempts").when(F.coalesce("topics", F.lit(0)) < need, "too few topics").otherwise("model not fitted")
    readiness = F.when(c("reviews") < MIN_REVIEWS, "too few reviews").when(n < MIN_ATTEMPTS, "too few attempts").when(coverage < MIN_COVERAGE, "too little coverage").otherwise("mapping not validated")
    confidence = F.when(reason.isNotNull(), None).when(c("reviews") >= 5 * MIN_REVIEWS, "high").when(c("reviews") >= 2 * MIN_REVIEWS, "medium").otherwise("low")
    return met.select("section", "reviews", "history_cards", memory.alias("memory"), confidence.alias("confidence"), performance.alias("performance"), readiness.alias("readiness"), coverage.alias("coverage"))


def attempts_by_section(attempts: DataFrame) -> DataFrame:
    """(section, attempts, topics) of held-out attempts (section, topic)."""
    return attempts.groupBy("section").agg(F.count("*").alias("attempts"), F.countDistinct("topic").alias("topics"))


def least_topics(outline: int) -> int:
    return math.ceil(outline / 3)
