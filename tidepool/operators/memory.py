"""Memory-state features from review histories, as native expressions over one array per card.

A card's history is one array (bounded by the reviews of a card, not by the table); every step below is a fold over it,
so the review log is shuffled once, by card.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.context import DAY, Clock

c = F.col
S_MIN, S_MAX, D_MIN, D_MAX = 0.001, 36_500.0, 1.0, 10.0

#: Default model parameters (fixed values of the published model, version 6).
DEFAULT_W = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)


def histories(reviews: DataFrame, clock: Clock) -> DataFrame:
    """(cid, revs): a card's reviews in order, with the rollover day of each counted back from today."""
    day = F.expr(f"({clock.next_day_at} - id div 1000) div {DAY}").alias("day")
    entry = F.struct("id", "event_id", "ease", "kind", "factor", "ivl", "last_ivl", day)
    return reviews.groupBy("cid").agg(F.array_sort(F.collect_list(entry)).alias("revs"))


def usable(history: DataFrame, ignore_before_ms: int = 0, training: bool = False) -> DataFrame:
    """(cid, kept, complete): the part of a history that memory is computed from.

    Walks backwards: the last run of learning answers starts the history; a reset ends the walk, completing the history
    if learning followed, leaving an incomplete one if another answer followed, dropping the card otherwise. Without
    learning answers the first day-long answer after the cutoff starts it (not in training). Cramming is skipped.
    """
    flag = lambda v: F.lit(v)
    start = F.struct(F.lit(None).cast("int").alias("learn"), F.lit(None).cast("int").alias("grade"), flag(False).alias("complete"), flag(False).alias("stopped"), flag(False).alias("dropped"))

    def step(acc: Column, x: Column) -> Column:
        e, i = x["e"], x["i"]
        cramming, reset = (e["kind"] == 3) & (e["factor"] == 0), (e["kind"] == 4) & (e["factor"] == 0)
        graded = e["ease"] > 0
        grade = F.when(graded & (e["id"] > ignore_before_ms) & ((e["ivl"] >= 1) | (e["ivl"] <= -DAY)), i).otherwise(acc["grade"])
        learning = graded & (e["kind"] == 0)
        has_learn, has_grade = acc["learn"].isNotNull(), grade.isNotNull()
        moved = F.struct(
            F.when(learning, i).otherwise(acc["learn"]).alias("learn"), grade.alias("grade"),
            F.when(learning, True).when(reset & has_learn, True).when(reset & has_grade, False).otherwise(acc["complete"]).alias("complete"),
            (~learning & F.when(reset, has_learn | has_grade).otherwise(has_learn)).alias("stopped"), (~learning & reset & ~has_learn & ~has_grade).alias("dropped"),
        )
        return F.when(acc["stopped"] | acc["dropped"] | cramming, acc).otherwise(moved)

    indexed = F.reverse(F.transform("revs", lambda e, i: F.struct(e.alias("e"), i.alias("i"))))
    walked = history.select("cid", "revs", F.aggregate(indexed, start, step).alias("w")).where("not w.dropped")
    learn_id = F.get("revs", c("w.learn"))["id"]
    early = c("w.learn").isNotNull() & (learn_id < ignore_before_ms)
    if training:
        at, complete = F.when(~early, c("w.learn")), c("w.complete")
    else:
        lost = early & (c("w.learn") < F.size("revs") - 1)
        at, complete = F.when(c("w.learn").isNotNull() & ~lost, c("w.learn")).otherwise(c("w.grade")), c("w.complete") & ~lost
    counted = lambda e: (e["ease"] > 0) & ~((e["kind"] == 3) & (e["factor"] == 0))
    kept = F.filter(F.slice("revs", at + 1, F.size("revs")), counted)
    gaps = F.transform(kept, lambda e, i: F.struct(e["id"].alias("id"), e["event_id"].alias("event_id"), e["ease"].alias("ease"), e["factor"].alias("factor"), e["ivl"].alias("ivl"), e["day"].alias("day")))
    out = walked.where(at.isNotNull()).select("cid", gaps.alias("k"), complete.alias("complete")).where(F.size("k") > 0)
    delta = F.transform("k", lambda e, i: F.struct(e["id"].alias("id"), e["event_id"].alias("event_id"), e["ease"].cast("double").alias("rating"), F.when(i == 0, F.lit(0)).otherwise(F.get("k", i - 1)["day"] - e["day"]).cast("double").alias("delta_t"), e["factor"].alias("factor"), e["ivl"].alias("ivl")))
    return out.select("cid", delta.alias("kept"), "complete")


def training_items(kept: DataFrame) -> DataFrame:
    """(review_id, event_id, cid, reviews): one item for each review some days after the one before it, with all prior reviews."""
    at = F.filter(F.sequence(F.lit(1), F.size("kept") - 1), lambda i: F.get("kept", i)["delta_t"] > 0)
    each = kept.where(F.size("kept") > 1).select("cid", "kept", F.explode(at).alias("i"))
    prefix = F.transform(F.slice("kept", F.lit(1), c("i") + 1), lambda e: F.struct(e["rating"].cast("int").alias("rating"), e["delta_t"].cast("int").alias("delta_t")))
    return each.select(F.get("kept", c("i"))["id"].alias("review_id"), F.get("kept", c("i"))["event_id"].alias("event_id"), "cid", prefix.alias("reviews"))


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _pick(rating: Column, values: Sequence[float]) -> Column:
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1], 1))):
        out = F.when(rating <= i, F.lit(v)).otherwise(out)
    return out


def recall(w: Sequence[float], days: Column, stability: Column) -> Column:
    factor = math.exp(math.log(0.9) / -w[20]) - 1
    return F.pow(days / stability * factor + 1, F.lit(-w[20]))


def first_state(w: Sequence[float], rating: Column) -> tuple[Column, Column]:
    difficulty = [min(max(w[4] - math.exp(w[5] * (r - 1)) + 1, D_MIN), D_MAX) for r in (1, 2, 3, 4)]
    return _clamp(_pick(rating, w[:4]), S_MIN, S_MAX), _pick(rating, difficulty)


def stepped(w: Sequence[float], days: Column, rating: Column, s: Column, d: Column) -> tuple[Column, Column]:
    """Stability and difficulty after one more review."""
    s, d = _clamp(s, S_MIN, S_MAX), _clamp(d, D_MIN, D_MAX)
    r = recall(w, days, s)
    bonus = F.when(rating == 2, F.lit(w[15])).when(rating == 4, F.lit(w[16])).otherwise(F.lit(1.0))
    success = s * (math.exp(w[8]) * (11 - d) * F.pow(s, F.lit(-w[9])) * (F.exp((1 - r) * w[10]) - 1) * bonus + 1)
    failure = F.least(w[11] * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1, F.lit(w[13])) - 1) * F.exp((1 - r) * w[14]), s / math.exp(w[17] * w[18]))
    same_day = F.exp((rating - 3 + w[18]) * w[17]) * F.pow(s, F.lit(-w[19]))
    short = s * F.when(rating >= 2, F.greatest(same_day, F.lit(1.0))).otherwise(same_day)
    new_s = F.when(days == 0, short).when(rating == 1, failure).otherwise(success)
    moved = d + (10 - d) * (-w[6] * (rating - 3)) / 9
    easiest = w[4] - math.exp(w[5] * 3) + 1
    new_d = _clamp(w[7] * (easiest - moved) + moved, D_MIN, D_MAX)
    return _clamp(new_s, S_MIN, S_MAX), new_d


def seed_state(w: Sequence[float], ease: Column, ivl: Column, retention: float = 0.9) -> tuple[Column, Column]:
    """State of a truncated history's first review, from its ease (1.3 and up) and interval; an ease of at most 1.1 holds the difficulty."""
    decay = -w[20]
    factor = 0.9 ** (1 / decay) - 1
    s = F.greatest(ivl.cast("double"), F.lit(S_MIN)) * factor / (retention ** (1 / decay) - 1)
    d = 11 - (ease - 1) / (math.exp(w[8]) * F.pow(s, F.lit(-w[9])) * math.expm1((1 - retention) * w[10]))
    return s, F.when(ease <= 1.1, (ease - 0.1) * 9 + 1).otherwise(_clamp(d, D_MIN, D_MAX))


def _fold(w: Sequence[float], retention: float) -> Column:
    """The state after a kept history, with the recall predicted for every review some days after the one before it."""
    first = F.get("kept", F.lit(0))
    ease = F.when(first["factor"] == 0, F.lit(2.5)).otherwise(first["factor"] / 1000.0)
    (s1, d1), (s2, d2) = first_state(w, first["rating"]), seed_state(w, ease, F.greatest(first["ivl"], F.lit(1)), retention)
    none = F.array().cast("array<struct<event_id:bigint,p:double,y:int,delta_t:double>>")
    start = F.struct(F.when(c("complete"), s1).otherwise(s2).alias("s"), F.when(c("complete"), d1).otherwise(d2).alias("d"), none.alias("seen"))

    def step(acc: Column, e: Column) -> Column:
        s, d = stepped(w, e["delta_t"], e["rating"], acc["s"], acc["d"])
        now = F.struct(e["event_id"].alias("event_id"), recall(w, e["delta_t"], acc["s"]).alias("p"), (e["rating"] >= 2).cast("int").alias("y"), e["delta_t"].alias("delta_t"))
        return F.struct(s.alias("s"), d.alias("d"), F.when(e["delta_t"] > 0, F.concat(acc["seen"], F.array(now))).otherwise(acc["seen"]).alias("seen"))

    return F.aggregate(F.slice("kept", F.lit(2), F.size("kept")), start, step)


def memory_states(kept: DataFrame, w: Sequence[float] = DEFAULT_W, retention: float = 0.9) -> DataFrame:
    return kept.select("cid", "complete", _fold(w, retention).alias("f")).select("cid", "complete", c("f.s").alias("stability"), c("f.d").alias("difficulty"))


def predictions(kept: DataFrame, w: Sequence[float] = DEFAULT_W, retention: float = 0.9) -> DataFrame:
    """(event_id, cid, p, y, delta_t): recall predicted before each review, and whether it was recalled."""
    return kept.select("cid", F.explode(_fold(w, retention)["seen"]).alias("x")).select("x.event_id", "cid", "x.p", "x.y", "x.delta_t")


def card_memory(cards: DataFrame, reviews: DataFrame, decks: DataFrame, clock: Clock, presets: dict[int, tuple[Sequence[float], float]]) -> DataFrame:
    """Memory state of every card under its preset's parameters ({preset: (parameters, retention)}).

    Cards without a usable history are seeded from their ease and interval, new ones have no state.
    """
    home = cards.withColumn("deck", F.when(c("odid") != 0, c("odid")).otherwise(c("did"))).join(decks.select(c("id").alias("deck"), "preset"), "deck").select("id", "preset", "type", "factor", "ivl")
    kept = usable(histories(reviews, clock)).withColumnRenamed("cid", "id")
    met = home.join(kept, "id", "left").where(c("preset").isin(*presets))
    state = retention_of = None
    for preset, (w, retention) in presets.items():  # one pass over the histories: a card takes the branch of its preset
        own = c("preset") == preset
        s0, d0 = seed_state(w, F.when(c("factor") == 0, F.lit(2.5)).otherwise(c("factor") / 1000.0), c("ivl"), retention)
        f = _fold(w, retention)
        folded, seeded = F.struct(f["s"].alias("s"), f["d"].alias("d")), F.struct(s0.alias("s"), d0.alias("d"))
        then = F.when(F.size("kept") > 0, folded).when((c("type") != 0) & (c("ivl") >= 1), seeded)
        state = F.when(own, then) if state is None else state.when(own, then)
        retention_of = F.when(own, F.lit(retention)) if retention_of is None else retention_of.when(own, F.lit(retention))
    return met.select("id", "preset", state.alias("m"), retention_of.alias("desired_retention")).select("id", "preset", c("m.s").alias("stability"), c("m.d").alias("difficulty"), "desired_retention")


# --- work load ---------------------------------------------------------------------------------------------------------


def chosen_days(cards: DataFrame, clock: Clock, weekday_factors: Sequence[float] = (1.0,) * 7) -> DataFrame:
    """For each review card the day of its fuzz range with the largest weight against one snapshot of the due counts.

    Weight: weekday factor over (load + 1) squared, over the day itself, and a little less where a sibling is due.
    """
    from tidepool.functions.scalars import fuzz_bounds

    live = cards.where((c("type") == 2) & (c("queue") == 2))
    load = live.groupBy(c("due").alias("day")).agg(F.count("*").alias("load"))
    low, high = fuzz_bounds(c("ivl").cast("double"))
    days = live.select("id", "nid", F.explode(F.sequence(low, high)).alias("ahead")).withColumn("day", c("ahead") + clock.days_elapsed)
    same_note = live.select(c("nid").alias("note"), c("due").alias("day"), c("id").alias("other")).distinct()
    near = days.join(same_note, (days["nid"] == same_note["note"]) & (days["day"] == same_note["day"]) & (c("id") != c("other")), "left").select(days["id"], days["ahead"], days["day"], c("other").isNotNull().alias("sibling")).distinct()
    factor = F.get(F.array(*[F.lit(float(x)) for x in weekday_factors]), F.pmod(c("day"), F.lit(7)).cast("int"))
    weight = factor * F.when(c("sibling"), 0.1).otherwise(1.0) / F.pow(F.coalesce("load", F.lit(0)) + 1, F.lit(2)) / c("ahead")
    weighed = near.join(load, "day", "left").select("id", "ahead", weight.alias("weight"))
    return weighed.groupBy("id").agg(F.max(F.struct("weight", -c("ahead"))).alias("b"), F.count("*").alias("choices")).select("id", (-c("b.col2")).alias("ahead"), c("b.weight").alias("weight"), "choices")
