"""Derived columns over cards, notes and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.context import DAY, NEW, RELEARN, REVIEW, SUSPENDED, Clock
from tidepool.functions.scalars import ancestors, checksum, drop_control, elapsed_secs, forgetting_curve, html_to_line, leaf, nfc, parent
from tidepool.operators.stats import effective_due, home_deck

c = F.col


def original_due() -> Column:
    """The due value before a study list took the card: odue if the card has a home deck elsewhere."""
    return F.when((c("odid") != 0) & (c("odue") != 0), c("odue")).otherwise(c("due"))


def due_time(clock: Clock) -> Column:
    """Second at which a card is due: stored seconds, or the rollover of its day; null for new and suspended cards."""
    due = original_due()
    by_day = F.lit(clock.next_day_at) + (due - clock.days_elapsed - 1) * DAY
    return F.when((c("type") == NEW) | (c("queue") == SUSPENDED), F.lit(None)).when(due > 1_000_000_000, due).otherwise(by_day)


def due_within(days: int, clock: Clock) -> Column:
    return due_time(clock) < clock.next_day_at + days * DAY


def since_review(clock: Clock) -> Column:
    return elapsed_secs(c("lrt"), original_due(), c("ivl"), clock.days_elapsed, clock.now)


def normal_difficulty(shift: float = 0.0) -> Column:
    return (c("d") - 1) / 9 + shift


def last_position() -> Column:
    """The position kept in the card, else the due value while it is new."""
    return F.when(c("type") == NEW, original_due()).otherwise(F.coalesce(c("pos"), F.lit(None)))


def deck_path(name: Column) -> Column:
    sep = "\x1f"
    return F.struct(parent(name, sep).alias("parent"), leaf(name, sep).alias("leaf"), F.size(F.split(name, sep)).alias("level"), ancestors(name, sep).alias("ancestors"))


def prepared_notes(notes: DataFrame) -> DataFrame:
    """Clean fields in NFC, the sort field as one line of text, and the first field's checksum."""
    clean = notes.withColumn("front", nfc(drop_control(c("front")))).withColumn("back", nfc(drop_control(c("back"))))
    line = html_to_line(c("front"))
    return clean.withColumn("sfld", line).withColumn("csum", checksum(line))


def browse_cards(cards: DataFrame, notes: DataFrame, decks: DataFrame, clock: Clock) -> DataFrame:
    """One wide row per card."""
    joined = cards.join(notes.select(c("id").alias("nid"), c("front").alias("sfld"), c("tag")), "nid").join(decks.select(c("id").alias("did"), c("leaf").alias("deck")), "did")
    return joined.select(
        "id", "sfld", "deck", "tag", due_time(clock).alias("due_at"), F.when(c("type") != NEW, c("factor") / 10.0).alias("ease"), F.when(c("type").isin(REVIEW, RELEARN), c("ivl")).alias("interval"), "lapses", "reps",
        F.floor(c("id") / 1000).cast("long").alias("created"), "mod", c("s").alias("stability"), normal_difficulty().alias("difficulty"), F.when(c("s").isNotNull(), forgetting_curve(since_review(clock) / DAY, c("s"))).alias("recall"),
    )


def browse_notes(cards: DataFrame, clock: Clock) -> DataFrame:
    """Per note: what its cards come to."""
    known = cards.withColumn("home", home_deck()).withColumn("due_at", due_time(clock))
    return known.groupBy("nid").agg(
        F.avg(F.when(c("type") != NEW, c("factor") / 10.0)).alias("ease"), F.avg(F.when(c("type").isin(REVIEW, RELEARN), c("ivl"))).alias("interval"), F.min("due_at").alias("due_at"), F.max("mod").alias("mod"),
        F.sum("lapses").alias("lapses"), F.sum("reps").alias("reps"), F.countDistinct("home").alias("decks"), F.count("*").alias("cards"),
    )


def due_column() -> Column:
    return effective_due()
