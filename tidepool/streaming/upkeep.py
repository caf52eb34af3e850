"""Tables and views kept up to date by micro-batches: buckets rewritten where touched, counts moved by retractions, windows
repaired after late events.

A micro-batch is applied in two steps. First everything it is going to write is staged in full under the batch's number; then
the staged buckets replace the old ones. A batch that runs again after a lost driver finds its staged rows and only repeats
the second step, so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.context import DAY, Clock
from tidepool.sources.shared import exists, removed

c = F.col
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def staged(rows: Callable[[], DataFrame], spark: SparkSession, path: str, schema: str, by: str | None = None) -> DataFrame:
    """The rows, written under `path` unless a run before has finished writing them."""
    if not exists(spark, f"{path}/_SUCCESS"):
        writer = rows().write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


class BucketTable:
    """Rows by key in hash buckets, one folder each. A change reads and rewrites the buckets of its keys and no others.

    A bucket is one task's work, so choose `buckets` for some 100 MB each. `merge(old, changes)` gives the new rows of the
    buckets touched; it must keep at least one row of a bucket that has any (a count that falls to zero stays as a zero).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop("bucket")

    def seed(self, rows: DataFrame) -> None:
        """The first content. A run that finds a table leaves it alone."""
        if not exists(self.spark, f"{self.path}/_SUCCESS"):
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def touched(self, changes: DataFrame) -> DataFrame:
        """The rows now in the buckets of the changes' keys."""
        numbers = [r[0] for r in changes.select(self._bucket()).distinct().collect()]  # at most `buckets`
        return self._all().where(c("bucket").isin(numbers)).drop("bucket")

    def apply(self, changes: DataFrame, number: int, merge: Merge) -> None:
        at = f"{self.path}.staged/{number}"
        new = lambda: merge(self.touched(changes), changes).withColumn("bucket", self._bucket()).repartition("bucket")
        rows = staged(new, self.spark, at, f"{self.schema}, bucket int", "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        removed(self.spark, f"{self.path}.staged/{number - 2}")  # the last batch's stay, should it run again


def newest(key: list[str], order: list[str]) -> Merge:
    """Last writer wins: of the rows of a key that with the largest `order` stays."""

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.unionByName(changes.select(*old.columns))
        return both.groupBy(*key).agg(F.max_by(F.struct(*both.columns), F.struct(*order)).alias("row")).select("row.*")

    return merge


def summed(key: list[str], value: str) -> Merge:
    """Adds the changes of each key to what it has."""

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        return old.unionByName(changes.select(*old.columns)).groupBy(*key).agg(F.sum(value).alias(value))

    return merge


# -- due counts --------------------------------------------------------------------------------------------------------

#: What stands in the view: how many cards of a deck are in a queue with a due time.
DUE = ["did", "queue", "due"]
LEARN_AGAIN = 600


def day_number(at: Column, clock: Clock) -> Column:
    """The study day of an instant, counted as the clock counts days_elapsed."""
    return (clock.days_elapsed - F.floor((clock.next_day_at - 1 - F.unix_timestamp(at)) / DAY)).cast("long")


def rescheduled(answers: DataFrame, clock: Clock) -> DataFrame:
    """(cid, queue, due, at, event_id): what the last of each card's answers (cid, at, event_id, ease, ivl) makes of it. A
    failed card is learned again within minutes, another waits for its interval."""
    again = c("ease") == 1
    queue = F.when(again, 1).otherwise(2)
    due = F.when(again, F.unix_timestamp("at") + LEARN_AGAIN).otherwise(day_number(c("at"), clock) + c("ivl"))
    last = answers.where("ease > 0").groupBy("cid").agg(F.max(F.struct("at", "event_id", "ease", "ivl")).alias("x")).select("cid", "x.*")
    return last.select("cid", queue.cast("int").alias("queue"), due.cast("long").alias("due"), "at", "event_id")


class LiveDue:
    """Due counts per deck, kept by retractions: an answer takes its card out of the old (deck, queue, due) and puts it into the
    new one. No micro-batch counts cards again; reading the counts never reads the cards."""

    def __init__(self, spark: SparkSession, path: str, clock: Clock, buckets: int = 64) -> None:
        self.spark, self.path, self.clock = spark, path, clock
        self.cards = BucketTable(spark, f"{path}/cards", "cid long, did long, queue int, due long, at timestamp, event_id long", ["cid"], buckets)
        self.counts = BucketTable(spark, f"{path}/counts", "did long, queue int, due long, n long", DUE, buckets)

    def seed(self, cards: DataFrame) -> None:
        """Starts from a card table (id, did, queue, due)."""
        self.cards.seed(cards.select(c("id").alias("cid"), "did", "queue", "due", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("event_id")))
        self.counts.seed(self.cards.read().groupBy(*DUE).agg(F.count("*").alias("n")))

    def apply(self, answers: DataFrame, number: int) -> None:
        """One micro-batch of answers. Late and repeated ones lose against what the card has."""

        def moves() -> DataFrame:
            new = rescheduled(answers, self.clock)
            old = self.cards.touched(new)
            later = old["at"].isNull() | (F.struct(new["at"], new["event_id"]) > F.struct(old["at"], old["event_id"]))
            return new.join(old, "cid").where(later).select("cid", "did", *[t[k].alias(f"{w}{k}") for k in ("queue", "due") for w, t in (("old_", old), ("", new))], new["at"], new["event_id"])

        moved = staged(moves, self.spark, f"{self.path}/moves/{number}", "cid long, did long, old_queue int, queue int, old_due long, due long, at timestamp, event_id long")
        side = lambda p, n: F.struct("did", c(f"{p}queue").alias("queue"), c(f"{p}due").alias("due"), F.lit(n).cast("long").alias("n"))
        deltas = moved.select(F.inline(F.array(side("old_", -1), side("", 1)))).groupBy(*DUE).agg(F.sum("n").alias("n"))
        self.counts.apply(deltas, number, summed(DUE, "n"))
        self.cards.apply(moved.drop("old_queue", "old_due"), number, newest(["cid"], ["at", "event_id"]))
        removed(self.spark, f"{self.path}/moves/{number - 2}")

    def due_now(self, learn_cutoff: int) -> DataFrame:
        """What can be studied now per deck, from the counts: new, review, interday, intraday, total."""
        q, today = c("queue"), c("due") <= self.clock.days_elapsed
        of = lambda test: F.sum(F.when(test, c("n")).otherwise(0))
        kinds = {"new": q == 0, "review": (q == 2) & today, "interday": (q == 3) & today, "intraday": (q == 1) & (c("due") < learn_cutoff), "total": F.lit(True)}
        return self.counts.read().groupBy("did").agg(*[of(test).alias(name) for name, test in kinds.items()])

    def follow(self, events: DataFrame, checkpoint: str):
        """Keeps the view over a stream of answers."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- late events -------------------------------------------------------------------------------------------------------


def repaired(closed: DataFrame, events: DataFrame, unit: str, tagged: Callable[[DataFrame], DataFrame], totals: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has closed, mended from all events that have arrived; adds `repaired`.

    tagged(events) has a row for each event and each `unit` (a window, a card) it counts in, totals(tagged rows) the stream's
    rows with their unit and the count `answers`. A unit is repaired if its count differs from that of the events: the
    watermark dropped some of them, or it is not closed yet. Over all events only units are counted; everything else is
    computed again for the units that are wrong.
    """
    rows = tagged(events.dropDuplicates(["event_id"]))
    seen = closed.groupBy(unit).agg(F.sum("answers").alias("__seen"))
    counted = rows.groupBy(unit).agg(F.count("*").alias("__n"))
    wrong = counted.join(seen, unit, "left").where("__seen is null or __n <> __seen").select(unit)
    again = totals(rows.join(wrong, unit, "left_semi"))
    fine = closed.join(wrong, unit, "left_anti")
    return fine.withColumn("repaired", F.lit(False)).unionByName(again.select(*closed.columns).withColumn("repaired", F.lit(True)))
