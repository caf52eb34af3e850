"""Review events as a stream. Late events are dropped past the watermark here; upkeep.repaired mends the windows they belong to
in the nightly batch, which is the truth."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidepool.operators.memory import DEFAULT_W
from tidepool.streaming.model import first, step
from tidepool.streaming.upkeep import BucketTable, newest

c = F.col
ROLLOVER = "4 hours"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The event table's files as a stream, with event time `at`."""
    return events_of(spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def events_of(raw: DataFrame) -> DataFrame:
    """Rows of the event table as review events."""
    ease = F.when(c("event_type") == "error", 1).when(c("event_type") == "view", 2).when(c("event_type") == "click", 3).when(c("event_type") == "purchase", 4).otherwise(0)
    return raw.select("event_id", c("user_id").alias("cid"), c("ts").cast("timestamp").alias("at"), ease.alias("ease"), F.floor(c("value") * 100).cast("long").alias("time_ms"), (F.floor(c("value") / 10) + ease).cast("int").alias("ivl"))


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once by id; state is kept for the watermark only."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def _answers(events: DataFrame, *tags: Column) -> DataFrame:
    return events.where("ease > 0").select("*", *tags)


def in_days(events: DataFrame) -> DataFrame:
    """Answers with their study day, which begins at the rollover hour."""
    return _answers(events, F.window("at", "1 day", "1 day", ROLLOVER).alias("day"))


def in_weeks(events: DataFrame) -> DataFrame:
    """Answers with each week of study days that they count in."""
    return _answers(events, F.window("at", "7 days", "1 day", ROLLOVER).alias("week"))


def day_totals(answers: DataFrame) -> DataFrame:
    return answers.groupBy("day").agg(F.count("*").alias("answers"), (F.sum("time_ms") / 1000.0).alias("seconds"))


def week_totals(answers: DataFrame) -> DataFrame:
    return answers.groupBy("week").agg(F.count("*").alias("answers"), F.count(F.when(c("ease") > 1, 1)).alias("passed"))


def session_totals(answers: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Study sessions of each card: answers less than `gap` apart."""
    return answers.groupBy("cid", F.session_window("at", gap).alias("session")).agg(F.count("*").alias("answers"), (F.sum("time_ms") / 1000.0).alias("seconds"))


def study_days(events: DataFrame) -> DataFrame:
    """Answers and seconds per study day. The watermark, which closes the days, is the caller's (see once)."""
    return day_totals(in_days(events))


def sliding_retention(events: DataFrame) -> DataFrame:
    return week_totals(in_weeks(events))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return session_totals(_answers(events), gap)


#: The state store that keeps lists and timers per key; Spark's default one cannot.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_NO_STATE = (0.0, 0.0, 0.0, 0)


class CardMemory(StatefulProcessor):
    """A card's memory state under answers in any order.

    The answers of the last `keep_days` are held as a list, each with the state after it; an answer that comes late goes in
    where it belongs and the ones behind it are folded again. An event-time timer turns what is older into one state, which
    heads the list with an ease of 0; answers from before that are left to the batch. Repeated events count once. Calls to the
    state store are the cost of a card: one reads its list, one writes it, and a timer that comes too early is set again.
    """

    def __init__(self, w: tuple[float, ...] = DEFAULT_W, keep_days: int = 40) -> None:
        self.w, self.keep = w, keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, event_id long, ease int, s double, d double, day double, n long")

    def _folded(self, state: tuple, answers: list[tuple]) -> list[tuple]:
        s, d, last, n = state
        out = []
        for at, event_id, ease in answers:
            day = float(at // 86_400_000_000)
            s, d = step(self.w, day - last, float(ease), s, d) if n else first(self.w, float(ease))
            last, n = day, n + 1
            out.append((at, event_id, ease, s, d, last, n))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = list(self.held.get())
        base = held[:1] if held and not held[0][2] else []
        waiting = len(held) > len(base)  # answers in the list have a timer
        known, least = {x[1] for x in held[len(base) :]}, base[0][:2] if base else (-1, -1)
        new = {}
        for row in rows:
            if row.ease and row.event_id not in known and (row.us, row.event_id) > least:
                new[row.event_id] = (row.us, row.event_id, row.ease)
        if not new:
            return
        keep = max(bisect.bisect_left(held, min(new.values())), len(base))
        behind = sorted([x[:3] for x in held[keep:]] + list(new.values()))
        held = held[:keep] + self._folded(held[keep - 1][3:] if keep else _NO_STATE, behind)
        self.held.put(held)
        if not waiting:
            self.handle.registerTimer(held[-1][0] // 1000 + self.keep)
        _, _, _, s, d, _, n = held[-1]
        yield Row(cid=key[0], stability=s, difficulty=d, reviews=n)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        *_, last = self.held.get()
        due = last[0] // 1000 + self.keep
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.held.put([(*last[:2], 0, *last[3:])])
        return iter(())


def live_memory(events: DataFrame, w: tuple[float, ...] = DEFAULT_W, keep_days: int = 40, late: str = "40 days") -> DataFrame:
    """(cid, stability, difficulty, reviews): each card's state, updated with every answer, late ones included. Needs a session
    with the settings ROCKS. State per card: the answers of its last `keep_days`."""
    known = events.withWatermark("at", late).where("ease > 0").select("cid", "at", F.unix_micros("at").alias("us"), "event_id", "ease")
    shape = "cid long, stability double, difficulty double, reviews long"
    return known.groupBy("cid").transformWithState(CardMemory(w, keep_days), shape, "Update", "EventTime")


CARDS = "cid long, at timestamp, event_id long, ease int"


def keep_cards(events: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Last-writer-wins card table (cid, at, event_id, ease); a micro-batch rewrites the buckets of its cards only."""
    order = ["at", "event_id"]
    table = BucketTable(events.sparkSession, path, CARDS, ["cid"], buckets)
    table.seed(events.sparkSession.createDataFrame([], CARDS))

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("cid").agg(F.max(F.struct(*order, "ease")).alias("x")).select("cid", "x.*")
        table.apply(latest, number, newest(["cid"], order))

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", key: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its output, written as Parquet: rows as they come in append mode, the
    last version of all rows in complete mode, the newest row of each key in update mode (the one with the largest `newest`).
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    # one folder for each micro-batch: a batch that runs again replaces its own
    query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).start()
    query.awaitTermination()
    if not query.lastProgress:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/batch={query.lastProgress['batchId']}")
    rows = spark.read.schema(stream.schema).parquet(f"{path}/batch=*")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), newest).alias("row")).select("row.*")
