"""Tables and views kept by micro-batches: what is rewritten, what a repeated batch does, what late events do."""

from __future__ import annotations

import collections
import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tidepool.context import FIXED
from tidepool.plans import stream_queries as SQ
from tidepool.plans.registry import QUERIES
from tidepool.sources.shared import scratch
from tidepool.streaming import reviews as ST
from tidepool.streaming import upkeep as UP

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DAY0 = dt.datetime(2024, 1, 10, 12)


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path.removeprefix('file://')}/bucket=*/*.parquet")}


def test_a_batch_rewrites_only_its_buckets(spark):
    table = UP.BucketTable(spark, f"{scratch(spark)}/t", "k long, at long, v string", ["k"], 16)
    table.seed(spark.range(1000).selectExpr("id AS k", "0L AS at", "'old' AS v"))
    before = files_of(table.path)
    change = spark.createDataFrame([(7, 5, "new")], "k long, at long, v string")
    table.apply(change, 0, UP.newest(["k"], ["at"]))
    after = files_of(table.path)
    assert len(set(before) & set(after)) == 15 and len(after) == 16  # one bucket of sixteen
    size = sum(os.path.getsize(f) for f in set(after) - set(before))
    assert size * 8 < sum(os.path.getsize(f) for f in after)
    table.apply(spark.createDataFrame([(7, 3, "late"), (5000, 1, "more")], "k long, at long, v string"), 1, UP.newest(["k"], ["at"]))
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(rows) == 1001 and rows[7] == "new" and rows[5000] == "more" and rows[8] == "old"
    table.apply(spark.createDataFrame([], "k long, at long, v string"), 2, UP.newest(["k"], ["at"]))
    assert table.read().count() == 1001


def test_a_batch_that_runs_again_counts_once(spark):
    table = UP.BucketTable(spark, f"{scratch(spark)}/t", "k long, n long", ["k"], 4)
    table.seed(spark.createDataFrame([], "k long, n long"))
    one = spark.createDataFrame([(k % 3, 1) for k in range(30)], "k long, n long")
    for number in (0, 0, 1, 1, 1):  # each batch once more after its end
        table.apply(one, number, UP.summed(["k"], "n"))
    assert {r["k"]: r["n"] for r in table.read().collect()} == {0: 20, 1: 20, 2: 20}
    UP.staged(lambda: table.touched(one).withColumn("n", F.lit(99).cast("long")).withColumn("bucket", table._bucket()), spark, f"{table.path}.staged/2", f"{table.schema}, bucket int", "bucket")  # the driver is lost after staging
    table.apply(one, 2, UP.summed(["k"], "n"))
    assert {r["n"] for r in table.read().collect()} == {99}


def plain_due(cards, answers):
    last = {}
    for a in sorted((a for a in answers if a[3] > 0), key=lambda a: (a[1], a[2])):
        last[a[0]] = a
    out = collections.Counter()
    for cid, did, queue, due in cards:
        if cid in last:
            _, at, _, ease, ivl = last[cid]
            seconds = int(at.replace(tzinfo=dt.UTC).timestamp())
            queue, due = (1, seconds + 600) if ease == 1 else (2, FIXED.days_elapsed - (FIXED.next_day_at - 1 - seconds) // 86400 + ivl)
        out[did, queue, due] += 1
    return out


def test_due_counts_move_with_answers(spark):
    rng = random.Random(1)
    cards = [(i, i % 4, rng.choice([0, 2, 2]), rng.randrange(60)) for i in range(200)]
    view = UP.LiveDue(spark, f"{scratch(spark)}/due", FIXED, buckets=4)
    view.seed(spark.createDataFrame(cards, "id long, did long, queue int, due long"))
    answers = [(rng.randrange(230), DAY0 + dt.timedelta(minutes=rng.randrange(40_000)), i, rng.randrange(5), rng.randrange(30)) for i in range(300)]
    rng.shuffle(answers)
    for number in range(3):
        batch = spark.createDataFrame(answers[number * 100 : number * 100 + 120], "cid long, at timestamp, event_id long, ease int, ivl int")  # some in two batches
        view.apply(batch, number)
        view.apply(batch, number)
        got = collections.Counter({(r["did"], r["queue"], r["due"]): r["n"] for r in view.counts.read().collect() if r["n"]})
        assert got == plain_due(cards, answers[: number * 100 + 120])
    due = {r["did"]: r for r in view.due_now(FIXED.now).collect()}
    assert sum(r["total"] for r in due.values()) == 200
    assert due[1]["review"] == sum(n for (d, q, t), n in got.items() if d == 1 and q == 2 and t <= FIXED.days_elapsed)


@pytest.mark.parametrize(
    ("unit", "tagged", "totals"),
    [("day", ST.in_days, ST.day_totals), ("cid", lambda e: e.where("ease > 0"), ST.session_totals)],
)
def test_late_events_are_repaired(spark, unit, tagged, totals):
    got = SQ._mended(spark, SF, unit, tagged, totals).cache()
    plain = totals(tagged(ST.events_of(spark.read.schema(ST.EVENT_SCHEMA).parquet(f"{SF}/events.parquet"))))
    assert got.drop("repaired").exceptAll(plain).count() == 0 and plain.exceptAll(got.drop("repaired")).count() == 0
    shares = {r["repaired"]: r["count"] for r in got.groupBy("repaired").count().collect()}
    assert shares[True] > 0 and (unit == "cid" or shares[False] > 0)  # every card has open sessions or late events in a small table


def test_the_stream_alone_loses_late_events(spark):
    at = scratch(spark)
    rows = [(1, DAY0), (2, DAY0 + dt.timedelta(days=9)), (3, DAY0 + dt.timedelta(hours=1)), (2, DAY0 + dt.timedelta(days=9))]
    for number, (event, when) in enumerate(rows):
        spark.createDataFrame([(event, when, 5, "click", 1.0, "{}")], ST.EVENT_SCHEMA).write.parquet(f"{at}/in/landing={number}")
        closed = ST.drained(ST.study_days(ST.once(ST.read_events(spark, f"{at}/in/landing=*"))), f"{at}/out", f"{at}/checkpoint", "append")
    arrived = ST.events_of(spark.read.schema(ST.EVENT_SCHEMA).parquet(f"{at}/in/landing=*"))
    assert [r["answers"] for r in closed.collect()] == [1]  # event 3 came after its day was closed; the day of event 2 is open
    mended = UP.repaired(closed, arrived, "day", ST.in_days, ST.day_totals)
    assert sorted((r["answers"], r["repaired"]) for r in mended.collect()) == [(1, True), (2, True)]


class Store:
    """Stands in for the state of one card; counts the calls that reach the store."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.timers[0]


def test_card_memory_in_any_order_with_few_calls():
    """Three batches, late and repeated answers, a timer that is set again and one that folds the list into its head."""
    day = 86_400_000_000
    answers = [Row(us=day * d, event_id=i, ease=e) for i, (d, e) in enumerate([(1, 3), (4, 3), (9, 1), (9, 3), (20, 4), (33, 3)])]
    store, whole = Store(), Store()
    one, all_at_once = ST.CardMemory(keep_days=40), ST.CardMemory(keep_days=40)
    one.init(store)
    all_at_once.init(whole)
    (want,) = all_at_once.handleInputRows((7,), iter(answers), None)
    for part in ([4, 0], [2, 4, 1], [3, 5, 0]):
        (got,) = one.handleInputRows((7,), iter([answers[i] for i in part]), None)
    assert got == want and got.reviews == 6 and got.cid == 7
    assert store.calls == 3 * 2 + 1 and store.timers == [day // 1000 * 60]  # a list read and written each time, one timer
    assert list(one.handleExpiredTimer((7,), None, store)) == [] and len(store.rows) == 6 and store.timers.pop(0) == day // 1000 * 60
    assert store.timers == [day // 1000 * 73] and list(one.handleExpiredTimer((7,), None, store)) == []
    assert len(store.rows) == 1 and store.rows[0][2] == 0
    assert list(one.handleInputRows((7,), iter(answers[:3] + [Row(us=day * 33, event_id=2, ease=3)]), None)) == []  # older than the head
    late = Row(us=day * 50, event_id=9, ease=3)
    (more,) = one.handleInputRows((7,), iter([late]), None)
    (whole_more,) = all_at_once.handleInputRows((7,), iter([late]), None)
    assert more == whole_more and more.reviews == 7 and len(store.rows) == 2 and store.timers[-1] == day // 1000 * 90


def test_sessions_keep_their_state_outside_the_heap(spark, monkeypatch):
    """The store of each stream is RocksDB; the session has its own again afterwards."""
    key, seen, run = next(iter(ST.ROCKS)), [], ST.drained
    before = spark.conf.get(key, None)
    monkeypatch.setattr(SQ.ST, "drained", lambda *a, **k: (seen.append(spark.conf.get(key)), run(*a, **k))[1])
    assert QUERIES["st4_sessions"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [ST.ROCKS[key]] * SQ.LANDINGS and spark.conf.get(key, None) == before
