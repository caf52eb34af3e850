"""Streaming operators run over the event table with an available-now trigger, and scans with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.context import FIXED
from tidepool.plans.memory_sql import LIVE
from tidepool.plans.registry import register
from tidepool.sources import notes_io as IO
from tidepool.sources.fixtures import view, with_tags
from tidepool.sources.shared import scratch
from tidepool.streaming import reviews as ST
from tidepool.streaming import upkeep as UP

c = F.col


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ST.read_events(spark, f"{d}/events.parquet*")  # a glob, so that one file serves as well as a folder


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; Spark's default store holds all of it in the executors' heap."""
    before = {k: spark.conf.get(k, None) for k in ST.ROCKS}
    try:
        for k, v in ST.ROCKS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _run(spark: SparkSession, stream: DataFrame, mode: str = "complete", **newest) -> DataFrame:
    at = scratch(spark)
    with _rocks(spark):
        return ST.drained(stream, f"{at}/out", f"{at}/checkpoint", mode, **newest)


LANDINGS = 2


def _landings(spark: SparkSession, d: str, each: Callable[[str], None]) -> DataFrame:
    """Lets the event table arrive in slices of time, one after the other: a fiftieth of the events comes with the last slice,
    weeks late, another fiftieth comes twice. After each landing, each(folder) runs a stream over what is new. Returns all
    that has arrived."""
    raw = spark.read.schema(ST.EVENT_SCHEMA).parquet(f"{d}/events.parquet")
    slice_of = F.least(F.floor((F.dayofmonth("ts") - 1) * LANDINGS / 31), F.lit(LANDINGS - 1))
    late, twice = F.pmod(F.xxhash64("event_id"), F.lit(50)) == 0, F.pmod(F.xxhash64("event_id"), F.lit(50)) == 1
    at = f"{scratch(spark)}/arrivals"
    for number in range(LANDINGS):
        first = F.when(late, LANDINGS - 1).otherwise(slice_of) == number
        again = twice & (F.least(slice_of + 1, F.lit(LANDINGS - 1)) == number)
        raw.where(first).unionByName(raw.where(again)).write.parquet(f"{at}/landing={number}")
        each(f"{at}/landing=*")
    return ST.events_of(spark.read.schema(ST.EVENT_SCHEMA).parquet(f"{at}/landing=*"))


def _mended(spark: SparkSession, d: str, unit: str, tagged, totals, late: str = "1 day") -> DataFrame:
    """What the stream closes over all landings, each event once, with the units of late events repaired."""
    at = scratch(spark)
    shape = totals(tagged(ST.events_of(spark.createDataFrame([], ST.EVENT_SCHEMA)))).schema

    def each(folder: str) -> None:
        stream = totals(tagged(ST.once(ST.read_events(spark, folder, 1000), late)))
        ST.drained(stream, f"{at}/out", f"{at}/checkpoint", "append")

    with _rocks(spark):
        arrived = _landings(spark, d, each)
    return UP.repaired(spark.read.schema(shape).parquet(f"{at}/out"), arrived, unit, tagged, totals)


_AT = "date_trunc('day', ts - INTERVAL 4 HOUR) + INTERVAL 4 HOUR"
register("st1_once", "SELECT event_id FROM events")(lambda spark, d: _run(spark, ST.once(_events(spark, d), "60 days"), "append").select("event_id"))
register("st2_study_days", f"SELECT {_AT} AS day, count(*) AS answers, sum(CAST(floor(value * 100) AS BIGINT)) / 1000.0 AS seconds FROM events WHERE event_type <> 'signup' GROUP BY 1")(
    lambda spark, d: _mended(spark, d, "day", ST.in_days, ST.day_totals).select(c("day.start").cast("timestamp_ntz").alias("day"), "answers", "seconds")
)
register("st3_sliding_retention", f"SELECT {_AT} - to_days(CAST(k AS INTEGER)) AS week, count(*) AS answers, count(*) FILTER (event_type <> 'error') AS passed FROM events, range(0, 7) r(k) WHERE event_type <> 'signup' GROUP BY 1")(
    lambda spark, d: _mended(spark, d, "week", ST.in_weeks, ST.week_totals).select(c("week.start").cast("timestamp_ntz").alias("week"), "answers", "passed")
)
_SESSIONS = (
    "WITH e AS (SELECT user_id AS cid, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WHERE event_type <> 'signup'), "
    "g AS (SELECT *, sum(s) OVER (PARTITION BY cid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT cid, min(ts) AS start, count(*) AS answers FROM g GROUP BY cid, n"
)
register("st4_sessions", _SESSIONS)(
    lambda spark, d: _mended(spark, d, "cid", lambda e: e.where("ease > 0"), ST.session_totals).select("cid", c("session.start").cast("timestamp_ntz").alias("start"), "answers")
)


@register("st5_live_memory", LIVE)
def live_memory(spark: SparkSession, d: str) -> DataFrame:
    """States after all answers, of which some came late and some twice."""
    at, out = scratch(spark), []

    def each(folder: str) -> None:
        stream = ST.live_memory(ST.read_events(spark, folder, 1000))
        out[:] = [ST.drained(stream, f"{at}/out", f"{at}/checkpoint", "update", key=["cid"], newest="reviews")]

    with _rocks(spark):
        _landings(spark, d, each)
    return out[0].withColumns({n: F.round(n, 6) for n in ("stability", "difficulty")})


_LAST = (
    "WITH a AS (SELECT user_id AS cid, arg_max({{'ts': ts, 'value': value, 'ease': {ease}}}, (ts, event_id)) AS x FROM events WHERE {ease} > 0 GROUP BY 1), "
    "f AS (SELECT k.did, CASE WHEN x IS NULL THEN k.queue WHEN x.ease = 1 THEN 1 ELSE 2 END AS queue, CASE WHEN x IS NULL THEN k.due WHEN x.ease = 1 THEN CAST(floor(epoch(x.ts)) AS BIGINT) + {again} "
    "ELSE {days} - CAST(floor(({next} - 1 - floor(epoch(x.ts))) / 86400) AS BIGINT) + CAST(floor(x.value / 10) AS BIGINT) + x.ease END AS due FROM cards k LEFT JOIN a ON a.cid = k.id)"
).format(ease="CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END", again=UP.LEARN_AGAIN, days=FIXED.days_elapsed, next=FIXED.next_day_at)


@register(
    "st7_live_due",
    f"{_LAST} SELECT did, count(*) FILTER (queue = 0) AS new, count(*) FILTER (queue = 2 AND due <= {FIXED.days_elapsed}) AS review, count(*) FILTER (queue = 3 AND due <= {FIXED.days_elapsed}) AS interday, "
    f"count(*) FILTER (queue = 1 AND due < {FIXED.now} + 1200) AS intraday, count(*) AS total FROM f GROUP BY 1",
)
def live_due(spark: SparkSession, d: str) -> DataFrame:
    """Due counts of the final cards, read from the view that answers arriving late and twice have moved along."""
    at = scratch(spark)
    view_of = UP.LiveDue(spark, f"{at}/due", FIXED, buckets=8)
    view_of.seed(view(spark, d, "cards"))
    _landings(spark, d, lambda folder: view_of.follow(ST.read_events(spark, folder, 1000), f"{at}/checkpoint").awaitTermination())
    return view_of.due_now(FIXED.now + 1200)


@register("st6_kept_cards", "SELECT user_id AS cid, arg_max(CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END, (ts, event_id)) AS ease FROM events GROUP BY 1")
def kept_cards(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    _landings(spark, d, lambda folder: ST.keep_cards(ST.read_events(spark, folder, 1000), f"{at}/cards", f"{at}/checkpoint", 8).awaitTermination())
    return UP.BucketTable(spark, f"{at}/cards", ST.CARDS, ["cid"]).read().select("cid", "ease")


register("io07_research_reviews", "SELECT event_id, cid FROM reviews WHERE ease BETWEEN 1 AND 4 OR (ease = 0 AND factor = 0)")(lambda spark, d: _exported(spark, d))
register("io08_reviews_since", f"SELECT event_id FROM reviews WHERE id >= {(FIXED.now - 5 * 86400) * 1000} AND cid IN (SELECT id FROM cards WHERE flags = 1)")(lambda spark, d: IO.reviews_since(view(spark, d, "reviews"), (FIXED.now - 5 * 86_400) * 1000, view(spark, d, "cards").where("flags = 1"), ordered=True).select("event_id"))
register("io09_sql", "SELECT did, count(*) AS n FROM cards WHERE reps >= 6 GROUP BY 1")(lambda spark, d: IO.sql(spark, "SELECT did, count(*) AS n FROM {cards} WHERE reps >= :reps GROUP BY 1", {"reps": 6}, cards=view(spark, d, "cards")))
register("io12_pages", "SELECT page_id, length(html) AS n FROM pages")(lambda spark, d: IO.read_pages(spark, f"{d}/pages.parquet").select("page_id", F.length("html").alias("n")))
register("io13_vectors", "SELECT vec_id, len(embedding) AS n FROM embeddings")(lambda spark, d: IO.read_vectors(spark, f"{d}/embeddings.parquet").select("vec_id", F.size("embedding").alias("n")))


def _note_files(spark: SparkSession, d: str) -> str:
    """Notes in files of three layouts: with a head that says all, with some of it, and with nothing but rows."""
    at = f"{scratch(spark)}/files"
    notes = with_tags(view(spark, d, "notes")).select("id", F.regexp_replace("front", "[\\t;,|\"#<>&]", " ").alias("front"), F.replace("tag", F.lit("::"), F.lit("/")).alias("tag")).where("trim(front) <> ''")
    quoted = F.concat(F.lit('"'), "front", F.lit('; <b>x</b>"'))
    kinds = {
        "said": (("#separator:Semicolon", "#html:true", "#tags column:3", "#guid column:1", "#deck:Said", "#notetype:Basic"), F.concat_ws(";", "id", quoted, "tag")),
        "some": (("#notetype column:1", "#columns:kind,front,id", "#kind is a comment"), F.concat_ws(",", F.lit("Plain"), "front", "id")),
        "none": ((), F.concat_ws("\t", F.concat(F.lit("x "), "front"), "id")),
    }
    for k, (name, (head, line)) in enumerate(kinds.items()):
        lines = notes.where(c("id") % 3 == k).select(line.alias("value"))

        def with_head(frames: Iterator[pd.DataFrame], head: tuple[str, ...] = head) -> Iterator[pd.DataFrame]:
            for n, frame in enumerate(frames):
                yield pd.concat([pd.DataFrame({"value": head if n == 0 else ()}, dtype=str), frame]) if head and n == 0 else frame

        lines.mapInPandas(with_head, "value string").write.text(f"{at}/{name}")
    return at


_FRONT = "regexp_replace(front, '[\t;,|\"#<>&]', ' ', 'g')"


@register(
    "io01_note_files",
    f"WITH n AS (SELECT id, {_FRONT} AS front, replace(tag, '::', '/') AS tag FROM notes WHERE trim({_FRONT}) <> '') SELECT CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) END AS guid, "
    "CASE id % 3 WHEN 0 THEN [front || '; <b>x</b>'] WHEN 1 THEN [front, CAST(id AS VARCHAR)] ELSE ['x ' || front, CAST(id AS VARCHAR)] END AS flds, CASE WHEN id % 3 = 0 THEN tag END AS tag, "
    "CASE WHEN id % 3 = 0 THEN 'Said' END AS deck, CASE id % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Plain' END AS notetype FROM n",
)
def note_files(spark: SparkSession, d: str) -> DataFrame:
    return IO.read_note_files(spark, f"{_note_files(spark, d)}/*").select("guid", "flds", F.get("tags", 0).alias("tag"), "deck", "notetype")


@register("io03_directives", "SELECT unnest(['said', 'some', 'none']) AS name, unnest([';', ',', chr(9)]) AS delimiter, unnest([3, 3, 2]) AS n, unnest([true, false, false]) AS html, unnest([5 + 1, 2, 0]) AS said")
def directives(spark: SparkSession, d: str) -> DataFrame:
    found = {(files[0].split("/")[-2], x.delimiter, x.columns, x.is_html, len(x.directives)) for x, files in IO.note_layouts(spark, f"{_note_files(spark, d)}/*")}
    return spark.createDataFrame(sorted(found), "name string, delimiter string, n int, html boolean, said int")


@register("io04_json_notes", "SELECT CAST(item_id AS VARCHAR) AS guid, CASE WHEN item_id % 2 = 0 THEN 'Own' ELSE 'All' END AS deck, 'Basic' AS notetype, [text, CAST(item_id AS VARCHAR)] AS flds FROM benchmark")
def json_notes(spark: SparkSession, d: str) -> DataFrame:
    """Files of JSON notes, whose decks are those of the file where a note names none."""
    at = f"{scratch(spark)}/json"
    note = F.struct(c("item_id").cast("string").alias("guid"), F.when(c("item_id") % 2 == 0, "Own").alias("deck"), F.array("text", c("item_id").cast("string")).alias("fields"), F.array().cast("array<string>").alias("tags"))
    files = view(spark, d, "benchmark").groupBy((c("item_id") % 4).alias("file")).agg(F.collect_list(note).alias("notes"))
    files.select(F.lit("All").alias("default_deck"), F.lit("Basic").alias("default_notetype"), "notes").write.option("maxRecordsPerFile", 1).json(at)  # a document is a file
    return IO.read_notes_json(spark, at).select("guid", "deck", "notetype", "flds")


def _exported(spark: SparkSession, d: str) -> DataFrame:
    at = f"{scratch(spark)}/research"
    IO.export_dataset(view(spark, d, "reviews"), view(spark, d, "cards"), view(spark, d, "decks"), at, 10)
    return spark.read.parquet(f"{at}/reviews").select("event_id", "cid")


@register("io05_notes_round_trip", "SELECT id AS guid, front, regexp_replace(tag, '::', '/') AS tag FROM notes WHERE NOT contains(front, chr(9)) AND trim(front) <> ''")
def notes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Notes written as delimited text and read back by their layout."""
    at = f"{scratch(spark)}/notes"
    notes = with_tags(view(spark, d, "notes")).where("not contains(front, '\t') and trim(front) <> ''").select(c("id").cast("string").alias("guid"), F.array("front").alias("flds"), F.array(F.replace("tag", F.lit("::"), F.lit("/"))).alias("tags"))
    IO.write_notes_csv(notes, at, guid=True)
    layout = IO.Layout("\t", True, 3, (1,), tags_column=2, guid_column=0)
    return IO.map_note_columns(IO.read_notes_csv(spark, at, layout), layout).select(c("guid").cast("long").alias("guid"), F.get("flds", 0).alias("front"), F.get("tags", 0).alias("tag"))
