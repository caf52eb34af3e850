"""Scans and sinks of notes, reviews, items, pages and vectors. Schemas are declared, never inferred."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.scalars import strip_html

c = F.col
DELIMITERS = ("\t", "|", ";", ":", ",", " ")
_HTML = r"(?i)<(?:br|div|p|b|i|u|img|span|a)\b[^>]*>|&[a-z]+;"


@dataclass(frozen=True)
class Layout:
    """Where things are in a delimited file, counted from 0; directives of the file itself override the defaults."""

    delimiter: str = "\t"
    is_html: bool = False
    columns: int = 2
    fields: tuple[int, ...] = (0, 1)
    tags_column: int | None = None
    deck_column: int | None = None
    notetype_column: int | None = None
    guid_column: int | None = None
    directives: dict[str, str] = field(default_factory=dict)
    multiline: bool = True


_NAMED = {"tab": "\t", "comma": ",", "semicolon": ";", "space": " ", "pipe": "|", "colon": ":"}


def note_layouts(spark: SparkSession, path: str, columns: int | None = None) -> list[tuple[Layout, list[str]]]:
    """The layouts of the files under a path, and the files of each.

    A file says how it is to be read in `#key:value` lines at its head, the later of two counting; else its first row shows it:
    the first of the delimiters that occurs there, and as many columns as it has. Cells are HTML if any row of the file
    looks like it. One scan over all lines; what reaches the driver is a row for each layout, with its files' names.
    """
    lines = spark.read.text(path).select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    comment = F.startswith("value", F.lit("#"))
    first = F.min(F.when((c("block") == 0) & ~comment, F.struct("id", "value"))).alias("first")
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    shown = lines.groupBy("file").agg(first, F.max(F.when(~comment, c("value").rlike(_HTML))).alias("html"), F.coalesce(F.max(odd & ~comment), F.lit(False)).alias("multiline"))
    heads = lines.where((c("block") == 0) & c("value").rlike("^#[A-Za-z ]+:")).join(shown.select("file", c("first.id").alias("until")), "file").where("until is null or id < until")
    key, value = F.lower(F.trim(F.substring_index(F.substring("value", 2, 1 << 30), ":", 1))), F.trim(F.regexp_replace("value", "^[^:]*:", ""))
    said = heads.groupBy("file", key.alias("key")).agg(F.max_by(value, "id").alias("value")).groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("said"))
    row = F.coalesce(c("first.value"), F.lit(""))
    guess = F.coalesce(*[F.when(F.contains(row, F.lit(d)), F.lit(d)) for d in DELIMITERS], F.lit("\t"))
    own = F.get(F.map_values(F.map_filter("said", lambda k, _: k == "separator")), 0)
    named = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair]), lambda k, _: k == F.lower(own))), 0)
    per = shown.join(said, "file", "left").withColumn("delimiter", F.coalesce(named, own, guess))
    width = F.size(F.split(F.regexp_replace(row, '"[^"]*"', ""), F.concat(F.lit("\\Q"), c("delimiter"), F.lit("\\E"))))
    per = per.withColumn("width", width).groupBy("delimiter", "html", "multiline", "width", F.to_json("said").alias("said")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [(_layout(r, columns), r["files"]) for r in per.collect()]


def _layout(row: Row, columns: int | None) -> Layout:
    said = json.loads(row["said"] or "{}")
    count = columns or (len(said["columns"].split(row["delimiter"])) if said.get("columns") else row["width"])
    number = lambda key: int(said[key]) - 1 if said.get(key, "").isdigit() else None
    special = {k: number(f"{k} column") for k in ("tags", "deck", "notetype", "guid")}
    html = said["html"].lower() == "true" if "html" in said else bool(row["html"])
    fields = tuple(i for i in range(count) if i not in special.values())
    return Layout(row["delimiter"], html, count, fields, special["tags"], special["deck"], special["notetype"], special["guid"], said, row["multiline"])


def csv_profile(spark: SparkSession, path: str, columns: int | None = 2) -> Layout:
    """The layout of files that are all alike."""
    found = note_layouts(spark, path, columns)
    if len(found) != 1:
        raise ValueError(f"{len(found)} layouts under {path}; read_note_files reads each file by its own")
    return found[0][0]


def read_notes_csv(spark: SparkSession, path: str | list[str], layout: Layout) -> DataFrame:
    """Cells c0.. of every row; rows may be short, comments and a leading tags line are skipped. Files with no line end inside a
    cell are split over tasks."""
    schema = ", ".join(f"c{i} string" for i in range(layout.columns))
    rows = spark.read.schema(schema).csv(path, sep=layout.delimiter, comment="#", multiLine=layout.multiline, mode="PERMISSIVE", escape='"')
    return rows.where(~F.startswith(F.coalesce("c0", F.lit("")), F.lit("tags:")))


def read_note_files(spark: SparkSession, path: str) -> DataFrame:
    """(flds, tags, deck, notetype, guid) of all note files under a path, each read by its own layout. A deck or notetype that a
    file names for all of its notes holds where a row names none."""
    notes = None
    for layout, files in note_layouts(spark, path):
        some = map_note_columns(read_notes_csv(spark, files, layout), layout)
        some = some.withColumns({k: F.coalesce(F.nullif(k, F.lit("")), F.lit(layout.directives.get(k)).cast("string")) for k in ("deck", "notetype")})
        if also := layout.directives.get("tags"):
            some = some.withColumn("tags", F.array_union("tags", F.array(*[F.lit(t) for t in also.split()])))
        notes = some if notes is None else notes.unionByName(some)
    return spark.createDataFrame([], "flds array<string>, tags array<string>, deck string, notetype string, guid string") if notes is None else notes


def map_note_columns(rows: DataFrame, layout: Layout) -> DataFrame:
    """(flds, tags, deck, notetype, guid): cells by column; cells that are not HTML are escaped, their lines become <br>."""

    def cell(i: int) -> Column:
        text = F.coalesce(c(f"c{i}"), F.lit(""))
        if layout.is_html:
            return text
        escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.regexp_replace(escaped, r"\r?\n", "<br>")

    plain = lambda i: F.lit(None).cast("string") if i is None else c(f"c{i}")
    tags = F.array().cast("array<string>") if layout.tags_column is None else F.filter(F.split(F.coalesce(plain(layout.tags_column), F.lit("")), r"\s+"), lambda t: t != "")
    return rows.select(F.array(*[cell(i) for i in layout.fields]).alias("flds"), tags.alias("tags"), plain(layout.deck_column).alias("deck"), plain(layout.notetype_column).alias("notetype"), plain(layout.guid_column).alias("guid"))


def read_notes_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "default_deck string, default_notetype string, notes array<struct<guid:string,deck:string,notetype:string,fields:array<string>,tags:array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select("default_deck", "default_notetype", F.explode("notes").alias("n")).select("n.guid", F.coalesce("n.deck", "default_deck").alias("deck"), F.coalesce("n.notetype", "default_notetype").alias("notetype"), c("n.fields").alias("flds"), c("n.tags").alias("tags"))


def write_notes_csv(notes: DataFrame, path: str, with_html: bool = True, guid: bool = False, deck: bool = False, tags: bool = True) -> None:
    """Tab-separated notes, fields first; the optional columns come in front (guid, deck) and at the end (tags)."""
    width = notes.agg(F.max(F.size("flds")).alias("n")).first()["n"] or 0
    shown = lambda f: f if with_html else strip_html(f)
    cells = [shown(F.coalesce(F.get("flds", i), F.lit(""))).alias(f"f{i}") for i in range(width)]
    front = ([c("guid")] if guid else []) + ([c("deck")] if deck else [])
    notes.select(*front, *cells, *([F.array_join("tags", " ").alias("tags")] if tags else [])).write.csv(path, sep="\t", quote='"', escape='"', emptyValue="")


def write_sides_csv(sides: DataFrame, path: str) -> None:
    """(question, answer) text: styles and typed-answer marks go, and an answer starts after its question's rule."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)<style.*?</style>", ""), r"\[\[type:[^\]]*\]\]", ""))
    answer = F.regexp_replace("answer", r"(?is)^.*?<hr id=answer>", "")
    sides.select(clean(c("question")).alias("question"), clean(answer).alias("answer")).write.csv(path, sep="\t", quote='"', escape='"', emptyValue="")


def export_dataset(reviews: DataFrame, cards: DataFrame, decks: DataFrame, path: str, min_entries: int = 0) -> None:
    """The research data set: graded and reset reviews in order of card, cards with their home deck, decks."""
    kept = reviews.where(c("ease").between(1, 4) | ((c("ease") == 0) & (c("factor") == 0)))
    if kept.limit(min_entries).count() < min_entries:
        raise ValueError(f"fewer than {min_entries} reviews")
    kept.repartitionByRange("cid").sortWithinPartitions("cid", "id").write.parquet(f"{path}/reviews")
    cards.select("id", "nid", F.when(c("odid") != 0, c("odid")).otherwise(c("did")).alias("deck")).write.parquet(f"{path}/cards")
    decks.write.parquet(f"{path}/decks")


def reviews_since(reviews: DataFrame, since_ms: int | None = None, cards: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Review-log scan with a pushed filter, a semi-join to cards, and (cid, id) order where asked for."""
    out = reviews if since_ms is None else reviews.where(c("id") >= since_ms)
    out = out if cards is None else out.join(cards.select(c("id").alias("of")), c("cid") == c("of"), "left_semi")
    return out.repartitionByRange("cid").sortWithinPartitions("cid", "id") if ordered else out


def sql(spark: SparkSession, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Ad-hoc SQL over the given tables, with parameters; tables are named in braces."""
    return spark.sql(text, args=args, **tables)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Many collections' reviews, partitioned by collection."""
    return spark.read.schema("id long, event_id long, cid long, ease int, kind int, factor int, ivl int, last_ivl int, time_ms long, next_day_at long, collection_id int").parquet(path)


def read_items(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, disagreements): JSON-lines items once by id, and the ids whose rows differ."""
    rows = spark.read.schema("id string, topic string, stem string, answer string, source_id string, options array<string>").json(paths)
    hashed = rows.withColumn("hash", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    differ = hashed.groupBy("id").agg(F.countDistinct("hash").alias("n")).where("n > 1").select("id")
    return hashed.groupBy("id").agg(F.min_by(F.struct(*[x for x in rows.columns if x != "id"]), "hash").alias("x")).select("id", "x.*"), differ


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, url string, html string").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, embedding array<float>, label int").parquet(path)
