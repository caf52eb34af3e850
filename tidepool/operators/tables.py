"""Joins, set operations, windows and orders over the review-history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidepool import context as C
from tidepool.context import DAY, Clock
from tidepool.functions.scalars import ancestors, checksum, forgetting_curve, relative_overdueness, stable_order
from tidepool.operators.projections import since_review
from tidepool.operators.ranks import numbered
from tidepool.operators.stats import day_offset, home_deck, is_reset, rated, scheduled

c = F.col

# --- joins -------------------------------------------------------------------------------------------------------------


def notes_of(notes: DataFrame, cards: DataFrame) -> DataFrame:
    """Notes that have one of the cards; a semi-join, so nothing has to be made distinct after it."""
    return notes.join(cards.select(c("nid").alias("of")), c("id") == c("of"), "left_semi")


def cards_of(cards: DataFrame, notes: DataFrame) -> DataFrame:
    return cards.join(notes.select(c("id").alias("of")), c("nid") == c("of"), "left_semi")


def reviews_of(reviews: DataFrame, cards: DataFrame) -> DataFrame:
    return reviews.join(cards.select(c("id").alias("of")), c("cid") == c("of"), "left_semi")


def orphan_cards(cards: DataFrame, notes: DataFrame) -> DataFrame:
    return cards.join(notes.select(c("id").alias("of")), c("nid") == c("of"), "left_anti")


def missing_decks(cards: DataFrame, decks: DataFrame) -> DataFrame:
    used = cards.select(F.explode(F.array("did", "odid")).alias("id")).where("id <> 0").distinct()
    return used.join(decks.select("id"), "id", "left_anti")


def studied_today_by_deck(reviews: DataFrame, cards: DataFrame, clock: Clock) -> DataFrame:
    now = reviews.where(scheduled() & (c("id") > clock.day_start * 1000)).select("cid")
    return now.join(cards.select(c("id").alias("cid"), home_deck().alias("deck")), "cid").groupBy("deck").agg(F.countDistinct("cid").alias("cards"))


def note_types_decks(notes: DataFrame, cards: DataFrame) -> DataFrame:
    home = cards.select("nid", home_deck().alias("deck")).distinct()
    return notes.select(c("id").alias("nid"), "mid", "csum").join(home, "nid")


def by_guid(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return incoming.join(existing.select("guid", c("id").alias("existing_id"), c("mod").alias("existing_mod")), "guid", "left")


#: Rows of each side that meet in a cell, on average, where a first field is frequent; and how many such fields are dealt into cells.
CELL_ROWS, FREQUENT_FIELDS = 4096, 10_000


def by_first_field(incoming: DataFrame, existing: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Candidates by (notetype, checksum), then the exact text; an incoming note without any stays once.

    The pairs of a first field grow with the square of its rows. Where either side has more than `cell_rows` of them, both sides are
    dealt into parts by id, and each part of one meets each part of the other in a cell of its own, so the pairs go to many tasks.
    The numbers of parts are broadcast, for the FREQUENT_FIELDS most frequent fields; any other has less than a 10,000th of all rows.
    """
    key = ["csum", "mid", "front"]
    existing = existing.dropna(subset=key).select(*key, "id")
    count = lambda notes, new: notes.select(*key, F.lit(new).alias("new"), F.lit(1 - new).alias("old"))
    counts = count(incoming, 1).union(count(existing, 0)).groupBy(*key).agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
    most = F.greatest("new", "old")
    parts = lambda n: F.greatest(F.ceil(c(n) / cell_rows), F.lit(1)).cast("int")
    frequent = counts.where(most > cell_rows).orderBy(most.desc(), *key).limit(FREQUENT_FIELDS)
    frequent = F.broadcast(frequent.select(*[c(x).alias(f"f{x}") for x in key], parts("new").alias("rows"), parts("old").alias("columns"), (c("old") > 0).alias("met")))

    def dealt(notes: DataFrame, own: str, other: str) -> DataFrame:
        same = [c(x).eqNullSafe(c(f"f{x}")) for x in key]
        found = notes.join(frequent, same[0] & same[1] & same[2], "left").drop(*[f"f{x}" for x in key])
        found = found.withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int"))
        return found.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    # The number is given, since sizes in bytes, by which Spark would put partitions together, say nothing of the pairs.
    tasks, cell = int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["csum", "mid", "rows", "columns", "front"]
    known = dealt(existing, "columns", "rows").select(*[c(x).alias(f"e{x}") for x in cell], c("id").alias("existing_id"), F.lit(True).alias("found"))
    asked, known = dealt(incoming, "rows", "columns").repartition(tasks, *cell), known.repartition(tasks, *[f"e{x}" for x in cell])
    same = [c(x) == c(f"e{x}") for x in cell]
    pairs = asked.join(known, same[0] & same[1] & same[2] & same[3] & same[4], "left")
    # Parts are dealt by a hash, so one may be empty; a frequent field that has notes meets them in the other cells.
    return pairs.where("found OR met IS NULL OR NOT met").select(*incoming.columns, "existing_id")


#: Rules that a plan may hold by itself.
LITERAL_RULES = 200


def _looked_up(rules: list[Row], prefixes: Column) -> Column:
    """The first of the rules whose tag is among the prefixes and whose deck, if any, is that of the row."""
    kind = "struct<rule_no:int,section:string,topic:string>"
    by_tag: dict[str, list[Row]] = {}
    for rule in rules:
        if rule["rule_tag"] is not None:
            by_tag.setdefault(rule["rule_tag"], []).append(rule)
    if not by_tag:
        return F.lit(None).cast(kind)
    text = lambda x: F.lit(x).cast("string")
    of = [F.array(*[F.struct(F.lit(r["rule_no"]).alias("rule_no"), text(r["section"]).alias("section"), text(r["topic"]).alias("topic"), text(r["rule_deck"]).alias("deck")) for r in rows]) for rows in by_tag.values()]
    known = F.create_map(*[x for pair in zip(map(F.lit, by_tag), of, strict=True) for x in pair])
    met = F.flatten(F.array_compact(F.transform(prefixes, lambda p: F.try_element_at(known, p))))
    fits = F.filter(met, lambda r: r["deck"].isNull() | (c("deck") == r["deck"])) if any(r["rule_deck"] is not None for r in rules) else met
    first = F.get(F.array_sort(fits, lambda x, y: x["rule_no"] - y["rule_no"]), 0)
    return F.when(first.isNotNull(), F.struct(first["rule_no"].alias("rule_no"), first["section"].alias("section"), first["topic"].alias("topic")))


def first_rule(notes: DataFrame, rules: DataFrame, name: str = "tag", separator: str = "::") -> DataFrame:
    """The first rule (rule_no, rule_tag, rule_deck) whose tag is the note's or a namespace above, with a matching deck.

    The least rule number wins; notes without a rule have nulls. Up to LITERAL_RULES rules become part of the plan, a map by tag
    that each note looks its own prefixes up in, so notes are neither joined nor shuffled. More rules are joined to the
    exploded prefixes; then notes are read once, in one row an id.
    """
    few = rules.select("rule_no", "rule_tag", "rule_deck", "section", "topic").limit(LITERAL_RULES + 1).collect()
    if len(few) <= LITERAL_RULES:
        found = _looked_up(few, ancestors(c(name), separator))
        return notes.withColumn("__rule", found).select(*notes.columns, *[c(f"__rule.{n}").alias(n) for n in ("rule_no", "section", "topic")])
    up = notes.withColumn("__prefix", F.explode_outer(ancestors(c(name), separator)))
    fits = (c("__prefix") == c("rule_tag")) & (c("rule_deck").isNull() | (c("deck") == c("rule_deck")))
    rest = [F.any_value(n).alias(n) for n in notes.columns if n != "id"]
    first = up.join(rules, fits, "left").groupBy("id").agg(F.min_by(F.struct("rule_no", "section", "topic"), "rule_no").alias("__rule"), *rest)
    return first.select(*notes.columns, *[c(f"__rule.{n}").alias(n) for n in ("rule_no", "section", "topic")])


def siblings(cards: DataFrame, queues: list[int]) -> DataFrame:
    """(id, sibling): other cards of the same note that are in one of the queues."""
    other = cards.where(c("queue").isin(queues)).select("nid", c("id").alias("sibling"))
    return cards.select("id", "nid").join(other, "nid").where("id <> sibling").select("id", "sibling")


def last_review(reviews: DataFrame, before_ms: int) -> DataFrame:
    return reviews.where(rated() & (c("id") < before_ms)).groupBy("cid").agg(F.max("id").alias("last"))


def reconciled(referenced: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """(name, status): unused where only present, missing where only referenced."""
    a = referenced.select(name).distinct().withColumn("r", F.lit(True))
    b = present.select(name).distinct().withColumn("p", F.lit(True))
    return a.join(b, name, "full_outer").select(name, F.when(c("r").isNull(), "unused").when(c("p").isNull(), "missing").otherwise("used").alias("status"))


# --- set operations ----------------------------------------------------------------------------------------------------


def decks_of(cards: DataFrame) -> DataFrame:
    return cards.select(c("did").alias("deck")).union(cards.where("odid <> 0").select("odid")).distinct()


def unused_tags(registered: DataFrame, notes: DataFrame) -> DataFrame:
    """Registered tags that no note has, nor any tag below them."""
    used = notes.select(F.explode(ancestors(c("tag"))).alias("tag")).distinct()
    return registered.select("tag").distinct().join(used, "tag", "left_anti")


# --- windows -----------------------------------------------------------------------------------------------------------


def day_gaps(reviews: DataFrame, clock: Clock) -> DataFrame:
    """Rollover days since the card's previous kept review; 0 for its first."""
    kept = reviews.where(rated() & ~((c("kind") == C.KIND_FILTERED) & (c("factor") == 0)))
    w = Window.partitionBy("cid").orderBy("id", "event_id")
    day = day_offset(clock)
    return kept.select("event_id", "cid", F.coalesce(day - F.lag(day).over(w), F.lit(0)).alias("delta_t"))


def last_info(reviews: DataFrame) -> DataFrame:
    """Per card: time of the last review that counts and the interval before it, forgotten at a reset."""
    when = F.struct("id", "event_id")
    counted = rated() & ~((c("kind") == C.KIND_FILTERED) & (c("factor") == 0))
    reset = reviews.groupBy("cid").agg(F.max(F.when(is_reset(), when)).alias("reset"), F.max(F.when(counted, F.struct("id", "event_id", "ease", "last_ivl"))).alias("last"))
    live = c("reset").isNull() | (F.struct("last.id", "last.event_id") > c("reset"))
    return reset.select("cid", F.when(live, F.expr("last.id div 1000")).alias("reviewed_at"), F.when(live & (c("last.ease") > 1) & (c("last.last_ivl") >= 0), c("last.last_ivl")).alias("previous_ivl"))


def reallocated_ids(rows: DataFrame, key: str, valid_below: int) -> DataFrame:
    """(old, new): ids at or beyond the bound get the numbers after the largest valid one, in their order.

    Ranks are taken in two levels (range partitions, then offsets), so many bad ids spread over tasks.
    """
    top = rows.where(c(key) < valid_below).agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    bad = rows.where(c(key) >= valid_below).select(c(key).alias("old"))
    return numbered(bad, ["old"], "place").select("old", (c("place") + top).alias("new"))


def holdout(reviews: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """The last share of each collection's reviews by time, ties by card; collections below `least` reviews are left out."""
    sizes = reviews.groupBy("collection_id").agg(F.count("*").alias("n")).where(c("n") >= least)
    ranked = numbered(reviews, ["id", "cid", "event_id"], "rank", ["collection_id"]).join(sizes, "collection_id")
    return ranked.withColumn("held_out", c("rank") > c("n") - F.ceil(c("n") * share)).select(*reviews.columns, "held_out")


def sibling_suppressed(gathered: DataFrame) -> DataFrame:
    """Cards (id, nid, position, buries) that no earlier sibling which buries suppresses."""
    earlier = F.max(c("buries").cast("int")).over(Window.partitionBy("nid").orderBy("position", "id").rowsBetween(Window.unboundedPreceding, -1))
    return gathered.withColumn("hidden", F.coalesce(earlier, F.lit(0)) == 1).where("not hidden").drop("hidden")


def capped(rows: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """The first `cap` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(c("rank") <= cap)


def repositioned(cards: DataFrame, start: int, step: int, salt: int | None = None) -> DataFrame:
    """New positions: all cards of a note share one, notes in order of id or, with a salt, of a stable hash."""
    new = cards.where(c("type") == C.NEW)
    key = c("nid") if salt is None else stable_order("nid", salt=salt)
    notes = numbered(new.select("nid", key.alias("key")).distinct(), ["key", "nid"], "rank")
    return new.join(notes.select("nid", (F.lit(start) + F.lit(step) * (c("rank") - 1)).alias("position")), "nid").select("id", "nid", "position")


def first_card(cards: DataFrame) -> DataFrame:
    return cards.groupBy("nid").agg(F.min_by(home_deck(), c("ord")).alias("deck"), F.min("ord").alias("ord"))


# --- orders ------------------------------------------------------------------------------------------------------------


def sort_keys(clock: Clock) -> dict[str, Column]:
    return {
        "created": c("id"), "modified": c("mod"), "due": c("due"), "ease": c("factor"), "interval": c("ivl"), "lapses": c("lapses"), "reps": c("reps"), "deck": c("did"), "template": c("ord"), "stability": c("s"), "difficulty": c("d"),
        "retrievability": forgetting_curve(since_review(clock) / DAY, c("s")),
    }


def card_order(by: str, clock: Clock, reverse: bool = False) -> list[Column]:
    key = sort_keys(clock)[by]
    return [key.desc_nulls_last() if reverse else key.asc_nulls_first(), c("id")]


def sorted_cards(cards: DataFrame, by: str, clock: Clock, reverse: bool = False) -> DataFrame:
    return cards.orderBy(*card_order(by, clock, reverse))


def note_keys(cards: DataFrame, by: str) -> DataFrame:
    """(nid, key): an aggregate of the cards of each note."""
    value = {"modified": F.max("mod"), "cards": F.count("*"), "decks": F.countDistinct(home_deck()), "due": F.min("due"), "ease": F.avg("factor"), "interval": F.avg("ivl"), "lapses": F.sum("lapses"), "reps": F.sum("reps")}[by]
    return cards.groupBy("nid").agg(value.alias("key"))


def sorted_notes(cards: DataFrame, by: str, reverse: bool = False) -> DataFrame:
    """Notes in the order of an aggregate of their cards."""
    return note_keys(cards, by).orderBy(c("key").desc() if reverse else c("key").asc(), "nid")


def review_list(cards: DataFrame, order: str, clock: Clock) -> DataFrame:
    """Due review cards in study order; ties by a stable hash."""
    recall = F.when(c("s").isNotNull(), forgetting_curve(since_review(clock) / DAY, c("s")))
    keys = {
        "day": [c("due")], "day_deck": [c("due"), c("did")], "deck_day": [c("did"), c("due")], "ivl_asc": [c("ivl")], "ivl_desc": [c("ivl").desc()], "ease_asc": [F.coalesce(-c("d"), c("factor"))], "ease_desc": [F.coalesce(-c("d"), c("factor")).desc()],
        "recall_asc": [recall.asc_nulls_last()], "recall_desc": [recall.desc_nulls_last()], "overdue": [relative_overdueness(recall, F.lit(0.9), since_review(clock) / DAY, c("ivl"))], "added": [c("nid"), c("ord")], "added_desc": [c("nid").desc(), c("ord")],
    }[order]
    return cards.where((c("queue") == 2) & (c("due") <= clock.days_elapsed)).orderBy(*keys, stable_order("id", "mod"), "id")


def new_list(cards: DataFrame, order: str, salt: int = 0) -> DataFrame:
    keys = {"position": [c("due"), c("ord")], "position_desc": [c("due").desc(), c("ord")], "random_note": [stable_order("nid", salt=salt), c("ord")], "random_card": [stable_order("id", salt=salt)]}[order]
    return cards.where(c("queue") == 0).orderBy(*keys, "id")


def term_order(cards: DataFrame, reviews: DataFrame, order: str, clock: Clock, limit: int) -> DataFrame:
    """The first cards of a study list's term."""
    recall = forgetting_curve(since_review(clock) / DAY, c("s"))
    if order == "oldest_reviewed":
        last = reviews.groupBy(c("cid").alias("id")).agg(F.max("id").alias("last"))
        return cards.join(last, "id", "left").orderBy(c("last").asc_nulls_first(), "id").limit(limit)
    keys = {"random": [stable_order("id", "mod")], "ivl_asc": [c("ivl")], "ivl_desc": [c("ivl").desc()], "lapses": [c("lapses").desc()], "added": [c("nid"), c("ord")], "added_desc": [c("nid").desc(), c("ord")], "due": [c("due")], "recall_asc": [recall.asc_nulls_last()], "recall_desc": [recall.desc_nulls_last()]}[order]
    return cards.orderBy(*keys, "id").limit(limit)


def study_list(cards: DataFrame, reviews: DataFrame, kind: str, clock: Clock, days: int = 1, limit: int = 99_999) -> DataFrame:
    """Preset study lists: forgotten, ahead, preview, cram_new, cram_due, cram_review, cram_all."""
    live = cards.where(~c("queue").isin(C.SUSPENDED, C.SIBLING_BURIED, C.USER_BURIED) & (c("odid") == 0))
    if kind == "forgotten":
        again = reviews.where((c("id") >= (clock.next_day_at - days * DAY) * 1000) & (c("ease") == 1)).select("cid").distinct()
        return term_order(live.join(again, live["id"] == c("cid"), "left_semi"), reviews, "random", clock, limit)
    if kind == "ahead":
        return term_order(live.where((c("queue") == 2) & (c("due") <= clock.days_elapsed + days)), reviews, "due", clock, limit)
    if kind == "preview":
        return term_order(live.where((c("type") == C.NEW) & (c("id") > (clock.next_day_at - days * DAY) * 1000)), reviews, "oldest_reviewed", clock, limit)
    chosen = {"cram_new": c("type") == C.NEW, "cram_due": (c("queue") == 2) & (c("due") <= clock.days_elapsed), "cram_review": c("type") != C.NEW, "cram_all": F.lit(True)}[kind]
    return term_order(live.where(chosen), reviews, {"cram_new": "added", "cram_due": "due"}.get(kind, "random"), clock, limit)


def two_terms(first: DataFrame, second: DataFrame, order_first: list, order_second: list) -> DataFrame:
    """Positions of two ordered, limited terms, the second without the cards of the first."""
    a = first.select("id", F.row_number().over(Window.orderBy(*order_first)).alias("position"))
    rest = second.join(first.select("id"), "id", "left_anti")
    b = rest.select("id", F.row_number().over(Window.orderBy(*order_second)).alias("position"))
    n = a.agg(F.coalesce(F.max("position"), F.lit(0)).alias("n"))
    return a.union(b.join(F.broadcast(n), F.lit(True), "left").select("id", c("position") + c("n")))


def interleaved(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two lists (id, position) spread evenly into each other: the i-th of n has the key i / (n + 1)."""

    def keyed(rows: DataFrame, which: int) -> DataFrame:
        n = rows.agg(F.count("*").alias("n"))
        return rows.join(F.broadcast(n), F.lit(True), "left").select("id", (c("position") / (c("n") + 1)).alias("key"), F.lit(which).alias("which"))

    return keyed(first, 0).union(keyed(second, 1))


def completed_tags(tags: DataFrame, typed: str, limit: int) -> DataFrame:
    """Tags whose parts hold the typed parts in order, those that start with the text first."""
    parts = [p for p in typed.split("::")]
    regex = "(?i)" + "::".join(rf"[^:]*{p}[^:]*" for p in parts)
    hits = tags.select("tag").distinct().where(c("tag").rlike(regex))
    return hits.orderBy((~F.startswith(F.lower("tag"), F.lit(typed.lower()))).cast("int"), F.lower("tag"), "tag").limit(limit)


def seeded(key: str, seed: int) -> Column:
    """An order that a key and a seed give in any engine."""
    return F.md5(F.concat_ws(":", c(key).cast("string"), F.lit(str(seed))))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows in a seeded order; an error if there are fewer."""
    out = rows.orderBy(seeded(key, seed), key).limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} rows to choose from")
    return out


def stratified_sample(rows: DataFrame, stratum: str, key: str, each: int, seed: int, used: DataFrame | None = None) -> DataFrame:
    pool = rows if used is None else rows.join(used.select(key), key, "left_anti")
    return capped(pool, stratum, [seeded(key, seed), c(key)], each).drop("rank")


def with_checksum(notes: DataFrame) -> DataFrame:
    return notes.withColumn("csum", checksum(c("front")))
