"""Projections, joins, windows, orders, merges, hierarchies and integrity checks as queries with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.context import FIXED
from tidepool.functions import scalars as S
from tidepool.operators import hierarchy as H
from tidepool.operators import merge as M
from tidepool.operators import projections as PJ
from tidepool.operators import quality as Q
from tidepool.operators import tables as T
from tidepool.operators.ranks import numbered
from tidepool.plans.registry import register
from tidepool.sources.fixtures import note_keys, view, with_tags

NOW, NEXT, DAYS = FIXED.now, FIXED.next_day_at, FIXED.days_elapsed
c = F.col
_HOME = "CASE WHEN odid <> 0 THEN odid ELSE did END"
_DUE0 = "CASE WHEN odid <> 0 AND odue <> 0 THEN odue ELSE due END"
_DUE_AT = f"CASE WHEN type = 0 OR queue = -1 THEN NULL WHEN ({_DUE0}) > 1000000000 THEN {_DUE0} ELSE {NEXT} + (({_DUE0}) - {DAYS} - 1) * 86400 END"
_ELAPSED = f"CASE WHEN lrt IS NOT NULL THEN greatest({NOW} - lrt, 0) WHEN ({_DUE0}) > 365000 THEN greatest({NOW} - greatest(({_DUE0}) - ivl, 0), 0) ELSE greatest({DAYS} - greatest(({_DUE0}) - ivl, 0), 0) * 86400 END"
_RECALL = f"CASE WHEN s IS NOT NULL THEN pow(({_ELAPSED}) / 86400.0 / s * (pow(0.9, -2) - 1) + 1, -0.5) END"
_OFFSET = f"((id // 1000) - {NEXT}) // 86400"


def _q(name: str, sql: str | None, operator, *tables: str) -> None:
    register(name, sql)(lambda spark, d: operator(*[with_tags(view(spark, d, t)) if t == "notes" else view(spark, d, t) for t in tables]))


# --- projections -------------------------------------------------------------------------------------------------------
_q("pj01_home_deck", f"SELECT id, {_HOME} AS deck, CASE WHEN odue <> 0 THEN odue ELSE due END AS due, {_DUE0} AS original_due FROM cards", lambda k: k.select("id", PJ.home_deck().alias("deck"), PJ.due_column().alias("due"), PJ.original_due().alias("original_due")), "cards")
_q("pj03_due_time", f"SELECT id, {_DUE_AT} AS due_at, ({_DUE_AT}) < {NEXT} + 7 * 86400 AS within_week FROM cards", lambda k: k.select("id", PJ.due_time(FIXED).alias("due_at"), PJ.due_within(7, FIXED).alias("within_week")), "cards")
_q("pj04_since_review", f"SELECT id, {_ELAPSED} AS secs FROM cards", lambda k: k.select("id", PJ.since_review(FIXED).alias("secs")), "cards")
_q("pj05_review_classes", "SELECT event_id, ease > 0 AS rated, kind = 4 AND factor = 0 AS reset, kind = 3 AND factor = 0 AS cramming FROM reviews", lambda r: r.select("event_id", (c("ease") > 0).alias("rated"), T.is_reset().alias("reset"), ((c("kind") == 3) & (c("factor") == 0)).alias("cramming")), "reviews")
_q("pj08_difficulty", "SELECT id, (d - 1) / 9 AS share, (d - 1) / 9 + 0.1 AS shifted FROM cards WHERE d IS NOT NULL", lambda k: k.where("d is not null").select("id", PJ.normal_difficulty().alias("share"), PJ.normal_difficulty(0.1).alias("shifted")), "cards")
_q("pj09_browse_cards", f"SELECT k.id, n.front AS sfld, e.leaf AS deck, n.tag, {_DUE_AT} AS due_at, CASE WHEN type <> 0 THEN factor / 10.0 END AS ease, CASE WHEN type IN (2, 3) THEN ivl END AS interval, lapses, reps, k.id // 1000 AS created, k.mod, s AS stability, (d - 1) / 9 AS difficulty, {_RECALL} AS recall FROM cards k JOIN notes n ON n.id = k.nid JOIN decks e ON e.id = k.did", lambda k, n, e: PJ.browse_cards(k, n, e, FIXED), "cards", "notes", "decks")
_q("pj09_browse_notes", f"SELECT nid, avg(CASE WHEN type <> 0 THEN factor / 10.0 END) AS ease, avg(CASE WHEN type IN (2, 3) THEN ivl END) AS interval, min({_DUE_AT}) AS due_at, max(mod) AS mod, sum(lapses) AS lapses, sum(reps) AS reps, count(DISTINCT {_HOME}) AS decks, count(*) AS cards FROM cards GROUP BY nid", lambda k: PJ.browse_notes(k, FIXED), "cards")
_CLEAN = "nfc_normalize(regexp_replace({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))"
_q("pj10_prepared_notes", f"WITH a AS (SELECT id, {_CLEAN.format('front')} AS front, {_CLEAN.format('back')} AS back FROM notes), b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(front, '(?i)<br\\s*/?>|</?(?:div|p|li|ul|ol|tr|h[1-6])\\b[^>]*>|\n', ' ', 'g'), '<[^>]*>|\\[sound:[^\\]]*\\]', '', 'g'), '\\s+', ' ', 'g')) AS sfld FROM a) SELECT id, front, back, sfld, CAST('0x' || substr(sha1(sfld), 1, 8) AS BIGINT) AS csum FROM b", lambda n: PJ.prepared_notes(n).select("id", "front", "back", "sfld", "csum"), "notes")
_q("pj11_deck_path", "SELECT id, parent, leaf, 2 AS level, [parent, name] AS ancestors FROM decks", lambda e: e.select("id", PJ.deck_path(c("name")).alias("p")).select("id", "p.*"), "decks")
_q("pj12_last_position", f"SELECT id, CASE WHEN type = 0 THEN {_DUE0} ELSE id END AS position FROM cards", lambda k: k.withColumn("pos", c("id")).select("id", PJ.last_position().alias("position")), "cards")

# --- joins and sets ----------------------------------------------------------------------------------------------------
_q("j01_notes_of_cards", "SELECT id FROM notes WHERE id IN (SELECT nid FROM cards WHERE lapses > 2)", lambda n, k: T.notes_of(n, k.where("lapses > 2")).select("id"), "notes", "cards")
_q("j02_reviews_of_cards", "SELECT event_id FROM reviews WHERE cid IN (SELECT id FROM cards WHERE flags = 2)", lambda r, k: T.reviews_of(r, k.where("flags = 2")).select("event_id"), "reviews", "cards")
_q("j03_cards_of_notes", "SELECT id FROM cards WHERE nid IN (SELECT id FROM notes WHERE mid = 2)", lambda k, n: T.cards_of(k, n.where("mid = 2")).select("id"), "cards", "notes")
_q("j04_orphan_cards", "SELECT id FROM cards WHERE nid NOT IN (SELECT id FROM notes WHERE mid <> 3)", lambda k, n: T.orphan_cards(k, n.where("mid <> 3")).select("id"), "cards", "notes")
_q("j05_missing_decks", "SELECT DISTINCT id FROM (SELECT did AS id FROM cards UNION SELECT odid FROM cards WHERE odid <> 0) WHERE id NOT IN (SELECT id FROM decks WHERE preset <> 1)", lambda k, e: T.missing_decks(k, e.where("preset <> 1")), "cards", "decks")
_q("j06_studied_today", f"SELECT {_HOME} AS deck, count(DISTINCT k.id) AS cards FROM reviews r JOIN cards k ON k.id = r.cid WHERE kind NOT IN (4, 5) AND r.id > {(NEXT - 86400) * 1000} GROUP BY 1", lambda r, k: T.studied_today_by_deck(r, k, FIXED), "reviews", "cards")
_q("j07_note_types_decks", f"SELECT DISTINCT nid, mid, csum, {_HOME} AS deck FROM cards JOIN notes ON notes.id = nid", T.note_types_decks, "notes", "cards")
_q("j08_by_guid", "SELECT a.id, b.id AS existing_id, b.mod AS existing_mod FROM notes a LEFT JOIN notes b ON b.id = a.id AND b.id % 3 <> 0", lambda n: T.by_guid(n.withColumn("guid", c("id")), n.withColumn("guid", c("id")).where("id % 3 <> 0")).select("id", "existing_id", "existing_mod"), "notes")
register("j09_by_first_field", "SELECT a.id, b.id AS existing_id FROM notes a LEFT JOIN notes b ON b.mid = a.mid AND b.front = a.front AND b.id % 2 = 0 WHERE a.id % 3 = 0")(
    lambda spark, d: T.by_first_field(note_keys(spark, d).where("id % 3 = 0"), note_keys(spark, d).where("id % 2 = 0")).select("id", "existing_id")
)
_q("j11_deck_descendants", "SELECT p.parent AS name, d.id FROM (SELECT DISTINCT parent FROM decks) p JOIN decks d ON d.parent = p.parent UNION ALL SELECT name, id FROM decks", lambda e: e.select(F.explode(S.ancestors(c("name"), "\x1f")).alias("name"), "id"), "decks")
_q("j13_last_review", f"SELECT cid, max(id) AS last FROM reviews WHERE ease > 0 AND id < {NOW * 1000 - 86400000} GROUP BY 1", lambda r: T.last_review(r, NOW * 1000 - 86_400_000), "reviews")
_q("j14_siblings", "SELECT a.id, b.id AS sibling FROM cards a JOIN cards b ON a.nid = b.nid AND a.id <> b.id WHERE b.queue IN (0, 2)", lambda k: T.siblings(k, [0, 2]), "cards")
_q("j15_reconciled", "SELECT coalesce(a.doc_id, b.page_id) AS id, CASE WHEN a.doc_id IS NULL THEN 'unused' WHEN b.page_id IS NULL THEN 'missing' ELSE 'used' END AS status FROM documents a FULL JOIN (SELECT page_id * 3 AS page_id FROM pages) b ON a.doc_id = b.page_id", lambda a, b: T.reconciled(a.select(c("doc_id").alias("id")), b.select((c("page_id") * 3).alias("id")), "id"), "documents", "pages")
_q("so1_decks_of_cards", "SELECT did AS deck FROM cards UNION SELECT odid FROM cards WHERE odid <> 0", T.decks_of, "cards")
_q("so2_unused_media", "SELECT page_id AS id FROM pages EXCEPT SELECT doc_id FROM labels", lambda p, b: p.select(c("page_id").alias("id")).join(b.select(c("doc_id").alias("id")), "id", "left_anti"), "pages", "labels")
_q("so3_unused_tags", "SELECT DISTINCT tag FROM notes WHERE tag NOT IN (SELECT tag FROM notes WHERE id % 50 = 0)", lambda n: T.unused_tags(n, n.where("id % 50 = 0")), "notes")
_q("so5_combined", "SELECT id FROM cards WHERE (type = 2 OR flags = 1) AND NOT lapses > 3", lambda k: k.where(((c("type") == 2) | (c("flags") == 1)) & ~(c("lapses") > 3)).select("id"), "cards")

def _caps(decks: DataFrame) -> DataFrame:
    """A cap for every deck and for what is above it."""
    return decks.select("name", (4 + c("id") % 9).cast("int").alias("cap")).union(decks.select(c("parent").alias("name"), F.lit(20).alias("cap")).distinct())


# --- windows -----------------------------------------------------------------------------------------------------------
_KEPT = "ease > 0 AND NOT (kind = 3 AND factor = 0)"
_q("w01_day_gaps", f"SELECT event_id, cid, coalesce({_OFFSET} - lag({_OFFSET}) OVER (PARTITION BY cid ORDER BY id, event_id), 0) AS delta_t FROM reviews WHERE {_KEPT}", lambda r: T.day_gaps(r, FIXED), "reviews")
_q("w04_last_info", f"WITH a AS (SELECT cid, max(struct_pack(i := id, e := event_id)) FILTER (kind = 4 AND factor = 0) AS rs, max(struct_pack(i := id, e := event_id, ease := ease, l := last_ivl)) FILTER ({_KEPT}) AS ls FROM reviews GROUP BY cid) SELECT cid, CASE WHEN ok THEN ls.i // 1000 END AS reviewed_at, CASE WHEN ok AND ls.ease > 1 AND ls.l >= 0 THEN ls.l END AS previous_ivl FROM (SELECT *, rs IS NULL OR (ls.i, ls.e) > (rs.i, rs.e) AS ok FROM a)", T.last_info, "reviews")
_q("w05_reallocated_ids", "SELECT id AS old, row_number() OVER (ORDER BY id) + (SELECT max(id) FROM cards WHERE id < 1000) AS new FROM cards WHERE id >= 1000", lambda k: T.reallocated_ids(k, "id", 1000), "cards")
_q("w06_name_ranks", "SELECT id, row_number() OVER (ORDER BY lower(name), name) AS position FROM decks", lambda e: H.name_ranks(e, "name").select("id", "position"), "decks")
_q("w09_holdout", "SELECT event_id, row_number() OVER (PARTITION BY collection_id ORDER BY id, cid, event_id) > count(*) OVER (PARTITION BY collection_id) - ceil(count(*) OVER (PARTITION BY collection_id) * 0.2) AS held_out FROM reviews", lambda r: T.holdout(r).select("event_id", "held_out"), "reviews")
_q("w10_siblings_suppressed", "SELECT id FROM (SELECT id, coalesce(max(CASE WHEN did % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY nid ORDER BY due, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM cards) WHERE h = 0", lambda k: T.sibling_suppressed(k.select("id", "nid", c("due").alias("position"), (c("did") % 2 == 0).alias("buries"))).select("id"), "cards")
_q("w11_capped", "SELECT id, did FROM cards QUALIFY row_number() OVER (PARTITION BY did ORDER BY due, id) <= 10", lambda k: T.capped(k, "did", [c("due"), c("id")], 10).select("id", "did"), "cards")
_q(
    "w11_nested_caps",
    "WITH k AS (SELECT cards.id, due, d.id AS did, d.parent FROM cards JOIN decks d ON d.id = cards.did), a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY did ORDER BY due, id) <= 4 + did % 9), "
    "b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY parent ORDER BY due, id) <= 20) SELECT id, did FROM b ORDER BY due, id LIMIT 70",
    lambda e, k: H.filled(k.join(e.select(c("id").alias("did"), c("name").alias("deck")), "did"), _caps(e), [c("due")], "\x1f", 70).select("id", "did"),
    "decks", "cards",
)
_q("w12_repositioned", "SELECT id, nid, 100 + 5 * (dense_rank() OVER (ORDER BY nid) - 1) AS position FROM cards WHERE type = 0", lambda k: T.repositioned(k, 100, 5), "cards")
_q("w14_first_card", f"SELECT nid, arg_min({_HOME}, ord) AS deck, min(ord) AS ord FROM cards GROUP BY nid", T.first_card, "cards")

# --- orders ------------------------------------------------------------------------------------------------------------


def _placed(df: DataFrame, order: list, key: str = "id") -> DataFrame:
    """An order as rows: every key with its place."""
    return numbered(df, order, "place").select(key, "place")


def _place(order: str, frm: str, key: str = "id") -> str:
    return f"SELECT {key}, row_number() OVER (ORDER BY {order}) AS place FROM {frm}"


for _by, _order in (
    ("due", "due NULLS FIRST, id"),
    ("ease", "factor NULLS FIRST, id"),
    ("difficulty", "d NULLS FIRST, id"),
    ("retrievability", f"{_RECALL} NULLS FIRST, id"),
):
    _q(f"s01_cards_by_{_by}", _place(_order, "cards"), lambda k, by=_by: _placed(k, T.card_order(by, FIXED)), "cards")
_q(
    "s02_notes_by_ease",
    _place("avg(factor) DESC, nid", "cards GROUP BY nid", "nid"),
    lambda k: _placed(T.note_keys(k, "ease"), [c("key").desc(), c("nid")], "nid"),
    "cards",
)
_q(
    "s03_review_list",
    _place("due, did, id", f"cards WHERE queue = 2 AND due <= {DAYS}"),
    lambda k: _placed(T.review_list(k, "day_deck", FIXED), ["due", "did", "id"]),
    "cards",
)
_q(
    "s04_new_list",
    _place("due, ord, id", "cards WHERE queue = 0"),
    lambda k: _placed(T.new_list(k, "position"), ["due", "ord", "id"]),
    "cards",
)
_q("s05_term_oldest", "SELECT id FROM (SELECT k.id, max(r.id) AS l FROM cards k LEFT JOIN reviews r ON r.cid = k.id GROUP BY k.id) ORDER BY l NULLS FIRST, id LIMIT 50", lambda k, r: T.term_order(k, r, "oldest_reviewed", FIXED, 50).select("id"), "cards", "reviews")
_q("s06_forgotten", f"SELECT id FROM cards WHERE queue >= 0 AND odid = 0 AND id IN (SELECT cid FROM reviews WHERE ease = 1 AND id >= {(NEXT - 3 * 86400) * 1000})", lambda k, r: T.study_list(k, r, "forgotten", FIXED, 3).select("id"), "cards", "reviews")
_q("s07_two_terms", "WITH a AS (SELECT id FROM cards WHERE type = 2 ORDER BY due, id LIMIT 20), b AS (SELECT id, due FROM cards WHERE lapses > 2 ORDER BY due, id LIMIT 40) SELECT id, row_number() OVER (ORDER BY due, id) AS position FROM cards WHERE id IN (SELECT id FROM a) UNION ALL SELECT id, 20 + row_number() OVER (ORDER BY due, id) FROM b WHERE id NOT IN (SELECT id FROM a)", lambda k: T.two_terms(k.where("type = 2").orderBy("due", "id").limit(20), k.where("lapses > 2").orderBy("due", "id").limit(40), [c("due"), c("id")], [c("due"), c("id")]), "cards")
_q("s08_interleaved", "WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS p, count(*) OVER () AS n FROM cards WHERE type = 0), b AS (SELECT id, row_number() OVER (ORDER BY id) AS p, count(*) OVER () AS n FROM cards WHERE flags = 5 AND type <> 0) SELECT id, p / (n + 1) AS key, 0 AS which FROM a UNION ALL SELECT id, p / (n + 1), 1 FROM b", lambda k: T.interleaved(*[numbered(x.select("id"), ["id"], "position") for x in (k.where("type = 0"), k.where("flags = 5 and type <> 0"))]), "cards")
_q("s09_completed_tags", "SELECT DISTINCT tag FROM notes WHERE regexp_matches(tag, '[^:]*e[^:]*::[^:]*1[^:]*', 'i') ORDER BY CASE WHEN starts_with(lower(tag), 'e::1') THEN 0 ELSE 1 END, lower(tag) LIMIT 10", lambda n: T.completed_tags(n, "e::1", 10), "notes")
_q("s12_seeded_sample", "SELECT id FROM cards ORDER BY md5(id || ':7'), id LIMIT 25", lambda k: T.seeded_sample(k, "id", 25, 7).select("id"), "cards")
_q("s13_stratified_sample", "SELECT did, id FROM cards QUALIFY row_number() OVER (PARTITION BY did ORDER BY md5(id || ':7'), id) <= 3", lambda k: T.stratified_sample(k, "did", "id", 3, 7).select("did", "id"), "cards")

# --- merges ------------------------------------------------------------------------------------------------------------
_q("m01_append_absent", "SELECT event_id, ease FROM reviews WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 9 FROM reviews WHERE event_id % 2 = 0 AND event_id % 3 <> 0", lambda r: M.append_absent(r.where("event_id % 3 = 0").select("event_id", "ease"), r.where("event_id % 2 = 0").select("event_id", F.lit(9).alias("ease")), "event_id"), "reviews")
_q("m02_last_writer_wins", "WITH l AS (SELECT id, mod, pending FROM notes WHERE id % 3 <> 0 OR id % 5 = 0), i AS (SELECT id, mod + id % 7 - 3 AS mod, false AS pending FROM notes WHERE id % 3 = 0 OR id % 4 = 0) SELECT coalesce(l.id, i.id) AS id, CASE WHEN i.id IS NULL OR (l.id IS NOT NULL AND l.pending AND l.mod >= i.mod) THEN l.mod ELSE i.mod END AS mod, CASE WHEN i.id IS NULL OR (l.id IS NOT NULL AND l.pending AND l.mod >= i.mod) THEN l.pending ELSE i.pending END AS pending FROM l FULL JOIN i ON l.id = i.id", lambda n: M.last_writer_wins(n.where("id % 3 <> 0 or id % 5 = 0").select("id", "mod", "pending"), n.where("id % 3 = 0 or id % 4 = 0").select("id", (c("mod") + c("id") % 7 - 3).alias("mod"), F.lit(False).alias("pending"))), "notes")
_q("m03_without_graves", "SELECT id FROM notes WHERE id % 29 <> 0", lambda n: M.without_graves(n, n.where("id % 29 = 0").select(c("id").alias("oid"), F.lit(1).alias("type")), 1).select("id"), "notes")
_q("m04_changed_since", "SELECT id FROM cards WHERE reps >= 8", lambda k: M.changed_since(k, 8, "reps").select("id"), "cards")
_q("m05_merge_notes", "SELECT a.id, a.id AS guid, CASE WHEN b.id IS NULL THEN 'new' WHEN a.mid <> b.mid THEN 'conflicting' WHEN a.mod + a.id % 5 - 2 > b.mod THEN 'updated' ELSE 'duplicate' END AS status, a.id AS target, a.mod + a.id % 5 - 2 AS mod FROM notes a LEFT JOIN (SELECT id, CASE WHEN id % 7 = 0 THEN 99 ELSE mid END AS mid, mod FROM notes WHERE id % 3 <> 0) b ON a.id = b.id", lambda n: M.merge_notes(n.where("id % 3 <> 0").select("id", c("id").alias("guid"), F.when(c("id") % 7 == 0, 99).otherwise(c("mid")).alias("mid"), "mod"), n.select("id", c("id").alias("guid"), "mid", (c("mod") + c("id") % 5 - 2).alias("mod"))), "notes")
_q(
    "m06_without_collisions",
    "SELECT id, CASE WHEN id % 2 = 0 THEN (SELECT max(id) FROM notes) + row_number() OVER (PARTITION BY id % 2 ORDER BY id) ELSE id END AS new_id "
    "FROM notes WHERE id % 3 <> 0",
    lambda n: M.without_collisions(n.where("id % 3 <> 0").select("id"), n.where("id % 2 = 0 or id % 3 = 0").select("id")),
    "notes",
)
_q("m07_import_cards", f"SELECT id, nid + 100000 AS nid, did + 50 AS did, ord, CASE WHEN queue IN (2, 3) THEN due + 5 ELSE due END AS due FROM cards WHERE nid % 2 = 0 AND did > 3 AND NOT (nid % 4 = 0 AND ord = 1)", lambda k: M.import_cards(k.where("nid % 4 = 0 and ord = 1").select((c("nid") + 100_000).alias("nid"), "ord"), k, k.where("nid % 2 = 0").select(c("nid").alias("old"), (c("nid") + 100_000).alias("new")).distinct(), k.where("did > 3").select(c("did").alias("old"), (c("did") + 50).alias("new")).distinct(), 5).select("id", "nid", "did", "ord", "due"), "cards")
_q("m08_text_import", "WITH e AS (SELECT mid, front, min(id) AS f, count(*) AS n FROM notes WHERE id % 2 = 0 GROUP BY ALL) SELECT a.id AS line, CASE WHEN trim(a.front) = '' THEN 'empty_first_field' WHEN a.id % 10 = 0 THEN 'updated' WHEN f IS NULL THEN 'new' WHEN n > 1 THEN 'updated_first_of_many' ELSE 'updated' END AS outcome, CASE WHEN a.id % 10 = 0 THEN a.id ELSE f END AS target FROM notes a LEFT JOIN e ON e.mid = a.mid AND e.front = a.front", lambda n: M.text_import(n.where("id % 2 = 0").withColumn("guid", c("id").cast("string")), n.select(c("id").alias("line"), F.when(c("id") % 10 == 0, c("id").cast("string")).otherwise("none").alias("guid"), "mid", "front", "csum")), "notes")
_q("m09_gathered_cards", "SELECT id FROM cards WHERE nid IN (SELECT id FROM notes WHERE mid = 3)", lambda n, k, e, r: M.gathered(n, k, e, r, c("mid") == 3)["cards"].select("id"), "notes", "cards", "decks", "reviews")
_q("m09_gathered_reviews", "SELECT event_id FROM reviews WHERE cid IN (SELECT id FROM cards WHERE nid IN (SELECT id FROM notes WHERE mid = 3))", lambda n, k, e, r: M.gathered(n, k, e, r, c("mid") == 3)["reviews"].select("event_id"), "notes", "cards", "decks", "reviews")
_q("m10_find_replace", "SELECT id, [regexp_replace(front, 'th(e|at)', '<\\1>', 'g'), back] AS flds FROM notes WHERE regexp_matches(front, 'th(e|at)')", lambda n: M.find_replace(n, "th(e|at)", "<$1>", 0).select("id", "flds"), "notes")
_q("m11_replace_tags", "SELECT id, list_sort(list_filter([replace(tag, 'src', 'source'), CASE WHEN quality = 1 THEN 'label::good' END, CASE WHEN toxic = 1 THEN 'label::toxic' END], lambda x: x IS NOT NULL)) AS tags FROM notes", lambda n: M.replace_tags(n, "src", "source").select("id", "tags"), "notes")
_q("m12_add_tags", "SELECT id, list_sort(list_filter([tag, 'a::new', CASE WHEN quality = 1 THEN 'label::good' END, CASE WHEN toxic = 1 THEN 'label::toxic' END], lambda x: x IS NOT NULL)) AS tags FROM notes", lambda n: M.add_tags(n, ["a::new", "a::new"]).select("id", "tags"), "notes")
_q("m12_remove_tags", "SELECT id, list_filter([CASE WHEN tag LIKE 'en::%' THEN NULL ELSE tag END, CASE WHEN quality = 1 THEN 'label::good' END], lambda x: x IS NOT NULL) AS tags FROM notes", lambda n: M.remove_tags(n, ["EN", "*toxic"]).select("id", "tags"), "notes")
_q("m13_rename_tags", "SELECT id, list_filter([regexp_replace(tag, '^fr::', 'french::'), CASE WHEN quality = 1 THEN 'label::good' END, CASE WHEN toxic = 1 THEN 'label::toxic' END], lambda x: x IS NOT NULL) AS tags FROM notes", lambda n: M.rename_tags(n, "FR", "french").select("id", "tags"), "notes")
_q("m14_reparent_tags", "SELECT id, list_filter([CASE WHEN tag LIKE 'de::%' THEN 'lang::' || tag ELSE tag END, CASE WHEN quality = 1 THEN 'label::good' END, CASE WHEN toxic = 1 THEN 'label::toxic' END], lambda x: x IS NOT NULL) AS tags FROM notes", lambda n: M.reparent_tags(n, ["de"], "lang").select("id", "tags"), "notes")
_q("m16_fixed_field_count", "SELECT id, [front || '; ' || back] AS one, [front, back, ''] AS three FROM notes", lambda n: n.select("id", M.fixed_field_count(c("flds"), F.lit(1)).alias("one"), M.fixed_field_count(c("flds"), F.lit(3)).alias("three")), "notes")
_q("m17_changed_notetype", "SELECT id, [back, '', front] AS flds, 9 AS mid FROM notes", lambda n, k: M.changed_notetype(n, k, [1, None, 0], {0: 1}, 9)[0].select("id", "flds", "mid"), "notes", "cards")
_q("m17_changed_cards", "SELECT id, 1 AS ord FROM cards WHERE ord = 0", lambda n, k: M.changed_notetype(n, k, [1, None, 0], {0: 1}, 9)[1].select("id", "ord"), "notes", "cards")
_q("m18_suspend", "SELECT id, CASE WHEN did = 4 THEN -1 ELSE queue END AS queue FROM cards", lambda k: M.suspend(k, c("did") == 4).select("id", "queue"), "cards")
_q("m18_bury", "SELECT id, CASE WHEN did = 4 AND queue <> -1 THEN -3 ELSE queue END AS queue FROM cards", lambda k: M.bury(k, c("did") == 4).select("id", "queue"), "cards")
_q("m18_unbury", "SELECT id, CASE WHEN queue IN (-1, -2, -3) THEN CASE WHEN type IN (1, 3) THEN CASE WHEN due > 1000000000 THEN 1 ELSE 3 END WHEN type = 0 THEN 0 ELSE 2 END ELSE queue END AS queue FROM cards", lambda k: M.unbury(k, F.lit(True)).select("id", "queue"), "cards")
_q("m18_reset", "SELECT id, CASE WHEN lapses > 3 THEN 0 ELSE type END AS type, CASE WHEN lapses > 3 THEN 0 ELSE ivl END AS ivl, CASE WHEN lapses > 3 THEN NULL ELSE s END AS s FROM cards", lambda k: M.reset_to_new(k, c("lapses") > 3).select("id", "type", "ivl", "s"), "cards")
_q("m18_set_due", f"SELECT id, CASE WHEN flags = 1 THEN {DAYS} + 5 ELSE due END AS due, CASE WHEN flags = 1 THEN 5 ELSE ivl END AS ivl FROM cards", lambda k: M.set_due(k, c("flags") == 1, "5!", DAYS).select("id", "due", "ivl"), "cards")
_q("m19_into_list", "SELECT id, CASE WHEN flags = 1 AND odid = 0 THEN 77 ELSE did END AS did, CASE WHEN flags = 1 AND odid = 0 THEN did ELSE odid END AS odid, CASE WHEN flags = 1 AND odid = 0 THEN id - 100000 ELSE due END AS due FROM cards", lambda k: M.into_study_list(k, c("flags") == 1, 77, c("id") - 100_000).select("id", "did", "odid", "due"), "cards")
_q("m19_out_of_list", f"SELECT id, CASE WHEN odid <> 0 THEN odid ELSE did END AS did, CASE WHEN odid <> 0 AND odue <> 0 THEN odue ELSE due END AS due FROM cards", lambda k: M.out_of_study_list(k, F.lit(True)).select("id", "did", "due"), "cards")
_q("m20_renamed_media", "SELECT page_id AS id, [replace(html, '\"/The\"', '\"/A\"')] AS flds FROM pages", lambda p: M.renamed_media(p.select(c("page_id").alias("id"), F.array("html").alias("flds")), {"/The": "/A"}), "pages")

# --- hierarchies -------------------------------------------------------------------------------------------------------
_q("h1_tag_tree", "WITH t AS (SELECT DISTINCT tag FROM notes) SELECT tag AS name, 2 AS level, true AS registered FROM t UNION ALL SELECT DISTINCT split_part(tag, '::', 1), 1, false FROM t", H.tag_tree, "notes")
_q("ag18_rolled_up", "WITH k AS (SELECT did, count(*) AS n FROM cards GROUP BY 1) SELECT name, n FROM decks JOIN k ON k.did = decks.id UNION ALL SELECT parent, sum(n) FROM decks JOIN k ON k.did = decks.id GROUP BY 1", lambda e, k: H.rolled_up(e.join(k.groupBy(c("did").alias("id")).agg(F.count("*").alias("n")), "id"), "name", ["n"], "\x1f"), "decks", "cards")
_q("h3_children", "SELECT id FROM decks WHERE parent = 'EUROPE'", lambda e: H.children(e, "name", "EUROPE", "\x1f").select("id"), "decks")
_q("h4_missing_ancestors", "SELECT DISTINCT parent AS name FROM decks", lambda e: H.missing_ancestors(e, "name", "\x1f"), "decks")
_q("ag19_capped", "SELECT name, least(n, 20) AS review FROM (SELECT name, count(*) AS n FROM decks JOIN cards ON cards.did = decks.id GROUP BY 1) UNION ALL SELECT parent, least(sum(least(n, 20)), 50) FROM (SELECT parent, name, count(*) AS n FROM decks JOIN cards ON cards.did = decks.id GROUP BY ALL) GROUP BY 1", lambda e, k: _capped(e, k), "decks", "cards")


def _capped(decks: DataFrame, cards: DataFrame) -> DataFrame:
    counts = cards.groupBy(c("did").alias("id")).agg(F.count("*").alias("review"))
    zero = F.lit(0).cast("long")
    leaves = decks.join(counts, "id").select("name", zero.alias("interday"), "review", zero.alias("new"), F.lit(20).alias("review_cap"), F.lit(5).alias("new_cap"))
    tops = decks.select(c("parent").alias("name")).distinct().select("name", zero.alias("interday"), zero.alias("review"), zero.alias("new"), F.lit(50).alias("review_cap"), F.lit(9).alias("new_cap"))
    return H.capped_roll_up(leaves.union(tops), "name", "\x1f").select("name", "review")


# --- integrity ---------------------------------------------------------------------------------------------------------
_q("q01_repaired_cards", f"SELECT id, least(greatest(ivl - 10, 0), 36500) AS ivl, least(mod + 2600000, {NOW}) AS mod, ivl < 10 OR mod + 2600000 > {NOW} AS fixed FROM cards", lambda k: Q.repaired_cards(k.withColumn("ivl", c("ivl") - 10).withColumn("mod", c("mod") + 2_600_000).withColumn("due", F.lit(0).cast("long")).withColumn("odue", F.lit(0).cast("long")), FIXED).select("id", "ivl", "mod", "fixed"), "cards")
_LAST_INFO = f"WITH a AS (SELECT cid, max(struct_pack(i := id, e := event_id)) FILTER (kind = 4 AND factor = 0) AS rs, max(struct_pack(i := id, e := event_id, ease := ease, l := last_ivl)) FILTER ({_KEPT}) AS ls FROM reviews GROUP BY cid) SELECT cid, CASE WHEN ok THEN ls.i // 1000 END AS reviewed_at, CASE WHEN ok AND ls.ease > 1 AND ls.l >= 0 THEN ls.l END AS previous_ivl FROM (SELECT *, rs IS NULL OR (ls.i, ls.e) > (rs.i, rs.e) AS ok FROM a)"
_q("q02_last_review", f"SELECT k.id, CASE WHEN k.id % 2 = 0 AND lrt IS NOT NULL THEN lrt WHEN s IS NOT NULL THEN reviewed_at END AS lrt FROM cards k LEFT JOIN ({_LAST_INFO}) l ON l.cid = k.id", lambda k, r: Q.repaired_last_review(k.withColumn("lrt", F.when(c("id") % 2 == 0, c("lrt"))), r).select("id", "lrt"), "cards", "reviews")
_q("q03_repaired_reviews", "SELECT event_id, CASE WHEN kind = 0 AND time_ms % 10 = 0 AND ease <= 1 THEN 5 ELSE kind END AS kind FROM reviews", lambda r: Q.repaired_reviews(r.withColumn("time_ms", c("time_ms") % 10).withColumn("ease", F.when(c("ease") <= 1, 0).otherwise(c("ease")))).select("event_id", "kind"), "reviews")
_q("q04_reference_faults", "SELECT 'card without note' AS fault, id FROM cards WHERE nid NOT IN (SELECT id FROM notes WHERE mid <> 3) UNION ALL SELECT 'missing deck', id FROM (SELECT did AS id FROM cards UNION SELECT odid FROM cards WHERE odid <> 0) WHERE id NOT IN (SELECT id FROM decks WHERE id <> 4) UNION ALL SELECT 'home deck outside list', id FROM cards WHERE odid <> 0 AND did NOT IN (SELECT id FROM decks WHERE filtered AND id <> 4)", lambda k, n, e: Q.reference_faults(k, n.where("mid <> 3"), e.where("id <> 4")), "cards", "notes", "decks")
_q("q05_first_of_duplicates", "SELECT min(id) AS id FROM cards GROUP BY did, ord", lambda k: Q.first_of_duplicates(k.withColumn("nid", c("did"))).select("id"), "cards")
_q("q06_beyond_templates", "SELECT k.id, nid, ord FROM cards k JOIN notes n ON n.id = k.nid WHERE mid = 2 AND ord >= 1", lambda k, n: Q.beyond_templates(k, n, {1: 2, 2: 1}), "cards", "notes")
_q("q07_repaired_notes", f"SELECT id, [front || '; ' || back] AS flds, 'fields' AS fixed FROM notes WHERE mid = 1", lambda n: Q.repaired_notes(n, {1: 1}, FIXED).select("id", "flds", "fixed"), "notes")
_q("q08_future_ids", "SELECT count(*) AS n FROM cards WHERE id > 1000", lambda k: Q.future_ids(k, type(FIXED)(1, 0, 0)), "cards")
_q("q08_rekeyed", "SELECT id, CASE WHEN nid >= 700 THEN nid + 1000 ELSE nid END AS nid FROM cards", lambda k: Q.rekeyed(k, k.where("nid >= 700").select(c("nid").alias("old"), (c("nid") + 1000).alias("new")).distinct(), "nid").select("id", "nid"), "cards")
_q("q09_next_position", "SELECT max(due) + 1 AS next FROM cards WHERE type = 0", Q.next_position, "cards")
_q("q10_raised_eases", "SELECT k.id, CASE WHEN preset IN (1, 3) AND factor <> 0 AND factor < 1600 THEN 2500 ELSE factor END AS factor FROM cards k JOIN decks e ON e.id = k.did", lambda k, e: Q.raised_eases(k, e, [1, 3], 1600).select("id", "factor"), "cards", "decks")
_q("q12_note_states", "SELECT n.id, CASE WHEN regexp_matches(front || back, '\\{\\{c\\d+::') AND mid <> 4 THEN 'cloze in plain type' WHEN trim(front) = '' THEN 'empty' WHEN mid = 4 AND NOT regexp_matches(front || back, '\\{\\{c\\d+::') THEN 'no cloze' WHEN count(*) OVER (PARTITION BY mid, front) > 1 THEN 'duplicate' ELSE 'normal' END AS state FROM notes n", lambda n: Q.note_states(n, [4]), "notes")
_q("q14_item_defects", "WITH i AS (SELECT *, trim(regexp_replace(lower(answer), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS f, trim(regexp_replace(lower(stem), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM items) SELECT item_id, contains(t, f) AS stem_tells, length(answer) > 12 AS long_answer, count(*) OVER (PARTITION BY f) > 1 AS same_answer FROM i", Q.item_defects, "items")
_q("q15_ledger_status", "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'unledgered' WHEN item_id % 4 = 1 THEN 'changed' WHEN item_id % 4 = 2 THEN 'missing' ELSE 'kept' END AS status FROM benchmark", lambda b: Q.ledger_status(b.where("item_id % 4 <> 2"), b.where("item_id % 4 <> 0").select("item_id", Q.item_hash(["item_id", "text"]).alias("hash")).withColumn("hash", F.when(c("item_id") % 4 == 1, "old").otherwise(c("hash"))), ["item_id", "text"]), "benchmark")
_q("q16_secret_shapes", "SELECT doc_id AS id, unnest(" + " || ".join(f"regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in Q.SECRET_SHAPES) + ") AS found FROM documents", lambda d: Q.secret_shapes(d.select(c("doc_id").alias("id"), "text")), "documents")
_q("ag20_notetype_use", "SELECT mid, count(*) AS n FROM notes GROUP BY 1", lambda n: n.groupBy("mid").agg(F.count("*").alias("n")), "notes")
_q("ag21_duplicates", "SELECT front, count(*) AS n, list_sort(list(id)) AS ids FROM notes WHERE front <> '' GROUP BY 1 HAVING count(*) > 1", lambda n: n.where("front <> ''").groupBy("front").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1"), "notes")
_q("ag38_row_counts", "SELECT 'cards' AS name, count(*) AS n FROM cards UNION ALL SELECT 'notes', count(*) FROM notes UNION ALL SELECT 'reviews', count(*) FROM reviews", lambda k, n, r: k.agg(F.count("*").alias("n")).select(F.lit("cards").alias("name"), "n").union(n.agg(F.count("*")).select(F.lit("notes"), "count(1)")).union(r.agg(F.count("*")).select(F.lit("reviews"), "count(1)")), "cards", "notes", "reviews")
_q("ag46_field_names", "SELECT DISTINCT name FROM (SELECT unnest(CASE mid WHEN 1 THEN ['Front', 'Back'] WHEN 2 THEN ['Front', 'Back', 'Hint'] ELSE ['Text'] END) AS name FROM notes WHERE tag LIKE 'en%')", lambda n: n.where("tag like 'en%'").select(F.explode(F.when(c("mid") == 1, F.array(F.lit("Front"), F.lit("Back"))).when(c("mid") == 2, F.array(F.lit("Front"), F.lit("Back"), F.lit("Hint"))).otherwise(F.array(F.lit("Text")))).alias("name")).distinct(), "notes")
