"""Every filter as a query over the fixture views, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.context import FIXED
from tidepool.operators import predicates as P
from tidepool.plans.registry import register
from tidepool.sources.fixtures import view, with_tags

NOW, NEXT, DAYS = FIXED.now, FIXED.next_day_at, FIXED.days_elapsed
_ANY = "(regexp_matches(front, '{0}', 'i') OR regexp_matches(back, '{0}', 'i'))"
_FOLD = "strip_accents(lower({0}))"


def _notes(name: str, sql: str, predicate) -> None:
    """A filter over notes: the ids it keeps."""
    register(name, f"SELECT id FROM notes WHERE {sql}")(lambda spark, d: with_tags(view(spark, d, "notes")).where(predicate()).select("id"))


def _cards(name: str, sql: str, predicate) -> None:
    register(name, f"SELECT id FROM cards WHERE {sql}")(lambda spark, d: view(spark, d, "cards").withColumn("data", F.to_json(F.struct("s", "d", "lrt", F.to_json(F.struct((F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, "x").alias("k"))).alias("cd")))).where(predicate()).select("id"))


def _joined(name: str, sql: str, operator, *tables: str) -> None:
    register(name, sql)(lambda spark, d: operator(*[view(spark, d, t) for t in tables]).select("id"))


_notes("pr01_everything", "true", P.everything)
_notes("pr02_text_contains", "front ILIKE '%thing%' OR back ILIKE '%thing%'", lambda: P.text_contains("thing"))
_notes("pr03_text_noaccent", f"contains({_FOLD.format('front')}, 'eleve') OR contains({_FOLD.format('back')}, 'eleve')", lambda: P.text_contains_noaccent("eleve"))
_notes("pr04_text_nocloze", "mid = 2 AND (front ILIKE '%queau%' OR back ILIKE '%queau%')", lambda: P.text_contains_nocloze("queau", [2]))
_notes("pr05_text_regex", _ANY.format("ing[s]?\\.$"), lambda: P.text_regex(r"ing[s]?\.$"))
_notes("pr06_word", _ANY.format("\\bthem[^ ]*\\b"), lambda: P.word("them*"))
_notes("pr07_field", "(mid = 1 AND front ILIKE 'th%') OR (mid = 2 AND back ILIKE 'th%')", lambda: P.field({1: 0, 2: 1}, "th*"))
_notes("pr08_field_nonempty", "mid IN (1, 2) AND length(back) > 0", lambda: P.field_nonempty({1: 1, 2: 1}))
_notes("pr09_field_regex", "mid = 1 AND regexp_matches(front, '^(the|and) ', 'i')", lambda: P.field_regex({1: 0}, "^(the|and) "))
_notes("pr10_field_noaccent", f"mid = 2 AND {_FOLD.format('front')} = 'nicht aulich fur sch eruver enau sch der.'", lambda: P.field_noaccent({2: 0}, "Nicht aulich fur sch eruver enau sch der."))
_notes("pr11_any_field", "front ILIKE 'and %' OR back ILIKE 'and %'", lambda: P.any_field("and *"))
_notes("pr12_tag", "lower(tag) = 'en' OR lower(tag) LIKE 'en::%'", lambda: P.tag("EN"))
_notes("pr12_tag_glob", "regexp_matches(tag, '^en::src1\\S*(::.*)?$', 'i')", lambda: P.tag("en::src1*"))
_notes("pr13_tag_regex", "regexp_matches(tag, 'src[35]$', 'i') OR (toxic = 1 AND regexp_matches('label::toxic', 'src[35]$'))", lambda: P.tag_regex("src[35]$"))
register("pr13_tag_noaccent", "SELECT id FROM notes WHERE tag LIKE 'fr::%'")(lambda spark, d: P.tag_noaccent(with_tags(view(spark, d, "notes")), "fr").select("id"))
_joined("pr14_deck", "SELECT c.id FROM cards c WHERE EXISTS (SELECT 1 FROM decks d WHERE d.parent = 'ASIA' AND d.id IN (c.did, c.odid))", lambda cards, decks: P.deck(cards, decks, "asia"), "cards", "decks")
_joined("pr14_deck_filtered", "SELECT id FROM cards WHERE odid <> 0", lambda cards, decks: P.deck(cards, decks, "filtered"), "cards", "decks")
_joined("pr15_deck_tree", "SELECT id FROM cards WHERE did = 5 OR odid = 5", lambda cards, decks: P.deck_tree_id(cards, decks, 5), "cards", "decks")
_cards("pr15_deck_ids", "did IN (3, 4) OR odid IN (3, 4)", lambda: P.deck_ids([3, 4]))
_joined("pr16_notetype", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment ILIKE 'b%'", lambda t: P.named(t.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("m")), t.select(F.col("c_mktsegment").alias("name"), F.col("c_mktsegment").alias("id")).distinct(), "b*", "m"), "customer")
_cards("pr17_template", "ord = 1", lambda: P.template(1))
_joined("pr18_preset", "SELECT c.id FROM cards c JOIN decks d ON d.id = CASE WHEN odid <> 0 THEN odid ELSE did END WHERE preset = 3", lambda cards, decks: P.preset(cards, decks, 3), "cards", "decks")
_cards("pr19_added", f"id > {(NEXT - 86400 * 7) * 1000}", lambda: P.added(FIXED, 7))
_notes("pr20_edited", f"mod > {NEXT - 86400 * 30}", lambda: P.edited(FIXED, 30))
_joined("pr21_introduced", f"SELECT id FROM cards WHERE id IN (SELECT cid FROM reviews WHERE ease <> 0 GROUP BY cid HAVING min(id) > {(NEXT - 86400 * 29) * 1000})", lambda cards, reviews: P.introduced(cards, reviews, FIXED, 29), "cards", "reviews")
_joined("pr22_rated", f"SELECT id FROM cards WHERE id IN (SELECT cid FROM reviews WHERE id >= {(NEXT - 86400 * 2) * 1000} AND ease = 3)", lambda cards, reviews: P.rated(cards, reviews, FIXED, 2, 3), "cards", "reviews")
for _name, _how, _sql in (("eq", "=", f"BETWEEN {(NEXT - 86400 * 3) * 1000} AND {(NEXT - 86400 * 2) * 1000 - 1}"), ("lt", "<", f"< {(NEXT - 86400 * 3) * 1000}"), ("ge", ">=", f">= {(NEXT - 86400 * 3) * 1000}")):
    _joined(f"pr23_rated_{_name}", f"SELECT id FROM cards WHERE id IN (SELECT cid FROM reviews WHERE id {_sql} AND ease = 0)", lambda cards, reviews, how=_how: P.rated_on(cards, reviews, FIXED, how, -2, "manual"), "cards", "reviews")
for _kind, _sql in (("new", "type = 0"), ("review", "type IN (2, 3)"), ("learn", "type IN (1, 3)"), ("suspended", "queue = -1"), ("buried", "queue IN (-2, -3)"), ("due", f"(queue IN (2, 3) AND due <= {DAYS}) OR (queue IN (1, 4) AND due <= {NOW} + 1200)")):
    _cards(f"pr24_state_{_kind}", _sql, lambda kind=_kind: P.state(kind, FIXED))
_cards("pr25_flag", "flags & 7 = 3", lambda: P.flag(3))
_cards("pr26_ids", "id IN (1, 5, 9, 100000)", lambda: P.ids([1, 5, 9, 100_000]))
_cards("pr27_prop_due", f"(queue IN (2, 3) AND CASE WHEN odue <> 0 THEN odue ELSE due END <= {DAYS} + 5) OR (queue IN (1, 4) AND ((CASE WHEN odue <> 0 THEN odue ELSE due END) - {NEXT}) // 86400 <= 5)", lambda: P.prop_due("<=", 5, FIXED))
_cards("pr28_prop_pos", "type = 0 AND CASE WHEN odue <> 0 THEN odue ELSE due END < 100", lambda: P.prop_pos("<", 100))
_cards("pr29_prop_ivl", "ivl >= 30", lambda: P.prop_int("ivl", ">=", 30))
_cards("pr29_prop_lapses", "lapses > 2 AND reps < 9", lambda: P.prop_int("lapses", ">", 2) & P.prop_int("reps", "<", 9))
_cards("pr30_prop_ease", "factor < 2000", lambda: P.prop_ease("<", 2.0))
_cards("pr31_prop_stability", "s > 40 OR d <= 0.5 * 9 + 1", lambda: P.prop_stability(">", 40) | P.prop_difficulty("<=", 0.5))
_cards("pr32_prop_retrievability", f"type <> 0 AND pow(greatest({NOW} - lrt, 0) / 86400.0 / s * (pow(0.9, -2) - 1) + 1, -0.5) < 0.9", lambda: P.prop_retrievability("<", 0.9, FIXED))
_cards("pr33_custom_data", "id % 7 >= 3 AND id % 3 = 0", lambda: P.custom_data_prop("v", ">=", 3) & P.custom_data_prop("k", "=", "x"))
register("pr34_dupe_of", "SELECT id FROM notes WHERE mid = 1 AND front = 'The and attion to thanedble the, anea. Eriner thanea.'")(
    lambda spark, d: P.dupe_of(with_tags(view(spark, d, "notes")), 1, "The and attion to thanedble the, anea. Eriner thanea.").select("id")
)
