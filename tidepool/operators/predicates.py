"""Filters over cards, notes and reviews: functions that give a Column, or a semi-join where another table decides.

Combine Columns with &, | and ~. Patterns are globs (* any run, _ one character) unless a function says regex; matching
ignores case. A null operand makes a comparison null, and the row is dropped, also under ~.
"""

from __future__ import annotations

import operator as op
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool import context as C
from tidepool.context import DAY, Clock
from tidepool.functions.scalars import checksum, custom_data, elapsed_secs, forgetting_curve, glob_to_like, glob_to_regex, is_glob, strip_cloze, strip_html_keep_media, without_marks

c = F.col
OPERATORS: dict[str, Callable] = {"=": op.eq, "!=": op.ne, "<": op.lt, "<=": op.le, ">": op.gt, ">=": op.ge}
_SPECIAL = r"\S"


def everything() -> Column:
    return F.lit(True)


# --- text in fields ----------------------------------------------------------------------------------------------------


def _like(pattern: str) -> str:
    return glob_to_like(pattern)


def text_contains(pattern: str, fields: str = "flds", skip: str | None = None) -> Column:
    """Any field holds the pattern; `skip` names an array of field numbers left out."""
    like = f"%{_like(pattern)}%"
    if skip is None:
        return F.exists(fields, lambda f: f.ilike(like))
    numbered = F.transform(fields, lambda f, i: F.struct(f.alias("f"), i.alias("i")))
    return F.exists(numbered, lambda x: x["f"].ilike(like) & ~F.array_contains(F.coalesce(c(skip), F.array().cast("array<int>")), x["i"]))


def text_contains_noaccent(pattern: str, fields: str = "flds") -> Column:
    """The same without accents, by collation."""
    plain = pattern.strip("*")
    return F.exists(fields, lambda f: F.contains(F.collate(f, "UNICODE_CI_AI"), F.collate(F.lit(plain), "UNICODE_CI_AI")))


def text_contains_nocloze(pattern: str, cloze_types: list[int], fields: str = "flds") -> Column:
    like = f"%{_like(pattern)}%"
    return c("mid").isin(cloze_types) & F.exists(F.transform(fields, lambda f: strip_cloze(f)), lambda f: f.ilike(like))


def text_regex(regex: str, fields: str = "flds") -> Column:
    return F.exists(fields, lambda f: f.rlike(f"(?i){regex}"))


def word(pattern: str, fields: str = "flds") -> Column:
    return text_regex(rf"\b{glob_to_regex(pattern, '[^ ]')}\b", fields)


def _of_field(ordinals: dict[int, int], test: Callable[[Column], Column], fields: str) -> Column:
    """The named field's place depends on the notetype: {notetype: ordinal}."""
    out = F.lit(False)
    for mid, n in ordinals.items():
        out = F.when(c("mid") == mid, test(F.get(fields, n))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def field(ordinals: dict[int, int], pattern: str, fields: str = "flds") -> Column:
    like = _like(pattern)
    return _of_field(ordinals, lambda f: f.ilike(like), fields)


def field_nonempty(ordinals: dict[int, int], fields: str = "flds") -> Column:
    return _of_field(ordinals, lambda f: F.length(f) > 0, fields)


def field_regex(ordinals: dict[int, int], regex: str, fields: str = "flds") -> Column:
    return _of_field(ordinals, lambda f: f.rlike(f"(?i){regex}"), fields)


def field_noaccent(ordinals: dict[int, int], pattern: str, fields: str = "flds") -> Column:
    return _of_field(ordinals, lambda f: F.collate(f, "UNICODE_CI_AI") == F.collate(F.lit(pattern), "UNICODE_CI_AI"), fields)


def any_field(pattern: str, fields: str = "flds") -> Column:
    like = _like(pattern)
    return F.exists(fields, lambda f: f.ilike(like))


# --- tags, decks, notetypes --------------------------------------------------------------------------------------------


def tag(pattern: str, tags: str = "tags") -> Column:
    """The tag or one below it; `none` for no tags, `*` for all notes, a pattern with a space matches nothing."""
    if pattern == "none":
        return F.size(tags) == 0
    if pattern == "*":
        return F.lit(True)
    if " " in pattern:
        return F.lit(False)
    regex = f"(?i)^{glob_to_regex(pattern, _SPECIAL)}(::.*)?$"
    return F.exists(tags, lambda t: t.rlike(regex))


def tag_regex(regex: str, tags: str = "tags") -> Column:
    return F.exists(tags, lambda t: t.rlike(f"(?i){regex}"))


def tag_noaccent(notes: DataFrame, pattern: str) -> DataFrame:
    regex = f"(?i)(^| ){glob_to_regex(pattern, _SPECIAL)}(::| |$)"
    return notes.where(without_marks(F.array_join("tags", " ")).rlike(regex))


def _dimension(cards: DataFrame, wanted: DataFrame, on: Column) -> DataFrame:
    return cards.join(wanted, on, "left_semi")


def deck(cards: DataFrame, decks: DataFrame, pattern: str) -> DataFrame:
    """Cards whose current or home deck matches the glob or lies below; `*` for all, `filtered` for study lists."""
    if pattern == "*":
        return cards
    if pattern == "filtered":
        return cards.where("odid <> 0")
    regex = "(?i)^" + "\x1f".join(glob_to_regex(p) for p in pattern.split("::")) + "($|\x1f.*)"
    wanted = decks.where(c("name").rlike(regex)).select(c("id").alias("wanted"))
    return _dimension(cards, wanted, (c("did") == c("wanted")) | (c("odid") == c("wanted")))


def deck_tree_id(cards: DataFrame, decks: DataFrame, deck_id: int) -> DataFrame:
    top = decks.where(c("id") == deck_id).select(c("name").alias("top"))
    wanted = decks.join(top, (c("name") == c("top")) | F.startswith("name", F.concat("top", F.lit("\x1f")))).select(c("id").alias("wanted"))
    return _dimension(cards, wanted, (c("did") == c("wanted")) | (c("odid") == c("wanted")))


def deck_ids(ids: list[int]) -> Column:
    return c("did").isin(ids) | c("odid").isin(ids)


def named(rows: DataFrame, names: DataFrame, pattern: str, key: str) -> DataFrame:
    """Rows whose `key` is the id of a notetype, preset or template with a matching name."""
    wanted = names.where(c("name").rlike(f"(?i)^{glob_to_regex(pattern)}$")).select(c("id").alias("wanted"))
    return _dimension(rows, wanted, c(key) == c("wanted"))


def template(ordinal: int) -> Column:
    return c("ord") == ordinal


def preset(cards: DataFrame, decks: DataFrame, preset_id: int) -> DataFrame:
    wanted = decks.where(c("preset") == preset_id).select(c("id").alias("wanted"))
    return _dimension(cards, wanted, F.when(c("odid") != 0, c("odid")).otherwise(c("did")) == c("wanted"))


# --- dates and reviews -------------------------------------------------------------------------------------------------


def _cutoff(clock: Clock, days: int) -> int:
    return clock.next_day_at - DAY * max(days, 1)


def added(clock: Clock, days: int) -> Column:
    return c("id") > _cutoff(clock, days) * 1000


def edited(clock: Clock, days: int) -> Column:
    return c("mod") > _cutoff(clock, days)


def introduced(cards: DataFrame, reviews: DataFrame, clock: Clock, days: int) -> DataFrame:
    """Cards whose first answer is after the cutoff. Only cards with a review since then have their history grouped."""
    cut = _cutoff(clock, days) * 1000
    recent = reviews.where((c("id") > cut) & (c("ease") != 0)).select("cid").distinct()
    first = reviews.where(c("ease") != 0).join(recent, "cid", "left_semi").groupBy("cid").agg(F.min("id").alias("first"))
    return cards.join(first.where(c("first") > cut), cards["id"] == c("cid"), "left_semi")


def _button(button: int | str) -> Column:
    return c("ease") > 0 if button == "any" else c("ease") == (0 if button == "manual" else int(button))


def rated(cards: DataFrame, reviews: DataFrame, clock: Clock, days: int, button: int | str = "any") -> DataFrame:
    return rated_on(cards, reviews, clock, ">", -days, button)


def rated_on(cards: DataFrame, reviews: DataFrame, clock: Clock, how: str, day: int, button: int | str = "any") -> DataFrame:
    """Cards answered on a relative day (0 today, -1 yesterday), compared by `how`."""
    end, start = (clock.next_day_at + DAY * day) * 1000, (clock.next_day_at + DAY * (day - 1)) * 1000
    within = {">": c("id") >= end, ">=": c("id") >= start, "<": c("id") < start, "<=": c("id") < end, "=": c("id").between(start, end - 1), "!=": ~c("id").between(start, end - 1)}[how]
    done = reviews.where(within & _button(button)).select("cid")
    return cards.join(done, cards["id"] == done["cid"], "left_semi")


def state(kind: str, clock: Clock, learn_ahead: int = 1200) -> Column:
    q = c("queue")
    return {
        "new": c("type") == C.NEW, "review": c("type").isin(C.REVIEW, C.RELEARN), "learn": c("type").isin(C.LEARN, C.RELEARN), "suspended": q == C.SUSPENDED, "buried": q.isin(C.SIBLING_BURIED, C.USER_BURIED),
        "buried-manually": q == C.USER_BURIED, "buried-sibling": q == C.SIBLING_BURIED, "due": (q.isin(2, 3) & (c("due") <= clock.days_elapsed)) | (q.isin(1, 4) & (c("due") <= clock.now + learn_ahead)),
    }[kind]


def flag(n: int) -> Column:
    return c("flags").bitwiseAND(F.lit(7)) == n


def ids(wanted: list[int], key: str = "id") -> Column:
    return c(key).isin(wanted)


# --- properties --------------------------------------------------------------------------------------------------------


def _due() -> Column:
    return F.when(c("odue") != 0, c("odue")).otherwise(c("due"))


def prop_due(how: str, days: int, clock: Clock) -> Column:
    by_second = F.expr(f"((CASE WHEN odue <> 0 THEN odue ELSE due END) - {clock.next_day_at}) div {DAY}")
    return (c("queue").isin(2, 3) & OPERATORS[how](_due(), days + clock.days_elapsed)) | (c("queue").isin(1, 4) & OPERATORS[how](by_second, days))


def prop_pos(how: str, position: int) -> Column:
    return (c("type") == C.NEW) & OPERATORS[how](_due(), position)


def prop_int(name: str, how: str, value: int) -> Column:
    """ivl, reps or lapses."""
    return OPERATORS[how](c(name), value)


def prop_ease(how: str, ease: float) -> Column:
    return OPERATORS[how](c("factor"), int(ease * 1000))


def prop_stability(how: str, value: float) -> Column:
    return OPERATORS[how](c("s"), value)


def prop_difficulty(how: str, share: float) -> Column:
    return OPERATORS[how](c("d"), share * 9 + 1)


def prop_retrievability(how: str, value: float, clock: Clock) -> Column:
    days = elapsed_secs(c("lrt"), _due(), c("ivl"), clock.days_elapsed, clock.now) / DAY
    return F.when(c("type") == C.NEW, F.lit(False)).otherwise(OPERATORS[how](forgetting_curve(days, c("s")), value))


def custom_data_has(key: str, data: str = "data") -> Column:
    return custom_data(c(data), key).isNotNull()


def custom_data_prop(key: str, how: str, value: float | str, data: str = "data") -> Column:
    got = custom_data(c(data), key)
    return OPERATORS[how](got.try_cast("double") if isinstance(value, (int, float)) else got, value)


def dupe_of(notes: DataFrame, mid: int, text: str) -> DataFrame:
    """Notes of a type whose first field is this text: by checksum, then by the stripped text itself."""
    stripped = strip_html_keep_media(F.lit(text))
    return notes.where((c("mid") == mid) & (c("csum") == checksum(stripped)) & (strip_html_keep_media(F.get("flds", 0)) == stripped))


def globbed(pattern: str) -> bool:
    return is_glob(pattern)
