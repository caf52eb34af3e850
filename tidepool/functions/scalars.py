"""Scalar functions as native Column expressions; the few that Spark has no expression for are Arrow UDFs, marked so."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400
FIELD_SEPARATOR = "\x1f"


def strip_html(text: Column) -> Column:
    """Drops elements of raw text with all they hold, comments and tags in one scan from the left, so a comment that a style
    element holds ends nothing. Entities are decoded by decode_entities()."""
    return F.regexp_replace(text, r"(?is)<(style|script)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", "")


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t).replace("\xa0", " "))


def html_to_line(text: Column) -> Column:
    """One line of text: line breaks and block ends become spaces before tags go."""
    spaced = F.regexp_replace(text, r"(?i)<br\s*/?>|</?(?:div|p|li|ul|ol|tr|h[1-6])\b[^>]*>|\n", " ")
    return F.trim(F.regexp_replace(strip_html(F.regexp_replace(spaced, r"\[sound:[^\]]*\]", "")), r"\s+", " "))


_MEDIA = r"""(?i)<(?:img|audio|video|object|source)\b[^>]*?\s(?:src|data)=["']?([^"'>\s]+)["']?[^>]*>"""


def strip_html_keep_media(text: Column) -> Column:
    """Tags go, but a media tag leaves its file name."""
    return strip_html(F.regexp_replace(text, _MEDIA, " $1 "))


def media_references(text: Column) -> Column:
    """File names that media tags and sound marks refer to, distinct, in order of kind."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(_MEDIA), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\[sound:(.+?)\]"), F.lit(1))))


# --- wildcards: plain Python, used while a plan is built ---------------------------------------------------------------


def is_glob(pattern: str) -> bool:
    return bool(re.search(r"(?<!\\)(?:\\\\)*[*_]", pattern))


def glob_to_regex(pattern: str, any_char: str = ".") -> str:
    """* is any run, _ one character, a backslash takes either literally."""
    out, escaped = [], False
    for ch in pattern:
        if escaped:
            out.append(re.escape(ch))
            escaped = False
        elif ch == "\\":
            escaped = True
        else:
            out.append(f"{any_char}*" if ch == "*" else any_char if ch == "_" else re.escape(ch))
    return "".join(out)


def glob_to_like(pattern: str) -> str:
    out, escaped = [], False
    for ch in pattern:
        if escaped:
            out.append("\\" + ch if ch in "%_" else ch)
            escaped = False
        elif ch == "\\":
            escaped = True
        else:
            out.append("%" if ch == "*" else "\\%" if ch == "%" else ch)
    return "".join(out)


def glob_literal(pattern: str) -> str:
    return re.sub(r"\\(.)", r"\1", pattern)


# --- fields, tags, text ------------------------------------------------------------------------------------------------


def split_fields(text: Column) -> Column:
    return F.split(text, FIELD_SEPARATOR)


def join_fields(fields: Column) -> Column:
    return F.array_join(fields, FIELD_SEPARATOR)


def nth_field(text: Column, n: int) -> Column:
    return F.get(split_fields(text), n)


def checksum(first_field: Column) -> Column:
    """The first four bytes of SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(first_field), 1, 8), 16, 10).cast("long")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Letters that decomposition leaves alone, and what stands for them (fixed values).
_PLAIN = {
    "€": "E", "Æ": "AE", "Ð": "D", "Ø": "O", "Þ": "TH", "ß": "s", "æ": "ae", "ð": "d", "ø": "o", "þ": "th", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h",
    "ı": "i", "ĸ": "k", "Ł": "L", "ł": "l", "Ŋ": "N", "ŋ": "n", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t", "Ə": "E", "ǝ": "e", "ɑ": "a",
}


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    plain = str.maketrans(_PLAIN)
    return text.map(lambda t: None if t is None else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.category(ch).startswith("M")).translate(plain))


def drop_control(text: Column) -> Column:
    """Control characters except tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


_CLOZE = r"(?s)\{\{c(\d+)::(.*?)(?:::[^{}]*?)?\}\}"


def strip_cloze(text: Column) -> Column:
    """The text of cloze deletions without their marks, the innermost first, however deep they are nested."""
    inner = r"(?s)\{\{c\d+::((?:(?!\{\{c\d+::|\}\}|::).)*)(?:::(?:(?!\{\{|\}\}).)*)?\}\}"
    opened = F.regexp_count(text, F.lit(r"\{\{c\d+::"))
    return F.when(opened == 0, text).otherwise(F.aggregate(F.sequence(F.lit(1), opened), text, lambda t, _: F.regexp_replace(t, inner, "$1")))


def cloze_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\{\{c(\d+)::"), F.lit(1)), lambda n: n.cast("int"))))


def split_tags(text: Column) -> Column:
    """Tags are separated by spaces, the ideographic one too."""
    return F.filter(F.split(text, "[ 　]"), lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.when(F.size(tags) == 0, "").otherwise(F.concat(F.lit(" "), F.array_join(tags, " "), F.lit(" ")))


def normal_tag(tag: Column) -> Column:
    """Each part trimmed and without control characters or quotes; an empty part is `blank`."""
    parts = F.transform(F.split(tag, "::"), lambda p: F.regexp_replace(F.trim(p), r"[\x00-\x1F\"]", ""))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "", "blank").otherwise(p)), "::")


def parent(name: Column, separator: str = "::") -> Column:
    parts = F.split(name, separator)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), separator))


def leaf(name: Column, separator: str = "::") -> Column:
    return F.element_at(F.split(name, separator), -1)


def reparented(name: Column, new_parent: Column, separator: str = "::") -> Column:
    """The name under a new parent (null: top level); null onto itself or its own child."""
    low, under = F.lower(name), F.lower(new_parent)
    moved = F.when(new_parent.isNull(), leaf(name, separator)).otherwise(F.concat(new_parent, F.lit(separator), leaf(name, separator)))
    return F.when(new_parent.isNotNull() & ((under == low) | F.startswith(under, F.concat(low, F.lit(separator)))), F.lit(None)).otherwise(moved)


def ancestors(name: Column, separator: str = "::", itself: bool = True) -> Column:
    """Every prefix of a hierarchical name, the shortest first."""
    parts = F.split(name, separator)
    upto = F.size(parts) if itself else F.size(parts) - 1
    return F.when(upto < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), upto), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator)))


# --- numbers -----------------------------------------------------------------------------------------------------------


def elapsed_secs(data_lrt: Column, due: Column, ivl: Column, days_elapsed: int, now: int) -> Column:
    """Seconds since the last review: stored time, else due - interval for cards due by the second, else by the day."""
    by_second = F.greatest(F.lit(now) - F.greatest(due - ivl, F.lit(0)), F.lit(0))
    by_day = F.greatest(F.lit(days_elapsed) - F.greatest(due - ivl, F.lit(0)), F.lit(0)) * DAY
    return F.when(data_lrt.isNotNull(), F.greatest(F.lit(now) - data_lrt, F.lit(0))).when(due > 365_000, by_second).otherwise(by_day)


def forgetting_curve(days: Column, stability: Column, decay: float = 0.5) -> Column:
    factor = 0.9 ** (-1 / decay) - 1
    return F.pow(days / stability * factor + 1, F.lit(-decay))


def relative_overdueness(retrievability: Column, desired: Column, elapsed_days: Column, ivl: Column, decay: float = 0.5) -> Column:
    """How far below its goal a card's recall is, negative; by elapsed time over interval where it has no state."""
    odds = lambda r: F.pow(F.greatest(r, F.lit(0.0001)), F.lit(-1 / decay)) - 1
    return F.when(retrievability.isNotNull() & desired.isNotNull(), -odds(retrievability) / odds(desired)).otherwise(-(elapsed_days + 0.001) / F.greatest(ivl, F.lit(1)))


def custom_data(data: Column, key: str) -> Column:
    """A member of the JSON text that the `cd` member of the card's JSON holds."""
    return F.get_json_object(F.get_json_object(data, "$.cd"), f"$.{key}")


STATE = "s double, d double, dr double, decay double, lrt long, pos long, cd string"


def card_data(data: Column) -> Column:
    """The card's JSON as a struct; what does not parse is null."""
    return F.from_json(data, STATE, {"mode": "PERMISSIVE"})


def stable_order(*columns: Column | str, salt: int = 0) -> Column:
    return F.xxhash64(*columns, F.lit(salt))


def time_span(seconds: Column) -> Column:
    """A span in its largest whole unit, one decimal from months on."""
    units = ((365 * DAY, "y", 1), (30 * DAY, "mo", 1), (DAY, "d", 0), (3600, "h", 0), (60, "m", 0))
    out = F.format_string("%ds", F.round(seconds).cast("long"))
    for size, name, places in reversed(units):
        shown = F.format_string(f"%.1f{name}", (seconds / size).cast("double")) if places else F.format_string(f"%d{name}", F.round(seconds / size).cast("long"))
        out = F.when(F.abs(seconds) >= size, shown).otherwise(out)
    return out


def leak_normal(text: Column) -> Column:
    """Lower case, everything but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def shingles(words: Column, n: int) -> Column:
    """The set of n-word shingles; none for fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(part: Column, whole: Column) -> Column:
    """Share of a set that another holds."""
    return F.when(F.size(part) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(F.array_distinct(part)))


def typographic(text: Column) -> Column:
    """Quotes, dashes, spaces and ligatures as plain typing has them; soft hyphens and zero-width marks go."""
    plain = F.translate(text, "‘’‚‛“”„‟–—−‐‑    ", "''''\"\"\"\"-----    ")
    return F.regexp_replace(F.regexp_replace(plain, "[­​‌‍⁠﻿]", ""), "…", "...")


def without_invisible(text: Column) -> tuple[Column, Column]:
    """(text, how many invisible characters it lost)."""
    clean = F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    return clean, F.length(text) - F.length(clean)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, nn = successes / n, n * 1.0
    middle, half = p + z * z / (2 * nn), z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))
    scale = 1 + z * z / nn
    return F.greatest((middle - half) / scale, F.lit(0.0)), F.least((middle + half) / scale, F.lit(1.0))


def newcombe(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column]:
    """Interval of a difference of two independent proportions."""
    (l1, u1), (l2, u2), p1, p2 = wilson(x1, n1), wilson(x2, n2), x1 / n1, x2 / n2
    return p1 - p2 - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u2 - p2, 2)), p1 - p2 + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p2 - l2, 2))


#: (from, to, share): how much an interval may be moved, per day of it in each range.
FUZZ = ((2.5, 7.0, 0.15), (7.0, 20.0, 0.1), (20.0, float("inf"), 0.05))


def fuzz_bounds(ivl: Column, least: int = 1, most: int = 36_500) -> tuple[Column, Column]:
    """The range of whole days that an interval may be moved to."""
    delta = F.when(ivl < 2.5, F.lit(0.0)).otherwise(F.lit(1.0) + sum((F.greatest(F.least(ivl, F.lit(b)) - a, F.lit(0.0)) * f for a, b, f in FUZZ), F.lit(0.0)))
    fit = lambda x: F.least(F.greatest(F.round(x).cast("int"), F.lit(least)), F.lit(most))
    low, high = fit(ivl - delta), fit(ivl + delta)
    return low, F.when((high == low) & (high > 2) & (high < most), high + 1).otherwise(high)


def due_range(spec: str) -> tuple[int, int, bool]:
    """`n`, `a-b`, and a trailing `!` that changes the interval as well."""
    m = re.fullmatch(r"(\d+)(?:-(\d+))?(!)?", spec.strip())
    if not m:
        raise ValueError(f"not a range of days: {spec!r}")
    low, high = sorted((int(m[1]), int(m[2] or m[1])))
    return low, high, bool(m[3])


def register(spark: SparkSession) -> None:
    """The functions that SQL text may want, as temporary functions."""
    for text in (
        "CREATE OR REPLACE TEMPORARY FUNCTION field_at(flds STRING, n INT) RETURNS STRING RETURN get(split(flds, '\x1f'), n)",
        "CREATE OR REPLACE TEMPORARY FUNCTION first_field_sum(t STRING) RETURNS BIGINT RETURN CAST(conv(substr(sha1(t), 1, 8), 16, 10) AS BIGINT)",
        "CREATE OR REPLACE TEMPORARY FUNCTION stable_hash(a BIGINT, salt BIGINT) RETURNS BIGINT RETURN xxhash64(a, salt)",
        "CREATE OR REPLACE TEMPORARY FUNCTION recall(days DOUBLE, s DOUBLE) RETURNS DOUBLE RETURN pow(days / s * (pow(0.9e0, -2e0) - 1) + 1, -0.5e0)",
        "CREATE OR REPLACE TEMPORARY FUNCTION card_state(data STRING, k STRING) RETURNS DOUBLE RETURN CAST(get_json_object(data, concat('$.', k)) AS DOUBLE)",
        "CREATE OR REPLACE TEMPORARY FUNCTION custom_data(data STRING, k STRING) RETURNS STRING RETURN get_json_object(get_json_object(data, '$.cd'), concat('$.', k))",
        "CREATE OR REPLACE TEMPORARY FUNCTION original_position(data STRING) RETURNS BIGINT RETURN CAST(get_json_object(data, '$.pos') AS BIGINT)",
        "CREATE OR REPLACE TEMPORARY FUNCTION matches_any_field(flds STRING, re STRING) RETURNS BOOLEAN RETURN exists(split(flds, '\x1f'), f -> f RLIKE re)",
        "CREATE OR REPLACE TEMPORARY FUNCTION matches_any_tag(tags STRING, re STRING) RETURNS BOOLEAN RETURN exists(split(trim(tags), ' '), t -> t RLIKE re)",
    ):
        spark.sql(text)
