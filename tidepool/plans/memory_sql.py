"""SQL for the memory states: usable histories by windows, and the fold over a history as a recursive query."""

from __future__ import annotations

import math

from tidepool.context import FIXED
from tidepool.operators.memory import D_MAX, D_MIN, DEFAULT_W, S_MAX, S_MIN

W = DEFAULT_W
_FACTOR = f"({math.exp(math.log(0.9) / -W[20]) - 1!r})"


def _kept(training: bool) -> str:
    """CTEs up to kept (cid, i, id, event_id, rating, delta_t, factor, ivl, complete): the part of a history that counts.

    Seen from its end, a card's history without cramming is decided by its first learning answer or reset.
    """
    grade = "NULL" if training else "g"
    return f"""
e AS (SELECT cid, id, event_id, ease, kind, factor, ivl, ({FIXED.next_day_at} - id // 1000) // 86400 AS day,
             row_number() OVER (PARTITION BY cid ORDER BY id DESC, event_id DESC) AS rn, ease > 0 AND kind = 0 AS learning, kind = 4 AND factor = 0 AS reset,
             ease > 0 AND id > 0 AND (ivl >= 1 OR ivl <= -86400) AS grade
      FROM reviews WHERE NOT (kind = 3 AND factor = 0)),
d AS (SELECT cid, min(rn) FILTER (learning) AS l, min(rn) FILTER (reset) AS r FROM e GROUP BY cid),
x AS (SELECT d.cid, l IS NOT NULL AND (r IS NULL OR l < r) AS learned, r IS NOT NULL AND (l IS NULL OR r < l) AS cut, l, r,
             coalesce(min(e.rn) FILTER (e.rn > l AND NOT learning) - 1, max(e.rn)) AS run_end,
             max(e.rn) FILTER (grade AND (r IS NULL OR e.rn < r)) AS g
      FROM d JOIN e ON e.cid = d.cid GROUP BY ALL),
s AS (SELECT cid, CASE WHEN learned THEN run_end ELSE {grade} END AS at, learned AS complete FROM x),
kept AS (SELECT e.cid, row_number() OVER w AS i, id, event_id, CAST(ease AS DOUBLE) AS rating, CAST(coalesce(lag(day) OVER w - day, 0) AS DOUBLE) AS delta_t, factor, ivl, complete
         FROM e JOIN s ON s.cid = e.cid AND e.rn <= s.at WHERE ease > 0 WINDOW w AS (PARTITION BY e.cid ORDER BY id, event_id))"""


def _clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def _first(values: list[float]) -> str:
    return "CASE CAST(rating AS INT) " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values, 1)) + " END"


def recall(days: str, s: str) -> str:
    return f"pow({days} / {s} * {_FACTOR} + 1, {-W[20]!r})"


def seed(ease: str, ivl: str, retention: str) -> tuple[str, str]:
    """Stability and difficulty of a truncated history's first review."""
    s = f"(greatest({ivl}, {S_MIN}) * ({0.9 ** (-1 / W[20]) - 1!r}) / (pow({retention}, {-1 / W[20]!r}) - 1))"
    d = f"CASE WHEN {ease} <= 1.1 THEN ({ease} - 0.1) * 9 + 1 ELSE {_clamp(f'11 - ({ease} - 1) / ({math.exp(W[8])!r} * pow({s}, {-W[9]!r}) * (exp((1 - {retention}) * {W[10]}) - 1))', D_MIN, D_MAX)} END"
    return s, d


def _fold(retention: str) -> str:
    """Recursive CTE states (cid, i, s, d, p): the state after the i-th kept review, and the recall predicted before it."""
    s, d = "f.s", "f.d"
    r = recall("k.delta_t", s)
    bonus = f"CASE k.rating WHEN 2 THEN {W[15]} WHEN 4 THEN {W[16]} ELSE 1.0 END"
    success = f"{s} * ({math.exp(W[8])!r} * (11 - {d}) * pow({s}, {-W[9]}) * (exp((1 - {r}) * {W[10]}) - 1) * {bonus} + 1)"
    failure = f"least({W[11]} * pow({d}, {-W[12]}) * (pow({s} + 1, {W[13]}) - 1) * exp((1 - {r}) * {W[14]}), {s} / {math.exp(W[17] * W[18])!r})"
    same_day = f"exp((k.rating - 3 + {W[18]}) * {W[17]}) * pow({s}, {-W[19]})"
    new_s = f"CASE WHEN k.delta_t = 0 THEN {s} * CASE WHEN k.rating >= 2 THEN greatest({same_day}, 1.0) ELSE {same_day} END WHEN k.rating = 1 THEN {failure} ELSE {success} END"
    moved = f"({d} + (10 - {d}) * {-W[6]} * (k.rating - 3) / 9)"
    easiest = W[4] - math.exp(W[5] * 3) + 1
    new_d = _clamp(f"{W[7]} * ({easiest!r} - {moved}) + {moved}", D_MIN, D_MAX)
    difficulty = [min(max(W[4] - math.exp(W[5] * (g - 1)) + 1, D_MIN), D_MAX) for g in (1, 2, 3, 4)]
    ease = "(CASE WHEN factor = 0 THEN 2.5 ELSE factor / 1000.0 END)"
    s0, d0 = seed(ease, "CAST(greatest(ivl, 1) AS DOUBLE)", retention)
    return f"""
states AS (SELECT cid, i, CAST(CASE WHEN complete THEN {_first(list(W[:4]))} ELSE {s0} END AS DOUBLE) AS s, CAST(CASE WHEN complete THEN {_first(difficulty)} ELSE {d0} END AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS p
           FROM kept WHERE i = 1
           UNION ALL
           SELECT k.cid, k.i, CAST({_clamp(new_s, S_MIN, S_MAX)} AS DOUBLE), CAST({new_d} AS DOUBLE), {recall('k.delta_t', 'f.raw')}
           FROM (SELECT cid, i, s AS raw, {_clamp('s', S_MIN, S_MAX)} AS s, {_clamp('d', D_MIN, D_MAX)} AS d FROM states) f JOIN kept k ON k.cid = f.cid AND k.i = f.i + 1)"""


USABLE = f"WITH {_kept(False)} SELECT cid, complete, CAST(count(*) AS INT) AS n, list(delta_t ORDER BY i) AS gaps FROM kept GROUP BY cid, complete"
TRAINING = (
    f"WITH {_kept(True)} SELECT k.id AS review_id, k.event_id, k.cid, string_agg(CAST(p.rating AS INT) || ':' || CAST(p.delta_t AS INT), ' ' ORDER BY p.i) AS reviews "
    "FROM kept k JOIN kept p ON p.cid = k.cid AND p.i <= k.i WHERE k.i > 1 AND k.delta_t > 0 GROUP BY ALL"
)
STATES = (
    f"WITH RECURSIVE {_kept(False)}, {_fold('0.9')} SELECT cid, complete, round(s, 6) AS stability, round(d, 6) AS difficulty "
    "FROM states JOIN (SELECT cid, complete, max(i) AS i FROM kept GROUP BY ALL) USING (cid, i)"
)
PREDICTIONS = (
    f"WITH RECURSIVE {_kept(False)}, {_fold('0.9')} SELECT event_id, cid, round(p, 9) AS p, CAST(rating >= 2 AS INT) AS y, delta_t FROM states JOIN kept USING (cid, i) WHERE i > 1 AND delta_t > 0"
)


def card_memory(retention: str) -> str:
    """State of every card; retention is an expression over its preset."""
    s0, d0 = seed("(CASE WHEN factor = 0 THEN 2.5 ELSE factor / 1000.0 END)", "CAST(ivl AS DOUBLE)", retention)
    of = f"(SELECT k.id, e.preset, k.type, k.factor, k.ivl, CAST({retention} AS DOUBLE) AS retention FROM cards k JOIN decks e ON e.id = CASE WHEN odid <> 0 THEN odid ELSE did END)"
    per = _kept(False).replace("kept AS (SELECT", "all_kept AS (SELECT", 1)
    joined = f"h AS (SELECT * FROM {of}), kept AS (SELECT a.*, h.retention FROM all_kept a JOIN h ON h.id = a.cid)"
    last = "(SELECT cid, s, d FROM states JOIN (SELECT cid, max(i) AS i FROM kept GROUP BY cid) USING (cid, i))"
    seeded = "type <> 0 AND ivl >= 1"
    s0, d0 = (x.replace(retention, "retention") for x in (s0, d0))
    return (
        f"WITH RECURSIVE {per}, {joined}, {_fold('retention')} SELECT h.id, preset, round(coalesce(s, CASE WHEN {seeded} THEN {s0} END), 6) AS stability, "
        f"round(coalesce(d, CASE WHEN {seeded} THEN {d0} END), 6) AS difficulty, retention AS desired_retention FROM h LEFT JOIN {last} l ON l.cid = h.id"
    )


#: The stream's states: answers in order of time, days of UTC, no history cut away.
LIVE = (
    "WITH RECURSIVE a AS (SELECT user_id AS cid, event_id, ts, floor(epoch(ts) / 86400) AS day, "
    "CASE event_type WHEN 'error' THEN 1.0 WHEN 'view' THEN 2.0 WHEN 'click' THEN 3.0 ELSE 4.0 END AS rating FROM events WHERE event_type IN ('error', 'view', 'click', 'purchase')), "
    "kept AS (SELECT cid, row_number() OVER w AS i, event_id AS id, event_id, CAST(rating AS DOUBLE) AS rating, CAST(coalesce(day - lag(day) OVER w, 0) AS DOUBLE) AS delta_t, "
    "0 AS factor, 1 AS ivl, true AS complete FROM a WINDOW w AS (PARTITION BY cid ORDER BY ts, event_id)), "
    f"{_fold('0.9')} SELECT cid, round(s, 6) AS stability, round(d, 6) AS difficulty, i AS reviews FROM states JOIN (SELECT cid, max(i) AS i FROM kept GROUP BY cid) USING (cid, i)"
)

_FUZZED = (
    "SELECT id, nid, ivl, CASE WHEN ivl < 2.5 THEN 0 ELSE 1 + greatest(least(ivl, 7) - 2.5, 0) * 0.15 + greatest(least(ivl, 20) - 7, 0) * 0.1 + greatest(ivl - 20, 0) * 0.05 END AS delta "
    "FROM cards WHERE type = 2 AND queue = 2"
)


def chosen_days(factors: tuple[float, ...]) -> str:
    """The day of each review card's fuzz range with the largest weight; of equal ones the nearest."""
    weekday = "CASE (ahead + %d) %% 7 " % FIXED.days_elapsed + " ".join(f"WHEN {i} THEN {float(x)}" for i, x in enumerate(factors)) + " END"
    return (
        f"WITH f AS ({_FUZZED}), b AS (SELECT id, nid, least(greatest(CAST(round(ivl - delta) AS INT), 1), 36500) AS low, least(greatest(CAST(round(ivl + delta) AS INT), 1), 36500) AS high FROM f), "
        "d AS (SELECT id, nid, CAST(unnest(range(low, CASE WHEN high = low AND high > 2 AND high < 36500 THEN high + 1 ELSE high END + 1)) AS INT) AS ahead FROM b), "
        "live AS (SELECT id, nid, due FROM cards WHERE type = 2 AND queue = 2), l AS (SELECT due, count(*) AS load FROM live GROUP BY 1), "
        f"w AS (SELECT id, ahead, {weekday} * CASE WHEN EXISTS (SELECT 1 FROM live o WHERE o.nid = d.nid AND o.id <> d.id AND o.due = d.ahead + {FIXED.days_elapsed}) THEN 0.1 ELSE 1.0 END "
        f"/ pow(coalesce(load, 0) + 1, 2) / ahead AS weight FROM d LEFT JOIN l ON l.due = d.ahead + {FIXED.days_elapsed}) "
        "SELECT id, arg_max(ahead, (weight, -ahead)) AS ahead, max(weight) AS weight, count(*) AS choices FROM w GROUP BY id"
    )
