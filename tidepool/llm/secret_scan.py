"""Secret scans: fixed patterns, and guess-cost dynamic programming on values in a credential context.

The fixed patterns (assign, access, hex) are found leftmost and without overlap per kind. Beside them, values that follow
a wider range of credential words are priced, as are the values of assign spans: a dynamic programme finds the cheapest
segmentation of the value into dictionary words, dates, repeats, keyboard walks and brute-force spans, in powers of ten of
guesses. The dictionary is made of the texts themselves: words by the number of texts that have them. A value that costs at
least `least_cost` is a span of kind guess; placeholders stay below. After "is", or after a separator and a space, a value
that looks like a plain word of any language is prose and no secret. Guess spans that overlap a fixed span are left out,
fixed ones always stay.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; a value is priced whole, in time
linear in its length (a longer value may cost less: it may complete a word or a repeat); repeated rows
are scanned each; an empty table gives no rows; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word as it may stand in a name; a name; and what stands between a name and its value, and the value.
_WORD = re.compile(r"(?<![A-Za-z])(?=(pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|auth(?:orization)?|credentials?|(?:api|access|private|signing|encryption)[_-]?key))", re.A | re.I)
_SECRET_KEY = re.compile(r"secret[_-]?key", re.A | re.I)
_NAME = re.compile(r"[A-Za-z0-9]++(?:[_.-][A-Za-z0-9]++)*+")
_VALUE = re.compile(r"[\"']?\s{0,3}(:|=>|:=|=|\bis\b)(\s{0,3})([\"']?)(?:bearer\s)?([^\s\"'<>,;`]{8,})", re.A | re.I)
#: How many more pieces a name may have behind its credential word.
MORE_PIECES = 4
#: What a plain word looks like: letters of one case, or only the first upper, in pieces joined by hyphens or apostrophes.
_PLAIN = re.compile(r"[^\W\d_]?(?:[^\W\d_A-Z]+|[A-Z]+)(?:['’-][^\W\d_A-Z]+)*[.!?:)]*")
_HINTS = ("pass", "pwd", "secret", "token", "bearer", "auth", "credential", "key")

#: Common words in the order guessers try them; a word's cost is its rank.
WORDS = (
    "password the and for you that this with have from user admin login welcome secret token change changeme default example test testing sample dummy "
    "placeholder your here none null true false undefined redacted hidden master access key api letmein dragon monkey shadow sunshine princess football "
    "baseball superman batman michael jordan hunter summer winter spring autumn monday friday love money computer internet server database root guest "
    "public private service account system manager office company security value string name email phone house water light green blue black white red"
).split()
_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
#: Words of more letters are left out of the dictionary, so that a value's cost takes linear time.
LONGEST = 20
_LETTERS = re.compile(r"[^\W\d_]{3,%d}" % LONGEST)
_LEET = str.maketrans("013457@$!", "oieastasi")
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
_NEXT = {(row[i], row[i + d]) for row in _ROWS for d in (1, -1) for i in range(len(row)) if 0 <= i + d < len(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")


def _class_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else 1.52


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of a value, in time linear in its length. ranks: a word's place in
    the order in which guessers try words."""
    n = len(value)
    low = "".join(x if len(x := c.lower()) == 1 else c for c in value)  # as long as the value
    plain = low.translate(_LEET)
    each = [_class_cost(c) for c in value]
    best = [0.0] + [math.inf] * n
    equal = [0] * 13  # per unit length: how many characters up to here equal those a unit before
    walk = 0  # where the keyboard walk that ends here starts
    starts: list[int] = []  # starts of its segments that are or can become the cheapest, the cheapest now last
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    for j in range(1, n + 1):
        cost = best[j - 1] + each[j - 1]
        for size in range(3, min(LONGEST, j) + 1):
            i = j - size
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                case = 0.3 if value[i:j] != low[i:j] else 0.0
                leet = 0.0 if low[i:j] in ranks else 0.6
                cost = min(cost, best[i] + math.log10(rank + 1) + case + leet + 0.3)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + math.log10(365 * 120 if j - i > 4 else 120))
        if j > 1 and (low[j - 2], low[j - 1]) not in _NEXT:
            walk = j - 1
            starts.clear()
        if j - walk >= 3:
            _add_start(starts, best, j)
            cost = min(cost, best[starts[-1]] + math.log10(47 * (j - starts[-1])))
        for unit in range(1, min(12, j - 1) + 1):
            equal[unit] = equal[unit] + 1 if low[j - 1] == low[j - 1 - unit] else 0
            times = equal[unit] // unit + 1
            if times > 1:
                cost = min(cost, best[j - times * unit] + sum(each[j - unit : j]) + math.log10(times))
        best[j] = cost
    return best[n]


def _overtakes(best: list[float], old: int, new: int) -> float:
    """The end from which a walk from `old` costs no more than one from the later `new`: once overtaken, `new` stays so."""
    ratio = 10.0 ** min(best[new] - best[old], 300.0)
    return (ratio * new - old) / (ratio - 1.0) if ratio > 1.0 else math.inf


def _add_start(starts: list[int], best: list[float], j: int) -> None:
    """Let walks that end at j start at j - 3 too. Each start is overtaken by the one before it, later ones sooner."""
    while len(starts) > 1 and _overtakes(best, starts[-2], starts[-1]) <= j:
        starts.pop()
    new = j - 3
    if starts and _overtakes(best, starts[-1], new) <= j:
        return
    while starts and (best[new] <= best[starts[-1]] or (len(starts) > 1 and _overtakes(best, starts[-1], new) >= _overtakes(best, starts[-2], starts[-1]))):
        starts.pop()
    starts.append(new)


def contexts(text: str) -> Iterator[re.Match]:
    """Matches of _VALUE behind names with a credential word near their end, from left to right and apart. A name is read once, its
    words once, and a value only behind such a name, so all of it takes linear time."""
    at = 0
    while name := _NAME.search(text, at):
        at = name.end()
        last = None
        for last in _WORD.finditer(text, name.start(), at):
            pass
        if last is None:
            continue
        word_end = max(last.end(1), m.end() if (m := _SECRET_KEY.match(text, last.start())) and m.end() <= at else 0)
        rest = text[word_end:at]
        if bool(rest and rest[0] not in "_.-") + sum(map(rest.count, "_.-")) <= MORE_PIECES and (value := _VALUE.match(text, at)):
            yield value
            at = value.end()


def spans(text: str | None, least_cost: float = 11.0, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, int, float | None]]:
    """(start, end, kind number, cost) in the order of start, then kind; cost for values in a credential context."""
    if not text:
        return []
    found: list[tuple[int, int, int, float | None]] = []
    low = text.lower()
    hints = any(h in low for h in _HINTS)
    if hints:
        found += [(m.start(), m.end(), 0, guess_cost(m[2], ranks)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2, None) for m in _HEX.finditer(text)]
    if hints:
        starts, ends = _union(found)
        for m in contexts(text):
            start, end = m.span(4)
            at = bisect_left(ends, start + 1)  # the first fixed stretch that ends behind the start
            if at < len(starts) and starts[at] < end:
                continue
            prose = m[1].lower() == "is" or (m[2] and not m[3])
            if not (prose and _PLAIN.fullmatch(m[4])) and (cost := guess_cost(m[4], ranks)) >= least_cost:
                found.append((start, end, 3, cost))
    return sorted(found, key=lambda s: s[:3])


def _union(found: list[tuple[int, int, int, float | None]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end, *_ in sorted(found, key=lambda s: s[:2]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def word_ranks(docs: DataFrame, most_words: int = 50_000) -> dict[str, int]:
    """The guessers' dictionary: the fixed words, then the words of the texts by the number of texts that have them: all from
    the least number on (in eighths of powers of two) that leaves at most `most_words` of them (about 5 MB). Counted over all texts, but for what stands in a credential context: a secret that copies repeat
    must not become a word. The bound is one on what is broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                low = (text.as_py() or "").lower()
                if any(h in low for h in _HINTS):
                    cuts = [0, *(x for m in contexts(low) for x in m.span(4)), len(low)]
                    low = "".join(low[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True))
                counts.update(set(_LETTERS.findall(low)))
                if len(counts) > 500_000:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = materialize(counted.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "words")
    least, total = None, 0
    for row in counted.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 8 * 63 rows
        total += row["count"]
        if total > most_words:
            break
        least = row["step"]
    common = [] if least is None else counted.where(F.col("step") >= least).collect()
    ranked = dict.fromkeys([*WORDS, *(r.word for r in sorted(common, key=lambda r: (-r.n, r.word)))])
    return {w: i + 1 for i, w in enumerate(ranked)}


def scan(docs: DataFrame, least_cost: float = 11.0, most_words: int = 50_000) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end, cost, value)."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, most_words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64()), ("value", pa.string())]))
        known = ranks.value
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "cost": c, "value": text[s:e]} for s, e, k, c in spans(text, least_cost, known)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,cost:double,value:string>>")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts per fixed kind, digest of the fixed spans and all spans as text, derived from scan(); least_cost is that of the value
    in a credential context (assign or guess) that is guessed first, in powers of ten."""
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.transform(F.filter("spans", lambda s: s["kind"] != "guess"), named)
    return scan(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", named), ",").alias("spans"), count("guess").alias("n_guess"),
        F.array_min(F.filter(F.transform("spans", lambda s: s["cost"]), lambda x: x.isNotNull())).alias("least_cost"),
    )
