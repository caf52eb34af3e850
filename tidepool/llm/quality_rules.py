"""Quality rules as a bitmask ledger.

Every text is measured once and every rule evaluated once; a row of the ledger holds the measurements and one bit per
failed rule. Policies are versioned masks over those bits, applied later without touching the texts, and an ablation is
a bitwise aggregation: how many documents would a policy keep without this rule.

Defined results: null and empty texts have zero words and fail the rule on length; ties and repeated rows are judged
row by row; an empty table gives no rows; other columns of the input are carried only where asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, window_hashes

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_marks"]


def measure(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """The MEASURES of one text; n_lines counts lines with a word, n_marks exclamation and question marks."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    repeated = 0
    if n >= 3:
        windows = window_hashes(hashes.of(words), 3)
        _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[at] > 1)
        if len(starts):
            covered = np.zeros(n, dtype=bool)
            for j in range(3):
                covered[starts + j] = True
            repeated = int(covered.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    packed = data.translate(None, SPACE + _CONTINUED)
    upper = sum(w.isupper() for w in words)
    return n, len(packed), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, data.count(b"!") + data.count(b"?")


def measurements(docs: DataFrame, *keep: str) -> DataFrame:
    """The `keep` columns (doc_id at least) and the MEASURES of every row."""
    keep = tuple(dict.fromkeys(("doc_id", *keep)))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            values = np.array([measure(t.as_py(), hashes) for t in batch.column("__text")], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(values[:, i]) for i in range(len(MEASURES))], [*keep, *MEASURES])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A named test; `fails` is a condition over the measurements. Its position in RULES is its bit for good."""

    name: str
    fails: str


#: Bits are never reused; new rules go to the end.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "2 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule("upper_case", "10 * n_upper_words > 7 * n_words"),
    Rule("shouting", "2 * n_marks > n_words"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what to reject: the rules that count, and how many of them a document may fail."""

    version: str
    rules: tuple[str, ...]
    may_fail: int = 0

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    "base": Policy("base", ("too_short", "repeated_windows")),
    "v1": Policy("v1", tuple(BIT)),
    "lenient": Policy("lenient", ("repeated_windows", "many_symbols", "duplicate_lines", "upper_case"), may_fail=1),
}


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """Measurements and `failed`, the bits of the failed rules."""
    bits = [F.when(F.expr(rule.fails), F.lit(BIT[rule.name]).cast("long")).otherwise(F.lit(0).cast("long")) for rule in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measurements(docs, *keep).withColumn("failed", failed)


def rejects(policy: Policy) -> Column:
    return F.bit_count(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))) > policy.may_fail


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, fail nothing else, and would be kept without it."""
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    counts = ledger.select(masked.alias("bits")).groupBy("bits").count()  # at most 2 ** len(rules) rows
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]
    per = counts.select("bits", "count", F.inline(F.array(*rows)))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    without = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))
    return per.groupBy("rule").agg(
        total(has).alias("failed"), total(F.col("bits") == F.col("bit")).alias("failed_alone"), total(has & (F.bit_count("bits") > policy.may_fail) & (without <= policy.may_fail)).alias("kept_without")
    )


def judged(docs: DataFrame, policy: Policy = POLICIES["v1"], *keep: str) -> DataFrame:
    """The ledger with base_failed and the policy's verdict, kept."""
    out = ledger(docs, *keep).withColumn("base_failed", rejects(POLICIES["base"]))
    return out.withColumn("kept", ~(F.col("base_failed") | rejects(policy)))
