"""How well predicted recall (p) meets outcomes (y): everything from a table of counts on a grid of thousandths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.scalars import newcombe, wilson

c = F.col
GRID = 1000
EPS = 1e-15


def grid(rows: DataFrame, *by: str) -> DataFrame:
    """(by, g, n, sum_p, sum_y) on the grid: at most 1001 rows a group, so later windows are small."""
    g = F.floor(F.least(F.greatest(c("p"), F.lit(0.0)), F.lit(1.0)) * GRID + 0.5).cast("int")
    return rows.groupBy(*by, g.alias("g")).agg(F.count("*").alias("n"), F.sum("p").alias("sum_p"), F.sum("y").cast("long").alias("sum_y"))


def _losses() -> tuple[Column, Column]:
    q = F.least(F.greatest(c("p"), F.lit(EPS)), F.lit(1 - EPS))
    return F.pow(c("p") - c("y"), 2), -F.when(c("y") == 1, F.log(q)).otherwise(F.log1p(-q))


def losses(rows: DataFrame, *by: str) -> DataFrame:
    brier, log = _losses()
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("y").alias("observed"), F.avg("p").alias("predicted"), F.avg(brier).alias("brier"), F.avg(log).alias("log_loss"))


def fixed_bins(grid: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(c("g") * bins / GRID), F.lit(bins - 1)).cast("int")
    return grid.groupBy(b.alias("bin")).agg(F.sum("n").alias("n"), (F.sum("sum_p") / F.sum("n")).alias("predicted"), (F.sum("sum_y") / F.sum("n")).alias("observed"))


def equal_bins(grid: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of about equal counts, cut where the running count passes each tenth of the whole."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = grid.agg(F.sum("n").alias("whole"))
    cut = grid.join(F.broadcast(whole), F.lit(True), "left").withColumn("bin", F.least(F.floor(before * bins / c("whole")), F.lit(bins - 1)).cast("int"))
    return cut.groupBy("bin").agg((F.min("g") / GRID).alias("low"), F.sum("n").alias("n"), (F.sum("sum_p") / F.sum("n")).alias("predicted"), (F.sum("sum_y") / F.sum("n")).alias("observed"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(c("n") * F.abs(c("predicted") - c("observed"))) / F.sum("n")).alias("ece"))


def auc(grid: DataFrame) -> DataFrame:
    """Chance that a recalled review was predicted above a forgotten one, ties half, from the grid."""
    lost = c("n") - c("sum_y")
    below = F.coalesce(F.sum(lost).over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grid.withColumn("pairs", c("sum_y") * (below + lost / 2.0)).agg((F.sum("pairs") / F.nullif(F.sum("sum_y") * F.sum(lost), F.lit(0))).alias("auc"))


def band(rows: DataFrame, centre: float, half: float = 0.005) -> DataFrame:
    """Of the reviews predicted about `centre`: how many were recalled, with a Wilson interval."""
    got = rows.where((c("p") >= centre - half) & (c("p") < centre + half)).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("recalled"))
    low, high = wilson(c("recalled"), F.nullif(c("n"), F.lit(0)))
    return got.select("n", "recalled", (c("recalled") / F.nullif(c("n"), F.lit(0))).alias("observed"), low.alias("low"), high.alias("high"))


def baseline(rows: DataFrame) -> DataFrame:
    """Losses of always predicting the share recalled."""
    b = rows.agg(F.avg("y").alias("b"))
    return b.select((c("b") * (1 - c("b"))).alias("brier"), (-(c("b") * F.log("b") + (1 - c("b")) * F.log(1 - c("b")))).alias("log_loss"))


def per_collection(rows: DataFrame, by: str = "collection_id") -> DataFrame:
    """Quantiles over collections of their own losses."""
    each = losses(rows, by)
    return each.agg(*[F.percentile("brier", F.lit(q)).alias(f"brier_{round(100 * q)}") for q in (0.1, 0.5, 0.9)], *[F.percentile("log_loss", F.lit(q)).alias(f"log_loss_{round(100 * q)}") for q in (0.1, 0.5, 0.9)])


#: Chances that a Poisson count of mean one is at most 0, 1, 2, ...
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 8) for k in range(7))


def bootstrap(rows: DataFrame, cluster: str, value: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """95% interval of the mean of `value`, clusters resampled: each draw weighs a cluster by a seeded Poisson(1) count."""
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    digest = F.md5(F.concat_ws(":", c(cluster).cast("string"), c("draw").cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)
    weight = sum((F.when(u >= t, 1).otherwise(0) for t in POISSON), F.lit(0))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy("draw").agg((F.sum(c("w") * c("s")) / F.nullif(F.sum(c("w") * c("n")), F.lit(0))).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.count("*").alias("draws"))


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """95% interval of the mean difference of two columns, rows resampled together."""
    return bootstrap(pairs.withColumn("__d", c(a) - c(b)), key, "__d", draws, seed)


def block_gaps(responses: DataFrame, draws: int = 200, seed: int = 7) -> DataFrame:
    """(measure, n, point, low, high) of answers (card_id, block, correct, skipped) to three blocks of items.

    Blocks are `card` (as learned), `rset` (the same cards reworded, several a card) and `pset` (held out). Accuracies have
    Wilson intervals, but that of rset is resampled by card, as its answers come in clusters. The gap to the reworded is
    paired by card and resampled with the cards; that to the held out is of two independent shares (Newcombe).
    """
    graded = responses.where(~c("skipped"))
    right = lambda name: F.sum(F.when(c("block") == name, c("correct")).otherwise(0)).cast("double")
    asked = lambda name: F.count(F.when(c("block") == name, 1)).cast("double")
    sums = graded.agg(*[f(b).alias(f"{n}_{b}") for b in ("card", "rset", "pset") for n, f in (("x", right), ("n", asked))])

    def share(name: str, low: Column, high: Column, label: str) -> Column:
        return F.struct(F.lit(label).alias("measure"), c(f"n_{name}").cast("long").alias("n"), (c(f"x_{name}") / F.nullif(c(f"n_{name}"), F.lit(0.0))).alias("point"), low.alias("low"), high.alias("high"))

    some = lambda name: F.nullif(c(f"n_{name}"), F.lit(0.0))
    gap = newcombe(c("x_card"), some("card"), c("x_pset"), some("pset"))
    held = F.struct(F.lit("card minus held out").alias("measure"), c("n_pset").cast("long").alias("n"), (c("x_card") / some("card") - c("x_pset") / some("pset")).alias("point"), gap[0].alias("low"), gap[1].alias("high"))
    plain = sums.select(F.inline(F.array(share("card", *wilson(c("x_card"), some("card")), "card"), share("pset", *wilson(c("x_pset"), some("pset")), "held out"), share("rset", *wilson(c("x_rset"), some("rset")), "reworded, naive"), held)))
    rset = graded.where("block = 'rset'")
    clustered = bootstrap(rset, "card_id", "correct", draws, seed).select("low", "high")
    per = graded.groupBy("card_id").agg(F.avg(F.when(c("block") == "card", c("correct"))).alias("a"), F.avg(F.when(c("block") == "rset", c("correct"))).alias("b")).where("a is not null and b is not null")
    paired = paired_bootstrap(per, "card_id", "a", "b", draws, seed).select("low", "high")
    one = lambda rows, label, n, point, interval: rows.agg(n.cast("long").alias("n"), point.alias("point")).join(interval, F.lit(True), "left").select(F.lit(label).alias("measure"), "n", "point", "low", "high")  # noqa: E731  one row each
    reworded = one(rset, "reworded", F.count("*"), F.avg("correct"), clustered)
    return plain.unionByName(reworded).unionByName(one(per, "card minus reworded", F.count("*"), F.avg(c("a") - c("b")), paired))
