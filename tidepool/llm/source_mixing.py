"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents laid end to end by doc_id, are packed into blocks of a fixed number of words. The
output is a row of slots, one block each, cut into shards. Every slot draws its source from the target shares, so each
shard's counts are a multinomial draw; where the draws of a source exceed its quota, the surplus slots (those last in
a hash order) are drawn again from the sources still short of theirs, so that totals meet the targets to a block. The
k-th slot of a source maps through that source's pseudorandom permutation of its block indices, and slots join blocks
by (source, index). Ranks and running totals are taken in two levels over range partitions, so a source of any size
spreads over all tasks.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a source of its own, after all
others; repeated rows are separate documents (equal doc_ids take an order by text hash); an empty table gives no rows;
other columns are ignored. Equal input gives equal output, however it is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

def running(df: DataFrame, order: list[str], value: str, name: str, within: str | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before this one in `order`, within equal `within` if given.

    Two levels: rows are range-partitioned by `order` (which starts with `within`), summed inside each partition, and
    the totals of earlier partitions are added. No group is gathered in one task.
    """
    spread = materialize(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__part", F.spark_partition_id()), "ranged")
    keys = ["__part"] + ([within] if within else [])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    out = spread.withColumn("__here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(totals, keys).withColumn(name, F.col("__here") + F.col("__before")).drop("__part", "__here", "__before")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds weight and target to (source_key, source_size): shares of all sizes by weight, stopped at `most` times a
    source's size, the excess reshared by weight until none is above. One row per source, its rank by code point."""
    ranked = running(sources.withColumn("one", F.lit(1).cast("long")), ["source_key"], "one", "rank").drop("one")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int"))).withColumn("cap", F.col("source_size") * most)
    # The level rises until the shares reach the total: sources stop in the order of cap over weight.
    ranked = ranked.withColumn("stop", F.col("cap") / F.col("weight"))
    order = ["stop", "source_key"]
    filled = running(running(ranked, order, "cap", "cap_before"), order, "weight", "weight_before")
    sums = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(sums["size"] or 0) - F.col("cap_before")) / (F.lit(sums["weight"] or 0) - F.col("weight_before"))
    free = filled.where(F.col("stop") >= level).agg(F.min(F.struct("stop", "source_key", level.alias("level"))).alias("first")).first()["first"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(free["level"] if free else 0.0)))
    return filled.select("source_key", "source_size", "rank", "weight", target.alias("target"))


def _mixed(key: Column, number: int, half: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(number), half), size)


def _halves(x: Column, b: Column) -> tuple[Column, Column]:
    right = F.pmod(x, b)
    return F.floor((x - right) / b), right


def _stepped(x: Column, a: Column, b: Column, key: Column) -> Column:
    """One pass of a four-round Feistel network over 0..a*b-1: x = left * b + right, each half shifted by a hash of the other."""
    left, right = _halves(x, b)
    for number in (0, 2):
        left = F.pmod(left + _mixed(key, number, right, a), a)
        right = F.pmod(right + _mixed(key, number + 1, left, b), b)
    return left * b + right


def permuted(rows: DataFrame, k: Column, n: Column, key: Column, name: str) -> DataFrame:
    """Adds `name`: the k-th index (modulo n) of the pseudorandom permutation of 0..n-1 that belongs to key, n below 2**52.

    The network runs over the least a * b >= n with a near the root of n. What it maps beyond n is mapped on until it is
    below n (cycle walking); there are fewer than a such places, so all but about one in a is right at once.
    """
    a, b, left, right = (F.col(c) for c in ("__a", "__b", "__left", "__right"))
    out = rows.withColumn("__k", F.pmod(k, n)).withColumn("__n", n).withColumn("__key", key).withColumn("__a", F.ceil(F.sqrt(F.col("__n").cast("double"))).cast("long"))
    out = out.withColumn("__b", F.floor((F.col("__n") + a - 1) / a).cast("long"))
    halves = _halves(F.col("__k"), b)
    out = out.withColumn("__left", halves[0]).withColumn("__right", halves[1])
    for number in (0, 2):  # the rounds of _stepped, each as a column of its own
        out = out.withColumn("__left", F.pmod(left + _mixed(F.col("__key"), number, right, a), a))
        out = out.withColumn("__right", F.pmod(right + _mixed(F.col("__key"), number + 1, left, b), b))
    once, size = F.col("__once"), F.col("__n")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once, lambda x, _: F.when(x < size, x).otherwise(_stepped(x, a, b, F.col("__key"))))
    out = out.withColumn("__once", left * b + right).withColumn("__walked", F.when(once < size, once).otherwise(walked))
    known = F.when(F.col("__walked") < size, F.col("__walked")).otherwise(F.raise_error(F.lit("a permutation's cycle is too long")).cast("long"))
    return out.withColumn(name, known).drop("__k", "__n", "__key", "__a", "__b", "__left", "__right", "__once", "__walked")


def blocks_of(rows: DataFrame, last: DataFrame) -> DataFrame:
    """Adds `block` to the rows (rank, k): the k-th of the source's permutation, with the last block swapped to the last place
    of each pass. last: (rank, source_key, blocks) per source."""
    swapped = permuted(last, F.col("blocks") - 1, F.col("blocks"), F.col("source_key"), "swapped")
    mapped = permuted(rows.join(swapped, "rank"), F.col("k"), F.col("blocks"), F.col("source_key"), "at")
    end = F.col("blocks") - 1
    return mapped.withColumn("block", F.when(F.pmod("k", "blocks") == end, end).when(F.col("at") == end, F.col("swapped")).otherwise(F.col("at")))


def _placed(rows: DataFrame, at: str, shares: DataFrame, most_step: int = 4096) -> DataFrame:
    """Joins each row to the share whose range [from, from + quota) holds its value: by equal steps, so that a large share
    is many join keys. A step is no longer than a share's mean length, so that the rows of a step meet few shares: over all
    steps at most twice as many pairs as rows, if these lie evenly."""
    size = shares.agg(F.count("*").alias("n"), F.coalesce(F.sum("quota"), F.lit(0)).alias("slots")).first()
    step = max(1, min(most_step, size["slots"] // max(size["n"], 1)))
    first, last = F.floor(F.col("from") / step), F.floor((F.col("from") + F.col("quota") - 1) / step)
    cut = shares.select("*", F.explode(F.sequence(first, last)).alias("__step"))
    inside = (F.col(at) >= F.col("from")) & (F.col(at) < F.col("from") + F.col("quota"))
    return rows.withColumn("__step", F.floor(F.col(at) / step)).join(cut, "__step").where(inside).drop("__step")


def mix(docs: DataFrame, block_words: int = 32, shard_slots: int = 4096, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes from the document, repeats counted), and the columns
    of docs named in carry."""
    known = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    sized = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("source_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"), *carry), "sized"
    )
    # null sources sort last: "0..." before "1"
    per = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    plan = targets(per, weights, most)
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    # whole passes over a source's blocks, then full blocks only: its last, shorter block comes last in every pass
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    plan = plan.withColumn("quota", F.least(passes * F.col("blocks") + F.round((F.col("target") - passes * F.col("source_size")) / block_words).cast("long"), F.col("blocks") * most))
    plan = materialize(running(plan, ["rank"], "quota", "from"), "plan")
    placed = running(sized.where("size > 0"), ["source_key", "doc_id", "tie"], "size", "start", "source_key")

    # slots: each draws a source by its quota's share, the place of a uniform draw among the running quotas
    total = plan.agg(F.sum("quota").alias("slots")).first()["slots"] or 0
    spark = docs.sparkSession
    shares = plan.where("quota > 0").select("source_key", "rank", "quota", "from", "blocks")
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("draw"))
    drawn = _placed(slots, "draw", shares)
    # within a source, slots are numbered in hash order; those beyond the quota are surplus
    numbered = running(drawn.drop("source_key", "quota", "from", "blocks", "draw").withColumn("one", F.lit(1).cast("long")).withColumn("mix", F.xxhash64("slot", F.lit(seed + 1))), ["rank", "mix", "slot"], "one", "k", "rank")
    numbered = materialize(numbered.join(shares.select("rank", "quota"), "rank"), "numbered")
    held = numbered.where("k < quota").select("slot", "shard", "rank", "k")
    counts = numbered.groupBy("rank").agg(F.count("*").alias("got"))
    short = shares.join(counts, "rank", "left").withColumn("missing", F.greatest(F.col("quota") - F.coalesce("got", F.lit(0)), F.lit(0)))
    short = running(short.drop("from"), ["rank"], "missing", "from").where("missing > 0")
    surplus = running(numbered.where("k >= quota").select("slot", "shard", "mix", "one"), ["mix", "slot"], "one", "draw")
    redrawn = _placed(surplus.select("slot", "shard", "draw"), "draw", short.select("source_key", "rank", F.col("missing").alias("quota"), "from", "blocks", F.coalesce("got", F.lit(0)).alias("got")))
    redrawn = redrawn.withColumn("k", F.col("got") + F.col("draw") - F.col("from"))
    full = held.union(redrawn.select("slot", "shard", "rank", "k"))
    mapped = blocks_of(full, shares.select("rank", "source_key", "blocks")).select("shard", "slot", "source_key", "block")
    # written, so that the join's null test on block does not take the whole permutation down into every join before it
    times = materialize(mapped.groupBy("source_key", "block").agg(F.count("*").alias("times")), "times")

    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.select("source_key", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    taken = pieces.join(times, ["source_key", "block"]).groupBy("source_key", "start").agg(F.sum(F.col("times") * overlap).alias("taken"))
    got = placed.join(taken, ["source_key", "start"], "left").select("doc_id", "source_key", "size", F.coalesce("taken", F.lit(0)).alias("taken"), *carry)
    got = got.union(sized.where("size = 0").select("doc_id", "source_key", "size", F.lit(0).cast("long").alias("taken"), *carry))
    return got.join(plan.select("source_key", "source_size", "target"), "source_key").select("doc_id", "size", "source_size", "target", "taken", *carry)
