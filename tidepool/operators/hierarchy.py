"""Hierarchies by name: tags (::) and decks (unit separator). Every step up is an exploded ancestor, not a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.scalars import ancestors, parent
from tidepool.sources.shared import kept

c = F.col


def tag_tree(tags: DataFrame, name: str = "tag", separator: str = "::") -> DataFrame:
    """(name, level, registered): all tags and the parents they lack, in order of name."""
    known = tags.select(c(name).alias("name")).where(c("name") != "").distinct()
    every = known.select(F.explode(ancestors(c("name"), separator)).alias("name")).distinct()
    return every.join(known.withColumn("registered", F.lit(True)), "name", "left").select("name", F.size(F.split("name", separator)).alias("level"), F.coalesce("registered", F.lit(False)).alias("registered"))


def rolled_up(counts: DataFrame, name: str, values: list[str], separator: str) -> DataFrame:
    """Sums of a node and all below it, for every node and ancestor."""
    each = counts.select(F.explode(ancestors(c(name), separator)).alias(name), *values)
    return each.groupBy(name).agg(*[F.sum(v).alias(v) for v in values])


def capped_roll_up(decks: DataFrame, name: str, separator: str) -> DataFrame:
    """Review and new counts under the caps of every ancestor: rows (name, interday, review, new, review_cap, new_cap).

    Interday learning goes first and uses the review cap, then reviews, then new cards, which the review cap holds too.
    Level by level from the deepest, over the deck dimension only; trees of any depth.
    """
    level = decks.withColumn("level", F.size(F.split(name, separator))).withColumn("parent", parent(c(name), separator))
    done = None
    below = None
    top = level.agg(F.max("level")).first()[0] or 0
    for n in range(top, 0, -1):
        now = level.where(c("level") == n)
        if below is not None:
            sums = below.groupBy(c("parent").alias(name)).agg(*[F.sum(v).alias(f"below_{v}") for v in ("interday", "review", "new")])
            now = now.join(sums, name, "left")
        for v in ("interday", "review", "new"):
            now = now.withColumn(v, c(v) + (F.coalesce(c(f"below_{v}"), F.lit(0)) if below is not None else F.lit(0)))
        now = now.withColumn("interday", F.least("interday", "review_cap")).withColumn("review", F.least("review", c("review_cap") - c("interday")))
        now = now.withColumn("new", F.least("new", "new_cap", c("review_cap") - c("interday") - c("review"))).select(name, "parent", "level", "interday", "review", "new")
        if (top - n) % 8 == 7:
            now = kept(now)  # deep trees: the plan does not grow with every level
        done = now if done is None else done.union(now)
        below = now
    return done if done is not None else level.select(name, "parent", "level", "interday", "review", "new")


def filled(cards: DataFrame, decks: DataFrame, order: list[Column], separator: str, overall: int, deck: str = "deck", key: str = "id") -> DataFrame:
    """The cards that a daily list takes when it is filled in `order`: a card goes in unless the cap of its deck, of a deck above
    it, or the overall cap is used up. cards have `deck`, the deck's name; decks are (name, cap).

    What a deck takes are the first of what the decks below it take and of its own, up to its cap. So caps apply level by level,
    the deepest first, and each level keeps a ranking's first rows for each deck: tasks drop what cannot be among them
    before anything is shuffled.
    """
    caps = decks.select(c("name").alias("__name"), c("cap").alias("__cap"))
    levels, most = decks.agg(F.max(F.size(F.split("name", separator))), F.max("cap")).first()
    path = F.split(c(deck), separator)
    left = cards.join(caps.select("__name"), c(deck) == c("__name"), "left_semi")
    for level in range(levels or 0, 0, -1):
        below = F.size(path) >= level
        node = F.array_join(F.slice(path, 1, level), separator)
        ranked = left.where(below).withColumn("__name", node).withColumn("__rank", F.row_number().over(Window.partitionBy("__name").orderBy(*order, c(key)))).where(c("__rank") <= most)
        kept_here = ranked.join(caps, "__name").where("__rank <= __cap").drop("__name", "__rank", "__cap")
        left = kept_here.unionByName(left.where(~below)) if level > 1 else kept_here
        if (levels - level) % 4 == 3:
            left = kept(left)  # deep trees: the plan does not grow with every level
    return left.orderBy(*order, c(key)).limit(overall)


def children(nodes: DataFrame, name: str, of: str, separator: str) -> DataFrame:
    return nodes.where(F.startswith(name, F.lit(of + separator)))


def parents(nodes: DataFrame, name: str, of: str, separator: str) -> DataFrame:
    parts = of.split(separator)
    return nodes.where(c(name).isin([separator.join(parts[:n]) for n in range(1, len(parts))]))


def missing_ancestors(nodes: DataFrame, name: str, separator: str) -> DataFrame:
    """Names that are an ancestor of a node and no node themselves (names compared without case)."""
    up = nodes.select(F.explode(ancestors(c(name), separator, itself=False)).alias(name)).distinct()
    known = nodes.select(F.lower(c(name)).alias("low")).distinct()
    return up.join(known, F.lower(up[name]) == known["low"], "left_anti")


def name_ranks(rows: DataFrame, name: str) -> DataFrame:
    """Position by name without case. For dimensions (decks, notetypes, templates): one window over a small table."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.lower(name), name)))
