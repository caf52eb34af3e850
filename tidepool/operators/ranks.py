"""Places in an order over a whole table, without gathering the table or a group of it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.sources.shared import kept


def numbered(rows: DataFrame, order: list[Column | str], name: str, within: list[str] | None = None) -> DataFrame:
    """Adds `name`: a row's place, from 1, in the order (within rows that agree in `within`).

    Two levels: rows are dealt to range partitions by `within` and the order, and written, so that a partition stays what
    it is if a task runs again; places inside a partition are added to the sizes of the partitions before it.
    """
    within = within or []
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    spread = kept(rows.repartitionByRange(*[F.col(k) for k in within], *keys).withColumn("__part", F.spark_partition_id()))
    groups = ["__part", *within]
    sizes = spread.groupBy(*groups).agg(F.count("*").alias("__n"))  # one row for each partition that a group has rows in
    before = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    here = spread.withColumn("__here", F.row_number().over(Window.partitionBy(*groups).orderBy(*keys)))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in groups]
    met = here.alias("r").join(sizes.alias("s"), same)
    return met.select(*[F.col(f"r.{k}") for k in rows.columns if k != name], (F.col("__here") + F.col("__before")).alias(name))
