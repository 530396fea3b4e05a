"""Running sums along an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace


def running_sums(df: DataFrame, work: Workspace, within: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """The rows with, for each name in `sums`, the inclusive running sum of its column along
    `order` inside each group of `within` (which may be empty: then over all rows).

    Rows are shuffled by range of (within, order) and written with the number of their range, so
    a group that holds a third of all rows is cut by its order into as many tasks as it needs.
    Sums run inside a range, and start from the totals of the group's earlier ranges: one row per
    group and range, and a group has at most as many as the shuffle has partitions."""
    staged = {f"_sum_{name}": column for name, column in sums.items()}
    blocks = work.keep(
        df.withColumns(staged).repartitionByRange(*within, *order).withColumn("_block", F.spark_partition_id())
    )
    group = [*within, "_block"]
    totals = blocks.groupBy(*group).agg(*(F.sum(c).alias(c) for c in staged))
    before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in staged))
    starts = work.keep(starts.toDF(*(f"_g{i}" for i in range(len(group))), *starts.columns[len(group) :]))
    same = [blocks[c].eqNullSafe(starts[f"_g{i}"]) for i, c in enumerate(group)]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = blocks.withColumns({c: F.sum(c).over(inside) for c in staged})
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = running.join(starts, condition, "left")
    return joined.select(
        *(joined[c] for c in df.columns), *((joined[c] + joined[f"{c}_before"]).alias(n) for n, c in zip(sums, staged, strict=True))
    )
