"""First-wins deduplication with an explicit order; safe for hot keys.

Groups are reduced by a partial aggregation, so a value that holds a third of all rows shuffles as
one row per task.  Wide rows are then joined on their own unique key, never on the hot value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_value(df: DataFrame, value: str, order_by: str) -> DataFrame:
    """(value, order_by) of the first row of every value."""
    return df.groupBy(value).agg(F.min(order_by).alias(order_by))


def dedup_content(docs: DataFrame, order_by: str = "seq", value: str = "content_hash") -> DataFrame:
    """Whole rows, first per content hash.  Only (hash, order key) is shuffled to find them, and
    the rows are joined on both, which no two rows share."""
    winners = first_per_value(docs.select(value, order_by), value, order_by)
    return docs.join(winners, [value, order_by], "left_semi")


def dedup_urls(urls: DataFrame, order_by: str, value: str = "url") -> DataFrame:
    """Distinct addresses in order of first appearance."""
    return first_per_value(urls, value, order_by).orderBy(order_by)


def union_sources(*sources: DataFrame, order_by: str = "pos", value: str = "url") -> DataFrame:
    """Addresses of several lists, each with a position, concatenated and deduplicated: earlier
    list first, then position."""
    whole = None
    for number, source in enumerate(sources):
        part = source.select(F.struct(F.lit(number).alias("source"), F.col(order_by).alias("pos")).alias("rank"), value)
        whole = part if whole is None else whole.unionByName(part)
    return (
        first_per_value(whole, value, "rank")
        .select(value, F.col("rank.source").alias("source"), F.col("rank.pos").alias("pos"))
        .orderBy("source", "pos")
    )


def new_urls(candidates: DataFrame, inventory: DataFrame, order_by: str, value: str = "url") -> DataFrame:
    """Distinct candidates that the inventory lacks, order kept.  Both sides are reduced to
    distinct addresses per task before they are shuffled."""
    return (
        first_per_value(candidates, value, order_by)
        .join(inventory.select(value).distinct(), value, "left_anti")
        .orderBy(order_by)
    )
