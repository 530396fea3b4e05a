"""The inventory flow: collect candidate addresses, keep the new ones, write the merged list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import dedup
from ..sources import url_list


def refresh(spark: SparkSession, path: str, version: int, *sources: DataFrame) -> DataFrame:
    """Candidates (pos, url) of several sources that the inventory at `path` lacks, in source
    order; the merged inventory becomes `version` unless nothing is new.

    The inventory is the newest version below `version`, so a refresh may be repeated.  What is new is
    computed once: it is written beside the inventory and read from there."""
    known = url_list.load_urls(spark, path, before=version)
    added = dedup.union_sources(*sources).join(known, "url", "left_anti")
    folder = f"{path}-added/version={version}"
    added.write.mode("overwrite").parquet(folder)
    stored = spark.read.schema(added.schema).parquet(folder)
    url_list.update_urls(known, stored, path, version)
    return stored.orderBy("source", "pos")
