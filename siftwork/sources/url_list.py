"""URL inventories kept as text, one address per line."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import strip


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct stripped lines without blank ones and `#` comments, as `url`."""
    url = strip(column)
    return lines.select(url.alias("url")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#"))).distinct()


_VERSION = re.compile(r"/version=(\d+)/")


def load_urls(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Inventory at `path`: a text file, or the newest version written by :func:`update_urls`, or the
    newest one below `before`.  Versions are told by the names of their folders; only the lines of
    one are read."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "url string")
    if "version" in lines.columns:
        versions = {int(found[1]) for name in lines.inputFiles() if (found := _VERSION.search(name))}
        older = [v for v in versions if before is None or v < before]
        if not older:
            return spark.createDataFrame([], "url string")
        lines = lines.filter(F.col("version") == max(older))
    return clean_lines(lines)


def merge_urls(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two inventories, sorted."""
    return existing.select("url").union(new.select("url")).distinct().orderBy("url")


def update_urls(existing: DataFrame, new: DataFrame, path: str, version: int) -> bool:
    """Write the merged inventory as a version of its own; nothing is written if nothing is new.  `new`
    is read twice: give a written table if it is costly."""
    if new.isEmpty():
        return False
    merge_urls(existing, new).write.mode("overwrite").text(f"{path}/version={version}")
    return True
