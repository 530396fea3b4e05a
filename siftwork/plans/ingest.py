"""The document flow as a whole: store, index, export, search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalogue, vectors


def ingest(
    spark: SparkSession,
    docs: DataFrame,
    root: str,
    batch: int,
    as_of: datetime,
    export_to: str | None = None,
) -> int:
    """Store a batch of documents, index what was accepted, optionally export the catalogue.

    Indexing reads the batch back from the catalogue: the written table is the lineage cut, and
    lost executors repeat neither the scan nor the classification.  Returns the number of newly
    indexed documents."""
    catalogue.save_batch(spark, docs, root, batch, as_of)
    added = vectors.index_batch(spark, catalogue.read_files(spark, root, batch), root, batch)
    if export_to:
        catalogue.export_json(spark, root, export_to, as_of)
    return added


def search(spark: SparkSession, root: str, query: str, n: int = 10, where=None) -> DataFrame:
    return vectors.semantic_search(vectors.read_index(spark, root), query, n, where)
