"""From raw documents to packed training sequences: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import stages
from siftwork.llm.common import Workspace, table

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("jaccard_join", stages.jaccard_join),
    ("pii_surrogates", stages.pii_surrogates),
    ("mix_sources", stages.mix_sources),
    ("pack_sequences", stages.pack_sequences),
]

#: A trained classifier, a similarity join and keyed surrogates have no SQL form; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir))
    return docs
