"""The stages of the corpus pipeline: (spark, documents, folder of the tables) -> documents.

All but the last return the columns of their input, whatever these are; each works on every row it
is given, and rows may repeat or hold nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, mixing, packing, pii, quality
from .common import code_points, table

#: Near duplicates in the pipeline: word shingles and percent of common ones.
SHINGLE, PERCENT = 5, 80
#: Capacities of a training sequence of several pieces: documents and attention cost (half of a full one's).
DOCUMENTS, ATTENTION = 64, packing.LENGTH**2 // 2


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_per_component(docs, SHINGLE, PERCENT)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; n_chars follows the new text."""
    found = pii.with_surrogates(docs)
    return found.withColumn("n_chars", code_points(F.col("text"))) if "n_chars" in docs.columns else found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids and their place in the training sequences."""
    return packing.pack_documents(docs, keep_ids=True, documents=DOCUMENTS, attention=ATTENTION)
