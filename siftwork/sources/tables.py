"""Table scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text, urls
from ..functions.regex import needle_text


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for an input with fewer splits than cores.

    Such an input is at most cores x maxPartitionBytes, so this shuffle is bounded; any larger
    input keeps the splits of its scan and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def read_table(spark: SparkSession, folder: str, name: str, columns=None, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df, key) if key else df


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table with a known schema; empty if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents; the address is the file path."""
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64("_metadata.file_path").alias("seq"),
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("raw_content"),
        F.lit(None).cast("string").alias("error"),
    )


def is_valid() -> Column:
    return F.col("error").isNull() & (F.coalesce(F.col("raw_content"), F.lit("")) != "")


def valid_docs(docs: DataFrame) -> DataFrame:
    """Documents that were obtained without error and have content."""
    return docs.filter(is_valid())


def corpus_scan(docs: DataFrame) -> DataFrame:
    """Document rows with hash, length, canonical address and prompt blocks."""
    return (
        docs.withColumn("_needles", needle_text("raw_content"))
        .withColumns(
            {
                "content_hash": F.when(F.col("error").isNull(), text.content_hash("raw_content")).otherwise(""),
                "metadata": F.struct(
                    urls.to_raw_url(F.col("url")).alias("raw_url"),
                    text.content_length("raw_content").alias("length"),
                ),
                "system_prompt_blocks": extract.prompt_blocks("raw_content", "_needles"),
            }
        )
        .drop("_needles")
    )
