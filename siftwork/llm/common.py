"""What several operators share: written intermediate tables, order, fold and word columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: A word of a text, also for Java.
WORD = r"[^\x20\x09-\x0D]+"
FOLDS, HELD_OUT_FOLD = 5, 0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that go to Python at once: whole texts are large, and a task holds several such batches.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TEXTS = 500


class Workspace:
    """A new folder in the cluster's shared storage; a written table cuts the lineage, survives
    lost executors and is computed once.  Batches for Python are limited to a size for texts."""

    def __init__(self, spark: SparkSession):
        if int(spark.conf.get(_BATCH_ROWS)) > _TEXTS:
            spark.conf.set(_BATCH_ROWS, str(_TEXTS))
        self.spark = spark
        self.folder = shared_folder(spark)
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.folder}/{self._n:03d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier's decimal text, modulo the folds; null for a null identifier."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def code_points(text: Column) -> Column:
    return F.length(text).cast("long")
