"""Incremental ingest of a stream of documents into the catalogue."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalogue import compact, read_files, save_batch
from ..operators.vectors import index_batch

#: Micro-batches after which their parts are merged.
COMPACT_EVERY = 16


def ingest_stream(
    docs: DataFrame,
    root: str,
    checkpoint: str,
    first_batch: int = 1,
    as_of: datetime | None = None,
    index: bool = False,
    compact_every: int = COMPACT_EVERY,
    **trigger,
) -> StreamingQuery:
    """Store every micro-batch of a streaming (seq, url, raw_content, error) table.

    Micro-batch e becomes catalogue batch `first_batch + e`.  After a failure Spark hands out the
    same micro-batch again and it replaces its own part, so nothing is stored twice.  The parts of
    `compact_every` micro-batches are merged, and so are as many merged ones.  Streams and batch jobs
    that share a catalogue need separate ranges of batch numbers, and must not write at the same time.

    A micro-batch is a few files, often fewer than there are cores, and a file's rows tend to lie in one
    split; so its new texts are dealt out evenly before they are scanned."""

    def store(batch_docs: DataFrame, epoch: int) -> None:
        spark = batch_docs.sparkSession
        number = first_batch + epoch
        save_batch(spark, batch_docs, root, number, as_of or datetime.now(timezone.utc), spread=True)
        compact(spark, root, compact_every)
        if index:
            index_batch(spark, read_files(spark, root, number), root, number)

    return (
        docs.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
