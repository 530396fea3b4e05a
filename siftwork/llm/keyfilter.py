"""A set of 64-bit keys as a bit table of fixed size, to leave rows out before they are moved.

A row whose bit is not set is certainly not in the set; the others go to an exact join.  The table
has the same size for any number of keys, so it may be sent to every task; with very many keys it
only leaves fewer rows out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 23
_PER_BUCKET = 1 << 15


def build(keys: DataFrame, key: str) -> np.ndarray:
    """The bit table (bytes) of a key column; nulls are left out."""
    place = F.pmod(F.col(key), F.lit(BITS)) + 1
    rows = (
        keys.filter(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    table = np.zeros((BITS // _PER_BUCKET, _PER_BUCKET // 8), np.uint8)
    for bucket, bits in rows:
        table[bucket - 1] = np.frombuffer(bits, np.uint8)
    return table.reshape(-1)


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = np.mod(keys, BITS)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def may_hold(table: np.ndarray, key: Column) -> Column:
    """Whether the key's bit is set, as a column; null keys have none."""

    @F.arrow_udf(T.BooleanType())
    def test(keys: pa.Array) -> pa.Array:
        return pa.array(holds(table, keys.fill_null(0).to_numpy()) & keys.is_valid().to_numpy(zero_copy_only=False))

    return test(key)
