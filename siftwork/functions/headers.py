"""Request-header maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_auth_headers(headers: str) -> Column:
    """The map with authorization values reduced to their scheme."""
    return F.expr(
        f"transform_values({headers}, (k, v) -> CASE WHEN lower(k) <> 'authorization' THEN v"
        " WHEN contains(v, ' ') THEN concat(substring_index(v, ' ', 1), ' [REDACTED]')"
        " ELSE '[REDACTED]' END)"
    )
