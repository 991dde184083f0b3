"""Join helpers: broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of in-process configuration (prompts, reviewers, templates) up to which
# a lookup side is broadcast.
CONFIG_ROWS = 10_000


def known_rows(df: DataFrame, n: int) -> DataFrame:
    """Record the row count of a table built from in-process configuration
    (a handful of prompts, reviewers, templates)."""
    df._weftmix_rows = int(n)
    return df


def bounded_broadcast(df: DataFrame, max_rows: int = CONFIG_ROWS) -> DataFrame:
    """``broadcast(df)`` for a configuration table of known, small size. Any
    other side is returned as it is: Catalyst and AQE compare its bytes with
    ``spark.sql.autoBroadcastJoinThreshold``."""
    n = getattr(df, "_weftmix_rows", None)
    return F.broadcast(df) if n is not None and n <= max_rows else df
