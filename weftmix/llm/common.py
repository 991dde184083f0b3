"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.session import checkpoint_dir, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows and bytes of text that a function handles at a time.
GROUP_ROWS, GROUP_BYTES = 128, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regroup(batches, rows: int = GROUP_ROWS, most: int = GROUP_BYTES, by: str = "text"):
    """A task's rows in groups of at most ``rows`` rows and ``most`` bytes of the
    column ``by`` (a longer value alone), as record batches. The groups depend
    on the rows and their order alone, not on how the session cuts batches."""
    held, n, size = [], 0, 0
    for batch in batches:
        at = 0
        for i, w in enumerate(pc.fill_null(pc.binary_length(batch.column(by)), 0).to_pylist()):
            if n and (n == rows or size + w > most):
                yield pa.concat_batches([*held, batch.slice(at, i - at)])
                held, n, size, at = [], 0, 0, i
            n, size = n + 1, size + w
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if n:
        yield pa.concat_batches(held)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(c, UPPER, UPPER.lower())


def id_bucket(c: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the
    empty text, whose crc32 is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(mod))
