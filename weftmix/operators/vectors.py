"""Embedding-table arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmix.operators.metrics import exact_sum


def apply_embedding_delta(vecs: DataFrame, base: DataFrame, mode: str = "add", id_col: str = "row_id",
                          vec_col: str = "vec") -> DataFrame:
    """Add (``add``) or subtract (``remove``) the base vectors on the rows
    the base has; rows beyond the base (new vocabulary) stay unchanged.

    An equi-join on the row id (shuffle or broadcast, as the planner sees
    fit for the base's size), element-wise ``zip_with`` in FLOAT. Spark has
    no half type: the reference's half-precision cast on the remove path is
    not reproduced (stated)."""
    if mode not in ("add", "remove"):
        raise ValueError(mode)
    b = base.select(F.col(id_col), F.col(vec_col).alias("_base"))
    op = (lambda x, y: x + y) if mode == "add" else (lambda x, y: x - y)
    j = vecs.join(b, id_col, "left")
    return (j.withColumn(vec_col, F.when(F.col("_base").isNull(), F.col(vec_col))
                         .otherwise(F.zip_with(vec_col, "_base", lambda x, y: op(x, y).cast("float"))))
            .drop("_base"))


def vector_sum(vec_col: str = "vec"):
    return F.aggregate(F.col(vec_col), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def embedding_checksum(vecs: DataFrame, expected: float | None = None, eps: float = 1e-4,
                       vec_col: str = "vec") -> DataFrame:
    """Sum of all elements, exact in any order of rows, and whether it is
    within ``eps`` of ``expected``."""
    s = vecs.select(F.explode(vec_col).alias("_x")).agg(exact_sum(F.col("_x").cast("double")).alias("total"))
    if expected is None:
        return s
    return s.withColumn("ok", F.abs(F.col("total") - F.lit(float(expected))) < F.lit(float(eps)))
