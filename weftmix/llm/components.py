"""Connected components of a table of links, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmix.llm.common import cut


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One large-star or small-star step over links (a, b), a > b. The minimum
    of each vertex is written first, so that the join with it has plain
    exchanges on both sides and a hot vertex's links can be split."""
    near = edges.select("a", "b")
    if larger:
        near = near.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")))
    met = near.join(least, near["a"] == least["v"])
    if larger:
        new = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return cut(new.filter("a > b").distinct())


def connected(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``links`` (a, b) that isn't the
    smallest of its component; root is that smallest vertex. Alternates
    large-star and small-star steps, O(log^2 n) of them; only a count and a
    checksum of the links reach the driver."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
    before = state(edges)
    while before[0]:
        edges = _stars(_stars(edges, True), False)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
