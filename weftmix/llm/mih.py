"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's binary code holds one sign bit per dimension. Codes are split into
``segments`` substrings of 16 bits. When two codes differ in d bits, at least
one substring differs in at most d // segments bits, so after all substring
buckets within radius r have been looked up, every code within
``segments * (r + 1) - 1`` bits has been seen. The search grows r until the
k-th verified distance lies inside that covered distance, so the result is
exact.

Rows are dealt to index blocks by the hash of their code and queries to query
blocks; each (index block, query block) pair is one task that sorts its
substring tables once and answers its queries; the k best of every block are
then merged. Equal codes are first reduced to one entry with their k + 1
smallest ids, which is all that a top-k by (distance, id) can use, so a hot
group of equal vectors is one entry.

Defined results: a null or empty vector has no code, is never found and finds
nothing; a query does not find its own id; ties in distance go to the smaller
id; repeated ids count once; fewer than k others give fewer rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftmix.llm.common import cut, table

K = 10
BITS = 64
SEGMENT_BITS = 16
INDEX_BLOCK = 1 << 20
QUERY_BLOCK = 1 << 15
QUERY_STEP = 50
#: At least so many index blocks, for tasks enough at any size.
LEAST_BLOCKS = 32


def binary_codes(df: DataFrame, id_col: str, vec_col: str, bits: int = BITS) -> DataFrame:
    """(id, code): bit i is 1 when component i is above zero; ``bits`` up to 64."""
    v = F.col(vec_col)
    code = None
    for i in range(bits):
        bit = F.when(F.get(v, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        code = bit if code is None else code.bitwiseOR(bit)
    return df.filter(F.size(v) > 0).select(F.col(id_col).cast("bigint").alias("id"), code.alias("code"))


def flips(bits: int, radius: int) -> np.ndarray:
    """All masks of ``radius`` set bits among ``bits``."""
    out = np.zeros(1, np.int64)
    for _ in range(radius):  # add a bit above the highest one set
        high = np.array([int(x).bit_length() for x in out])
        out = np.concatenate([out[high <= b] | (1 << b) for b in range(bits)])
    return out


class SegmentTables:
    """Substring tables of one block of distinct codes."""

    def __init__(self, codes: np.ndarray, segments: int, bits: int):
        self.codes, self.segments, self.bits = codes, segments, bits
        self.order, self.starts = [], []
        for s in range(segments):
            v = self.part(codes, s)
            o = np.argsort(v, kind="stable")
            self.order.append(o)
            self.starts.append(np.searchsorted(v[o], np.arange((1 << bits) + 1)))
        self.masks = [flips(bits, 0)]

    def part(self, codes, s):
        return ((codes >> np.uint64(s * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def at_radius(self, codes, r) -> np.ndarray:
        """(query, entry) pairs, as query * entries + entry, with a substring
        at exactly ``r`` bits from the query's."""
        while len(self.masks) <= r:
            self.masks.append(flips(self.bits, len(self.masks)))
        found = []
        for s in range(self.segments):
            keys = (self.part(codes, s)[:, None] ^ self.masks[r][None, :]).ravel()
            a, b = self.starts[s][keys], self.starts[s][keys + 1]
            n = b - a
            if total := int(n.sum()):
                at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
                q = np.repeat(np.arange(len(keys)) // len(self.masks[r]), n)
                found.append(q * len(self.codes) + self.order[s][at])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def search(self, codes, need, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of all pairs seen until every query has
        ``need`` ids (an entry has ``size`` of them) within its covered distance."""
        m = len(self.codes)
        seen = np.zeros(len(codes) * m, bool)
        hits, active = [], np.arange(len(codes))
        within = np.zeros((len(codes), self.segments * (self.bits + 1) + 1), np.int64)  # ids by distance
        for r in range(self.bits + 1):
            pairs = self.at_radius(codes[active], r)
            q, e = active[pairs // m], pairs % m
            new = ~seen[q * m + e]
            q, e = q[new], e[new]
            seen[q * m + e] = True
            d = np.bitwise_count(self.codes[e] ^ codes[q]).astype(np.int64)
            np.add.at(within, (q, d), size[e])
            hits.append((q, e, d))
            covered = self.segments * (r + 1) - 1
            active = active[within[active, :covered + 1].sum(axis=1) < need]
            if not len(active):
                break
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True))


def _block_search(k: int, segments: int, bits: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "neighbor_id", "distance")})
        if not len(index) or not len(queries):
            return out
        entry = index["code"].to_numpy(np.int64).view(np.uint64)
        ids = [np.asarray(x, np.int64) for x in index["ids"]]
        size = np.array([len(x) for x in ids])
        start, flat = np.concatenate(([0], np.cumsum(size))), np.concatenate(ids)
        tables = SegmentTables(entry, segments, bits)
        asked = np.unique(queries["code"].to_numpy(np.int64))
        step = max(1, (1 << 24) // len(entry))
        parts = []
        for i in range(0, len(asked), step):
            own = asked[i:i + step]
            # the query itself may be one of the ids found, so k + 1 are needed
            q, e, d = tables.search(own.view(np.uint64), k + 1, size)
            n = size[e]
            at = np.repeat(start[e] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            q, d, found = np.repeat(q, n), np.repeat(d, n), flat[at]
            o = np.lexsort((found, d, q))
            q, d, found = q[o], d[o], found[o]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            best = rank <= k
            parts.append(pd.DataFrame({"code": own[q[best]], "neighbor_id": found[best], "distance": d[best]}))
        got = queries[["id", "code"]].merge(pd.concat(parts), on="code")
        got = got[got["id"] != got["neighbor_id"]].rename(columns={"id": "query_id"})
        got = got[got.groupby("query_id").cumcount() < k]
        return got[["query_id", "neighbor_id", "distance"]]
    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, segment_bits: int = SEGMENT_BITS,
          index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK,
          least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """Exact k nearest codes of every query: (query_id, neighbor_id, distance,
    rank), ranked by (distance, id). ``codes`` and ``queries`` have (id, code).
    A task holds at most about ``index_block`` distinct codes and
    ``query_block`` queries whatever the input."""
    each, of_code = W.partitionBy("code", "spread").orderBy("id"), W.partitionBy("code").orderBy("id")
    ids = codes.select("id", "code").distinct().withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(16)))
    for w in (each, of_code):  # the k + 1 smallest ids of a code; a hot code's rows are limited before they move
        ids = ids.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1).drop("rn")
    index = cut(ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = cut(queries.select("id", "code").distinct())
    n_index = max(least_blocks, -(-index.count() // index_block))
    n_query = max(1, -(-asked.count() // query_block))
    left = index.select("*", F.pmod(F.xxhash64("code"), F.lit(n_index)).alias("ib"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"))
    right = asked.select("id", "code", F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int").alias("qb"),
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_index - 1).cast("bigint"))).alias("ib"))
    tasks = n_index * n_query  # stated, or small inputs would be put back together in one task
    left, right = (x.repartition(tasks, "ib", "qb") for x in (left, right))
    found = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInPandas(
        _block_search(k, -(-bits // segment_bits), segment_bits), "query_id long, neighbor_id long, distance long")
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k)
    return (found.groupBy("query_id").agg(best.alias("best"))
            .select("query_id", F.posexplode("best").alias("i", "hit"))
            .select("query_id", F.col("hit.neighbor_id").alias("neighbor_id"),
                    F.col("hit.distance").alias("distance"), (F.col("i") + 1).alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    codes = binary_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(codes, codes.filter(F.col("id") % QUERY_STEP == 0))


SQL = f"""
WITH c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
           FROM embeddings WHERE len(embedding) > 0),
d AS (SELECT q.id AS query_id, c.id AS neighbor_id,
             {BITS} - list_sum(list_transform(list_zip(q.bits[1:{BITS}], c.bits[1:{BITS}]), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) AS distance
      FROM c q, c WHERE q.id % {QUERY_STEP} = 0 AND q.id <> c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, neighbor_id, distance::BIGINT AS distance, rank::INTEGER AS rank FROM r WHERE rank <= {K}"""
