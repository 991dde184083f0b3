"""SimHash near-duplicate detection with bit-sliced comparison.

A document's fingerprint has bit i set when more than half of its word-shingle
hashes (XXH64, seed 42) have it set. Equal fingerprints are one vertex from the
start. Of 64 bits in four blocks, two fingerprints within two bits agree on at
least two blocks, so they meet in one of six buckets (a pair of blocks each).
In a bucket 64 fingerprints at a time are stored as bit planes: word j holds
bit j of all 64. One fingerprint meets a block by adding, plane by plane, the
bits that differ into carry-save counters; a block is abandoned once all its
counters exceed the radius. A bucket gives each of its fingerprints one link
to the smallest that it reaches there, never all pairs, and the links of all
buckets are joined into components.

A bucket of more than ``BUCKET`` fingerprints is dealt out once more by each
third of its other 32 bits, which two within two bits also share in one place;
fingerprints are distinct, so the parts are bounded whatever the input.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; rows that repeat an id are linked like other rows; the
component id is null only when all its ids are; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.llm.common import cut, regroup, table
from weftmix.llm.components import connected

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCK_BITS = 16
BUCKET = 1 << 14
#: (fingerprint, block) meetings held at a time.
MEETINGS = 1 << 18
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text; A-Z count as a-z, white space is
    ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    end = list(accumulate(len(w) + 1 for w in words))
    start = [0, *end[:-1]]
    spans = zip(start, end[size - 1:], strict=False) if len(words) >= size else [(0, end[-1])]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(line[a:b - 1], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), 1 << 14):
        ones += np.unpackbits(raw[i:i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, keys, fp): fp holds the fingerprint's bits as a signed long;
    ``keys`` are columns of longs that are carried along."""
    names = ["doc_id", *keys, "fp"]

    def run(batches):
        for batch in regroup(batches):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array(fp.view(np.int64))], names=names)
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keys, "text")
            .mapInArrow(run, ", ".join(f"{c} long" for c in names)))


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(blocks, 64): word j of a block has bit j of its up to 64 fingerprints."""
    n = -(-len(fp) // 64)
    full = np.zeros(n * 64, np.uint64)
    full[:len(fp)] = fp
    bits = np.unpackbits(full.view(np.uint8).reshape(n, 64, 8), axis=2, bitorder="little")  # block, member, bit
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64).reshape(n, 64)


def meet(fp: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row i's fingerprint meets block i: (rows, words) of those with a member
    within ``radius``; bit t of a word stands for the block's member t."""
    bits = (radius + 1).bit_length()
    at = np.arange(len(fp))
    count = [np.zeros(len(fp), np.uint64) for _ in range(bits)]
    over = ~valid
    for j in range(64):
        # members whose bit j differs
        carry = planes[at, j] ^ np.where((fp[at] >> np.uint64(j)) & np.uint64(1), ALL, np.uint64(0))
        for k in range(bits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        equal = ALL  # counters that now stand at radius + 1 stay over
        for k in range(bits):
            equal = equal & (count[k] if (radius + 1) >> k & 1 else ~count[k])
        over = over | equal | carry
        if j % 4 == 3:
            alive = over != ALL
            if not alive.all():
                at, over, count = at[alive], over[alive], [c[alive] for c in count]
    return at, ~over


def bucket_roots(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by bucket, the index of the smallest row of the same
    bucket that each reaches through links inside the bucket."""
    n = len(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, n))
    blocks = -(-size // 64)
    # blocks of 64 never mix buckets: rows move to slots that start each bucket anew
    block_of = np.cumsum(blocks) - blocks
    bucket = np.repeat(np.arange(len(first)), size)
    slot = block_of[bucket] * 64 + np.arange(n) - first[bucket]
    total = int(blocks.sum())
    laid, used, row_of = np.zeros(total * 64, np.uint64), np.zeros(total * 64, np.uint8), np.zeros(total * 64, np.int64)
    laid[slot], used[slot], row_of[slot] = fp, 1, np.arange(n)
    planes = bit_planes(laid)
    valid = np.packbits(used.reshape(total, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    root = np.arange(n)
    rows = np.flatnonzero(size[bucket] > 1)
    # meetings of each row with its own block and those before it in the bucket
    n_meet = (slot[rows] // 64 - block_of[bucket[rows]] + 1) if len(rows) else np.empty(0, np.int64)
    upto = np.cumsum(n_meet)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS, "right")))
        own, m = rows[at:stop], n_meet[at:stop]
        r = np.repeat(own, m)
        b = np.repeat(block_of[bucket[own]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        hit, word = meet(fp[r], planes[b], valid[b], radius)
        i, t = np.nonzero((word[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
        _join(root, r[hit][i], row_of[b[hit][i] * 64 + t])
        at = stop
    return _flat(root)


def _flat(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := root[root], root):
        root = up
    return root


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite rows a[i] and b[i] in ``root`` (each points to a smaller row or itself)."""
    while len(a):
        root[:] = _flat(root)
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def _bucket_links(batches):
    """(a, b) links from rows (key, fp) sorted by key; a bucket never ends with
    a batch, so the last one waits for the next batch."""
    held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(key, fp):
        root = bucket_roots(key, fp)
        a, b = fp.view(np.int64), fp[root].view(np.int64)
        own = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own])], names=["a", "b"])
    for batch in batches:
        key = np.concatenate([held_key, batch.column("key").to_numpy()])
        fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield links(key[:last], fp[:last])
        held_key, held_fp = key[last:], fp[last:]
    if len(held_key):
        yield links(held_key, held_fp)


def links(reps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints ``reps`` (fp) within two bits:
    at least a spanning forest of every bucket."""
    spark = reps.sparkSession
    part = [F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = list(combinations(range(4), 2))

    def key_and_rest(n, i, j):
        k, m = (x for x in range(4) if x not in (i, j))
        return F.struct((F.lit(n).cast("bigint") * (1 << 32) + part[i] * (1 << 16) + part[j]).alias("key"),
                        (part[k] * (1 << 16) + part[m]).alias("rest"))
    rows = reps.select("fp", F.explode(F.array(*[key_and_rest(n, i, j) for n, (i, j) in enumerate(pairs)])).alias("x")).select("fp", "x.*")
    full = cut(rows.groupBy("key").count().filter(F.col("count") > bucket).select(F.col("key").alias("full_key")))
    rows = rows.join(full, rows["key"] == full["full_key"], "left")
    thirds = [F.xxhash64("key", F.lit(s), F.shiftright("rest", a).bitwiseAND((1 << w) - 1)) for s, (a, w) in enumerate(((0, 11), (11, 11), (22, 10)))]
    rows = rows.select("fp", F.explode(F.when(F.col("full_key").isNull(), F.array("key")).otherwise(F.array(*thirds))).alias("key"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return cut(rows.repartition(n, "key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(_bucket_links, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text)."""
    own = cut(fingerprints(docs))
    reps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected(links(reps.select("fp"), bucket))
    found = found.union(found.select(F.col("root").alias("vertex"), "root").distinct())
    ids = cut(found.join(reps, found["vertex"] == reps["fp"]).select("vertex", "root", "first_id"))
    least = cut(ids.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id")))
    grouped = ids.join(least, ids["root"] == least["r"]).select("vertex", "component_id")
    whole = cut(reps.join(grouped, reps["fp"] == grouped["vertex"], "left")
                .select(F.col("fp").alias("f"), F.coalesce("component_id", "first_id").alias("component_id")))
    return own.join(whole, own["fp"] == whole["f"]).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """(kept_id, kept_hash): id and text hash of one row of each near-duplicate
    group, the one with the smallest id (null last), then the smallest hash."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = cut(fingerprints(rows, "th").groupBy("fp").agg(F.min(order).alias("first")))
    found = connected(links(first.select("fp")))
    least = (first.join(found, first["fp"] == found["vertex"], "left")
             .groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("first").alias("first")))
    return least.select(F.col("first.doc_id").alias("kept_id"), F.col("first.th").alias("kept_hash"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest id. A row is
    its id and its text: texts that share an id or have none stand each on
    their own, and only rows equal in both are one."""
    stay = survivors(docs)
    own = docs["doc_id"].eqNullSafe(stay["kept_id"]) & (F.xxhash64(docs["text"]) == stay["kept_hash"])
    return docs.join(stay, own, "left_semi").dropDuplicates(["doc_id", "text"])
