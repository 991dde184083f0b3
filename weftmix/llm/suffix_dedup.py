"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Every byte position with ``length`` bytes ahead of it starts a suffix; the
suffixes are ordered by their first ``length`` bytes only, digit by digit,
most significant digit first, and a group that holds one suffix leaves the
sort. The groups still equal at depth ``length`` are exactly the repeated
windows; the bytes that they cover are removed everywhere.

Digits are 128-bit hashes of byte ranges (the first: 64-bit), and neighbouring suffixes travel together:

1. First digit: a block of ``ANCHOR`` bytes. Of the blocks inside a window the
   one with the smallest hash stands for it, so equal windows have equal
   blocks at equal places, and a run of neighbouring windows with the same
   block (a family) is one entry. Blocks that occur once leave.
2. Second digit: the whole stretch of bytes that a family's windows cover.
   Families with an equal stretch are repeated as a whole.
3. The others, and one of each set of equal families as a partner, go through
   passes. A pass halves the windows of every entry by the place of the block;
   each half is one entry again and its digit is all bytes that its windows
   share. Entries that are equal as a whole are repeated as a whole; one of them
   goes on as a partner where an unresolved entry has the same digit. The last
   digit is a single window. Equal entries become one counted row before they
   meet others, so a passage that many documents share is no hot group, and no
   group is gathered; groups of any size take the same passes.

Defined results: a null or empty text, or one shorter than ``length`` bytes,
is kept as it is; a document that overlaps a copy of itself loses both; rows
that repeat a document count as two documents; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmix.llm.common import cut, regroup, table

LENGTH = 200
ANCHOR = 64
#: Stretches that a task handles at a time.
STRETCHES = 2048
LOW = np.uint64(0xFFFFFFFF)
#: Odd multipliers, one for each doubling of a block's length.
ODD = np.random.default_rng(20).integers(1 << 60, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)


def block_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size``-byte block, by doubling."""
    h, m, i = BYTE[data], 1, 0

    def joined(left, right, c):
        x = left * c
        x ^= x >> np.uint64(32)
        x += right
        return x
    while 2 * m <= size:
        h, m, i = joined(h[:-m], h[m:], ODD[i]), 2 * m, i + 1
    if size > m:
        h = joined(h[:len(h) - (size - m)], h[size - m:], ODD[i])
    h = h * ODD[15]
    return h ^ (h >> np.uint64(31))


def families(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(block start, block hash, first window, last window) of a document's
    families, in order; they tile its windows."""
    if len(data) < length:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    h = block_hashes(data, anchor)
    # smallest hash first, among equals the last place, within each window
    low, m, width = (h & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64)), 1, length - anchor + 1
    while 2 * m <= width:
        low, m = np.minimum(low[:-m], low[m:]), 2 * m
    if width > m:
        low = np.minimum(low[:len(low) - (width - m)], low[width - m:])
    p = (LOW - (low & LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    return p[first], h[p[first]], first, np.append(first[1:], len(p)) - 1


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _blocks(with_id: bool):
    """(h) or (doc_id, th, h): the distinct blocks of each document; a block that a
    document has more than once comes twice where only hashes are asked."""
    def run(batches):
        for batch in regroup(batches):
            hs, ids = [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                h = families(_bytes(t))[1]
                u, n = np.unique(h, return_counts=True)
                hs.append(u if with_id else np.concatenate([u, u[n > 1]]))
                ids.append(np.full(len(hs[-1]), k))
            h = pa.array(np.concatenate(hs).view(np.int64)) if hs else pa.array([], pa.int64())
            if with_id:
                at = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), h], names=["doc_id", "th", "h"])
            else:
                yield pa.RecordBatch.from_arrays([h], names=["h"])
    return run


_PER_DOC = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
                      ("o", pa.list_(pa.int64())), ("h", pa.list_(pa.int64())), ("fk", pa.list_(pa.binary())), ("at", pa.list_(pa.int64())),
                      ("blob", pa.binary())])
PER_DOC = ("doc_id long, th long, a array<long>, n array<long>, o array<long>, h array<long>, fk array<binary>, at array<long>, "
           "blob binary")


def _per_document(length: int):
    """Families whose block repeats: first window a, number of windows n, place
    o of the block in window a, block hash h, hash fk of the whole stretch, and
    the stretches' bytes, each byte once, compressed."""
    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in regroup(batches):
            rows = []
            for doc_id, th, text, hs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "hs")), strict=True):
                data = _bytes(text)
                p, h, a, z = families(data, length)
                own = np.isin(h, np.array(hs, np.int64).view(np.uint64))
                p, h, a, z = p[own], h[own], a[own], z[own]
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, z + length, -1)
                used = np.cumsum(edge[:-1]) > 0
                place, raw = np.cumsum(used) - 1, data.tobytes()
                fk = [xxhash.xxh3_128_digest(raw[i:j + length] + (k - i).to_bytes(2, "little"))
                      for i, j, k in zip(a.tolist(), z.tolist(), p.tolist(), strict=True)]
                rows.append({"doc_id": doc_id, "th": th, "a": a, "n": z - a + 1, "o": p - a, "h": h.view(np.int64), "fk": fk,
                             "at": place[a], "blob": zip_.compress(data[used].tobytes())})
            yield pa.RecordBatch.from_pylist(rows, _PER_DOC)
    return run


#: An entry of a pass: the first window a of a stretch in its document, the
#: number of windows n, the block's place o in the first of them, whether it is
#: still unresolved, and the stretch. lo and hi bound the block's place in its
#: windows; key hashes the bytes that all windows with these bounds share, and
#: whole the stretch.
_ROW = pa.schema([("key", pa.binary()), ("whole", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()),
                  ("a", pa.int64()), ("n", pa.int32()), ("o", pa.int32()), ("open", pa.int32()), ("stretch", pa.binary())])
ROW = "key binary, whole binary, lo int, hi int, doc_id long, th long, a long, n int, o int, open int, stretch binary"


def _entry(length: int, lo: int, hi: int, o: int, stretch: bytes) -> dict:
    place = lo.to_bytes(4, "little") + hi.to_bytes(4, "little")
    return {"key": xxhash.xxh3_128_digest(place + stretch[o - lo:o + length - hi]),
            "whole": xxhash.xxh3_128_digest(place + o.to_bytes(4, "little") + stretch), "lo": lo, "hi": hi, "o": o, "stretch": stretch}


def _unpack(length: int, anchor: int):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in regroup(batches, by="blob"):
            rows = []
            for r in batch.to_pylist():
                blob = unzip.decompress(r["blob"])
                for x in r["picked"]:
                    i = x["i"]
                    at, n = r["at"][i], r["n"][i]
                    rows.append({"doc_id": r["doc_id"], "th": r["th"], "a": r["a"][i], "n": n, "open": x["open"]}
                                | _entry(length, 0, length - anchor, r["o"][i], blob[at:at + n + length - 1]))
            yield pa.RecordBatch.from_pylist(rows, _ROW)
    return run


def _halve(length: int):
    """Each entry's windows, halved by the block's place."""
    def run(batches):
        for batch in regroup(batches, STRETCHES, by="stretch"):
            rows = []
            for r in batch.to_pylist():
                mid, s, o = (r["lo"] + r["hi"]) // 2, r["stretch"], r["o"]
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    # window a + t has the block at o - t
                    t0, t1 = max(0, o - hi), min(r["n"] - 1, o - lo)
                    if lo <= hi and t0 <= t1:
                        rows.append({"doc_id": r["doc_id"], "th": r["th"], "a": r["a"] + t0, "n": t1 - t0 + 1, "open": r["open"]}
                                    | _entry(length, lo, hi, o - t0, s[t0:t1 + length]))
            yield pa.RecordBatch.from_pylist(rows, _ROW)
    return run


def _release(spark: SparkSession) -> None:
    """Finished steps' shuffle files go when the driver collects its garbage,
    which on its own it may not do before the next step needs the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _sorted_out(rows: DataFrame, length: int) -> DataFrame | None:
    """Spans of the open entries of ``rows`` whose windows occur elsewhere, by
    one pass a digit; the same passes whatever a group's size."""
    spans = None
    while True:
        # a group goes on while it holds two different stretches and one is open
        groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("entries"), F.max("open").alias("any_open"))
        groups = groups.filter("entries > 1 and any_open = 1").select(F.col("key").alias("k"))
        halves = cut(rows.join(groups, rows["key"] == groups["k"], "left_semi").mapInArrow(_halve(length), ROW))
        if halves.isEmpty():
            return spans
        # entries that are equal as a whole: all are repeated, and one stands for them
        same = ["key", "lo", "hi", "n", "o", "stretch"]
        distinct = cut(halves.groupBy("whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th", "a")).alias("one"),
                                                   F.max("open").alias("open"), *(F.first(c).alias(c) for c in same)))
        known = distinct.filter("copies > 1 and open = 1").select(F.col("whole").alias("w"))
        found = cut(halves.filter("open = 1").join(known, halves["whole"] == known["w"], "left_semi")
                    .select("doc_id", "th", F.col("a").alias("first"), (F.col("a") + F.col("n") - 1).alias("last")))
        spans = found if spans is None else spans.union(found)
        rows = distinct.select("key", "whole", "lo", "hi", "one.*", "n", "o", F.when(F.col("copies") == 1, F.col("open")).otherwise(0).alias("open"), "stretch")
        # what this pass has written goes before the next one writes
        del groups, halves, known, found
        _release(rows.sparkSession)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, th, spans): per document with any, the runs (first, last) of its
    repeated windows; th is the hash of its text. ``docs`` has (doc_id, text)."""
    spark = docs.sparkSession
    # the text's hash goes with the id, so that rows without an id, or with one
    # id for many texts, are no hot key
    docs = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .select("doc_id", F.xxhash64("text").alias("th"), "text"))
    twice = cut(docs.select("text").mapInArrow(_blocks(False), "h long").groupBy("h").count().filter("count > 1")
                .select(F.col("h").alias("twice")))
    _release(spark)
    own = docs.mapInArrow(_blocks(True), "doc_id long, th long, h long")
    blocks = cut(own.join(twice, own["h"] == twice["twice"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set("h").alias("hs"))
                 .select(F.col("doc_id").alias("id"), F.col("th").alias("t"), "hs"))
    _release(spark)
    per = cut(docs.join(blocks, docs["doc_id"].eqNullSafe(blocks["id"]) & (docs["th"] == blocks["t"]))
              .select("doc_id", "th", "text", "hs").mapInArrow(_per_document(length), PER_DOC))
    _release(spark)

    entry = per.select("doc_id", "th", F.posexplode(F.arrays_zip("a", "n", "h", "fk")).alias("i", "x")).select(
        "doc_id", "th", "i", "x.a", "x.n", "x.h", "x.fk")
    stretches = cut(entry.groupBy("fk").agg(F.count(F.lit(1)).alias("copies"), F.min("h").alias("h"),
                                            F.min(F.struct("doc_id", "th", "i")).alias("one")))
    groups = stretches.groupBy("h").agg(F.count(F.lit(1)).alias("entries"), F.min("copies").alias("least"))
    groups = cut(groups.filter("entries > 1 and least = 1").select(F.col("h").alias("g")))
    picked = (stretches.join(groups, stretches["h"] == groups["g"]).select("one.*", (F.col("copies") == 1).cast("int").alias("open"))
              .groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("i", "open")).alias("picked")))
    once = per.join(picked, per["doc_id"].eqNullSafe(picked["d"]) & (per["th"] == picked["t"]))
    once = cut(once.select("doc_id", "th", "a", "n", "o", "h", "at", "blob", "picked").mapInArrow(_unpack(length, anchor), ROW))
    del groups, picked, twice, blocks
    _release(spark)
    entries, once = [once], None  # handed over, so that it can be released after the first pass
    parts = _sorted_out(entries.pop(), length)

    known = stretches.filter("copies > 1").select(F.col("fk").alias("known"))
    full = entry.join(known, entry["fk"] == known["known"], "left_semi").select(
        "doc_id", "th", F.col("a").alias("first"), (F.col("a") + F.col("n") - 1).alias("last"))
    out = cut((full if parts is None else full.union(parts)).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    _release(spark)
    return out


def remove_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """(kept bytes, maximal removed runs as (start, end)) of one document."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return data[~gone].tobytes(), list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, as_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and any others) with what was removed:
    removed_spans array of (start, end) byte positions, kept binary, n_bytes,
    and kept_text, when asked for, without characters that a cut split. These
    four replace columns of the same names."""
    found = repeated_spans(docs, length, anchor).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found["__id"]) & (th == found["__th"]), "left").drop("__id", "__th")
    extra = ["removed_spans", "kept", "n_bytes", "kept_text"]
    fields = [f for f in docs.schema.fields if f.name not in extra]
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, *(T.StructField(c, t) for c, t in zip(extra, (kind, T.BinaryType(), T.LongType(), T.StringType()), strict=True))])
    names = [f.name for f in fields]

    def run(batches):
        for batch in regroup(batches):
            runs, kept, size = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                data = _bytes(text)
                first, last = (np.array([s[c] for s in spans or []], np.int64) for c in ("first", "last"))
                k, gone = remove_spans(data, first, last, length)
                kept.append(k)
                runs.append([{"start": a, "end": b} for a, b in gone])
                size.append(len(data))
            plain = [k.decode("utf-8", "ignore") if as_text else None for k in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                              pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(plain, pa.string())],
                                             names=[*names, *extra])
    return joined.select(*names, "__spans").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                      F.size("removed_spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the texts without their repeated passages; characters
    cut in two go, n_chars follows the text, a null text stays null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    got = dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("__rest")), as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))

    def column(c):
        if c == "n_chars":
            return F.length(text).cast(docs.schema[c].dataType).alias(c)
        return F.col("doc_id") if c == "doc_id" else text.alias(c) if c == "text" else F.col(f"__rest.{c}")
    return got.select(*[column(c) for c in docs.columns])
