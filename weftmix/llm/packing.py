"""Sequence packing by order-preserving dynamic programming.

Documents are tokenised in the order in which a task reads them and laid end
to end; each batch of documents is then cut into windows of at most ``length``
tokens. Cut points are document ends (free), sentence ends (a token whose text
ends in a stop or holds a line break; ``SENTENCE_CUT``) and, where a sentence
is longer than ``STRIDE`` tokens and in the last window, plain token positions
(``HARD_CUT``). Over these points

    best[j] = cut(j) + min over i of best[i] + padding(end[j] - end[i])

where padding(n) is ``length - n``, or nothing when n is a power of two.
best[i] + end[i] does not depend on j, so the first case is a sliding-window
minimum kept in a monotone queue, and the second looks up at most one point
per power of two. Each document keeps its order and its ids stay together
save for the cuts; every id lies in exactly one piece.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each on their own; a text of any length is cut as often as needed; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from weftmix.llm.common import regroup, table

LENGTH = 2048
END_ID = 1
SENTENCE_CUT = 2
HARD_CUT = 8
STRIDE = 256
#: Documents and bytes of text packed together; a longer text is packed alone.
BATCH_DOCS, BATCH_BYTES = 512, 64 << 20

#: A run of white space before a word leaves its last blank to the word. Where
#: no two blanks stand together both patterns split alike, and the second is
#: quicker as it needs no look-ahead.
TWO_BLANKS = re.compile(r"\s\s")
LOOK_AHEAD = r"|\s+(?!\S)"


@functools.cache
def tokenizer(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """(encode, is_end) of a byte-level BPE vocabulary file of ranks; a string
    of ``special`` in a text is its one id, and the text around it stands in
    parts of its own."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    plain = tiktoken.Encoding("plain", pat_str=pattern.replace(LOOK_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    marked = tiktoken.Encoding("marked", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    marks = [mark for mark, _ in special]

    def encode(text: str) -> list[int]:
        if any(mark in text for mark in marks):
            return marked.encode(text, allowed_special="all")
        return (whole if TWO_BLANKS.search(text) else plain).encode_ordinary(text)
    is_end = np.zeros(max([*ranks.values(), *(i for _, i in special)]) + 1, bool)
    for token, i in ranks.items():
        is_end[i] = token.rstrip(b"\"')").endswith((b".", b"!", b"?")) or b"\n" in token
    return encode, is_end


def public_vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """(path of the ranks, split pattern, special strings and their ids) of the
    installed public tokenizer ``name``.json, whose ranks form encodes fastest."""
    import public_tokenizers
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, tuple((x["content"], x["id"]) for x in added)


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, cost of a cut there) for a batch: 0, document and sentence
    ends, and plain positions inside long stretches and in the last window."""
    total = int(doc_ends[-1])
    soft = np.unique(np.concatenate(([0], doc_ends, sentence_ends)))
    gap = np.diff(soft)
    inner = [np.arange(a + stride, a + g, stride) for a, g in zip(soft[:-1][gap > stride], gap[gap > stride], strict=True)]
    near = soft[(soft > total - length) & (soft < total)]
    left = total - near  # the tail may end in windows of powers of two
    for k in range(length.bit_length() - 1, -1, -1):
        take = left >= (1 << k)
        left = np.where(take, left - (1 << k), left)
        inner.append(total - left[take])
    points = np.unique(np.concatenate([soft, *inner]))
    cost = np.full(len(points), HARD_CUT)
    cost[np.searchsorted(points, soft)] = SENTENCE_CUT
    cost[np.searchsorted(points, np.concatenate(([0], doc_ends)))] = 0
    return points, cost


def cut_windows(points: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """The chosen window ends, from the dynamic program of the module's text."""
    exact: list[list[int]] = [[] for _ in points]
    for k in range(length.bit_length()):
        at = np.searchsorted(points, points - (1 << k))
        for j in np.flatnonzero((at < len(points)) & (points[np.minimum(at, len(points) - 1)] == points - (1 << k))):
            exact[j].append(int(at[j]))
    end, price = points.tolist(), cost.tolist()
    best, back = [0] * len(end), [0] * len(end)
    queue: deque[int] = deque()
    for j in range(1, len(end)):
        i = j - 1
        v = best[i] + end[i]
        while queue and best[queue[-1]] + end[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
        e = end[j]
        while end[queue[0]] < e - length:
            queue.popleft()
        i = queue[0]
        low = best[i] + length - (e - end[i])
        for x in exact[j]:
            if best[x] < low:
                low, i = best[x], x
        best[j], back[j] = low + price[j], i
    ends, j = [], len(end) - 1
    while j:
        ends.append(end[j])
        j = back[j]
    return ends[::-1]


def pack_batch(ids: list[np.ndarray], is_end: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Pieces of one batch: doc (index), start, length, sequence (index), offset, at (in the batch)."""
    size = np.array([len(x) for x in ids])
    doc_end = np.cumsum(size)
    doc_start = doc_end - size
    flat = np.concatenate(ids)
    points, cost = cut_points(doc_end, np.flatnonzero(is_end[flat]) + 1, length, STRIDE)
    window_end = np.array(cut_windows(points, cost, length))
    window_start = np.concatenate(([0], window_end[:-1]))
    at = np.union1d(doc_start, window_start)
    doc = np.searchsorted(doc_start, at, "right") - 1
    seq = np.searchsorted(window_start, at, "right") - 1
    return {"doc": doc, "start": at - doc_start[doc], "length": np.diff(np.append(at, doc_end[-1])), "sequence": seq,
            "offset": at - window_start[seq], "at": at, "flat": flat, "doc_tokens": size[doc]}


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids array<int>")


def _pack(vocabulary: tuple, length: int, end_id: int, with_ids: bool):
    def run(batches):
        encode, is_end = tokenizer(*vocabulary)
        # a task's sequences are numbered from its partition's own range
        first = TaskContext.get().partitionId() << 32
        for batch in regroup(batches, BATCH_DOCS, BATCH_BYTES):
            ids = [np.array([*encode(t), end_id], np.uint32) if t else np.array([end_id], np.uint32)
                   for t in batch.column("text").to_pylist()]
            p = pack_batch(ids, is_end, length)
            raw = p["flat"].astype("<u4")
            spans = list(zip(p["at"].tolist(), (p["at"] + p["length"]).tolist(), strict=True))
            doc_id = batch.column("doc_id").take(pa.array(p["doc"]))
            yield pa.RecordBatch.from_arrays([
                doc_id, *[pa.array(p[c], pa.int64()) for c in ("start", "length")],
                pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                pa.array(p["doc_tokens"], pa.int64()), pa.array(first + p["sequence"], pa.int64()), pa.array(p["offset"], pa.int64()),
                pa.array([raw[a:b].astype(np.int32) if with_ids else None for a, b in spans], pa.list_(pa.int32()))],
                names=[x.split()[0] for x in SCHEMA.split(", ")])
            first += int(p["sequence"][-1]) + 1
    return run


def pack(docs: DataFrame, vocabulary: tuple | None = None, length: int = LENGTH,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece, with its token ids unless ``with_ids`` is false:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.
    Map-only: nothing is shuffled, and a lost task is run again alone."""
    return (docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(text, '') as text")
            .mapInArrow(_pack(vocabulary or public_vocabulary(), length, end_id, with_ids), SCHEMA))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
