"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.
In each chunk learned filters slide over byte embeddings and are max-pooled;
the chunks' pooled values are combined by mean and by maximum into one
probability:

    bytes -> embedding -> filters (width WIDTH, every STRIDE bytes) -> max over
    the chunk -> ReLU -> mean and max over the chunks -> logistic

Training (Adam, cross-entropy, derivatives written out below) runs on a
bounded sample of labelled rows: per class the ``TRAIN_PER_CLASS`` documents
with the smallest hash of their id, and of these, in that order, those that
together stay within ``TRAIN_BYTES``; every chunk of a sampled document is
learned. Classes are weighted back to their share among all labels. Scoring
reads every chunk of every document and is map-only.

Defined results: a null or empty text is one blank chunk and gets that chunk's
score; labels other than 0 and 1 and documents with conflicting labels are not
learned; of rows that share an id the text that sorts first is learned; a null
id is in the held-out fold, as the empty text's crc32 is 0; with no label at all every score is 0.5, with one class only that
class; repeated rows score alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmix.llm.common import id_bucket, regroup, stored, table

CHUNK, STEP = 512, 448
WIDTH, STRIDE = 8, 4
EMBED, FILTERS = 8, 32
BLANK = 256

TRAIN_PER_CLASS = 1200
TRAIN_BYTES = 64 << 20
#: Chunks whose windows are in memory at a time.
ROWS = 512
EPOCHS, BATCH, RATE = 6, 32, 4e-3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


def chunks(data: bytes) -> np.ndarray:
    """(n, CHUNK) byte values, every STEP bytes; BLANK fills the last chunk."""
    n = max(1, -(-(len(data) - CHUNK) // STEP) + 1)
    buf = np.full((n - 1) * STEP + CHUNK, BLANK, np.int16)
    buf[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, CHUNK)[::STEP]


class ByteCNN:
    """Parameters: embedding, filters, filter bias, output weights, output bias."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.p = [g.normal(0, 0.5, (257, EMBED)).astype(np.float32),
                  g.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
                  np.zeros(FILTERS, np.float32), g.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32)]
        self.p[0][BLANK] = 0

    def windows(self, x: np.ndarray) -> np.ndarray:
        """(chunks, positions, WIDTH * EMBED) embedded windows."""
        e = self.p[0][x]
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2)
                                    ).reshape(len(x), -1, WIDTH * EMBED)

    def pooled(self, x: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """Max-pooled filter values of chunks, ``rows`` chunks at a time."""
        out = []
        for i in range(0, len(x), rows):
            w = self.windows(x[i:i + rows])
            z = (w.reshape(-1, w.shape[2]) @ self.p[1]).reshape(w.shape[0], w.shape[1], FILTERS)
            out.append(z.max(axis=1) + self.p[2])
        return np.maximum(np.concatenate(out), 0)

    def combine(self, pooled: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability per document from its chunks' pooled values."""
        both = np.concatenate([np.add.reduceat(pooled, starts) / counts[:, None], np.maximum.reduceat(pooled, starts)], axis=1)
        return 1 / (1 + np.exp(-np.clip((both @ self.p[3] + self.p[4]).astype(np.float64), -40, 40)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        parts = [chunks((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        counts = np.array([len(c) for c in parts])
        starts = np.cumsum(counts) - counts
        return self.combine(np.concatenate([self.pooled(c) for c in self._groups(parts)]), starts, counts)

    @staticmethod
    def _groups(parts: list[np.ndarray], rows: int = ROWS):
        """Short documents' chunks put together, so that products are large."""
        held, n = [], 0
        for c in parts:
            held.append(c)
            n += len(c)
            if n >= rows:
                yield np.concatenate(held)
                held, n = [], 0
        if held:
            yield np.concatenate(held)

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Derivatives of the weighted mean cross-entropy of one batch."""
        x = np.concatenate(docs)
        counts = np.array([len(d) for d in docs])
        starts = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(docs)), counts)
        best = [z.argmax(axis=1) for z in (self.windows(x[i:i + ROWS]) @ self.p[1] for i in range(0, len(x), ROWS))]
        # byte values of each filter's best window, (chunks, filters, WIDTH)
        seen = x[np.arange(len(x))[:, None, None], np.concatenate(best)[:, :, None] * STRIDE + np.arange(WIDTH)]
        parts = [slice(i, i + ROWS) for i in range(0, len(x), ROWS)]
        kernels = self.p[1].T.reshape(FILTERS, WIDTH, EMBED)
        m = np.concatenate([np.einsum("nfwe,fwe->nf", self.p[0][seen[i]], kernels) for i in parts]) + self.p[2]
        h = np.maximum(m, 0)
        mean, peak = np.add.reduceat(h, starts) / counts[:, None], np.maximum.reduceat(h, starts)
        both = np.concatenate([mean, peak], axis=1)
        prob = 1 / (1 + np.exp(-np.clip(both @ self.p[3] + self.p[4], -40, 40)))
        d_logit = ((prob - y) * weight / weight.sum()).astype(np.float32)
        d_both = d_logit[:, None] * self.p[3]
        at_peak = h == peak[doc]
        shared = np.add.reduceat(at_peak.astype(np.float32), starts)[doc]
        d_h = d_both[doc, :FILTERS] / counts[doc][:, None] + at_peak * d_both[doc, FILTERS:] / shared
        d_m = (d_h * (m > 0)).astype(np.float32)
        d_filters, d_embed = np.zeros_like(self.p[1]), np.zeros_like(self.p[0])
        for i in parts:
            d_filters += np.einsum("nf,nfwe->wef", d_m[i], self.p[0][seen[i]]).reshape(d_filters.shape)
            np.add.at(d_embed, seen[i], d_m[i][:, :, None, None] * kernels[None])
        d_embed[BLANK] = 0
        return [d_embed, d_filters, d_m.sum(axis=0), both.T @ d_logit, np.array([d_logit.sum()], np.float32)]

    def fit(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteCNN:
        g = np.random.default_rng(seed)
        m1, m2, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(epochs):
            order = g.permutation(len(docs))
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for i in range(0, len(order), BATCH):
                own, step = order[i:i + BATCH], step + 1
                for k, d in enumerate(self.gradients([docs[j] for j in own], y[own], weight[own])):
                    m1[k] += 0.1 * (d - m1[k])
                    m2[k] += 0.001 * (d * d - m2[k])
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, seed: int = 7) -> ByteCNN | float:
    """A network learned from (doc_id, text) and (doc_id, label); a plain
    number when the labels hold fewer than two classes. At most
    2 * per_class texts of TRAIN_BYTES a class reach the driver."""
    known = (labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("y"), F.max("label").alias("z"))
             .filter("y = z").select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("h")))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return float(next(iter(share))) if share else 0.5
    picked = [(r["doc_id"], r["y"]) for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class).collect()]
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, y int"))  # 2 * per_class rows
    sample = stored(docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "quality")
    size = {r["doc_id"]: r["n"] for r in sample.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()}
    own, used = [], {0: 0, 1: 0}
    for i, c in picked:  # in the order of the hash
        if i in size and used[c] + size[i] <= TRAIN_BYTES:
            own.append((i,))
            used[c] += size[i]
    rows = (sample.join(F.broadcast(spark.createDataFrame(own, "doc_id long")), "doc_id")
            .select("y", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")).collect())
    rows.sort(key=lambda r: (r["y"], bytes(r["data"])))  # the order of training doesn't hang on the order of tasks
    if len({r["y"] for r in rows}) < 2:
        return float(rows[0]["y"]) if rows else 0.5
    y = np.array([r["y"] for r in rows], np.float32)
    x = [chunks(bytes(r["data"])) for r in rows]
    # each class weighs what its share among all labels says
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum())).astype(np.float32)
    return ByteCNN(seed).fit(x, y, weight / weight.mean())


def score(docs: DataFrame, model: ByteCNN | float, out: str = "quality_score") -> DataFrame:
    """``docs`` columns and the score as ``out``; map-only over whole texts."""
    docs = docs.drop(out)
    if isinstance(model, float):
        return docs.withColumn(out, F.lit(model))

    def run(batches):
        for batch in regroup(batches):
            if batch.num_rows:
                got = model.score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())],
                                                 names=[*batch.schema.names, out])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> ByteCNN | float:
    """The network learned from the rows outside the held-out fold."""
    own = id_bucket("doc_id", FOLDS) != HELD_OUT
    return train(docs.filter(own), labels.filter(own).select("doc_id", F.col(label_col).alias("label")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"),
                      F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier doesn't reject."""
    cols = docs.columns
    got = score(docs, learn(docs, table(spark, sf_dir, "labels")), "__quality")
    return got.filter(F.col("__quality") >= THRESHOLD).select(*cols)
