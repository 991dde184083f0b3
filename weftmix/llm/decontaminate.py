"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is a short set of word shingles (five words), a document a long
one. Items are partitioned by set size; an item's signature is its ``m``
smallest shingle hashes, with m = (1 - threshold) * (upper size of its
partition) + 1, at most its whole set. An item of n shingles that a document
holds to at least the threshold misses at most (1 - threshold) * n of them, so
at least m minus that many signature hashes are found in the document however
long it is: the search loses nothing. Candidates are then verified by exact
shingle containment.

All work is built-in expressions: shingles are hashed and met with the
signatures inside one generated stage. The signatures are a written table, so
Spark knows their bytes and broadcasts them up to
``spark.sql.autoBroadcastJoinThreshold``; beyond it both sides are shuffled.

What a text holds hangs on the text alone, so a 128-bit hash of it is the key
of a row and of an item: rows that share an id, or have none, are judged each
by their own text, and copies of a text are judged once.

Defined results: null or empty texts and items without a word match nothing;
an item of fewer words than a shingle is one shingle of its own length;
repeated words, shingles and rows count once; where several rows of a doc_id
and several items of an item_id match, the pair of ids is one row with the
greatest containment, then n_shared, then n_item; null ids are ids like any
other; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.llm.common import cut, stored, table

SHINGLE = 5
THRESHOLD = 0.8
BETWEEN = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingles(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, h): the hash of every ``size``-word shingle of ``df`` (key, w)."""
    places = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size))
    return (df.select(key, "w", F.explode(places).alias("i"))
            .select(key, F.xxhash64(F.lit(size), *[F.get("w", F.col("i") + j) for j in range(size)]).alias("h")))


def text_key(text: Column) -> Column:
    """128 bits of hash that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def item_shingles(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item, size, h, n): distinct shingles of each item text and their number."""
    w = cut(items.select(text_key(F.col("text")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
            .withColumn("size", F.least(F.size("w"), F.lit(size))))
    parts = None
    for k in sorted(r["size"] for r in w.select("size").distinct().collect()):  # at most ``size`` values
        part = shingles(w.filter(F.col("size") == k), "item", k).withColumn("size", F.lit(k))
        parts = part if parts is None else parts.union(part)
    if parts is None:
        return w.select("item", "size", F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("n"))
    sets = cut(parts.groupBy("item").agg(F.collect_set(F.struct("h", "size")).alias("s")))
    return stored(sets.select("item", F.size("s").alias("n"), F.explode("s").alias("x")).select("item", "x.size", "x.h", "n"), "items")


def signatures(own: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(h, item, need): the smallest hashes of each item and how many of
    them a document must hold to be a candidate."""
    upper = F.pow(2, F.ceil(F.log2(F.col("n"))))  # items of (upper / 2, upper] shingles are one partition
    sets = own.groupBy("item", "n").agg(F.array_sort(F.collect_list("h")).alias("s"))
    m = F.least(F.col("n"), (F.floor(upper * (1 - threshold) + 1e-9) + 1).cast("int"))
    missed = F.floor(F.col("n") * (1 - threshold) + 1e-9)
    return (sets.select("item", F.explode(F.slice("s", 1, m)).alias("h"), (m - missed).alias("need"))
            .select("h", "item", "need"))


def matches(texts: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc, item, n_item, n_shared, containment) of the distinct texts of two
    tables with a column ``text``; doc and item are the texts' keys."""
    own = item_shingles(items, size)
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect()) or [size]
    signed = stored(signatures(own, threshold), "signatures")
    by_key = texts.select(text_key(F.col("text")).alias("doc"), words(F.col("text")).alias("w"))

    def all_shingles(df):
        out = shingles(df, "doc", sizes[0])
        for k in sizes[1:]:
            out = out.union(shingles(df, "doc", k))
        return out
    hits = all_shingles(by_key).join(signed, "h").select("doc", "item", "need", "h").distinct()
    found = stored(hits.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("hits"), F.max("need").alias("need"))
                   .filter("hits >= need").select("doc", "item"), "candidates")
    again = by_key.join(found.select("doc").distinct(), "doc", "left_semi")
    shared = (all_shingles(again).join(own.select("h", "item", "n"), "h").select("doc", "item", "n", "h").distinct()
              .groupBy("doc", "item").agg(F.max("n").cast("bigint").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
              .join(found, ["doc", "item"], "left_semi"))
    return (shared.withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .filter(F.col("containment") >= threshold))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document and
    item whose shingles the document's text holds to at least ``threshold``."""
    found = stored(matches(docs.select("text"), items.select("text"), threshold, size), "contained")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("doc"))
    named = items.select("item_id", text_key(F.col("text")).alias("item")).distinct()
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("best")
    return (ids.join(found, "doc").join(named, "item").groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose text holds no benchmark item, each judged
    by its own text."""
    found = matches(docs.select("text"), table(spark, sf_dir, "benchmark").select("text"))
    bad = stored(found.select(F.col("doc").alias("bad")).distinct(), "contaminated")
    return docs.join(bad, text_key(docs["text"]) == bad["bad"], "left_anti")


def _sql() -> str:
    w = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH i AS (SELECT row_number() OVER () AS ri, item_id, {w} AS w FROM benchmark),
k AS (SELECT ri, item_id, w, least(len(w), {SHINGLE}) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT ri, item_id, k, array_to_string(w[x:x + k - 1], ' ') AS s
      FROM (SELECT ri, item_id, k, w, unnest(range(1, len(w) - k + 2)) AS x FROM k)),
n AS (SELECT ri, count(*) AS n FROM s GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rd, doc_id, {w} AS w FROM documents),
e AS (SELECT rd, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS x FROM d, (SELECT DISTINCT k FROM k)),
t AS (SELECT DISTINCT rd, doc_id, k, array_to_string(w[x:x + k - 1], ' ') AS s FROM e),
c AS (SELECT rd, doc_id, ri, item_id, count(*) AS n_shared FROM t JOIN s USING (k, s) GROUP BY ALL),
m AS (SELECT doc_id, item_id, n AS n_item, n_shared, n_shared / n AS containment FROM c JOIN n USING (ri) WHERE n_shared / n >= {THRESHOLD})
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n_shared DESC, n_item DESC) = 1"""


SQL = _sql()
