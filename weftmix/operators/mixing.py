"""Sampling and mixing (B1-B7): the weighted round-robin schedule in closed form.

The reference's producer loop cycles over a tag list (each tag repeated
``weight`` times), draws the next row of that tag and wraps to the first
file when a tag is exhausted; every ``batch_size`` draws form a batch. Here
each row computes its own slots: the schedule is an ``explode`` over keys,
dealt out by hash beforehand, with no join and no driver loop:

* ``o_t`` = sum of earlier weights, ``W`` = sum of all weights,
  ``G = steps * batch_size`` slots per rank, ``N_t`` rows of tag t on a rank;
* draws of tag t among the first G slots:
  ``K_t(G) = (G div W) * w_t + min(max(G mod W - o_t, 0), w_t)``;
* row ``i`` is draw ``k`` for ``k in {i, i + N_t, i + 2 N_t, ...}, k < K_t``;
* draw ``k`` sits at slot ``g = (k div w_t) * W + o_t + (k mod w_t)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmix.operators.indexing import dense_index

# Files of a rank that one running sum covers.
OFFSET_BLOCK = 4096
MIX_SPEC_SCHEMA = "tag string, ord int, weight int, file_start int"


def mix_spec(spark: SparkSession, weights) -> DataFrame:
    """Build the ordered mix config. ``weights`` is a list of
    ``(tag, weight)`` or ``(tag, weight, file_start)``; order matters."""
    rows = []
    for i, w in enumerate(weights):
        tag, weight = w[0], int(w[1])
        start = int(w[2]) if len(w) > 2 and w[2] is not None else None
        rows.append((tag, i, weight, start))
    df = spark.createDataFrame(rows, MIX_SPEC_SCHEMA)
    df._weftmix_spec = rows
    return df


def _spec_rows(spec: DataFrame):
    """The mix config as (tag, ord, weight, offset, cycle) tuples. The spec is
    configuration (one row per subset), read once on the driver."""
    known = getattr(spec, "_weftmix_spec", None)
    src = known if known is not None else [(r["tag"], r["ord"], r["weight"], r["file_start"]) for r in spec.collect()]
    rows = sorted((o, t, int(w)) for t, o, w, _s in src)
    rows = [(o, t, w) for o, t, w in rows if w > 0]
    total = sum(w for _, _, w in rows)
    out, off = [], 0
    for o, t, w in rows:
        out.append((t, o, w, off, total))
        off += w
    return out


def expand_weights(spec: DataFrame) -> DataFrame:
    """Per tag its offset ``o_t`` in the repeated tag list and the cycle
    length ``W`` (as a small local table)."""
    rows = _spec_rows(spec)
    return spec.sparkSession.createDataFrame(
        rows, "tag string, ord int, weight int, w_offset bigint, w_total bigint")


def select_files(files: DataFrame, spec: DataFrame) -> DataFrame:
    """A2: keep ``<n>.jsonl`` files and ``shard=<n>/`` shard files of configured
    tags whose number is at least the tag's ``file_start`` (when one is
    configured).

    ``files`` needs ``tag, file_name``; the spec is a handful of rows, so it is
    broadcast and the (possibly large) file listing never shuffles.
    """
    return (files.filter(F.col("file_name").rlike(CORPUS_NAME))
            .join(F.broadcast(spec.select("tag", "file_start")), "tag", "inner")
            .withColumn("file_stem", F.regexp_extract("file_name", r"^(.*)\.jsonl?$", 1))
            .withColumn("file_no", file_number(F.col("file_name")))
            .filter(F.col("file_start").isNull() | (F.col("file_no") >= F.col("file_start"))))


CORPUS_NAME = r"\.jsonl$|^shard=[0-9]+/[^/]*\.json$"


def file_number(file_name: Column) -> Column:
    number = F.concat(F.regexp_extract(file_name, r"^([0-9]+)\.jsonl$", 1), F.regexp_extract(file_name, r"^shard=([0-9]+)/", 1))
    return F.nullif(number, F.lit("")).try_cast("bigint")


def spec_tags(spec: DataFrame) -> list[str]:
    """The configured tags, in order."""
    return [t for t, *_ in _spec_rows(spec)]


def chosen_file(tag: Column, file_name: Column, spec: DataFrame) -> Column:
    """A2's rule as a predicate on a file's tag and name; the spec's few rows
    are literals in it."""
    known = getattr(spec, "_weftmix_spec", None)
    rows = known if known is not None else [(r["tag"], r["ord"], r["weight"], r["file_start"]) for r in spec.collect()]
    out = F.lit(False)
    for t, _o, _w, start in rows:
        own = tag == t
        out = out | (own if start is None else own & (file_number(file_name) >= start))
    return out & file_name.rlike(CORPUS_NAME)


def shard_files(files: DataFrame, world_size: int, by=("tag",)) -> DataFrame:
    """B1 + G1: rank r gets the tag's sorted files r, r+R, r+2R, ...

    Sorting is binary string order (Python's order: ``9.jsonl`` after
    ``10.jsonl``). The listing is numbered by a range sort (dense_index), so a
    tag with very many files is no single task either.
    """
    R = int(world_size)
    return (dense_index(files, by, ["file_name"], out_col="_ord").withColumn("file_ord", F.col("_ord").cast("int")).drop("_ord")
            .withColumn("rank", (F.col("file_ord") % R).cast("int"))
            .withColumn("rank_file_ord", (F.col("file_ord") / R).cast("int")))


def file_offsets(shards: DataFrame) -> DataFrame:
    """Per-file start position inside the rank's concatenation and the rank's
    subset size, from a listing with per-file row counts ``n_file``.

    A running sum in two levels: inside blocks of ``OFFSET_BLOCK`` files of a
    rank, then over the blocks' totals, so that no window holds a whole tag."""
    part = ["tag", "rank"]
    blocked = shards.withColumn("_blk", F.floor(F.col("rank_file_ord") / OFFSET_BLOCK).cast("bigint"))
    totals = blocked.groupBy(*part, "_blk").agg(F.sum("n_file").alias("_n"))
    before = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(Window.partitionBy(*part)).cast("bigint").alias("n_rows"))
    run = Window.partitionBy(*part, "_blk").orderBy("rank_file_ord").rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.drop("n_rows").withColumn("_own", F.coalesce(F.sum("n_file").over(run), F.lit(0)))
    return (out.join(totals, [*part, "_blk"]).withColumn("file_offset", (F.col("_start") + F.col("_own")).cast("bigint"))
            .drop("_blk", "_own", "_start"))


def index_rows(rows: DataFrame, shards: DataFrame, order_cols, file_key=("tag", "file_name"),
               pos_col: str | None = None) -> DataFrame:
    """B2: position of each row in its rank's concatenation of files.

    ``rows`` holds the records with the file key columns; ``shards`` is the
    file listing from :func:`shard_files` (one row per file; broadcast or
    shuffled by its bytes). The
    position is a dense index over ``(tag, rank)`` ordered by the file's
    place in the rank's list and then by ``order_cols`` inside the file. It
    is computed with a balanced range shuffle (:func:`dense_index`), never
    one window partition per file or per tag. Adds ``rank, rank_file_ord,
    row_idx`` and the rank's tag size ``n_rows``.

    When the rows already know their 0-based position inside their file
    (``pos_col``) and the listing has per-file counts (``n_file``), the index
    is ``file_offset + pos`` from a join with the listing.
    """
    key = list(file_key)
    if pos_col is not None and "n_file" in shards.columns:
        offs = shards if "file_offset" in shards.columns else file_offsets(shards)
        listing = offs.select(*key, "rank", "rank_file_ord", "file_offset", "n_rows")
        return (rows.join(listing, key, "inner")
                .withColumn("row_idx", (F.col("file_offset") + F.col(pos_col)).cast("bigint"))
                .drop("file_offset"))
    has_size = "n_rows" in shards.columns
    listing = shards.select(*key, "rank", "rank_file_ord", *(["n_rows"] if has_size else []))
    with_rank = rows.join(listing, key, "inner")
    return dense_index(with_rank, ["tag", "rank"], ["rank_file_ord", *order_cols],
                       out_col="row_idx", size_col=None if has_size else "n_rows")


def parse_resume_step(checkpoint_path: str | None) -> int:
    """B7 helper: the step number in a checkpoint folder name
    (``.../ckpt_step-<n>_loss-<x>``); 0 when there is none."""
    if not checkpoint_path:
        return 0
    base = checkpoint_path.rstrip("/").split("/")[-1]
    return int(base.split("step-")[1].split("_")[0])


def resume_step_col(path_col) -> Column:
    """B7 as a Column: the step parsed from a checkpoint path column."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.regexp_extract(c, r"step-(\d+)", 1).cast("bigint")


def _draws_before(slots: Column, w: Column, o: Column, W: Column) -> Column:
    """K_t(G): how many of the first ``slots`` slots belong to the tag."""
    return (F.floor(slots / W) * w + F.least(F.greatest(slots % W - o, F.lit(0)), w)).cast("bigint")


def slot_of_draw(draw: Column, spec: DataFrame, tag_col: str = "tag") -> Column:
    """The slot of the tag's draw ``k`` in the endless mix:
    ``(k div w) * W + o + k mod w``; null for tags outside the mix."""
    out = F.lit(None).cast("bigint")
    for tag, _o, w, off, cycle in _spec_rows(spec):
        slot = F.floor(draw / w).cast("bigint") * cycle + off + draw % w
        out = F.when(F.col(tag_col) == tag, slot.cast("bigint")).otherwise(out)
    return out


# A row drawn more often than this is split into chunks of this many draws
# that are spread over tasks before they are generated.
CHUNK_DRAWS = 4096


def mix_schedule(indexed: DataFrame, spec: DataFrame, steps: int | Column, batch_size: int,
                 start_step: int | Column = 0, chunk_draws: int = CHUNK_DRAWS) -> DataFrame:
    """B4 + B5 + B6 + B7: every draw of every row with its slot.

    ``indexed`` needs ``tag, rank, row_idx, n_rows`` (see :func:`index_rows`).
    Emits one row per draw with ``draw`` (k), ``global_pos`` (g), ``batch_id``
    and ``slot``. Only batches ``start_step <= batch_id < steps`` are made:
    the step limit (B6) and the resume skip (B7) are folded into the draw
    range, so no skipped row is generated and then dropped. ``steps`` may be
    a Column (for a data-derived epoch length).

    Skew: a row of a tiny, heavily weighted subset can be drawn a large share
    of all slots, so every row's draw range is cut into chunks of
    ``chunk_draws`` (one for most rows) and the chunks are dealt out by hash
    before the draws are generated. Callers pass keys without the text, so
    this moves a few numbers per row.
    """
    B = int(batch_size)
    # the spec is configuration (one row per subset): its per-tag weight,
    # offset and cycle become literal CASE expressions, so the schedule
    # needs no join at all
    conf = [(t, w, off, tot) for t, _o, w, off, tot in _spec_rows(spec)]
    if not conf:
        raise ValueError("empty mix spec")

    def per_tag(i: int) -> Column:
        expr = None
        for row in conf:
            cond = F.col("tag") == F.lit(row[0])
            expr = F.when(cond, F.lit(row[i])) if expr is None else expr.when(cond, F.lit(row[i]))
        return expr.cast("bigint")

    indexed = indexed.filter(F.col("tag").isin([c[0] for c in conf]))
    indexed = indexed.withColumn("_wt", per_tag(1)).withColumn("_woff", per_tag(2)).withColumn("_wcyc", per_tag(3))
    steps_c = steps if isinstance(steps, Column) else F.lit(int(steps))
    start_c = start_step if isinstance(start_step, Column) else F.lit(int(start_step))
    g_end = steps_c.cast("bigint") * B
    g_start = F.least(start_c.cast("bigint"), steps_c.cast("bigint")) * B

    w, o, W = F.col("_wt"), F.col("_woff"), F.col("_wcyc")
    N = F.col("n_rows").cast("bigint")
    i = F.col("row_idx")
    k_lo = _draws_before(g_start, w, o, W)
    k_hi = _draws_before(g_end, w, o, W)
    # first k >= k_lo with k = i (mod N)
    k_first = F.when(i >= k_lo, i).otherwise(i + F.ceil((k_lo - i) / N).cast("bigint") * N)

    C = int(chunk_draws)
    df = (indexed.withColumn("_k_hi", k_hi)
          .withColumn("_k_first", k_first)
          .filter(F.col("_k_first") < F.col("_k_hi"))
          .withColumn("_n_draws", F.floor((F.col("_k_hi") - 1 - F.col("_k_first")) / N).cast("bigint") + 1))

    def explode_range(d: DataFrame, lo: Column, hi: Column) -> DataFrame:
        d = d.withColumn("draw", F.explode(F.sequence(lo, F.greatest(hi - 1, lo), N)))
        return d.filter(F.col("draw") < hi)

    chunks = (df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                           F.floor((F.col("_n_draws") - 1) / C).cast("bigint"))))
              # a stated number: by their few bytes AQE would put all chunks in one task
              .repartition(int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tag", "rank", "row_idx", "_chunk"))
    c_lo = F.col("_k_first") + F.col("_chunk") * C * N
    c_hi = F.least(F.col("_k_hi"), c_lo + C * N)
    df = explode_range(chunks, c_lo, c_hi).drop("_chunk")
    g = (F.floor(F.col("draw") / w) * W + o + F.col("draw") % w).cast("bigint")
    return (assign_batches(df.withColumn("global_pos", g), B)
            .drop("_wt", "_woff", "_wcyc", "_k_hi", "_k_first", "_n_draws"))


def assign_batches(df: DataFrame, batch_size: int, pos_col: str = "global_pos") -> DataFrame:
    """B5 on its own: batch id and slot from a 0-based position."""
    B = int(batch_size)
    return (df.withColumn("batch_id", F.floor(F.col(pos_col) / B).cast("bigint"))
            .withColumn("slot", (F.col(pos_col) % B).cast("int")))


def limit_steps(df: DataFrame, max_steps: int) -> DataFrame:
    """B6 on its own: keep batches below ``max_steps``."""
    return df.filter(F.col("batch_id") < int(max_steps))


def resume_from(df: DataFrame, checkpoint_path: str | None) -> DataFrame:
    """B7 on its own: skip batches below the checkpoint's step."""
    return df.filter(F.col("batch_id") >= parse_resume_step(checkpoint_path))


def epoch_steps(indexed: DataFrame, spec: DataFrame, batch_size: int) -> int:
    """A data-derived step count: ceil(max over (rank, tag) of ceil(N / w) * W / B),
    i.e. enough batches that every rank draws each of its rows at least once.

    The per-(rank, tag) sizes are a partial aggregate; only the final scalar
    reaches the driver (it plays the role of ``max_train_steps``).
    """
    e = expand_weights(spec).select("tag", "weight", "w_total")
    per = (indexed.groupBy("rank", "tag").agg(F.max("n_rows").alias("n_rows"))
           .join(F.broadcast(e), "tag")
           .select((F.ceil(F.col("n_rows") / F.col("weight")) * F.col("w_total")).alias("_g")))
    v = per.agg(F.ceil(F.max("_g") / F.lit(int(batch_size))).cast("bigint").alias("s")).first()["s"]
    return int(v or 0)
