"""Scores and training metrics.

All aggregations are partial (map-side) aggregations on their group keys;
per-category and per-bucket groups are tiny after the partial step, so a
hot category or run does not concentrate rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmix.operators.review import score_ok


def _with_category(reviews: DataFrame, questions: DataFrame) -> DataFrame:
    """Every review with its question's category (NULL for an unknown
    question) and ``reason``, NULL when it counts (C11)."""
    q = questions.select("question_id", F.col("category").alias("_cat"), F.lit(True).alias("_known"))
    j = reviews.drop("category").join(q, "question_id", "left").withColumnRenamed("_cat", "category")
    usable = F.coalesce(score_ok(), F.lit(False))
    return j.withColumn("reason", F.when(F.col("_known").isNull(), "unknown question").when(~usable, "no two positive scores")).drop("_known")


def rejected_reviews(reviews: DataFrame, questions: DataFrame) -> DataFrame:
    """The reviews that no mean counts: ``question_id, reason``."""
    return _with_category(reviews, questions).filter("reason is not null").select("question_id", "reason")


def _scored(reviews: DataFrame, questions: DataFrame, strict: bool = False) -> DataFrame:
    """C11 + D5: usable reviews with the question's category. The others are
    listed by :func:`rejected_reviews`; ``strict`` fails the job on one."""
    j = _with_category(reviews, questions)
    if strict:
        j = j.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(
            F.lit("review of question "), F.coalesce(F.col("question_id").cast("string"), F.lit("NULL")), F.lit(": "), "reason"))))
    return j.filter("reason is null").select("question_id", F.element_at("score", 1).alias("a"), F.element_at("score", 2).alias("b"), "category")


def _first_questions(questions: DataFrame) -> DataFrame:
    """Order of the categories: each one's smallest question id."""
    return questions.groupBy("category").agg(F.min("question_id").alias("first_qid"))


def category_scores(reviews: DataFrame, questions: DataFrame, strict: bool = False) -> DataFrame:
    """Per category (only categories with reviews): count and the mean
    score of each side, unrounded and rounded to 2 places; ``first_qid``, the
    category's first question whether scored or not, gives the order."""
    s = _scored(reviews, questions, strict)
    means = s.groupBy("category").agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    return (means.join(_first_questions(questions), "category")
            .withColumn("score_a", F.round("mean_a", 2)).withColumn("score_b", F.round("mean_b", 2)))


def micro_scores(reviews: DataFrame, questions: DataFrame, strict: bool = False) -> DataFrame:
    """Mean over every usable review, each side."""
    s = _scored(reviews, questions, strict)
    return s.agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("a").alias("micro_a"), F.avg("b").alias("micro_b"))


def macro_scores(category_table: DataFrame) -> DataFrame:
    """Mean of the **unrounded** category means."""
    return category_table.agg(F.count(F.lit(1)).alias("n_categories"),
                              F.avg("mean_a").alias("macro_a"), F.avg("mean_b").alias("macro_b"))


def score_table(reviews: DataFrame, questions: DataFrame, strict: bool = False) -> DataFrame:
    """E1 + E2 + E3 as one table: category rows, then 'micro' and 'macro'.
    E1 and E2 come from one ``rollup`` pass; E3 aggregates E1's rows."""
    s = _scored(reviews, questions, strict)
    r = (s.rollup("category")
         .agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
              F.grouping_id().alias("_gid")))
    cats = r.filter(F.col("_gid") == 0).join(_first_questions(questions), "category")
    micro = (r.filter(F.col("_gid") == 1).withColumn("category", F.lit("micro"))
             .withColumn("first_qid", F.lit(None).cast("bigint")))
    macro = cats.agg(F.lit("macro").alias("category"), F.count(F.lit(1)).alias("n_reviews"),
                     F.avg("mean_a").alias("mean_a"), F.avg("mean_b").alias("mean_b"),
                     F.lit(None).cast("bigint").alias("first_qid"), F.lit(2).cast("bigint").alias("_gid"))
    cols = ["category", "n_reviews", "mean_a", "mean_b", "first_qid", "_gid"]
    return cats.select(*cols).unionByName(micro.select(*cols)).unionByName(macro.select(*cols)).drop("_gid")


# ------------------------------------------------------------ token losses
EXACT_BELOW = float(1 << 40)


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of doubles, rounded once, whatever the order and the
    partitions. Each value is split into whole multiples of 2 ** -20, 2 ** -50
    and 2 ** -80 (nothing is lost above 2 ** -80), these are summed as integers,
    and the total becomes a double. A plain sum where a value isn't finite or
    reaches ``EXACT_BELOW``; null when there is no value."""
    fits = F.abs(value) < EXACT_BELOW  # false for NaN and infinities
    x = F.when(fits, value.cast("double")) * float(1 << 20)
    high = F.floor(x)
    rest = (x - high) * float(1 << 30)
    mid = F.floor(rest)
    low = F.rint((rest - mid) * float(1 << 30))

    def total(part, weight):
        return F.sum(part.cast("decimal(19,0)")).cast("decimal(38,0)") * F.lit(weight).cast("decimal(38,0)")
    whole = total(high, 1 << 60) + total(mid, 1 << 30) + total(low, 1)
    return F.when(F.max(~fits), F.sum(value.cast("double"))).otherwise(whole.cast("double") * 2.0 ** -80)


def masked_loss(tokens: DataFrame, by) -> DataFrame:
    """Mean NLL over target tokens per group ``by``. Labels are shifted,
    so position 0 never counts; a group without any target token keeps its
    row with a NULL loss (the reference yields NaN). Adds ``n_target``."""
    by = [by] if isinstance(by, str) else list(by)
    t = (F.col("pos") >= 1) & (F.col("loss_mask") == 1)
    return (tokens.groupBy(*by)
            .agg(exact_sum(F.when(t, F.col("nll"))).alias("_s"), F.sum(F.when(t, 1).otherwise(0)).alias("n_target"))
            .withColumn("loss", F.col("_s") / F.nullif(F.col("n_target").cast("double"), F.lit(0.0)))
            .drop("_s"))


def perplexity(tokens: DataFrame, by) -> DataFrame:
    """E5: token-weighted perplexity ``exp(sum(nll) / count)`` over the target
    tokens of each group (our stated choice for the unpublished code)."""
    by = [by] if isinstance(by, str) else list(by)
    t = tokens.filter((F.col("pos") >= 1) & (F.col("loss_mask") == 1))
    return (t.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tokens"), (exact_sum(F.col("nll")) / F.count("nll")).alias("mean_nll"))
            .withColumn("ppl", F.exp("mean_nll")))


# ------------------------------------------------------------ step metrics
def step_tflops(numel, batch_size, seq_len, step_time):
    """``numel * batch * seq * 8 / 1e12 / (secs + 1e-12)`` in double."""
    lit = lambda x: x if not isinstance(x, (int, float)) else F.lit(float(x))
    c = lambda x: F.col(x) if isinstance(x, str) else lit(x)
    return (c(numel) * c(batch_size) * c(seq_len) * F.lit(8.0) / F.lit(1e12)
            / (c(step_time) + F.lit(1e-12)))


# Logging and saving intervals, and the checkpoint folder name.
LOG_EVERY = 100
SAVE_EVERY = 1000
CKPT_NAME_FORMAT = "ckpt_step-%d_loss-%.4f"


def trailing_mean(metrics: DataFrame, n: int = LOG_EVERY, cols=("loss", "tflops"), by=("run", "rank")) -> DataFrame:
    """at every step divisible by ``n``: the mean of the last ``n``
    values, always divided by ``n`` (fewer rows after a resume still divide
    by ``n``; ``n_rows`` tells).

    With one record per step (the trainer's contract), the last ``n``
    records at step ``s`` are exactly the steps ``s-n+1 .. s``: a
    bucket ``ceil(step / n)``. So this is a partial aggregation on
    ``(run, rank, bucket)`` — no window over a whole run in one task."""
    by = list(by)
    b = F.ceil(F.col("step") / F.lit(int(n))).cast("bigint")
    aggs = [F.sum(c).alias(f"_sum_{c}") for c in cols]
    g = (metrics.withColumn("_bucket", b).groupBy(*by, "_bucket")
         .agg(F.max("step").alias("_last"), F.count(F.lit(1)).alias("n_rows"), *aggs))
    g = g.filter(F.col("_last") == F.col("_bucket") * int(n)).withColumn("step", F.col("_last"))
    for c in cols:
        g = g.withColumn(f"avg_{c}", F.col(f"_sum_{c}") / F.lit(float(n)))
    return g.select(*by, "step", "n_rows", *[f"avg_{c}" for c in cols])


def trailing_mean_records(metrics: DataFrame, n: int = LOG_EVERY, cols=("loss", "tflops"),
                          by=("run", "rank")) -> DataFrame:
    """F2 for any record layout: at each step divisible by ``n``, the sum of
    the last ``n`` **records** (by step order) divided by ``n`` — exactly
    the reference's list slice, even when steps have gaps or repeat across
    ranks.

    Records get a dense position per ``(run, rank)`` (balanced range
    shuffle, :func:`dense_index`); a reporting record ``r`` needs records
    ``r-n+1 .. r``, which lie in position buckets ``r div n`` and the one
    before, so the band is an equi-join on ``(run, rank, bucket)`` plus a
    filter: each reported row meets at most ``2n`` rows, and no window
    spans a whole run."""
    from weftmix.operators.indexing import dense_index
    by = list(by)
    return trailing_of_places(dense_index(metrics, by, ["step"], out_col="_rec"), n, cols, by).drop("_rec")


def trailing_of_places(rec: DataFrame, n: int, cols, by, reported=None) -> DataFrame:
    """The reports of records whose 0-based place ``_rec`` in their group is
    known; of those only, for which the condition ``reported`` holds. A step that
    was logged twice reports twice, told apart by ``_rec``."""
    by, N = list(by), int(n)
    rec = rec.withColumn("_b", F.floor(F.col("_rec") / N).cast("bigint"))
    rep = rec.filter(F.col("step") % N == 0)
    rep = (rep if reported is None else rep.filter(reported)).select(*by, "step", F.col("_rec").alias("_r"), F.col("_b").alias("_rb"))
    rep = rep.withColumn("_b", F.explode(F.array(F.col("_rb"), F.col("_rb") - 1)))
    vals = rec.select(*by, "_b", "_rec", *cols)
    j = (rep.join(vals, [*by, "_b"], "inner")
         .filter((F.col("_rec") <= F.col("_r")) & (F.col("_rec") > F.col("_r") - N)))
    return (j.groupBy(*by, "step", F.col("_r").alias("_rec"))
            .agg(F.count(F.lit(1)).alias("n_rows"), *[(F.sum(c) / F.lit(float(N))).alias(f"avg_{c}") for c in cols]))


def checkpoint_summary(metrics: DataFrame, n: int = SAVE_EVERY, by=("run", "rank")) -> DataFrame:
    """every ``n`` steps, the trailing-``n`` loss and the checkpoint
    folder name ``ckpt_step-<step>_loss-<loss %.4f>``."""
    t = trailing_mean(metrics, n, ("loss",), by)
    return t.withColumn("ckpt_name", F.format_string(CKPT_NAME_FORMAT, F.col("step"),
                                                     F.round("avg_loss", 4)))
