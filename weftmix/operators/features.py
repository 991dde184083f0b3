"""Training features (H7 with F1): ids, loss masks, truncation and padding.

``featurize`` is one projection (no shuffle); ``pad_batches`` is the single
shuffle of the pipeline: the longest example of each ``(rank, batch_id)``
decides the padded length. Batches have ``batch_size`` rows, so every
window partition is small and the key is fine-grained and even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmix.functions.text import loss_split_point
from weftmix.functions.tokens import encode, lm_mask, pad, seq2seq_mask, truncate


def lm_ids(text_col: str, max_len: int, tokenizer=None):
    """Tokenised, truncated plain text (bos + text + eos, then cut)."""
    return truncate(encode(F.col(text_col), True, True, tokenizer), max_len)


def featurize(df: DataFrame, max_len: int, key_cols=("rank", "global_pos"), tokenizer=None,
              lm_ids_col: str | None = None) -> DataFrame:
    """H1 + H3 + H4 + H5: ``input_ids``, ``loss_mask``, ``n_target``.

    Plain text ('lm' rows): the whole text is tokenised with bos and eos,
    cut to ``max_len`` (a long text loses its eos), then split at a seeded
    point in ``[int(0.2 n) + 1, int(0.7 n)]``. Seq2seq rows: ``prefix`` with
    bos, ``output`` with eos, mask 0/1, cut to ``max_len`` **after** masking
    (a long prefix leaves no supervised token; the row is kept).

    ``lm_ids_col`` names precomputed plain-text ids (tokenised once per
    source row before the schedule repeats it).
    """
    L = int(max_len)
    is_lm = F.col("kind") == "lm"
    lm = F.col(lm_ids_col) if lm_ids_col else lm_ids("input", L, tokenizer)
    d = df.withColumn("_lm", F.when(is_lm, lm))
    d = (d.withColumn("_ids1", F.when(~is_lm, encode(F.col("prefix"), True, False, tokenizer)))
         .withColumn("_ids2", F.when(~is_lm, encode(F.col("output"), False, True, tokenizer))))
    d = d.withColumn("_split", F.when(is_lm, loss_split_point(F.size("_lm"), list(key_cols))))
    ids = F.when(is_lm, F.col("_lm")).otherwise(truncate(F.concat("_ids1", "_ids2"), L))
    mask = (F.when(is_lm, lm_mask(F.size("_lm"), F.col("_split")))
            .otherwise(truncate(seq2seq_mask(F.size("_ids1"), F.size("_ids2")), L)))
    d = (d.withColumn("input_ids", ids).withColumn("loss_mask", mask)
         .withColumn("n_tokens_full", F.when(is_lm, F.lit(None)).otherwise(F.size("_ids1") + F.size("_ids2")))
         .withColumn("n_target", F.when(is_lm, F.greatest(F.size("_lm") - F.col("_split"), F.lit(0))).otherwise(
             F.greatest(F.least(F.size("_ids1") + F.size("_ids2"), F.lit(L)) - F.size("_ids1"), F.lit(0))).cast("int")))
    return d.drop("_lm", "_ids1", "_ids2", "_split")


def batch_pad_length(df: DataFrame, by=("rank", "batch_id")) -> DataFrame:
    """longest example of each batch."""
    w = Window.partitionBy(*by)
    return df.withColumn("pad_len", F.max(F.size("input_ids")).over(w).cast("int"))


def pad_batches(df: DataFrame, by=("rank", "batch_id")) -> DataFrame:
    """F1 + H6: right-pad ids and mask with literal 0 to the batch maximum."""
    d = batch_pad_length(df, by)
    return (d.withColumn("input_ids", pad("input_ids", "pad_len"))
            .withColumn("loss_mask", pad("loss_mask", "pad_len")))


def make_features(examples: DataFrame, max_len: int, key_cols=("rank", "global_pos"),
                  tokenizer=None, lm_ids_col: str | None = None, by=("rank", "batch_id")) -> DataFrame:
    """H7: examples with ``prefix`` (see ``examples.with_prefix``) to padded
    feature rows ``input_ids, loss_mask, pad_len, n_target``.

    The one shuffle is placed **before** tokenisation: rows move to their
    batch's partition while they are still text (fewer bytes than two int
    arrays per token), and the pad-length window then finds its
    distribution already satisfied (no second exchange)."""
    grouped = examples.repartition(*by)
    return pad_batches(featurize(grouped, max_len, key_cols, tokenizer, lm_ids_col), by)
