"""J1 with a sub-word model: tokenizers of public libraries as Columns.

The model file goes to every executor once (``SparkContext.addFile``) and is
opened once per task. A slice of a batch's texts becomes one Arrow list column:
all ids as one array of values and one of offsets. The kind follows the file's
name:

* ``*.model`` — sentencepiece (the reference's kind of tokenizer);
* ``*.json`` — tokenizers; special tokens in a text are their own ids, as the
  library has it, unless the file says otherwise;
* ``*.tiktoken`` — byte-level ranks with a split pattern.

A null text has null ids, an empty one none. The texts around a prompt are
encoded each on their own, as the reference does, since sub-word ids of two
texts don't join to those of the whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.operators.external import text_slices


def load(path: str, pattern: str | None = None) -> Callable[[list[str]], list]:
    """texts -> the ids of each, by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
    raise ValueError(f"no tokenizer library for {path}")


def as_lists(ids: list, null: np.ndarray) -> pa.ListArray:
    """One Arrow list column from the ids of each text."""
    offsets = np.array([0, *accumulate(map(len, ids))], np.int32)
    if ids and isinstance(ids[0], np.ndarray):
        values = np.concatenate(ids).astype(np.int32)
    else:
        values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(null) if null.any() else None)


def encoded(batch: pa.Array, encode: Callable[[list[str]], list]) -> Iterator[pa.ListArray]:
    """The ids of a batch's texts, a slice of the texts at a time."""
    for part in text_slices(batch):
        null = part.is_null().to_numpy(zero_copy_only=False)
        yield as_lists(encode(part.fill_null("").to_pylist()), null)


class SubwordTokenizer:
    """A tokenizer for ``functions.tokens.encode`` and ``make_features``."""

    concatenative = False

    def __init__(self, spark: SparkSession, model_path: str, pattern: str | None = None):
        spark.sparkContext.addFile(model_path)
        name = os.path.basename(model_path)

        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = load(SparkFiles.get(name), pattern)
            for batch in batches:
                yield from encoded(batch, encode)
        self._udf = F.arrow_udf(ids, "array<int>")

    def ids(self, text: Column | str) -> Column:
        return self._udf(F.col(text) if isinstance(text, str) else text)


def with_subword_ids(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", pattern: str | None = None) -> DataFrame:
    """``df`` with the sub-word ids of a text column."""
    return df.withColumn(out_col, SubwordTokenizer(df.sparkSession, model_path, pattern).ids(text_col))


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """The path of an installed public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)
