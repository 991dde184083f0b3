"""User-supplied functions run by Spark.

A tokenizer, a generator model or a remote judge cannot be a SQL
expression, so these run as Arrow-batched Python on executors:

* J1: an iterator ``arrow_udf`` — the tokenizer factory is called once per
  task, before the batch loop, then every Arrow batch is encoded;
* J2: ``mapInPandas``, J3: ``mapInArrow`` — the model/judge factory is called
  once per partition; rows stream through in Arrow batches.

A batch stays in Arrow's memory, which Spark bounds by bytes; texts become
Python objects a slice (J1) or a row (J3) at a time.

Calls are deterministic functions of the row (ids are hashes, not random),
so a retried task produces the same rows.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, as_completed, wait

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmix.functions.chat import render_prompt
from weftmix.functions.review import new_id
from weftmix.functions.text import py_strip
from weftmix.operators.chat import chat_template, question_conversations


# --------------------------------------------------------------------- J1
#: Bytes of text that a task turns into ids at a time.
SLICE_BYTES = 1 << 20


def text_slices(batch: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The batch's texts in order, in slices of at most ``most`` bytes or one text."""
    import numpy as np
    import pyarrow.compute as pc
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def with_tokenizer(factory: Callable[[], Callable[[str], list]], bos: bool = False, eos: bool = False):
    """Returns ``encode(col) -> Column[ARRAY<INT>]`` backed by an
    iterator Arrow UDF. ``factory()`` loads the tokenizer (e.g. a
    sentencepiece model file) once per task; its result maps one string to
    a list of ids. ``bos``/``eos`` add ids 1/2 like H1. A batch's ids, several
    times as large as its texts, leave the task in slices."""

    def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        tok = factory()
        head = np.array([1] if bos else [], dtype=np.int32)
        tail = np.array([2] if eos else [], dtype=np.int32)
        for batch in batches:
            for part in text_slices(batch):
                # numpy arrays convert to Arrow lists far faster than Python lists
                yield pa.array([None if t is None else np.concatenate([head, np.asarray(tok(t), dtype=np.int32), tail])
                                for t in part.to_pylist()], pa.list_(pa.int32()))

    _encode = F.arrow_udf(_encode, T.ArrayType(T.IntegerType()))

    def encode(col) -> Column:
        return _encode(F.col(col) if isinstance(col, str) else col)

    return encode


def codepoint_tokenizer_factory():
    """Python twin of the built-in code-point tokenizer (id = ord + 3): a
    numpy view of the UTF-32 encoding, one vector op per text."""
    import numpy as np
    return lambda t: np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.int32) + 3


def sentencepiece_factory(model_file: str):
    """A J1 factory for a sentencepiece model file (loaded on the executor)."""
    def factory():
        import sentencepiece as spm
        sp = spm.SentencePieceProcessor(model_file=model_file)
        return lambda t: sp.encode(t)
    return factory


class TokenizerUDF:
    """Adapter so a J1 tokenizer can be passed where H1 takes a tokenizer."""

    concatenative = False

    def __init__(self, factory):
        self._enc = with_tokenizer(factory)

    def ids(self, text) -> Column:
        return self._enc(text)


# --------------------------------------------------------------------- J2
ANSWER_SCHEMA = "question_id bigint, text string"


def generate_answers(questions: DataFrame, model_id: str, factory: Callable[[], Callable[[str], str]],
                     template: str = "human-assistant") -> DataFrame:
    """Question -> conversation (H11, H13) -> prompt (H8) -> model text
    -> strip -> answer rows ``question_id, text, answer_id, model_id,
    metadata``. ``factory()`` loads the model once per partition; its result
    maps a prompt to the generated continuation."""
    tpl = chat_template(template)
    conv = question_conversations(questions, tpl["roles"])
    prompts = conv.select("question_id", render_prompt(F.lit(tpl["system"]), F.col("messages"), tpl["style"],
                                                       tpl["sep"], tpl["sep2"]).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            yield pd.DataFrame({"question_id": pdf["question_id"],
                                "text": [model(p) for p in pdf["prompt"]]})

    out = prompts.mapInPandas(run, ANSWER_SCHEMA)
    return out.select("question_id", py_strip(F.col("text")).alias("text"),
                      new_id(F.lit(model_id), F.col("question_id")).alias("answer_id"),
                      F.lit(model_id).alias("model_id"),
                      F.create_map().cast("map<string,string>").alias("metadata"))


# --------------------------------------------------------------------- J3
# Judge tries, seconds between calls, seconds after a failure,
# and the text recorded when every try failed.
JUDGE_TRIES = 5
JUDGE_GAP_SEC = 3.0
JUDGE_RETRY_WAIT_SEC = 5.0
JUDGE_FAILED_TEXT = "error"
# Least number of tasks that call the judge side by side unless told otherwise.
JUDGE_PARTITIONS = 8
# Answers that a task of :func:`judge_stored` holds before it writes them.
COMMIT_ROWS = 16


class _Pace:
    """Starts of a task's calls, at least ``spacing`` seconds apart, the first
    after ``delay``; shared by the calls in flight."""

    def __init__(self, spacing: float, delay: float):
        self.spacing, self.at, self.lock = spacing, time.monotonic() + delay, threading.Lock()

    def wait(self) -> None:
        if self.spacing <= 0:
            return
        with self.lock:
            start = max(self.at, time.monotonic())
            self.at = start + self.spacing
        time.sleep(max(0.0, start - time.monotonic()))


def _asker(call, pace: _Pace, max_retry: int, retry_wait: float):
    """One request's tries: the answer, or None when all of them failed."""
    def ask(system_prompt, prompt, max_tokens):
        for i in range(max_retry):
            pace.wait()
            try:
                return call(system_prompt, prompt, int(max_tokens))
            except Exception:  # noqa: BLE001 - the judge's failure is data here
                if retry_wait > 0 and i + 1 < max_retry:
                    time.sleep(retry_wait)
        return None
    return ask


def _answered(requests: Iterator[tuple], ask, in_flight: int) -> Iterator[tuple]:
    """(key, answer) of the requests ``(key, *arguments)`` as they are answered,
    with at most ``in_flight`` of them asked at a time."""
    if in_flight == 1:
        for key, *arguments in requests:
            yield key, ask(*arguments)
        return
    with ThreadPoolExecutor(in_flight) as pool:
        open_calls = {}
        for key, *arguments in requests:
            open_calls[pool.submit(ask, *arguments)] = key
            if len(open_calls) == in_flight:
                for done in wait(open_calls, return_when=FIRST_COMPLETED).done:
                    yield open_calls.pop(done), done.result()
        for done in as_completed(list(open_calls)):
            yield open_calls.pop(done), done.result()


def _judge_tasks(requests: DataFrame, gap: float, partitions: int | None) -> int:
    """``partitions``; by default the session's cores, when no rate is stated."""
    cores = 0 if gap > 0 else requests.sparkSession.sparkContext.defaultParallelism
    return int(partitions or max(JUDGE_PARTITIONS, cores))


def judge(requests: DataFrame, factory: Callable[[], Callable[[str, str, int], str]],
          max_retry: int = JUDGE_TRIES, gap: float = JUDGE_GAP_SEC, retry_wait: float = JUDGE_RETRY_WAIT_SEC,
          partitions: int | None = None, in_flight: int = 1) -> DataFrame:
    """Call the judge for every request (``system_prompt, prompt,
    max_tokens``) with up to ``max_retry`` tries; after the last failure the
    text is ``error``. The requests are dealt to ``n = partitions`` tasks (with
    no gap, as many as the session has cores); a task's calls, retries included,
    start at least ``gap * n`` seconds apart and task ``p`` starts ``gap * p``
    seconds late, so the whole job starts at most one call per ``gap``. A task
    has up to ``in_flight`` calls open, for judges that take longer than that
    (its function must then allow calls from several threads). Adds ``text``;
    every other column is kept."""
    n = _judge_tasks(requests, gap, partitions)
    df = requests.repartition(n, "question_id")
    schema = T.StructType(list(df.schema.fields) + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ask = _asker(factory(), _Pace(gap * n, gap * TaskContext.get().partitionId()), int(max_retry), retry_wait)
        for batch in batches:
            texts = [JUDGE_FAILED_TEXT] * batch.num_rows
            for i, text in _answered(zip(range(len(texts)), *_values(batch, *ASKED), strict=True), ask, in_flight):
                if text is not None:
                    texts[i] = text
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return df.mapInArrow(run, schema)


# What the judge is asked.
ASKED = ["system_prompt", "prompt", "max_tokens"]


def _values(batch: pa.RecordBatch, *names: str) -> list[Iterator]:
    """The columns' values, made one at a time."""
    return [(x.as_py() for x in batch.column(c)) for c in names]


# Stored answers: one row per answered request, by the hash of what was asked.
ANSWERS_SCHEMA = "request_key string, answer string"


def request_key() -> Column:
    """SHA-256 of what the judge is asked: prompts and token budget."""
    return F.sha2(F.to_json(F.struct("system_prompt", "prompt", F.col("max_tokens").cast("int").alias("max_tokens"))), 256)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """``request_key, answer`` of the answers under ``store``; of two answers to
    one request (a task that ran twice at a time) the smaller text counts."""
    rows = spark.read.schema(ANSWERS_SCHEMA).option("recursiveFileLookup", "true").parquet(store)
    return rows.groupBy("request_key").agg(F.min("answer").alias("answer"))


def judge_stored(requests: DataFrame, factory: Callable[[], Callable[[str, str, int], str]], store: str,
                 max_retry: int = JUDGE_TRIES, gap: float = JUDGE_GAP_SEC, retry_wait: float = JUDGE_RETRY_WAIT_SEC,
                 partitions: int | None = None, in_flight: int = 1, commit_rows: int = COMMIT_ROWS) -> DataFrame:
    """:func:`judge` whose answers outlive its tasks. Every task writes its
    answers in files of at most ``commit_rows`` under ``store`` (a folder that
    driver and executors share, on a store that pyarrow can write) while it
    runs; a task that is run again, and a later run over the same ``store``, ask
    only what has no stored answer. A lost task repeats at most the
    ``commit_rows - 1 + in_flight`` calls that it had not written. Equal requests
    are asked once. Failed requests get the text ``error`` and are not stored, so
    that the next run asks them again; an answer that can't be parsed is an
    answer, so a pass that wants new ones takes a new ``store``. Adds ``text``."""
    spark = requests.sparkSession
    n = _judge_tasks(requests, gap, partitions)
    root = store.rstrip("/")
    spark.createDataFrame([], ANSWERS_SCHEMA).write.mode("append").parquet(root)  # makes the folder
    keyed = requests.withColumn("request_key", request_key())
    asked = keyed.select("request_key", "system_prompt", "prompt", "max_tokens").dropDuplicates(["request_key"])
    todo = asked.join(stored_answers(spark, root), "request_key", "left_anti").repartition(n, "request_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        files, own = _task_folder(f"{root}/deal={n}-{task}")
        known = _read_answers(files, own)
        ask = _asker(factory(), _Pace(gap * n, gap * task), int(max_retry), retry_wait)
        fresh = (row for batch in batches for row in zip(*_values(batch, "request_key", *ASKED), strict=True) if row[0] not in known)
        held, written = [], 0
        for key, text in _answered(fresh, ask, in_flight):
            if text is not None:
                held.append((key, text))
            if len(held) == commit_rows:
                _write_answers(files, own, held)
                held, written = [], written + len(held)
        _write_answers(files, own, held)
        yield pa.RecordBatch.from_pydict({"answers": pa.array([written + len(held)], pa.int64())})

    todo.mapInArrow(run, "answers bigint").agg(F.sum("answers")).collect()  # one number; the answers lie under the store
    return (keyed.join(stored_answers(spark, root), "request_key", "left")
            .withColumn("text", F.coalesce("answer", F.lit(JUDGE_FAILED_TEXT))).drop("request_key", "answer"))


def _task_folder(path: str):
    """(file system, path) of a task's own folder, made if need be."""
    from pyarrow import fs
    scheme, _, rest = path.partition(":")
    files, own = fs.FileSystem.from_uri("/" + rest.lstrip("/") if scheme == "file" else path)
    files.create_dir(own, recursive=True)
    return files, own


def _read_answers(files, own: str) -> set:
    """The keys that earlier attempts of the task have written."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    known = set()
    for f in files.get_file_info(fs.FileSelector(own)):
        if f.base_name.startswith("answers-"):
            known.update(pq.read_table(f.path, columns=["request_key"], filesystem=files)["request_key"].to_pylist())
    return known


def _write_answers(files, own: str, rows: list) -> None:
    """One file, which gets its name when it is whole."""
    import pyarrow.parquet as pq
    if not rows:
        return
    keys, texts = zip(*rows, strict=True)
    name = uuid.uuid4().hex
    pq.write_table(pa.table({"request_key": pa.array(keys, pa.string()), "answer": pa.array(texts, pa.string())}), f"{own}/_{name}", filesystem=files)
    files.move(f"{own}/_{name}", f"{own}/answers-{name}.parquet")
