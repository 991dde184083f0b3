"""JSON-lines corpora, prompt pools, evaluation tables, sinks and logs.

Schemas are always explicit (no inference pass); columns missing from a
file come back NULL, so files with and without ``type`` read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmix.functions.text import py_strip, seeded_hash
from weftmix.operators.indexing import scan_positions
from weftmix.operators.mixing import chosen_file, file_offsets, index_rows, select_files, shard_files, spec_tags
from weftmix.session import checkpoint_dir

# ---------------------------------------------------------------- schemas
LM_SCHEMA = "text string, meta map<string,string>"
TRANSLATE_SCHEMA = "en_text string, zh_text string"
TASK_SCHEMA = "id string, input string, output string, type string"
INSTRUCT_SCHEMA = "instruction string, input string, output string, source string"
QUESTION_SCHEMA = "question_id bigint, text string, category string"
ANSWER_SCHEMA = "question_id bigint, text string, answer_id string, model_id string, metadata map<string,string>"
REVIEWER_SCHEMA = ("reviewer_id string, prompt_id int, metadata struct<temperature: double, max_tokens: int>, "
                   "description string, category string")
JUDGE_PROMPT_SCHEMA = ("prompt_id int, system_prompt string, prompt_template string, "
                       "defaults map<string,string>, description string, category string")
REVIEW_SCHEMA = ("review_id string, question_id bigint, answer1_id string, answer2_id string, reviewer_id int, "
                 "metadata map<string,string>, text string, score array<double>")


def list_corpus_files(spark: SparkSession, root: str, tags) -> DataFrame:
    """A2 (listing): ``tag, file_name, file_path`` of every ``<n>.jsonl`` file
    under ``root/<tag>/`` and of every shard ``shard=<n>/part-….json`` that A6
    wrote there; ``file_name`` is the path below the tag's folder. Only paths
    are selected, so no file content is read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{jsonl,json}")
          .option("recursiveFileLookup", "true").load(tag_folders(root, tags)).select(F.col("_metadata.file_path").alias("file_path")))
    return (df.withColumn("file_name", F.regexp_extract("file_path", BELOW, 2)).withColumn("tag", F.regexp_extract("file_path", BELOW, 1))
            .filter(F.col("tag").isin(list(tags))))


#: A corpus file's path: its tag's folder and its name below that.
BELOW = r"/([^/]+)/([^/]+\.jsonl|shard=[0-9]+/[^/]+\.json)$"


def tag_folders(root: str, tags) -> list[str]:
    return [f"{root.rstrip('/')}/{t}" for t in tags]


def _scan(spark: SparkSession, folders, files: DataFrame | None, spec: DataFrame | None):
    """(reader of the folders' JSON-lines files, what keeps the chosen ones)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,json}")

    def keep(df: DataFrame) -> DataFrame:
        if spec is not None:  # on the path alone, so Spark leaves other files unopened
            df = df.filter(chosen_file(F.regexp_extract("_metadata.file_path", BELOW, 1), F.regexp_extract("_metadata.file_path", BELOW, 2), spec))
        df = (df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"))
              .withColumn("_line", F.monotonically_increasing_id()))
        return df if files is None else df.join(files.select("file_path").distinct(), "file_path", "left_semi")
    return reader, [folders] if isinstance(folders, str) else list(folders), keep


def read_corpus(spark: SparkSession, folders, schema: str, files: DataFrame | None = None, spec: DataFrame | None = None,
                strict: bool = True) -> DataFrame:
    """A1: read the corpus files under ``folders`` with a fixed schema. A
    malformed line fails the job; with ``strict=False`` it is left out here
    and listed by :func:`corpus_rejects`.

    ``spec`` (A2's rule) decides on the paths, before a file is opened;
    ``files``, a listing, is met by the rows' file path. Neither comes to the
    driver, so a corpus may have any number of files. Each row keeps
    ``file_path`` and its file order key ``(file_block_start, _line)`` where
    ``_line`` is monotonically increasing within a split, so rows can be
    numbered in file order per file (B2).
    """
    reader, paths, keep = _scan(spark, folders, files, spec)
    df = reader.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(paths)
    return keep(df).select(*df.columns, "file_path", "_block", "_line")


def corpus_rejects(spark: SparkSession, folders, schema: str, files: DataFrame | None = None, spec: DataFrame | None = None) -> DataFrame:
    """``file_path, line``: the lines of the chosen files that are no record."""
    reader, paths, keep = _scan(spark, folders, files, spec)
    text = keep(reader.text(paths)).select("file_path", F.col("value").alias("line"))
    got = F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return text.filter(F.length(F.trim("line")) > 0).withColumn("_r", got).filter(
        F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()).select("file_path", "line")


def number_lines(corpus: DataFrame) -> DataFrame:
    """Rows of :func:`read_corpus` with ``file_pos``, their place in the file,
    and ``n_file``, its rows. The rows are written once to the shared folder
    (the files' text is parsed once); only their keys are counted."""
    checkpoint_dir(corpus.sparkSession)
    return scan_positions(corpus.checkpoint(eager=True))


def read_mixed_corpus(spark: SparkSession, root: str, spec: DataFrame, schema: str, world_size: int) -> DataFrame:
    """A1 + A2 + B1 + B2: the indexed rows of every configured subset.

    Row positions come from the scan order (:func:`scan_positions`): each
    row's place in its file, plus the file's offset in its rank's list — no
    shuffle of the records."""
    tags = spec_tags(spec)
    checkpoint_dir(spark)
    # the listing is a written table; it meets the rows by their file path
    files = shard_files(select_files(list_corpus_files(spark, root, tags), spec), world_size).select(
        "file_path", "tag", "file_name", "rank", "rank_file_ord").checkpoint(eager=True)
    rows = number_lines(read_corpus(spark, tag_folders(root, tags), schema, spec=spec))
    # per-file counts from the split table -> file offsets in each rank's list
    counts = rows.select("file_path", "n_file").distinct()
    listing = file_offsets(files.join(counts, "file_path", "inner"))
    rows = rows.drop("n_file").join(files.select("file_path", "tag", "file_name"), "file_path")
    return index_rows(rows, listing.drop("file_path"), ["_block", "_line"], pos_col="file_pos")


def read_prompt_pools(spark: SparkSession, paths) -> DataFrame:
    """A3: ``pool_key, prompts`` from ``*.prompt`` files, one prompt per line.

    Python text mode ends lines at ``\\r\\n``, ``\\r`` or ``\\n``; a final
    line end does not start a new prompt; blank lines stay as empty prompts;
    every prompt is ``strip()``-ed. Key = file name without ``.prompt``, or
    the name of the ``[column=]<key>.prompt`` folder that holds the file.
    """
    if isinstance(paths, str):
        paths = [paths]
    df = (spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
          .select("value", F.regexp_extract("_metadata.file_path", r"([^/=]+)\.prompt(?:/[^/]*)?$", 1).alias("pool_key")))
    lines = F.split(F.col("value"), "\r\n|\r|\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return (df.select("pool_key", F.transform(lines, lambda x: py_strip(x)).alias("prompts")))


def read_eval_table(spark: SparkSession, path, schema: str, strict: bool = True) -> DataFrame:
    """A4: JSON-lines evaluation table (questions, answers, reviews, ...) with
    the place of each record: ``<kind>_idx``, from 0, for reviewers
    (``reviewer_idx``) and judge prompts (``prompt_idx``), whose place in the
    table has a meaning; several part files count on in the order of their names. ``strict`` fails on a malformed line."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    place = {REVIEWER_SCHEMA: "reviewer_idx", JUDGE_PROMPT_SCHEMA: "prompt_idx"}.get(schema)
    if place is None:
        return df
    keyed = (df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"))
             .withColumn("_line", F.monotonically_increasing_id()))
    own = scan_positions(keyed, out_col="_own")
    # files in the order of their names, each behind the records of those before
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = own.select("file_path", "n_file").distinct().withColumn("_start", F.coalesce(F.sum("n_file").over(before), F.lit(0)))
    return (own.join(files.select("file_path", "_start"), "file_path").withColumn(place, (F.col("_start") + F.col("_own")).cast("int"))
            .select(*df.columns, place))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: one JSON object per line; non-ASCII kept, null fields kept,
    an empty map written as ``{}``."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_features(features: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Sink for feature rows: one folder per rank (``rank=<r>/``), rows in
    ``(batch_id, slot)`` order inside each file, so a rank's trainer reads
    its batches sequentially. The rows already sit in their batch's
    partition (``make_features``); only a local sort is added."""
    cols = [c for c in ("rank", "batch_id", "slot", "tag", "input_ids", "loss_mask", "pad_len", "n_target")
            if c in features.columns]
    (features.select(*cols).sortWithinPartitions("rank", "batch_id", "slot")
     .write.mode(mode).partitionBy("rank").format(fmt).save(path))


SHARD_BYTES = 1 << 30
#: Ranges of the order that a shard's bytes are summed in; a task gets a few.
SHARD_RANGES = 64


def write_prompt_pools(pools: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``pool_key, ord, prompt`` rows as one ``pool=<key>.prompt`` folder a
    key, one line a prompt in the order of ``ord``."""
    (pools.select(F.concat("pool_key", F.lit(".prompt")).alias("pool"), "ord", F.col("prompt").alias("value"))
     .repartition("pool").sortWithinPartitions("pool", "ord").drop("ord").write.mode(mode).partitionBy("pool").text(path))


def record_bytes(df: DataFrame) -> Column:
    """Bytes of a record's values: texts by their length, others by their width."""
    width = {"int": 4, "float": 4}
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(width.get(t, 8)) for c, t in df.dtypes),
               F.lit(0)).cast("bigint")


def place_in_shards(df: DataFrame, shard_bytes: int, seed: int, id_cols, world_size: int = 1):
    """(records with ``shard`` and ``_order``, number of shards, target):
    records in the order of a seeded hash, cut whenever their running bytes
    pass the target, so a shard holds the target to within one record however
    long single records are.

    The running sum is taken in two levels. The hash is uniform, so its equal
    ranges hold about the same number of records: each range is summed by a
    window of its own, and the ranges' totals give the starts. A range is a
    small part of a shard, so the tasks that the ranges are dealt to by hash
    read about the same bytes."""
    ids = list(id_cols)
    rows = df.withColumn("_order", seeded_hash(ids, f"order-{seed}")).withColumn("_bytes", record_bytes(df))
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    target = max(1, min(int(shard_bytes), -(-total // int(world_size))))
    n_shards = max(int(world_size), -(-total // target))
    ranges = SHARD_RANGES * n_shards
    rows = rows.withColumn("_range", F.floor(F.col("_order") * ranges / (1 << 32)).cast("int"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = rows.groupBy("_range").agg(F.sum("_bytes").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    run = (Window.partitionBy("_range").orderBy("_order", *ids, F.xxhash64(*df.columns))
           .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_own", F.coalesce(F.sum("_bytes").over(run), F.lit(0))).join(starts, "_range")
    return placed.withColumn("shard", F.floor((F.col("_start") + F.col("_own")) / target).cast("int")).select(*df.columns, "shard", "_order"), n_shards, target


def write_shuffled_shards(df: DataFrame, path: str, n_shards: int | None, seed: int, id_cols,
                          world_size: int = 1, mode: str = "overwrite", shard_bytes: int = SHARD_BYTES) -> int:
    """Shuffle records once and store them as numbered shards
    (``shard=<n>/part-….json``, which A2 lists). Returns their number.

    The order is a seeded hash, then the ids. Without ``n_shards`` shards are
    balanced by bytes, ``shard_bytes`` each (:func:`place_in_shards`); with it
    a second seeded hash deals the records to that many. The shard number is
    the task's number, so a task reads and writes one shard, and each shard is
    one file (a range shuffle over so few values would put neighbours, with two
    shards often the whole table, into one task). At least one shard per rank
    is made.
    """
    ids = list(id_cols)
    if n_shards is None:
        placed, n_shards, _ = place_in_shards(df, shard_bytes, seed, ids, world_size)
    elif n_shards < world_size:
        raise ValueError(f"need at least one shard per rank: {n_shards} < {world_size}")
    else:
        placed = (df.withColumn("shard", (seeded_hash(ids, f"shard-{seed}") % int(n_shards)).cast("int"))
                  .withColumn("_order", seeded_hash(ids, f"order-{seed}")))
    out = placed.repartitionById(int(n_shards), F.col("shard")).sortWithinPartitions("shard", "_order", *ids, F.xxhash64(*df.columns)).drop("_order")
    out.write.mode(mode).partitionBy("shard").option("ignoreNullFields", "false").json(path)
    return int(n_shards)


# ------------------------------------------------------------ training log
# The log line shapes the trainer writes.
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
_LOG_RE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] (.*)$"
_TRAIN_RE = r"^\[training\] step (\d+): lr (\S+)  loss (\S+)  tflops (\S+)$"
_DATA_PROGRESS_RE = r"^\[data\] (\S+) (\S+) (\d+)/(\d+)$"
_DATA_LOAD_RE = r"^\[data\] loading (\S+): (\S+)$"


def format_training_line(ts, step, lr, loss, tflops):
    """The trainer's ``[time] [training] step N: lr X  loss Y  tflops Z`` line."""
    msg = F.format_string("[training] step %d: lr %s  loss %s  tflops %s",
                          step, lr.cast("string"), loss.cast("string"), tflops.cast("string"))
    return F.concat(F.lit("["), F.date_format(ts, LOG_TIME_FORMAT), F.lit("] "), msg)


def format_load_line(ts, tag, file_name):
    """The trainer's line on opening a data file."""
    return F.concat(F.lit("["), F.date_format(ts, LOG_TIME_FORMAT), F.lit("] [data] loading "), tag, F.lit(": "), file_name)


def format_progress_line(ts, tag, file_name, done, total):
    """The trainer's line on progress inside a data file."""
    return F.concat(F.lit("["), F.date_format(ts, LOG_TIME_FORMAT), F.lit("] [data] "),
                    F.concat_ws(" ", tag, file_name, F.concat_ws("/", done.cast("string"), total.cast("string"))))


def _field(pattern: str, group: int, typ: str):
    """A typed regex group of the log body; NULL when the line differs."""
    return F.nullif(F.regexp_extract("_body", pattern, group), F.lit("")).try_cast(typ)


def parse_log_lines(df: DataFrame, line_col: str = "value") -> DataFrame:
    """A7 (parser): split log lines into kind, time and the numeric fields."""
    body = F.regexp_extract(line_col, _LOG_RE, 2)
    return (df.withColumn("ts", F.to_timestamp(F.regexp_extract(line_col, _LOG_RE, 1), LOG_TIME_FORMAT))
            .withColumn("_body", body)
            .withColumn("kind", F.when(F.col("_body").rlike(_TRAIN_RE), "training")
                        .when(F.col("_body").rlike(_DATA_LOAD_RE), "data_load")
                        .when(F.col("_body").rlike(_DATA_PROGRESS_RE), "data_progress")
                        .otherwise("other"))
            .withColumn("step", _field(_TRAIN_RE, 1, "bigint"))
            .withColumn("lr", _field(_TRAIN_RE, 2, "double"))
            .withColumn("loss", _field(_TRAIN_RE, 3, "double"))
            .withColumn("tflops", _field(_TRAIN_RE, 4, "double"))
            .withColumn("data_tag", F.when(F.col("kind") == "data_load", F.regexp_extract("_body", _DATA_LOAD_RE, 1))
                        .when(F.col("kind") == "data_progress", F.regexp_extract("_body", _DATA_PROGRESS_RE, 1)))
            .withColumn("data_file", F.when(F.col("kind") == "data_load", F.regexp_extract("_body", _DATA_LOAD_RE, 2))
                        .when(F.col("kind") == "data_progress", F.regexp_extract("_body", _DATA_PROGRESS_RE, 2)))
            .drop("_body"))


def read_training_log(spark: SparkSession, path) -> DataFrame:
    """Training log files ``log.txt.<rank>``; rank from the file name."""
    return ranked_log_lines(spark.read.option("recursiveFileLookup", "true").text(path))


def ranked_log_lines(lines: DataFrame) -> DataFrame:
    """Parsed lines of a text scan, batch or stream, with the rank that the
    name ``log.txt.<rank>`` of their file, or of its folder, states."""
    df = lines.select("value", F.col("_metadata.file_path").alias("_f"))
    df = df.withColumn("rank", F.nullif(F.regexp_extract("_f", r"log\.txt\.([0-9]+)(?:/[^/]*)?$", 1), F.lit(""))
                       .try_cast("int")).drop("_f")
    return parse_log_lines(df)
