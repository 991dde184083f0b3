"""Stand-in inputs built from the driver's tables.

* subset (tag) = ``documents.lang``; file = ``documents.source``; row order
  inside a file = ``doc_id``;
* translation pair = the j-th ``en`` and the j-th ``fr`` document of the same
  source file (a row number per file, then an equi-join on ``(source, j)``);
* task record = a document: input = text, output = first line, type = source;
* instruction record = a user turn with the previous system turn as
  instruction and the next assistant turn as output;
* question = document, category from the source number; answers = the two
  halves of its text; reviews come from a deterministic stand-in judge.

Everything here is a lazy DataFrame over the given parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.operators.indexing import dense_index

# The nine English question categories, in table order.
CATEGORIES = ["generic", "knowledge", "roleplay", "common-sense", "fermi",
              "counterfactual", "coding", "math", "writing"]

# Our own prompt pools for the driver queries (stored stripped, as A3 yields).
TRANSLATE_POOLS = {
    "en-zh": ["Translate the passage above into the second language.",
              "Give the same text in the other language:",
              "Please render this paragraph in translation."],
    "zh-en": ["Translate the passage above back into English.",
              "Write the text above in English:"],
}
TASK_POOLS = {
    "src1.pre": ["Answer after reading:  ", "Read the passage and reply.", "Question follows.\t"],
    "src1.post": ["Now give the short answer.", "Reply briefly: "],
    "src2.pre": ["Summarise the following text.  "],
    "src3.post": ["What is the first line of this text?", "Repeat the opening line.　"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """The documents table, or an already-loaded frame of it (a streaming
    micro-batch)."""
    d = docs if docs is not None else table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "source")


def source_number(col="source"):
    return F.regexp_extract(F.col(col), r"(\d+)", 1).cast("int")


def lm_rows(spark: SparkSession, sf_dir: str, langs, docs: DataFrame | None = None) -> DataFrame:
    """LM subsets: ``tag, file_name, doc_id, text``."""
    d = documents(spark, sf_dir, docs).filter(F.col("lang").isin(list(langs)))
    return d.select(F.col("lang").alias("tag"), F.col("source").alias("file_name"), "doc_id", "text")


def translate_pairs(spark: SparkSession, sf_dir: str, src_lang: str = "en", tgt_lang: str = "fr",
                    tag: str = "translate", docs: DataFrame | None = None) -> DataFrame:
    """Translation pairs by their keys ``tag, file_name, doc_id, pair_doc_id,
    file_pos``: the j-th document of each language within the same source
    file; ``file_pos`` = j is the pair's position inside its file (pairs are
    dense, 0..min(n_en, n_fr)-1, in the order of the ``en`` doc ids)."""
    d = documents(spark, sf_dir, docs).filter(F.col("lang").isin(src_lang, tgt_lang)).select("source", "lang", "doc_id")
    j = dense_index(d, ["source", "lang"], ["doc_id"], out_col="file_pos")
    a = j.filter(F.col("lang") == src_lang).select("source", "file_pos", "doc_id")
    b = j.filter(F.col("lang") == tgt_lang).select("source", "file_pos", F.col("doc_id").alias("pair_doc_id"))
    return a.join(b, ["source", "file_pos"]).select(F.lit(tag).alias("tag"), F.col("source").alias("file_name"), "doc_id", "pair_doc_id", "file_pos")


def task_rows(spark: SparkSession, sf_dir: str, langs) -> DataFrame:
    """Task records ``tag, file_name, doc_id, input, output, type``."""
    d = documents(spark, sf_dir).filter(F.col("lang").isin(list(langs)))
    return d.select(F.concat(F.lit("task-"), F.col("lang")).alias("tag"), F.col("source").alias("file_name"),
                    "doc_id", F.col("text").alias("input"),
                    F.element_at(F.split("text", "\n", -1), 1).alias("output"),
                    F.col("source").alias("type"))


def instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records from conversations: one per user turn,
    ``conv_id, turn, instruction, input, output``.

    The previous system turn (turn - 1) is the instruction and the next
    assistant turn (turn + 1) the output, empty when there is none; both are
    equi-joins on ``(conv_id, turn)``, so no conversation is ever gathered in
    one task.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    sysm = c.filter(F.col("role") == "system").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("instruction"))
    asst = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return (user.join(sysm, ["conv_id", "turn"], "left").join(asst, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", F.coalesce("instruction", F.lit("")).alias("instruction"),
                    "input", F.coalesce("output", F.lit("")).alias("output")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions ``question_id, text, category`` from documents
    (``question_id = doc_id + 1``, so ids run 1..n like a question file)."""
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    d = documents(spark, sf_dir)
    return d.select((F.col("doc_id") + 1).alias("question_id"), "text",
                    F.element_at(cats, source_number() % len(CATEGORIES) + 1).alias("category"))


def answers(spark: SparkSession, sf_dir: str, half: int, model_id: str) -> DataFrame:
    """Answers ``question_id, text, answer_id, model_id``: half 1 / half 2 of
    each document's text."""
    from weftmix.functions.review import new_id
    d = documents(spark, sf_dir)
    txt = (F.expr("substring(text, 1, CAST(floor(length(text) / 2) AS INT))") if half == 1
           else F.expr("substring(text, CAST(floor(length(text) / 2) AS INT) + 1)"))
    qid = F.col("doc_id") + 1
    return d.select(qid.alias("question_id"), txt.alias("text"),
                    new_id(F.lit(model_id), qid).alias("answer_id"),
                    F.lit(model_id).alias("model_id"))
