"""License scans with a positional rare-token index.

The words of the templates' mandatory key phrases are ranked by how few
documents hold them (inverse document frequency). The index lists, for a word,
its postings: (template, key phrase, position in the template). A file looks up
the highest-IDF words that it holds itself: for every key phrase all of whose
words it has, the rarest. Each place of such a word votes for (template, place
minus position); the postings of a template's key phrases are intersected by
that relative position, and where all agree the phrases are verified word for
word. A phrase that stands in a file has its rarest word there, so no
template whose key phrases stand is missed, whatever its words' ranks. The score is the
share of the template's words that stand in their places; a template may hang
over either end of the text as long as its key phrases stand inside.

Base phrases are looked up beside that wherever their words stand
consecutively. Everything is built-in expressions on one row's word array, so
after the word counts (one row per word of a key phrase) nothing is shuffled.

Defined results: a null or empty text has no word, no label (an empty string)
and score 0; overlapping places all count; ties in rarity go to the word that
sorts first; a very long text is one row's word array, read whole; repeated
rows give repeated results; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.llm.common import UPPER, ascii_lower, table
from weftmix.llm.license_texts import TEMPLATES

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label and phrase.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))


def plain_words(text: str) -> list[str]:
    """The words of a template or phrase, by the documents' rule."""
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, UPPER.lower()))) if w]


def key_phrases(templates=TEMPLATES) -> list[tuple[int, int, list[str]]]:
    """(template, start in the template, words) of every mandatory phrase."""
    out = []
    for n, t in enumerate(templates):
        own = plain_words(t.text)
        for key in map(plain_words, t.keys):
            out.append((n, next(i for i in range(len(own)) if own[i:i + len(key)] == key), key))
    return out


def doc_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def consecutive(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    want = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(want))
    hit = F.filter(starts, lambda i: _all(F.get(words, i + k) == w for k, w in enumerate(want)))
    return F.when(F.array_contains(words, want[0]) & (F.size(words) >= len(want)), hit).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def document_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """In how many rows each word of a key phrase stands; one number per word."""
    vocabulary = sorted({w for _, _, key in key_phrases(templates) for w in key})
    held = docs.select(F.explode(F.array_intersect(_texts(vocabulary), doc_words(F.col("text")))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def rarest(key: list[str], counts: dict[str, int]) -> tuple[str, int]:
    """The highest-IDF word of a phrase and its first place there."""
    return min((counts[w], w, i) for i, w in enumerate(key))[1:]


def _postings(counts: dict[str, int], templates) -> Column:
    """One entry per key phrase: its words, rarest first, and the rarest one's template and position."""
    entries = []
    for t, start, key in key_phrases(templates):
        w, i = rarest(key, counts)
        by_idf = sorted(set(key), key=lambda x: (counts[x], x))
        entries.append(F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(start + i).alias("i"), _texts(by_idf).alias("key")))
    return F.array(*entries)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not at each of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(words: Column, counts: dict[str, int], templates) -> Column:
    """(template, start) where the rarest words of all its key phrases agree."""
    need = F.array(*[F.lit(len(t.keys)) for t in templates])

    def votes(own):
        at = _once(F.transform(own, lambda e: e["w"]), lambda ws: F.filter(
            F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(ws, F.get(words, i))))
        return F.array_sort(F.flatten(F.transform(at, lambda i: F.transform(
            F.filter(own, lambda e: e["w"] == F.get(words, i)), lambda e: F.struct(e["t"].alias("t"), (i - e["i"]).alias("at"))))))

    def agreed(v):
        # equal votes stand together: all phrases agree when the first and the n-th of a run are equal
        runs = F.filter(F.transform(v, lambda x, j: F.struct(x["t"].alias("t"), x["at"].alias("at"), j.alias("j"))),
                        lambda x: F.get(v, x["j"] + F.get(need, x["t"]) - 1) == F.struct(x["t"], x["at"]))
        return F.array_distinct(F.transform(runs, lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"))))
    # the postings that this file looks up: those of phrases all of whose words it holds
    looked = _once(F.array_intersect(_texts(sorted(counts)), words), lambda held: F.filter(
        _postings(counts, templates), lambda e: F.forall(e["key"], lambda w: F.array_contains(held, w))))
    return _once(looked, lambda own: F.when(F.size(own) > 0, _once(votes(own), agreed)))


def _verified(words: Column, found: Column, templates) -> Column:
    """The found places whose key phrases stand there, with their score."""
    texts = F.array(*[_texts(plain_words(t.text)) for t in templates])
    labels = _texts([t.label for t in templates])
    own_keys: list[list] = [[] for _ in templates]
    for t, start, key in key_phrases(templates):
        own_keys[t] += [F.struct(F.lit(start + i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(key)]
    keys = F.array(*[F.array(*k) for k in own_keys])
    stand = F.filter(found, lambda x: F.coalesce(F.forall(F.get(keys, x["t"]), lambda k: F.get(words, x["at"] + k["i"]) == k["w"]), F.lit(False)))

    def share(x):
        own = F.get(texts, x["t"])
        equal = F.filter(F.transform(own, lambda w, i: F.get(words, x["at"] + i) == w), lambda e: e)
        return F.size(equal) / F.size(own)
    return F.transform(stand, lambda x: F.struct(F.get(labels, x["t"]).alias("label"), x["at"].alias("start"), share(x).alias("share")))


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """Per row: doc_id, n_words, base array of (label, start), found array of
    (label, start, share of the template's words in place)."""
    counts = document_counts(docs, templates)
    got = docs.select("doc_id", doc_words(F.col("text")).alias("words"))

    def labelled(label, phrase):
        return F.transform(consecutive(F.col("words"), phrase), lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))
    starts = [labelled(label, phrase) for label, phrase in base]
    got = got.withColumn("base", F.concat(*starts)).withColumn("places", _places(F.col("words"), counts, templates))
    return got.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "base", F.coalesce(
        _verified(F.col("words"), F.col("places"), templates), F.array().cast("array<struct<label:string,start:int,share:double>>")).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_distinct(F.array_sort(F.col("base.label")))
    both = F.array_distinct(F.array_sort(F.concat(F.col("base.label"), F.col("found.label"))))
    return got.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").cast("bigint").alias("first_word"), F.array_max("base.start").cast("bigint").alias("last_word"),
        F.array_join(names, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.coalesce(F.array_max("found.share"), F.lit(0.0)).alias("score"))


def _sql() -> str:
    """The statement: a label stands wherever all its template's key phrases
    stand in their places; nothing of the index is said here."""
    rows = [f"({n}, {i}, '{w}', '{t.label}')" for n, t in enumerate(TEMPLATES) for i, w in enumerate(plain_words(t.text))]
    keys = [f"({t}, {m}, {start + i}, '{w}')" for m, (t, start, key) in enumerate(key_phrases()) for i, w in enumerate(key)]
    phrases = [f"('{label}', {i}, '{w}', {len(p.split())})" for label, p in BASE for i, w in enumerate(p.split())]
    return f"""
WITH tpl(t, i, w, label) AS (VALUES {', '.join(rows)}),
keyw(t, m, i, w) AS (VALUES {', '.join(keys)}),
phr(label, i, w, len) AS (VALUES {', '.join(phrases)}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
v AS (SELECT w FROM keyw UNION SELECT w FROM phr),
q AS MATERIALIZED (SELECT * FROM p WHERE w IN (SELECT w FROM v)),
bp AS (SELECT r, label, q.pos - i AS start FROM q JOIN phr USING (w) GROUP BY r, label, q.pos - i, len HAVING count(*) = len),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bp GROUP BY r),
kc AS (SELECT t, count(*) AS n_keys FROM keyw GROUP BY t),
ok AS (SELECT r, t, q.pos - i AS pos FROM q JOIN keyw USING (w) JOIN kc USING (t) GROUP BY r, t, q.pos - i, n_keys HAVING count(*) = n_keys),
sc AS (SELECT ok.r, ok.t, ok.pos, any_value(tpl.label) AS label,
              count(*) FILTER (ok.pos + tpl.i >= 0 AND tpl.w = d.ws[ok.pos + tpl.i + 1]) / count(*) AS share
       FROM ok JOIN tpl USING (t) JOIN d ON d.r = ok.r GROUP BY ok.r, ok.t, ok.pos),
lab AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
        (SELECT r, label FROM bp UNION ALL SELECT r, label FROM sc) GROUP BY r),
top AS (SELECT r, max(share) AS score FROM sc GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN lab USING (r) LEFT JOIN top USING (r)"""


SQL = _sql()
