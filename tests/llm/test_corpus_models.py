"""Collocations and language-model scores against plain Python."""

import math
import os
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest

from weftmix.llm import blocks, collocations, recurrent_lm


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_collocations(rows, max_words, least, top):
    count, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i:i + k])] += 1
    good = {x: a for x, a in count.items() if a >= least and len(x[1]) > 1}
    out = {}
    for (lang, words), a in good.items():
        inside = [b for (other, longer), b in good.items() if other == lang and len(longer) > len(words)
                  and any(longer[i:i + len(words)] == words for i in range(len(longer) - len(words) + 1))]
        if any(100 * b >= 50 * a for b in inside):
            continue
        cuts = [(1_000_000 * a * a // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]]))
    return {(lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
            for lang, found in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)}


def texts(seed, n):
    r = random.Random(seed)
    words = ["New", "york", "city", "der", "die", "été", "the", "of", "a b", "世界", "x", "y"]

    def one():
        return "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]) for _ in range(r.randint(0, 40)))
    return [one() for _ in range(n)]


ROW = "doc_id long, text string, lang string, a long, phrase string, held boolean, block long"


@pytest.mark.parametrize("max_words", [3, 4])
def test_collocations_against_brute_force(spark, max_words):
    r = random.Random(4)
    rows = [(t, r.choice(["en", "en", "en", "de", "und", None])) for t in texts(1, 120)]
    rows += [(None, "en"), ("", None), ("!!! ...", "fr"), ("  \t ", "en")] + rows[:10] + [("word " * 3000, "fr")]
    df = spark.createDataFrame([(i, t, lang, 7, "clash", True, 3) for i, (t, lang) in enumerate(rows)], ROW).repartition(5)
    got = [tuple(x) for x in collocations.collocations(df, max_words, least=10, top=25).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_collocations(rows, max_words, 10, 25)


def test_collocation_blocks_may_be_small(spark, monkeypatch):
    """Pieces of a document stay whole wherever blocks end; workers import their own modules, so the split is by rows here."""
    rows = [(t, "en") for t in texts(8, 60)]
    one = spark.createDataFrame([(0, "\n".join(t for t, _ in rows), "en", 0, "", False, 0)], ROW)
    many = spark.createDataFrame([(i, t, "en", 0, "", False, 0) for i, (t, _) in enumerate(rows)], ROW).repartition(9)
    assert sorted(map(tuple, collocations.collocations(one).collect())) == sorted(map(tuple, collocations.collocations(many).collect()))


def test_exact_scores_beyond_64_bits(spark):
    a, x, y = 3_000_000_000_001, 5_000_000_000_007, 7_000_000_000_009
    level = spark.createDataFrame([(a, [x, y], [y, x])], "a long, pre array<long>, suf array<long>")
    row = collocations.score_phrases(level).first()
    assert (row["score"], row["l"], row["r"]) == (1_000_000 * a * a // (x * y), x, y)


def test_no_collocations_in_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], ROW)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None, None, 0, None, None, 0)], ROW)).collect() == []


def test_words_and_codes():
    raw = "Ab  cdé AB.x\n\n z".encode().translate(blocks.byte_table(b".\n", b" "))
    codes, words, breaks = blocks.words_of(raw)
    assert [words[c].as_py() for c in codes.tolist()] == ["ab", "cdé", "ab", "x", "z"] and breaks.tolist() == [0, 0, 0, 1, 3]
    codes, words, breaks = blocks.words_of(b"")
    assert not len(codes) and not len(words) and not len(breaks)


# -- language model ---------------------------------------------------------

def small_counts():
    g = np.random.default_rng(0)
    heads = {c: [(f"w{c}_{i}", int(n)) for i, n in enumerate(sorted(g.integers(1, 50, g.integers(0, recurrent_lm.HEADS + 1)))[::-1])]
             for c in range(recurrent_lm.CLASSES)}
    others = {c: (int(g.integers(0, 9)) * 2, int(g.integers(0, 9))) for c in range(0, recurrent_lm.CLASSES, 2)}
    return recurrent_lm.Counts(5000, 800, 40, heads, others)


def stream(counts, sizes, seed=1):
    g = np.random.default_rng(seed)
    tokens = np.concatenate([np.append(g.choice(counts.slots, n - 1), recurrent_lm.END) for n in sizes])
    return tokens.astype(np.int64), np.array(sizes)


def test_probabilities_add_up_to_one():
    counts = small_counts()
    model = recurrent_lm.GatedLM(recurrent_lm.untrained(counts))
    h = np.random.default_rng(3).normal(size=(1, recurrent_lm.HIDDEN)).astype(np.float32)
    free = [c * recurrent_lm.SLOTS + i for c in range(recurrent_lm.CLASSES) for i in range(recurrent_lm.SLOTS) if not counts.unused[c, i]]
    slots = np.array([*free, recurrent_lm.END])
    got, _ = model.log_probs(np.repeat(h, len(slots), axis=0), slots)
    assert abs(np.exp(got).sum() - 1) < 1e-4


def test_gradients_are_numeric_gradients(monkeypatch):
    monkeypatch.setattr(recurrent_lm, "FLOAT", np.float64)
    counts = small_counts()
    g = np.random.default_rng(6)
    start = recurrent_lm.untrained(counts)
    model = recurrent_lm.GatedLM(start + 0.1 * g.normal(size=len(start)))
    tokens, sizes = stream(counts, [4, 7, 3])
    lanes = recurrent_lm.Lanes(sizes, 2)
    before, fresh, slot, live, _ = next(lanes.windows(tokens, 9))
    h = g.normal(size=(2, recurrent_lm.HIDDEN))
    _, grads, _ = model.gradients(before, fresh, slot, live, h)
    for name, p in model.p.items():
        flat, own = p.ravel(), grads[name].ravel()
        for i in [*np.argsort(-np.abs(own))[:4], *g.integers(0, len(own), 2)]:
            kept, loss = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = kept + step
                loss.append(model.gradients(before, fresh, slot, live, h)[0])
            flat[i] = kept
            assert abs((loss[0] - loss[1]) / 2e-5 - own[i]) < 1e-5 * max(1, abs(own[i])), (name, i)


def test_state_is_carried_over_windows_and_not_over_documents():
    counts = small_counts()
    model = recurrent_lm.GatedLM(recurrent_lm.untrained(counts))
    tokens, sizes = stream(counts, [1, 300, 2, 64, 65, 1000, 7])
    got = model.document_scores(tokens, sizes)
    at = 0
    for n, score in zip(sizes.tolist(), got.tolist(), strict=True):
        own = tokens[at:at + n]
        at += n
        # one document alone, token by token
        h, total = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 0.0
        for i, slot in enumerate(own):
            before = np.array([[recurrent_lm.END if i == 0 else own[i - 1]]])
            h, _, _ = model.states(before, np.array([[i == 0]]), h)
            total += model.log_probs(h, np.array([slot]))[0][0] / math.log(10)
        assert abs(total - score) < 1e-3 * max(1, abs(total))


def run(spark, rows):
    d = tempfile.mkdtemp(prefix="weftmix-test-")
    df = spark.createDataFrame([(i, t, "en", 0, "", None, 0) for i, t in rows], ROW)
    df.write.parquet(os.path.join(d, "documents.parquet"))
    got = recurrent_lm.query(spark, d)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return got.collect()


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def base_rows(rows):
    count = Counter()
    split = [(i, [w for w in re.split("[ \t\n\x0b\f\r]", lower(t)) if w] + [None]) for i, t in rows]
    for i, words in split:
        if not held(i):
            count.update(words)
    n, v = sum(count.values()), len(count)
    return sorted((-1 if i is None else i, held(i), len(w), sum(count[x] > 0 for x in w), n,
                   round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in split)


def test_base_score_against_plain_counts(spark):
    rows = list(enumerate(texts(3, 80))) + [(None, "no id here"), (None, "NO id here"), (7, None), (7, ""), (5, "unseen zebra"), (900, "w " * 30_000)]
    got = run(spark, rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], *tuple(x)[1:5], round(x["base_score"], 6)) for x in got) == base_rows(rows)
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)


def test_model_learns_an_order_that_counts_cannot_see(spark):
    r = random.Random(1)
    cycle = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ren", "sol", "tav")]
    rows = []
    for i in range(1200):
        at = r.randrange(len(cycle))
        rows.append((i, " ".join(cycle[(at + k) % len(cycle)] for k in range(r.randint(20, 60)))))
    got = [x for x in run(spark, rows) if x["held_out"]]
    assert len(got) > 40 and sum(x["score"] for x in got) > 0.7 * sum(x["base_score"] for x in got)


def test_language_model_edges(spark):
    assert run(spark, []) == []
    only_held = [(i, "some words") for i in range(50) if held(i)]
    for x in run(spark, only_held):
        assert x["train_tokens"] == x["n_known"] == 0 and x["base_score"] == 0 and math.isfinite(x["score"])
