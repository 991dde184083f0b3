"""Language profiles and the quality network: held-out accuracy and edges."""

import random

import numpy as np
import pytest

from weftmix.llm import langid, quality_cnn

WORDS = {"en": "the of and to in that was with for this have from they which one you were her all".split(),
         "de": "der die und das nicht von ist mit sich auf für eine auch werden noch über schön größe".split(),
         "fr": "le les des est une dans qui pour pas sur avec être même très où leur était déjà".split()}


def prose(lang, r, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def test_ngram_keys_match_plain_counting():
    text = "Été, l'été! a-b 42 ñandú\U00010437x _"
    words = [w for w in ["été", "l", "été", "a", "b", "ñandú\U00010437x"]]
    want = []
    for w in words:
        p = f"_{w}_"
        want += [p[i:i + n] for n in range(1, 5) for i in range(len(p) - n + 1) if n > 1 or p[i:i + n] != "_"]
    want = [g for g in want if g != "_"]

    def key(g):
        return sum((ord(c) if ord(c) < 1 << 16 else ord(c) % 65521 + 1) << 16 * i for i, c in enumerate(g))
    assert sorted(langid.ngram_keys(text).tolist()) == sorted(key(g) for g in want)
    assert not len(langid.ngram_keys("12 ... _ ½")) and not len(langid.ngram_keys(None))


def test_out_of_place_distance_by_hand():
    a, b = (langid.ranked(*langid.ngram_counts(t)) for t in ("aab ab", "ab b"))
    p = langid.Profiles({"x": a, "y": b})
    lang, score = p.predict("aab ab")
    own = a.tolist()

    def far(ranks):
        return sum(abs(i - ranks.index(g)) if g in ranks else langid.PROFILE for i, g in enumerate(own))
    sim = {k: 1 - far(v.tolist()) / (langid.PROFILE * len(own)) for k, v in (("x", a), ("y", b))}
    assert lang == "x" and score == pytest.approx(sim["x"] / sum(sim.values()))


def test_language_id_held_out_and_edges(spark):
    r = random.Random(4)
    rows = [(i, prose(lang, r, 30), lang, "s", 1.0) for i, lang in enumerate(sorted(WORDS) * 40)]
    rows += [(900, None, "en", "s", 1.0), (901, "", "de", "s", 1.0), (902, "12 34 !!", "fr", "s", 1.0), (903, prose("de", r, 9000), None, "s", 1.0),
             (904, prose("fr", r, 20), "fr", "s", 1.0), (904, prose("fr", r, 20), "fr", "s", 1.0), (None, prose("en", r, 30), "en", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = [x.asDict() for x in langid.identify(docs, langid.learn(docs.filter("doc_id % 3 <> 0 or doc_id > 100"))).collect()]
    want = {i: lang for i, _, lang, _, _ in rows}
    plain = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 900]
    assert np.mean([x["lang_pred"] == want[x["doc_id"]] for x in plain]) == 1 and all(0 < x["score"] <= 1 for x in plain)
    odd = {x["doc_id"]: x for x in got if x["doc_id"] is None or x["doc_id"] >= 900}
    assert [odd[i]["lang_pred"] for i in (900, 901, 902, 903, 904, None)] == ["und"] * 3 + ["de", "fr", "en"]
    assert odd[900]["score"] == 0 and len(got) == len(rows)
    assert {x["lang_pred"] for x in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), {}).collect() == []


def test_language_id_query_never_learns_from_the_held_out_fold(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, prose(lang, r, 40), lang) for i, lang in enumerate(sorted(WORDS) * 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    first = {x["doc_id"]: x for x in langid.query(spark, str(tmp_path)).collect()}
    wrong = [(i, t, "xx" if first[i]["held_out"] else lang) for i, t, lang in rows]
    spark.createDataFrame(wrong, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/b/documents.parquet")
    second = {x["doc_id"]: x for x in langid.query(spark, f"{tmp_path}/b").collect()}
    assert first == second and np.mean([first[i]["lang_pred"] == lang for i, _, lang in rows]) > 0.98
    import zlib
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in first.items())


def test_chunks_cover_the_document():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(i % 251 for i in range(n))
        c = quality_cnn.chunks(data)
        joined = np.concatenate([c[0], *[x[quality_cnn.CHUNK - quality_cnn.STEP:] for x in c[1:]]])
        assert (joined[:n] == np.frombuffer(data, np.uint8)).all() and (joined[n:] == quality_cnn.BLANK).all()
        assert len(joined) - n < quality_cnn.CHUNK or n == 0


def test_network_gradients_match_differences():
    net = quality_cnn.ByteCNN(3)
    net.p = [p.astype(np.float64) for p in net.p]
    net.p[2] += 0.3
    g = np.random.default_rng(0)
    docs = [quality_cnn.chunks(bytes(g.integers(97, 110, n, dtype=np.uint8))) for n in (300, 900, 1500)]
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        n = np.array([len(d) for d in docs])
        p = net.combine(net.pooled(np.concatenate(docs)), np.cumsum(n) - n, n)
        return float((w * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())
    for k, d in enumerate(net.gradients(docs, y, w)):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        own, eps = net.p[k][at], 1e-5
        net.p[k][at] = own + eps
        up = loss()
        net.p[k][at] = own - eps
        down = loss()
        net.p[k][at] = own
        assert (up - down) / (2 * eps) == pytest.approx(float(d[at]), rel=2e-2, abs=1e-6)


def quality_rows(n=160):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose("en", r, r.randint(20, 200))
        rows.append((i, text if good else " | ".join(text.upper().split()) + "!!"))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_held_out_and_edges(spark, docs):
    rows, labels = quality_rows()
    odd = [(500, None), (501, ""), (502, prose("en", random.Random(1), 8000)), (None, "The of and."), (3, rows[3][1])]
    src = docs(rows + odd).withColumnRenamed("score", "quality_score")
    lab = spark.createDataFrame([*labels, (500, 7), (5, 0), (502, None)], "doc_id long, quality int")
    model = quality_cnn.learn(src, lab)
    got = quality_cnn.score(src, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= x["quality_score"] <= 1 for x in got)
    y = dict(labels)
    import zlib
    held = [(x["quality_score"], y[x["doc_id"]]) for x in got if x["doc_id"] in y and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([(s >= 0.3) == (q == 1) for s, q in held]) > 0.95
    by = {x["doc_id"]: x["quality_score"] for x in got}
    assert by[500] == by[501]
    assert quality_cnn.score(src.limit(0), model).collect() == []


def test_quality_without_both_classes(spark, docs):
    src = docs([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (6, 1)], "doc_id long, quality int")
    for lab, want in ((none, 0.5), (one, 1.0)):
        model = quality_cnn.learn(src, lab)
        assert {x["quality_score"] for x in quality_cnn.score(src, model).collect()} == {want}


def test_network_learns_every_chunk_in_bounded_pieces(monkeypatch):
    g = np.random.default_rng(2)
    docs = [quality_cnn.chunks(bytes(g.integers(97, 123, n, dtype=np.uint8))) for n in (10, 6000, 500)]
    y, weight = np.array([0, 1, 0], np.float32), np.ones(3, np.float32)
    whole = quality_cnn.ByteCNN(3).gradients(docs, y, weight)
    monkeypatch.setattr(quality_cnn, "ROWS", 2)
    for a, b in zip(whole, quality_cnn.ByteCNN(3).gradients(docs, y, weight), strict=True):
        assert np.allclose(a, b, atol=1e-6)


def test_training_sample_stays_within_its_bytes(spark, docs, monkeypatch):
    rows, labels = quality_rows()
    lab = spark.createDataFrame(labels, "doc_id long, label int")
    seen = []
    monkeypatch.setattr(quality_cnn.ByteCNN, "fit", lambda self, x, y, weight: seen.append((len(x), y.sum())) or self)
    for most in (1 << 20, 2000):
        monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", most)
        quality_cnn.train(docs(rows), lab)
    known = [i for i, _ in labels if i in {r[0] for r in rows}]
    assert seen[0][0] == len(known) and 0 < seen[1][1] < seen[1][0] < seen[0][0]
