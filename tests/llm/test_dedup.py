"""Suffix-array dedup and SimHash groups against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from weftmix.llm import simhash, suffix_dedup
from weftmix.llm.components import connected


def brute_removed(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(3)

    def words(n):
        return " ".join("".join(r.choices("abcdefghéß", k=r.randint(1, 8))) for _ in range(n))
    shared, line = words(60), words(20)[:90]
    texts = [words(150) for _ in range(12)]
    texts += [texts[0], texts[1] + words(30), words(10) + texts[2][50:500] + words(10)]
    texts += [words(40) + " " + shared + " " + words(40) for _ in range(9)]
    texts += [line + words(60) + line for _ in range(9)]
    texts += [None, "", "short", "a" * 199, "a" * 200, "ab" * 400, "xyz " * 300, words(30) + "ab" * 150, words(4000)]
    texts += [shared, shared[3:], texts[5][:205] + words(20), texts[5][:200], "e" * 201]
    return texts


@pytest.mark.parametrize("sharing", [0, 1, 1025, 5000])
def test_suffix_dedup_matches_brute_force(spark, docs, sharing):
    """Also with a passage that many documents hold between words of their own,
    shorter than a window, or longer and cut at various places."""
    r, texts = random.Random(7), corpus()
    passage = "".join(r.choices("abcdefgh ", k=330))
    texts += ["".join(r.choices("ijklmnop ", k=60)) + passage[r.choice([0, 0, 0, 100, 170]):] + "".join(r.choices("ijklmnop ", k=60)) for _ in range(sharing)]
    got = suffix_dedup.dedup(docs(list(enumerate(texts)))).collect()
    have = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed_spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got}
    assert have == dict(enumerate(brute_removed(texts)))


def test_suffix_dedup_repeated_rows_ids_and_empty(spark, docs):
    long = "".join(random.Random(1).choices("abcdefgh ", k=450))
    other = "".join(random.Random(2).choices("abcdefgh ", k=450))
    # the same row twice, one id with two texts, a null id
    got = suffix_dedup.dedup(docs([(1, long), (1, long), (2, other), (2, "tail"), (None, other[100:400])])).collect()
    gone = sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"])) for r in got if r["doc_id"] is not None)
    assert gone == [(False, 1, 450, 450), (False, 1, 450, 450), (False, 2, 4, 0), (False, 2, 450, 300)]
    assert [(r["n_bytes"], len(r["kept"])) for r in got if r["doc_id"] is None] == [(300, 0)]
    assert suffix_dedup.dedup(docs([])).collect() == []


def test_families_tile_the_windows_and_follow_content():
    g = np.random.default_rng(0)
    data = g.integers(0, 4, 3000).astype(np.uint8)
    p, h, a, z = suffix_dedup.families(data)
    assert a[0] == 0 and z[-1] == len(data) - 200 and (a[1:] == z[:-1] + 1).all()
    assert ((p >= z) & (p + suffix_dedup.ANCHOR <= a + 200)).all()
    moved = np.concatenate([g.integers(0, 4, 777).astype(np.uint8), data])
    p2, _, a2, z2 = suffix_dedup.families(moved)
    at = {int(w): int(x - w) for x, s, e in zip(p2, a2, z2, strict=True) for w in range(s, e + 1)}
    assert all(at[w + 777] == x - w for x, s, e in zip(p, a, z, strict=True) for w in range(s, e + 1))


def test_strip_repeats_keeps_columns_and_whole_characters(spark, docs):
    shared = "é" * 120
    rows = [(1, "aß" + shared + "b"), (2, "cé" + shared + "d"), (3, None), (4, "")]
    src = docs(rows)
    got = suffix_dedup.strip_repeats(spark, src, "")
    assert got.columns == src.columns
    out = {r["doc_id"]: r for r in got.collect()}
    assert out[1]["text"] == "aßb" and out[2]["text"] == "cd" and out[3]["text"] is None and out[4]["text"] == ""
    assert out[1]["n_chars"] == 3 and out[1]["kept"] == "x"


SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPLIT.findall(t)
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2)


def brute_components(fp):
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "Two  WORDS", "É x É", "a b c\x1fd e\x0bf", "w " * 5000, "A b C d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates_match_brute_force(spark, docs):
    r = random.Random(5)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) + str(r.randint(0, 30)) for _ in range(80)) for _ in range(25)]
    texts = [*base, *base[:5], *(b + " tail" for b in base), *(b.replace("alpha", "ALPHA") for b in base[:3]), None, "", " ", "one", "One"]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(1000 - i, texts[j]) for i, j in enumerate(order)]
    fp = [brute_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    comp = brute_components(fp)
    least = {}
    for i, c in zip(ids, comp, strict=True):
        least[c] = min(i, least.get(c, i))
    for bucket in (simhash.BUCKET, 2):
        got = {x["doc_id"]: x for x in simhash.near_duplicates(docs(rows), bucket).collect()}
        assert {i: x["fp"] & (2 ** 64 - 1) for i, x in got.items()} == dict(zip(ids, fp, strict=True))
        assert {i: x["component_id"] for i, x in got.items()} == {i: least[c] for i, c in zip(ids, comp, strict=True)}


def test_near_duplicates_edges(spark, docs):
    got = simhash.near_duplicates(docs([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 7), (7, 7), (7, 7), (9, 9)]
    assert simhash.near_duplicates(docs([])).collect() == []
    kept = simhash.keep_one(spark, docs([(7, "a b c d"), (7, "a b c d"), (8, "A b c d"), (9, None), (10, "")]), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [7, 9]


def test_keep_one_keeps_a_row_of_every_group(spark, docs):
    a, b, c, d = ("alpha beta gamma delta", "one two three four", "x y z w", "red green blue white")
    e = "un deux trois quatre"
    # three texts without an id, copies of two of them, id 7 with a text of its own and a copy of doc 3
    rows = [(None, a), (None, b), (None, a), (None, e), (7, c), (7, d), (3, d), (9, b)]
    kept = simhash.keep_one(spark, docs(rows).repartition(4), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, a), (0, e), (9, b), (7, c), (3, d)])
    # groups whose smallest id is the same
    kept = simhash.keep_one(spark, docs([(7, a), (7, b), (8, a), (8, b)]), "")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(7, a), (7, b)]


def test_bucket_roots_match_brute_force():
    g = np.random.default_rng(1)
    base = g.integers(0, 2 ** 63, 150, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << g.integers(0, 64, 150).astype(np.uint64)) for _ in range(3)]))
    key = np.sort(g.integers(0, 3, len(fp)))
    want = np.empty(len(fp), np.int64)
    for k in range(3):
        own = np.flatnonzero(key == k)
        want[own] = own[brute_components([int(x) for x in fp[own]])]
    assert (simhash.bucket_roots(key, fp) == want).all()


def test_connected_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {v: v for e in links for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
