"""Exact top-k search and containment search against brute force."""

import random

import numpy as np
import pytest

from weftmix.llm import decontaminate, mih


def code_rows(seed=0, n=400):
    g = np.random.default_rng(seed)
    near = g.integers(0, 2 ** 63, 12, dtype=np.int64)
    far = g.integers(-2 ** 63, 2 ** 63 - 1, n, dtype=np.int64)
    own = near[g.integers(0, 12, n)] ^ (np.int64(1) << g.integers(0, 63, n))
    codes = np.concatenate([far[:n // 2], own, np.repeat(near[:1], 60)])
    return [(i, int(c)) for i, c in enumerate(codes)]


def brute_top(codes, queries, k):
    out = {}
    for q, c in queries:
        d = sorted(((c ^ x) & (2 ** 64 - 1)).bit_count() * 10 ** 6 + i for i, x in codes if i != q)
        out[q] = [(y % 10 ** 6, y // 10 ** 6) for y in d[:k]]
    return out


@pytest.mark.parametrize("k,index_block,query_block,least", [(10, 1 << 20, 1 << 15, 3), (3, 50, 7, 1), (700, 1 << 20, 1 << 15, 2)])
def test_top_k_matches_brute_force(spark, k, index_block, query_block, least):
    rows = code_rows()
    queries = [r for r in rows if r[0] % 25 == 0]
    codes = spark.createDataFrame(rows + rows[:20], "id long, code long")  # repeated ids count once
    got = mih.top_k(codes, spark.createDataFrame(queries, "id long, code long"), k, index_block=index_block,
                    query_block=query_block, least_blocks=least).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append((r["neighbor_id"], r["distance"]))
    assert have == brute_top(rows, queries, k)


def test_flips():
    for r in range(5):
        f = mih.flips(8, r)
        assert sorted(f) == [x for x in range(256) if x.bit_count() == r]


def test_binary_codes_edges(spark):
    rows = [(0, [1.0, -1.0, 0.0]), (1, None), (2, []), (3, [0.5] * 64), (4, [2.0, -0.1, 0.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["id"]: r["code"] for r in mih.binary_codes(df, "vec_id", "embedding").collect()}
    assert got == {0: 1, 3: -1, 4: 1, None: 1}
    codes = mih.binary_codes(df.filter("vec_id is not null"), "vec_id", "embedding")
    best = mih.top_k(codes, codes, 5, least_blocks=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["neighbor_id"], r["distance"]) for r in best] == [
        (0, 4, 0), (0, 3, 63), (3, 0, 63), (3, 4, 63), (4, 0, 0), (4, 3, 63)]
    none = codes.limit(0)
    assert mih.top_k(none, none).collect() == []


def plain_words(t):
    out, w = [], ""
    for c in (t or "").lower() + " ":
        if c.isalnum():
            w += c
        elif w:
            out.append(w)
            w = ""
    return out


def sets(w, k):
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute_contained(docs, items, t=0.8):
    out = {}
    for i, text in items:
        w = plain_words(text)
        k = min(5, len(w))
        own = sets(w, k) if k else set()
        for d, doc in docs:
            if own and len(own & sets(plain_words(doc), k)) / len(own) >= t:
                out[d, i] = (len(own), len(own & sets(plain_words(doc), k)))
    return out


@pytest.fixture(params=["8m", "-1"])
def broadcast_bytes(spark, request):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_contamination_matches_brute_force(spark, docs, broadcast_bytes):
    r = random.Random(9)

    def prose(n):
        return " ".join("".join(r.choices("abcdeé", k=r.randint(2, 6))) for _ in range(n))
    items = [(i, prose(r.randint(6, 70))) for i in range(30)] + [(40, "Just four words here"), (41, "one"), (42, None), (43, " ...")]
    items += [(44, items[3][1]), (45, "x x x x x x x x")]
    rows = [(i, prose(r.randint(0, 400))) for i in range(30)]
    for i in range(30):
        w = items[i][1].split()
        cut = w[:r.randint(1, len(w))] if i % 3 else w
        if i % 5 == 0:
            cut[len(cut) // 2] = "edited"
        rows.append((100 + i, prose(200) + ". " + ", ".join(cut).upper() + "! " + prose(200)))
    rows += [(200, "it is JUST four: words here."), (201, "One"), (202, None), (203, ""), (204, "x " * 3000), (None, items[0][1]), (205, prose(6000) + items[1][1])]
    got = decontaminate.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): (x["n_item"], x["n_shared"]) for x in got} == brute_contained(rows, items)
    assert all(x["containment"] == x["n_shared"] / x["n_item"] for x in got) and len(got) > 12


def test_contamination_edges(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l")], "item_id long, text string")
    # rows that share an id are judged each by its own text: 1 holds its item in no row, 4 in one of two
    rows = [(1, "a b c d e"), (1, "b c d e f"), (2, "a b c d e"), (3, "g h i j k l m"), (4, "a b c d e f"), (4, "a b c d e")]
    got = decontaminate.contaminated(docs(rows), items).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["containment"]) for r in got) == [(3, 0, 1.0), (4, 1, 1.0)]
    assert decontaminate.contaminated(docs([]), items).collect() == []
    assert decontaminate.contaminated(docs([(1, "a b")]), items.limit(0)).collect() == []


def test_contaminated_rows_without_id(spark, docs):
    # two rows without an id that hold one item only together, and one that holds another whole
    item = " ".join(f"w{i}" for i in range(20))
    first, last = " ".join(item.split()[:12]), " ".join(item.split()[8:])
    items = spark.createDataFrame([(1, item), (2, "p q r s t u")], "item_id long, text string")
    rows = [(None, first), (None, last), (None, "p q r s t u v"), (None, "p q r s t u v")]
    got = decontaminate.contaminated(docs(rows), items).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in got] == [(None, 2, 1.0)]


def test_contaminated_items_under_one_id(spark, docs):
    items = [(1, "a b c d e f g h i"), (1, "p q r s t u v w x"), (None, "k l m n o aa bb"), (None, "cc dd ee ff gg hh ii")]
    rows = [(1, "so a b c d e f g h i"), (2, "cc dd ee ff gg hh ii jj"), (3, "k l m n o aa bb p q r s t u v w x"), (4, "plain words that are no item")]
    got = decontaminate.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(1, 1, 5, 5), (2, 0, 3, 3), (3, 0, 3, 3), (3, 1, 5, 5)]
    assert sorted((r["doc_id"], r["item_id"] or 0, r["n_item"], r["n_shared"]) for r in got) == want


def test_drop_contaminated_judges_each_row(spark, docs, tmp_dir):
    spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    leak, clean = "so a b c d e f g h i", "q r s t u v w"
    # clean rows beside a leak under one id and under none, and two rows that hold the item only together
    rows = [(None, leak), (None, clean), (None, None), (1, leak), (1, clean + " x"), (2, "a b c d e f"), (2, "d e f g h i"), (3, clean)]
    kept = decontaminate.drop_contaminated(spark, docs(rows).repartition(3), tmp_dir).collect()
    want = [r for r in rows if r[1] != leak]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted((i or 0, t or "") for i, t in want)


def test_drop_contaminated_tests_each_item(spark, docs, tmp_dir):
    # two items under one id, two without an id; a document holds one of each pair whole
    items = [(1, "a b c d e f g h i"), (1, "p q r s t u v w x"), (None, "k l m n o aa bb"), (None, "cc dd ee ff gg hh ii")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    rows = [(1, "so a b c d e f g h i"), (2, "cc dd ee ff gg hh ii jj"), (3, "plain words that are no item")]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(spark, docs(rows), tmp_dir).collect()] == [3]
