"""Packing and WARC: exact round trips and brute-force checks."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from weftmix.llm import packing, warc


def best_cost(points, cost, length):
    """The dynamic program without its queue."""
    best = [0] * len(points)
    for j in range(1, len(points)):
        low = None
        for i in range(j):
            n = int(points[j] - points[i])
            if n <= length:
                pad = 0 if n & (n - 1) == 0 else length - n
                if low is None or best[i] + pad < low:
                    low = best[i] + pad
        best[j] = low + int(cost[j])
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_cut_windows_are_optimal(seed):
    g = np.random.default_rng(seed)
    ends = np.cumsum(g.integers(1, 60, 30))
    sentences = np.unique(g.integers(1, ends[-1], 60))
    points, cost = packing.cut_points(ends, sentences, 64, 16)
    windows = packing.cut_windows(points, cost, 64)
    size = np.diff([0, *windows])
    assert windows[-1] == ends[-1] and (size > 0).all() and size.max() <= 64
    pad = sum(0 if n & (n - 1) == 0 else 64 - n for n in size.tolist())
    price = dict(zip(points.tolist(), cost.tolist(), strict=True))
    assert pad + sum(price[w] for w in windows) == best_cost(points, cost, 64)


def token_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_pack_round_trip(spark, docs):
    r = random.Random(1)
    texts = [None, "", " ", "Hi.", "two  blanks\n\n then a line", "tabs\t\tand nbsp\u00a0\u00a0x", "<|endoftext|> starts", "a <|endoftext|> b<|endoftext|><|endoftext|> \n", "été 世界 🙂!",
             "no stop " * 4000, "a" * 5000] + [" ".join(r.choice(["the", "cat", "sat.", "On", "it's"]) for _ in range(r.randint(1, 900))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, "Hi.")]
    got = packing.pack(docs(rows).repartition(3)).collect()
    by_doc, by_seq = {}, {}
    for x in got:
        assert zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"] and len(x["ids"]) == x["length"] > 0
        by_doc.setdefault((x["doc_id"], x["doc_tokens"]), []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    for i, t in enumerate(texts):
        want = token_ids(t)
        pieces = sorted(by_doc[i, len(want)], key=lambda x: (x["start"], x["sequence_id"], x["offset"]))
        copies = 2 if i == 3 else 1
        assert sum(x["length"] for x in pieces) == copies * len(want)
        assert all(x["ids"] == want[x["start"]:x["start"] + x["length"]] for x in pieces)
    used = padded = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda x: x["offset"])
        n = 0
        for x in pieces:
            assert x["offset"] == n
            n += x["length"]
        assert n <= packing.LENGTH
        used, padded = used + n, padded + (0 if n & (n - 1) == 0 else packing.LENGTH - n)
    assert padded / used < 0.02
    assert packing.pack(docs([])).collect() == []


PAGES = [(5, "http://a.org/x", "<p>é</p>"), (3, "http://a.org/y", "<p>é</p>"), (9, None, None), (8, "http://b.org/ \r\nX: y", ""),
         (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "u", "x\r\n\r\n" * 50), (4, "u", "long " * 60_000),
         (2, "v", "same"), (2, "v", "same"), (1, "w", "only")]


def want_pages(rows, least=0):
    out = []
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            first[b] = min(i, first.get(b, i))
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and first[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def page_rows(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("least,compression", [(0, "gzip"), (5, "none")])
def test_warc_round_trip(spark, tmp_dir, least, compression):
    path = warc.write_captures(page_rows(spark, PAGES), f"{tmp_dir}/w{least}", least, compression)
    records = warc.read_records(spark, path)
    assert sorted(records.groupBy("record_type").count().collect())[1]["count"] == len(PAGES)
    captures = warc.assemble(records)
    got = [tuple(r) for r in warc.captures_digest(captures).collect()]
    assert sorted(got, key=str) == want_pages(PAGES, least)
    body = {r["capture"]["record_id"]: bytes(r["capture"]["payload"]).decode() for r in captures.collect() if r["capture"]["record_type"] == "response"}
    assert set(body.values()) == {h or "" for _, _, h in PAGES}
    rows = captures.collect()
    assert len(rows) == len(PAGES) and all(len(r["metadata"]) == 1 and r["request"]["record_type"] == "request" for r in rows)


def test_warc_null_page_id(spark, tmp_dir):
    path = warc.write_captures(page_rows(spark, [(None, "u", "a"), (4, "u", "a"), (None, "u", "b")]), f"{tmp_dir}/n")
    got = [tuple(r)[:2] + tuple(r)[3:] for r in warc.captures_digest(warc.assemble(warc.read_records(spark, path))).collect()]
    assert sorted(got, key=str) == [(4, 1, "response", None), (None, 1, "response", None), (None, 1, "revisit", 4)]


def test_warc_empty_table(spark, tmp_dir):
    path = warc.write_captures(page_rows(spark, PAGES).limit(0), f"{tmp_dir}/none")
    assert warc.captures_digest(warc.assemble(warc.read_records(spark, path))).collect() == []


def record(kind, rid, to=None, block=b"", extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n" + (f"WARC-Concurrent-To: {to}\r\n" if to else "") + extra
    return (head + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_assembly_follows_any_direction(spark, tmp_dir):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\n"
    archive = [record("warcinfo", "<i>", block=b"software: t\r\n"),
               record("request", "<q>"), record("response", "<r>", "<q>", http), record("metadata", "<m>", "<r>", b"page-id: 4\r\n"),
               record("metadata", "<m2>", "<r>", b""), record("request", "<lone>", "<gone>")]
    import os
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(r) for r in archive))  # one member a record
    rows = {r["transaction"]: r for r in warc.assemble(warc.read_records(spark, f"{tmp_dir}/in")).collect()}
    assert set(rows) == {"<i>", "<q>", "<gone>"}
    whole = rows["<q>"]
    assert bytes(whole["capture"]["payload"]) == b"body\r\n\r\n" and whole["request"]["record_id"] == "<q>"
    assert sorted(m["record_id"] for m in whole["metadata"]) == ["<m2>", "<m>"]
    assert rows["<gone>"]["capture"] is None and rows["<gone>"]["request"]["record_id"] == "<lone>"


def test_batch_settings_do_not_change_results(spark, docs):
    """What a session sets for Arrow batches, or another operator's build, has no say."""
    from weftmix.llm import langid, simhash
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = docs([(i, f"word{i}. " * (i % 90)) for i in range(1200)]).coalesce(1)
    before, seen = spark.conf.get(key), []
    try:
        for n in ("1", "128", "10000"):
            spark.conf.set(key, n)
            got = packing.pack(rows, with_ids=False).drop("ids")
            simhash.fingerprints(rows)
            langid.identify(rows, {})
            assert spark.conf.get(key) == n
            seen.append(sorted(tuple(x) for x in got.collect()))
    finally:
        spark.conf.set(key, before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 1200
