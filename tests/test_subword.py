"""J1 with the installed public tokenizers: ids equal the libraries' own."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftmix.operators import subword
from weftmix.plans import training as T

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["Hello world.", "", None, "été 世界 🙂", "a <|endoftext|> b <s> c</s>", "  two\n\n lines ", "x" * 3000, "Hello world."]


def expected(name, text):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    if name.endswith(".json"):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    import base64

    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"])
def test_ids_are_the_librarys(spark, name):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n long, text string").repartition(3)
    rows = subword.with_subword_ids(df, public_tokenizers.path(name), pattern=public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for x in rows:
        assert x["ids"] == (None if x["text"] is None else expected(name, x["text"]))
    assert 50256 not in expected("byte_bpe_50k.tiktoken", TEXTS[4]) and 50256 in expected("byte_bpe_50k.json", TEXTS[4])


def test_no_rows_and_unknown_files(spark):
    empty = spark.createDataFrame([], "text string")
    assert subword.with_subword_ids(empty, public_tokenizers.path("piece_bpe_32k.model")).collect() == []
    with pytest.raises(ValueError):
        subword.load("model.bin")


def test_subword_queries_against_the_library(spark):
    from weftmix.plans import catalog
    sf = "/root/testdata/sf0.001"
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: expected("piece_bpe_32k.model", t or "") for d, t in docs.items()}
    got = catalog.queries()["subword_ids"](spark, sf).collect()
    assert {x["doc_id"]: (x["n_ids"], x["ids_md5"]) for x in got} == {
        d: (len(v), hashlib.md5(",".join(map(str, v)).encode()).hexdigest()) for d, v in ids.items()}
    # stage-1 rows: bos, the text's ids, eos, cut and padded to the batch's longest
    feats = catalog.queries()["subword_features"](spark, sf).filter(F.col("tag") != "translate").collect()
    assert feats
    for x in feats:
        own = [1, *ids[x["doc_id"]], 2][:T.MAX_LEN]
        padded = own + [0] * (x["pad_len"] - len(own))
        assert x["ids_md5"] == hashlib.md5(",".join(map(str, padded)).encode()).hexdigest()


def test_a_slice_of_texts_at_a_time():
    import pyarrow as pa
    texts = ["é" * 300_000, None, "", "a" * 700_000, "b" * 400_000, "c" * 3_000_000, None, "d"]
    asked = []

    def encode(part):
        asked.append(sum(len(t.encode()) for t in part))
        return [[len(t)] * (len(t) % 7) for t in part]
    # a slice of an array, as batches may be
    parts = list(subword.encoded(pa.array(["x", *texts])[1:], encode))
    assert pa.concat_arrays(parts).to_pylist() == [None if t is None else [len(t)] * (len(t) % 7) for t in texts]
    assert asked == [600_000, 700_000, 400_000, 3_000_000, 1]
    assert list(subword.encoded(pa.array([], pa.string()), encode)) == []
