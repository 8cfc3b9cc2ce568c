import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from stowage.llm import bpe

TEXTS = [None, "", "Hello world, it's  fine\n\n\n", "é" * 300, "a" * 5000, "abc" * 700, " " * 400 + "x", "<|endoftext|>", "日本語 text 🙂🙂", "\t \r\n", "x" * 97, "12345 67,890"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_same_as_the_library(spark, sf_dir, ranks):
    texts = [(i, t, f"{i}") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, IDS string").drop("IDS").withColumn("other", F.lit(1))
    docs = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("other", F.lit(2)))
    out = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks)
    assert out.columns == ["doc_id", "text", "other", "ids", "decoded"]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    for r in out.collect():
        text = r["text"] or ""
        assert r["ids"] == lib.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


def test_long_pieces_merge_as_short_ones(ranks):
    """Pieces of up to 5,000 bytes, beside short ones in the same queries, against the library."""
    rng = random.Random(1)
    coder = bpe.Encoder(ranks, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    pieces = ["".join(rng.choice("theandingabé") for _ in range(n)) for n in (1, 2, 5, 40, 90, 96, 97, 300, 1000, 5000)]
    assert [x.tolist() for x in coder.encode([p.encode() for p in pieces])] == [lib.encode_ordinary(p) for p in pieces]


def test_no_rows(spark, ranks):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks).collect() == []


def test_bytes_that_are_not_text(spark, ranks):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'ff61fe20' AS BINARY) AS text")
    r = bpe.decode(bpe.encode(df, ranks, P.PATTERN), ranks).first()
    assert bytes(r["decoded"]) == bytes.fromhex("ff61fe20")


def test_unknown_ids_and_nulls(spark, ranks):
    df = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, ranks).collect()] == [None, bytearray(b"")]
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([10**7],)], "ids array<int>"), ranks).collect()
