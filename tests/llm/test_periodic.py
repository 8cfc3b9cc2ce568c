import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import periodic


def by_hand(words, exponent, least):
    """Every maximal stretch by every period; a period counts if the stretch has no smaller one."""
    out, n = set(), len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, q, length))
            i = j
    return [(s, m, p) for s, p, m in sorted(out)]


def found(texts, exponent, least):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return periodic.runs_of(np.array([w for t in texts for w in t], dtype=np.int64), first, exponent, least)


@pytest.mark.parametrize("exponent,least", [(2, 2), (3, 4), (4, 6)])
def test_runs_against_every_period(exponent, least):
    rng = random.Random(exponent)
    texts = [[]]
    for _ in range(400):
        base = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(1, 12))]
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += base[: rng.randrange(len(base) + 1)] * rng.randrange(1, 7) + [rng.randrange(3)] * rng.randrange(3)
        texts.append(text[: rng.randrange(1, 60)])
    assert found(texts, exponent, least) == [by_hand(t, exponent, least) for t in texts]
    assert found(texts[:1], exponent, least) == [[]]


def test_a_long_text_of_one_word_and_of_a_long_period():
    assert found([[5] * 20_000], 4, 6) == [[(0, 20_000, 1)]]
    assert found([list(range(900)) * 20 + [7]], 4, 6) == [[(0, 18_000, 900)]]


def test_next_smaller_reaches_far():
    v = np.concatenate([[50], np.arange(1000, 100, -1), [3], np.arange(200, 300)])
    end = np.full(len(v), len(v))
    want = [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]
    assert periodic.next_smaller(v, end).tolist() == want


def test_column_results(spark):
    rows = [
        (1, "a b a b a b a b", 9), (2, None, 9), (3, "", 9), (4, " \t\n", 9), (5, "x " * 5, 9), (6, "x " * 6, 9), (7, "p q r " * 6 + "end", 9),
        (1, "a b a b a b a b", 9), (8, "a a a a a a b a a a a a a b a a a a a a b a a a a a a b", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    out = periodic.find_runs(df).withColumn("best", periodic.longest(F.col("runs"))).withColumn("list", periodic.listed(F.col("runs")))
    got = out.collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and out.columns == ["doc_id", "runs", "collapsed", "best", "list"]
    assert by[1]["list"] == "0,8,2\n" and by[1]["collapsed"] == "a b" and by[1]["best"].asDict() == {"start": 0, "length": 8, "period": 2}
    assert all(by[i]["list"] == "" and by[i]["collapsed"] == "" and by[i]["best"] is None for i in (2, 3, 4))
    assert by[5]["list"] == "" and by[5]["collapsed"] == "x x x x x" and by[6]["collapsed"] == "x"
    assert by[7]["collapsed"] == "p q r end"
    assert by[8]["list"] == "0,6,1\n0,28,7\n7,6,1\n14,6,1\n21,6,1\n" and by[8]["best"]["length"] == 28 and by[8]["collapsed"] == "a b"
    assert periodic.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(df, exponent=1)


def test_looped_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 23))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", periodic.looped(F.col("text"), F.floor(h / 10)).alias("t")).collect()}
    for i, text in rows:
        words, g = text.split(), zlib.crc32(str(i).encode()) // 10
        if words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        assert got[i] == " ".join(words)
