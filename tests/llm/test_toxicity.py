import zlib

import numpy as np
from pyspark.sql import functions as F

from stowage.llm import queries, toxicity


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["w" + str(k) for k in range(400)]
    texts, y = [], []
    for i in range(n):
        t = list(rng.choice(words, rng.integers(20, 120)))
        if i % 4 == 0:
            t.insert(int(rng.integers(0, len(t))), str(rng.choice(["awfulness", "awfully", "vile"])))
        texts.append(" ".join(t).encode())
        y.append(int(i % 4 == 0))
    return texts, np.array(y)


def test_learns_words_and_stems():
    model = toxicity.train(*sample(800))
    texts, y = sample(400, 1)
    p = model.scores(texts)
    assert ((p >= 0.5) == y).mean() > 0.97
    assert model.scores([b"the quick brown"])[0] < 0.5 and len(model.scores([b"", b" "])) == 2


def test_one_class_only():
    assert toxicity.train([b"a", b"b"], np.array([1, 1])).scores([b"x"])[0] == 1.0
    assert toxicity.train([], np.array([])).scores([b"x"])[0] == 0.0


def test_score_and_folds(spark, sf_dir):
    model = toxicity.train(*sample(200))
    df = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "word " * 50_000, 2)], "doc_id long, text string, SCORE int")
    out = toxicity.score(df, model).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out) and out[0]["score"] == out[1]["score"]
    assert toxicity.score(df.limit(0), model).count() == 0
    q = queries.op10_toxicity(spark, sf_dir).toPandas()
    assert (q["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in q["doc_id"]]).all() and (q["predicted"] == (q["score"] >= 0.5)).all()


def test_only_the_text_goes_to_python(spark):
    """Other columns stay in the JVM, also those of types that Arrow doesn't have; a row's text crosses once and doesn't come back."""
    df = spark.createDataFrame([(1, "vile words"), (2, None)], "doc_id long, text string").withColumn("span", F.expr("make_interval(0, 0, 0, cast(doc_id as int))"))
    out = toxicity.score(df, toxicity.train(*sample(200))).select("doc_id", F.col("span").cast("string").alias("span"), "score").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["span"]) for r in out] == [(1, "1 days"), (2, "2 days")] and all(0 <= r["score"] <= 1 for r in out)


def test_training_reads_no_held_out_row(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels.unionByName(labels), max_positive=30, max_negative=1000)
    assert sum(r["toxic"] for r in rows) == 30 and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    q = queries.op10_toxicity(spark, sf).toPandas()
    lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = q.merge(lab, on="doc_id").query("held_out")
    assert (m["predicted"] == m["toxic"]).mean() > 0.9


def test_texts_of_no_known_language_have_the_threshold_of_all_rows():
    texts = [b"the of and to", b"zzz qqq", b"", b"der die und das"]
    hashes, begins = toxicity.word_hashes(texts)[:2]
    found = toxicity.languages(hashes, begins)
    assert found[1] == found[2] == len(toxicity.LANGUAGES) and found[0] != found[3] and max(found[0], found[3]) < len(toxicity.LANGUAGES)
    assert len(toxicity.train(*sample(400)).thresholds) == len(toxicity.LANGUAGES) + 1


def test_scores_against_plain_loops():
    """The forward pass, filter by filter and word by word."""
    model = toxicity.train(*sample(200))
    for text in (b"awfully nice words w1 w2 w3", b"vile", b"w9 w9 w9 w9 w9 w9 w9"):
        hashes, begins = toxicity.word_hashes([text])[:2]
        n, out, at = int(begins[1]) - toxicity.PAD, model.bias, 0
        assert n == len(text.split())
        vectors = [sum(model.table[r] for r in rows) for rows in toxicity.rows_of(hashes[:n])]
        for w in toxicity.WIDTHS:
            best = np.full(toxicity.FILTERS, -np.inf)
            for i in range(n + toxicity.PAD):
                total = model.biases[w].astype(np.float64).copy()
                for j in range(w):
                    if i + j < n:
                        total += vectors[i + j] @ model.filters[w][j]
                best = np.maximum(best, total)
            out = out + np.maximum(best, 0) @ model.out[at : at + toxicity.FILTERS]
            at += toxicity.FILTERS
        z = model.logits(*toxicity.different_words(hashes), begins)[0]
        assert abs(z - out) < 1e-3 * max(1, abs(out))


def test_every_labelled_row_trains_and_calibrates(spark):
    """Words of rows beyond any bound of rows or bytes are learnt, in several parts."""
    texts, y = sample(400, 3)
    docs = [(i, t.decode()) for i, t in enumerate(texts)]
    rare = [(1000 + i, "x " * (300_000 if i == 0 else 20) + f"rareword w{i}") for i in range(40)]
    labels = [(i, int(v)) for i, v in enumerate(y)] + [(i, 1) for i, _ in rare]
    d = spark.createDataFrame(docs + rare, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.training_set(d, known)
    assert {r["doc_id"] for r in rows.collect()} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5}
    hits = toxicity.all_hits(rows)
    own = toxicity.rows_of(toxicity.word_hashes([b"rareword"])[0][:1])[0, 0]
    assert hits[1, own] >= sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rare)
    model = toxicity.fit_model(d, known, part_rows=100)
    fresh, truth = sample(300, 4)
    assert ((model.scores(fresh) >= 0.5) == truth).mean() > 0.95
    again = toxicity.fit_model(d.repartition(7), known.repartition(3), part_rows=100)
    assert np.allclose(model.scores(fresh), again.scores(fresh))
