import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from stowage.llm import mixing, near_dedup


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, f in cp.STAGES:
        f(spark, docs, sf_dir).write.parquet(str(base / name))
        docs = out[name] = spark.read.parquet(str(base / name))
    return out


def test_columns_and_order(spark, sf_dir, stages):
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "byte_bpe"] and all(stages[n].dtypes == want for n, _ in cp.STAGES[:-1])


def test_decisions_take_effect(spark, sf_dir, stages):
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in stages.items()}
    assert ids["near_dedup"] < ids["toxicity"] and ids["suffix_dedup"] == ids["near_dedup"] and ids["mixing"] <= ids["suffix_dedup"] and ids["byte_bpe"] == ids["mixing"]
    before, after = (stages[n].agg(F.sum(F.char_length("text"))).first()[0] for n in ("near_dedup", "suffix_dedup"))
    assert after < before
    size = lambda df: df.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(size(stages["mixing"]) / size(stages["suffix_dedup"]) - 1.5) < 0.1


def test_tokens_decode_to_the_text(stages):
    digest = stages["mixing"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")).distinct()
    out = stages["byte_bpe"].select("doc_id", F.col("decoded_sha256").alias("h")).distinct()
    assert digest.exceptAll(out).isEmpty() and out.exceptAll(digest).isEmpty()


def test_near_copies_from_a_similarity_of_four_fifths(spark, sf_dir):
    """The stage against all pairs of shingle sets, in pairs and chains on both sides of 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for group in range(40):
        base = [word() for _ in range(200)]
        for k in range(3):
            text = list(base)
            for at in rng.sample(range(0, 200, 6), rng.randrange(1, 4)):
                text[at] = word()
            rows.append((10 * group + k, " ".join(text), "en", "s", 1))
    sets = {r[0]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in rows for w in [r[1].split()]}
    root, ids, between = {i: i for i in sets}, sorted(sets), 0
    find = lambda i: i if root[i] == i else find(root[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            between += 80 * either <= 100 * both < 85 * either
            if 100 * both >= 80 * either:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert between > 10 and {r["doc_id"] for r in cp.drop_near_copies(spark, df, sf_dir).collect()} == {i for i in ids if find(i) == i}


def test_bands_follow_the_threshold():
    assert near_dedup.bands_for(85) == near_dedup.BANDS == 25 and near_dedup.bands_for(80) == 37
    assert all((1 - (p / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(p) <= near_dedup.MISSED for p in range(50, 100))


DOC = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def staged(spark, docs, sf_dir, base):
    out = {}
    for name, f in cp.STAGES:
        f(spark, docs, sf_dir).write.parquet(str(base / name))
        docs = out[name] = spark.read.parquet(str(base / name))
    return out


def test_nulls_repeats_and_clashing_columns(spark, sf_dir, tmp_path):
    words = [f"word{i}" for i in range(60)]
    long = " ".join(words)
    rows = [
        (1, long, "en", "a", 1, 0), (2, " ".join([*words[:-1], "other"]), "en", "a", 1, 0), (3, None, "en", None, None, 0), (4, "", None, "a", 0, 0), (5, "short and clean", "en", "b", 1, 0), (5, "short and clean", "en", "b", 1, 0),
        (None, "without an id", "en", "b", 1, 0), (7, "x " * 30_000, "xx", "b", 1, 0),
    ]
    out = staged(spark, spark.createDataFrame(rows, DOC).withColumnRenamed("extra", "SCORE"), sf_dir, tmp_path)
    ids = {n: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str) for n, df in out.items()}
    assert ids["toxicity"] == sorted((r[0] for r in rows), key=str)
    assert 2 not in ids["near_dedup"] and {1, 3, 4, 5, 7, None} <= set(ids["near_dedup"]) and ids["suffix_dedup"] == ids["near_dedup"]
    kept = {r["doc_id"]: r for r in out["suffix_dedup"].collect()}
    assert kept[3]["text"] is None and kept[4]["text"] == "" and kept[1]["text"] == long and len(kept[7]["text"]) < 200
    assert all(r["n_tokens"] == len(r["ids"]) for r in out["byte_bpe"].collect())


def test_an_empty_table_gives_an_empty_result(spark, sf_dir, tmp_path):
    out = staged(spark, spark.createDataFrame([], DOC), sf_dir, tmp_path)
    assert all(df.count() == 0 for df in out.values())


def test_without_labels_no_document_is_rejected(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}", "en", "a", 1, 0) for i in range(5)], DOC)
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.drop_toxic(spark, docs, str(tmp_path)).count() == 5
