import pytest
from pyspark.sql import functions as F

from stowage.llm import mixing

SCHEMA = "doc_id long, text string, source string, SLICE int, mix_size string"


def mix(df, **more):
    return mixing.mix_sources(df, size=mixing.word_count(F.col("text")), quality=mixing.text_quality(F.col("text")), **more)


def targets(sizes, weights, share, cap):
    """Resharing what is above the cap, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= cap * sizes[s]}
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (1 + i * 7 % 40), f"s{i % 3 if i % 2 else 0}", i, "x") for i in range(400)]
    rows += [(1000 + i, "a b c", None, i, "x") for i in range(20)] + [(2000, None, "s1", 0, "x"), (2001, "", "s2", 0, "x"), (None, "one two", "s1", 0, "x"), (5, "same id", "s1", 0, "x"), (5, "same id", "s1", 0, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_takes(docs):
    out = mix(docs).toPandas()
    sizes = {(None if s != s else s): int(v) for s, v in out.groupby(out["source"].astype(object).where(out["source"].notna(), "~"))["mix_size"].sum().items()}
    sizes[None] = sizes.pop("~")
    want = targets(sizes, (3, 1, 2), 1.5, 2.0)
    for s, t in want.items():
        own = out[out["source"].isna()] if s is None else out[out["source"] == s]
        assert (own["mix_target"] - t).abs().max() < 1e-5
        assert abs(own["mix_taken"].sum() - t) <= own["mix_size"].max()
        assert own["mix_copies"].max() - own["mix_copies"].min() <= 1
    assert (out["mix_taken"] <= 2 * out["mix_size"]).all() and len(out) == docs.count() and "SLICE" in out


def test_reruns_and_slices_agree(docs):
    base = sorted(map(str, mix(docs).select("doc_id", "mix_taken").collect()))
    assert base == sorted(map(str, mix(docs.repartition(7)).select("doc_id", "mix_taken").collect()))
    assert base == sorted(map(str, mix(docs, slices=8, few=5).select("doc_id", "mix_taken").collect()))


def test_few_rows_are_left_to_sort_however_the_weights_lie(spark):
    """Keys of very low weights lie far apart, those of very high ones close together; the bracket that is sorted stays small."""
    rows = spark.range(20_000).select(F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"), mixing.exponential_key(F.col("id"), F.when(F.col("id") % 3 == 0, 1e-6).otherwise(F.when(F.col("id") % 3 == 1, 1.0).otherwise(1e6))).alias("key"))
    for rest in (1.0, 20_000.5, 45_000.0, 59_999.0):
        start = rows.groupBy(F.col("source").alias("t_source")).agg(F.lit(rest).alias("rest"), F.count("*").alias("m"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.lit(0).cast("long").alias("before"))
        edge = mixing.narrowed(rows, start, 64, 50).first()
        inside = rows.filter(F.col("key").between(edge["lo"], edge["hi"])).count()
        assert inside <= 50 and edge["before"] < rest <= edge["before"] + 3 * inside and rows.filter(F.col("key") < edge["lo"]).count() * 3 == edge["before"]


def test_better_documents_come_first(spark):
    rows = [(i, "word " * 10 if i % 2 else "!!!! " * 10, "s") for i in range(1000)] + [(5000 + i, "w " * 10, "t") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(df, share=0.5).toPandas()
    taken = out[out["source"] == "s"].groupby("doc_id")["mix_copies"].sum()
    assert taken[taken.index % 2 == 1].sum() > 2 * taken[taken.index % 2 == 0].sum()


def test_empty(docs):
    assert mix(docs.limit(0)).count() == 0
