import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.operators import coldstart


def test_blocks_give_what_the_expression_gives(spark, monkeypatch):
    """Copies, zeros, nulls, rows of other lengths, extreme and not finite values, ties of rounding and blocks without rows."""
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(60)] + [(100 + k, [1.0, 2.0, 3.0, 4.0]) for k in range(5)]
    rows += [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [0.0] * 4), (203, [1.0, 2.0]), (204, []), (205, [1e-200] * 4), (206, [1e200] * 4), (207, [float("nan"), 1.0, 1.0, 1.0]), (208, [float("inf"), 1.0, 1.0, 1.0]), (209, [-1.0, -2.0, -3.0, -4.0]), (None, [1.0] * 4)]
    rows += [(300, [1.0, 0.0, 0.0, 0.0]), (301, [3.0, 4.0, 0.0, 0.0]), (302, [0.5, 0.5, 0.5, 0.5]), (303, [1.0, 1.0, 1.0, -1.0]), (304, [0.000005, 1.0, 0.0, 0.0])]
    t = spark.createDataFrame(rows, "id long, x array<double>")
    old = t.select(F.col("id").alias("a"), F.col("x").alias("ax")).crossJoin(t.select(F.col("id").alias("b"), F.col("x").alias("bx"))).filter("a <> b")
    for digits in (1, 5):
        want = {(r["a"], r["b"]): r["s"] for r in old.select("a", "b", F.round(X.similarity(F.col("ax"), F.col("bx"), "cosine"), digits).alias("s")).collect()}
        for sizes in ((512, 4096), (8, 16)):
            monkeypatch.setattr(coldstart, "ASKED", sizes[0])
            monkeypatch.setattr(coldstart, "ROUTES", sizes[1])
            found = coldstart.similarity_matrix(t, t, "cosine", digits=digits).collect() if sizes[0] > 8 or digits == 5 else None
            if found is not None:
                got = {(r["a"], r["b"]): r["similarity"] for r in found}
                assert len(got) == len(found) and got.keys() == want.keys()
                assert all(repr(got[k]) == repr(want[k]) for k in want), [(k, got[k], want[k]) for k in want if repr(got[k]) != repr(want[k])][:9]


def test_rows_are_sent_about_as_often_whatever_their_number():
    for rows in (10_000, 100_000, 300_000, 600_000):
        groups, units = coldstart.dealt(rows // 50, rows)
        assert groups * rows + units * (rows // 50) < 2.5 * rows and rows / units < 10_000
    for asked, rows in ((0, 0), (0, 9), (1, 1), (100_000, 100_000), (1_000_000, 50_000_000)):
        groups, units = coldstart.dealt(asked, rows)
        assert groups >= 1 and units >= 1 and asked / groups <= coldstart.HELD and rows / units <= 2 * coldstart.HELD


def test_equal_similarities_lie_together_on_disk(spark, tmp_path):
    rng = np.random.default_rng(1)
    t = spark.createDataFrame([(k, rng.normal(size=64).tolist()) for k in range(8000)], "id long, x array<double>")
    coldstart.similarity_matrix(t.filter("id % 50 = 0"), t, "cosine", digits=5).write.parquet(str(tmp_path / "out"))
    groups = [f.row_group(g) for f in (pq.ParquetFile(p).metadata for p in glob.glob(str(tmp_path / "out/*.parquet"))) for g in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 160 * 7999
    assert sum(g.column(c).total_compressed_size for g in groups for c in range(3)) < 5 * 160 * 7999


def test_groups_and_batches_leave_no_pair_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    t = spark.createDataFrame([(k, rng.normal(size=3 + k % 2).tolist()) for k in range(90)], "id long, x array<double>").repartition(5)
    whole = sorted(map(tuple, coldstart.similarity_matrix(t, t, "cosine", digits=4).collect()))
    for name, n in (("HELD", 16), ("ASKED", 8), ("ROUTES", 16)):
        monkeypatch.setattr(coldstart, name, n)
    assert coldstart.dealt(90, 90) == (6, 6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert sorted(map(tuple, coldstart.similarity_matrix(t, t, "cosine", digits=4).collect())) == whole and len(whole) == 90 * 89
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
