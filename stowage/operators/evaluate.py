"""Forecast evaluation, grouped by series: rows of key, idx, y, yhat, lower, upper."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import exprs as X


def metrics(y: str = "y", f: str = "yhat") -> dict[str, Column]:
    e = F.col(f) - F.col(y)
    return {"mape": 100 * F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(1e-8))), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "bias": F.avg(e)}


def interval_metrics(y: str = "y", lower: str = "lower", upper: str = "upper", alpha: float = 0.1) -> dict[str, Column]:
    a, lo, hi = F.col(y), F.col(lower), F.col(upper)
    return {"coverage": F.avg(a.between(lo, hi).cast("double")), "width": F.avg(hi - lo), "interval_score": F.avg(X.interval_score(a, lo, hi, alpha))}


def evaluate(rows: DataFrame, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """All point and interval metrics in one aggregate."""
    both = {**metrics(), **interval_metrics(alpha=alpha)}
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in both.items()])


def seasonal_scale(train: DataFrame, key: str, order: str, y: str, season: int) -> DataFrame:
    """Mean absolute seasonal difference; null below 1e-8."""
    d = F.abs(F.col(y) - F.lag(y, season).over(Window.partitionBy(key).orderBy(order)))
    out = train.withColumn("_d", d).groupBy(key).agg(F.avg("_d").alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") >= 1e-8, F.col("scale")))


def seasonal_naive(train: DataFrame, key: str, order: str, y: str, season: int) -> DataFrame:
    """(key, slot, naive): the last season's values, slot 0 for the first of them."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return train.withColumn("_b", back).filter(F.col("_b") <= season).select(key, (season - F.col("_b")).alias("slot"), F.col(y).alias("naive"))


def scaled_errors(train: DataFrame, test: DataFrame, key: str, order: str, season: int = 7) -> DataFrame:
    """mase and skill of test (key, order, y, yhat) against the seasonal naive forecast of train (key, order, y)."""
    step = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = test.withColumn("slot", step % season).join(seasonal_naive(train, key, order, "y", season), [key, "slot"], "left")
    sums = rows.groupBy(key).agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("naive"))).alias("naive_mae"))
    out = sums.join(seasonal_scale(train, key, order, "y", season), key, "left")
    return out.select(key, F.try_divide("mae", "scale").alias("mase"), (1 - F.try_divide("mae", "naive_mae")).alias("skill"))


def diebold_mariano(rows: DataFrame, key: str, order: str, horizon: int = 1, loss: Callable[[Column], Column] | None = None) -> DataFrame:
    """Statistic and two-sided p of equal accuracy of f1 and f2; null where the variance isn't positive."""
    loss = loss or (lambda e: e * e)
    w = Window.partitionBy(key).orderBy(order)
    d = loss(F.col("y") - F.col("f1")) - loss(F.col("y") - F.col("f2"))
    rows = rows.withColumn("_d", d).withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, horizon)}) if horizon > 1 else rows.withColumn("_d", d)
    terms = F.var_pop("_d")
    for k in range(1, horizon):
        terms = terms + 2 * (1 - k / horizon) * F.covar_samp("_d", f"_d{k}")
    out = rows.groupBy(key).agg(F.avg("_d").alias("_m"), terms.alias("_v"), F.count("_d").alias("_n"))
    stat = F.when(F.col("_v") > 0, F.col("_m") / F.sqrt(F.when(F.col("_v") > 0, F.col("_v")) / F.col("_n")))
    return out.withColumn("dm", stat).withColumn("p", 2 * (1 - X.norm_cdf(F.abs("dm")))).select(key, "dm", F.when(F.col("dm").isNotNull(), F.col("p")).alias("p"))


def pit_histogram(rows: DataFrame, pit: str, bins: int = 10) -> DataFrame:
    """Shares by bin of [0, 1], the last one closed; values outside stay in the divisor. Empty bins have rows too."""
    v = F.col(pit)
    b = F.when(v.between(0, 1), F.least(F.floor(v * bins).cast("int"), F.lit(bins - 1)))
    counts = rows.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.lit(total)).alias("share"))


def reliability(rows: DataFrame, y: str, quantiles: dict[float, str]) -> DataFrame:
    """Nominal against empirical levels."""
    items = F.explode(F.array(*[F.struct(F.lit(q).alias("nominal"), (F.col(y) <= F.col(c)).cast("double").alias("hit")) for q, c in sorted(quantiles.items())]))
    out = rows.select(items.alias("i")).groupBy(F.col("i.nominal").alias("nominal")).agg(F.avg("i.hit").alias("empirical"))
    return out.withColumn("error", F.abs(F.col("nominal") - F.col("empirical")))


def folds(n: int, splits: int = 5, test: int = 7, gap: int = 1, least: int = 365, expanding: bool = True) -> list[dict]:
    """Row ranges [train_start, train_end) and [test_start, test_end) of each fold; those past the end are dropped."""
    room = n - (least + gap + test)
    step = room // (splits - 1) if splits > 1 else 0
    out = []
    for i in range(splits):
        end = least + gap + test + i * step
        train_end = end - test - gap
        if room >= 0 and end <= n and train_end > 0:
            out.append({"fold": i, "train_start": 0 if expanding else max(0, train_end - least), "train_end": train_end, "test_start": end - test, "test_end": end})
    return out


def fold_rows(series: DataFrame, key: str, order: str, *, splits: int = 5, test: int = 7, gap: int = 1, least: int = 365) -> DataFrame:
    """Each row with the folds that it trains or tests in, per series: fold ranges are computed beside the rows."""
    by = Window.partitionBy(key)
    rows = series.withColumns({"_i": F.row_number().over(by.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(by)})
    room = F.col("_n") - (least + gap + test)
    step = F.floor(room / (splits - 1)).cast("int") if splits > 1 else F.lit(0)
    rows = rows.filter(room >= 0).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    rows = rows.withColumn("_end", least + gap + test + F.col("fold") * step).filter(F.col("_end") <= F.col("_n"))
    part = F.when(F.col("_i") < F.col("_end") - test - gap, "train").when((F.col("_i") >= F.col("_end") - test) & (F.col("_i") < F.col("_end")), "test")
    return rows.withColumn("part", part).filter("part IS NOT NULL").drop("_i", "_n", "_end")


def cross_validate(rows: DataFrame, key: str, predict: Callable[[pd.DataFrame, pd.DataFrame], pd.Series]) -> DataFrame:
    """Metrics of predict(train, test) in each (key, fold) of fold_rows(); a group holds one series, not the table."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        test = pdf[pdf["part"] == "test"]
        e = predict(pdf[pdf["part"] == "train"], test).to_numpy() - test["y"].to_numpy()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "fold": [pdf["fold"].iloc[0]], "mae": [abs(e).mean()], "rmse": [(e**2).mean() ** 0.5], "bias": [e.mean()]})

    return rows.groupBy(key, "fold").applyInPandas(one, f"{key} string, fold int, mae double, rmse double, bias double")


def baselines(series: DataFrame, key: str, order: str, y: str, season: int = 7, width: int = 28) -> DataFrame:
    """Seasonal naive, moving average and drift forecasts of the next row, from the rows before."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w) - 1
    first = F.first(y).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lag(y).over(w)
    return series.withColumns({"seasonal_naive": F.lag(y, season).over(w), "moving_average": F.avg(y).over(w.rowsBetween(-width, -1)), "drift": last + F.try_divide(last - first, n - 1)})


def monitor(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, sharpness and bias with a traffic light for 80 % intervals: green 75 to 85 %, amber 70 to 90 %."""
    out = rows.groupBy(*keys).agg(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("sharpness"), F.avg(F.col("yhat") - F.col("y")).alias("bias"))
    return out.withColumn("light", F.when(F.col("coverage").between(0.75, 0.85), "green").when(F.col("coverage").between(0.70, 0.90), "amber").otherwise("red"))
