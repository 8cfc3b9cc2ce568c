"""Models: closed forms where they exist, MLlib where not."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge_one(rows: DataFrame, keys: list[str], x: str, y: str, alpha: float = 1.0) -> DataFrame:
    """weight and intercept of ridge regression on one predictor, from moments."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    w = n * F.covar_pop(x, y) / (n * F.var_pop(x) + alpha)
    out = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(w.alias("weight"), F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    return out.withColumn("intercept", F.col("_y") - F.col("weight") * F.col("_x")).drop("_x", "_y")


def gradient_boosting(train: DataFrame, features: list[str], label: str, *, rounds: int = 100, depth: int = 5, rate: float = 0.05, seed: int = 42):
    """A fitted pipeline; MLlib's boosting in place of leaf-wise boosting, so fits differ, the use doesn't."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)]).fit(train)


def quantile_forest(train: DataFrame, rows: DataFrame, features: list[str], label: str, levels: list[float], *, trees: int = 20, depth: int = 6, seed: int = 42) -> DataFrame:
    """rows (with id) and a column q_<level> for each level: means over trees of the quantiles in their leaves.

    MLlib has no boosting on quantile loss; a forest's leaves hold the conditional distribution instead.
    """
    pack = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    model = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, leafCol="leaves").fit(pack.transform(train))
    from pyspark.ml.functions import vector_to_array

    place = lambda df: model.transform(pack.transform(df)).select("*", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    leaves = place(train).groupBy("tree", "leaf").agg(*[F.percentile(label, q).alias(f"q_{q}") for q in levels])
    means = place(rows).select("id", "tree", "leaf").join(leaves, ["tree", "leaf"]).groupBy("id").agg(*[F.avg(F.col(f"`q_{q}`")).alias(f"q_{q}") for q in levels])
    return rows.join(means, "id", "left")


def point_and_band(train: DataFrame, rows: DataFrame, features: list[str], label: str, levels: list[float], *, rounds: int = 20, trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """rows (with id) and point by boosting, a quantile for each level, lower and upper: those of the least and greatest level."""
    model = gradient_boosting(train, features, label, rounds=rounds, depth=depth, seed=seed)
    point = model.transform(rows).withColumnRenamed("prediction", "point").drop("features")
    out = quantile_forest(train, point, features, label, levels, trees=trees, depth=depth, seed=seed)
    return out.withColumns({"lower": F.col(f"`q_{min(levels)}`"), "upper": F.col(f"`q_{max(levels)}`")})


def seasonal_regression(train: DataFrame, features: list[str], label: str, alpha: float = 1.0):
    """Trend, Fourier terms and regressors by ridge regression: a fitted pipeline with column prediction."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LinearRegression(labelCol=label, regParam=alpha / max(1, train.count()), elasticNetParam=0.0, standardization=False)]).fit(train)


def importance(model) -> list[tuple[str, float]]:
    """Features of a fitted boosting pipeline by gain, largest first."""
    names, gains = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, gains), strict=True), key=lambda t: (-t[1], t[0]))
