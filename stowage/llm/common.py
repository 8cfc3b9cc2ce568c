"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stowage.functions.shared import cut, new_folder, shared_dir

__all__ = ["ascii_lower", "cut", "cut_and_sum", "new_folder", "shared_dir", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_and_sum(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """cut, with aggregates over df that the same pass takes."""
    seen = Observation()
    return cut(df.observe(seen, *(c.alias(name) for name, c in sums.items()))), seen.get


def ascii_lower(col: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns whose names an operator is about to add (Spark resolves names without regard to case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])
