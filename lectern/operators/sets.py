"""Comparison of experiments by the keys that they found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, run: str, key: Sequence[str], score: str, tie: Sequence[Column]) -> DataFrame:
    """Of a run's rows with one key, that of the highest score, first on ties."""
    w = Window.partitionBy(run, *key).orderBy(F.col(score).desc_nulls_last(), *tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def presence(df: DataFrame, run: str, key: Sequence[str], runs: Sequence[str]) -> DataFrame:
    """For each key in how many runs it is, and whether in each of them."""
    cells = [F.max((F.col(run) == r).cast("int")).cast("boolean").alias(f"in_{i}") for i, r in enumerate(runs)]
    return df.where(F.col(run).isin(*runs)).groupBy(*key).agg(F.countDistinct(run).alias("n_runs"), *cells)


def stability(df: DataFrame, run: str, key: Sequence[str], runs: int) -> DataFrame:
    """For each key the share of runs that have it, and whether all have it."""
    return df.groupBy(*key).agg((F.countDistinct(run) / F.lit(float(runs))).alias("share")).withColumn("stable", F.col("share") == 1.0)


def pairwise_diff(df: DataFrame, run: str, key: Sequence[str], base: str, other: str) -> DataFrame:
    """Keys of two runs by bucket: only_base, only_other or both."""
    two = df.where(F.col(run).isin(base, other)).groupBy(*key)
    have = two.agg(F.max((F.col(run) == base).cast("int")).alias("b"), F.max((F.col(run) == other).cast("int")).alias("o"))
    bucket = F.when(F.col("o") == 0, "only_base").when(F.col("b") == 0, "only_other").otherwise("both")
    return have.select(*key, bucket.alias("bucket"))
