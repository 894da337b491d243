"""Keyed writes re-expressed as queries over all versions of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], where: Column | None = None) -> DataFrame:
    """The first row of each key in the given order; order must be total for a stable answer."""
    if where is not None:
        df = df.where(where)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def partial_upsert(df: DataFrame, keys: Sequence[str], version: Sequence[str], first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """One row per key: columns `first` keep the value of the earliest version, columns `last` that of the latest."""
    at = F.struct(*version)
    kept = [F.min_by(F.struct(*first), at).alias("_first")] if first else []
    moved = [F.max_by(F.struct(*last), at).alias("_last")] if last else []
    out = df.groupBy(*keys).agg(*kept, *moved)
    return out.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in first), *(F.col(f"_last.{c}").alias(c) for c in last))


def without_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete, or skip what is done already: rows of df whose key isn't in gone."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def recently_done(candidates: DataFrame, log: DataFrame, keys: Sequence[str], done: Column, at: str, now: Column, hours: float) -> DataFrame:
    """candidates with `recent`: has the log a row of the key, done, and not older than some hours?"""
    since = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600))
    hit = log.where(done & (F.col(at) >= since)).select(*keys).distinct().withColumn("recent", F.lit(True))
    return candidates.join(hit, list(keys), "left").withColumn("recent", F.coalesce("recent", F.lit(False)))


def merged_metadata(old: Column, new: Column) -> Column:
    """JSON objects of strings as one; the new one's keys win."""
    kind = "map<string,string>"
    a = F.coalesce(F.from_json(old, kind), F.from_json(F.lit("{}"), kind))
    b = F.coalesce(F.from_json(new, kind), F.from_json(F.lit("{}"), kind))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def fallback(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, and for keys that df doesn't have, the rows of other."""
    return df.unionByName(without_keys(other, df, keys))
