"""Aggregates with the exact rules of audit reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import written

#: Parts of a range of values that are counted before any rows are ordered, and the most rows of a part that are then.
BUCKETS, ORDERED = 4096, 1 << 16


def ordered_statistics(df: DataFrame, keys: Sequence[str], value: str, most: int = ORDERED) -> DataFrame:
    """n, mean, upper median v[n // 2] and p95 v[max(0, int(0.95 n) - 1)] of each key's sorted values; nulls don't count.

    Values are counted by part of the key's range, and the part that holds an asked place is cut again by its own range until it
    has few rows or one value, so that neither an outlier nor a value that many rows have brings a key's rows into one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    p95 = F.greatest(F.lit(0), F.floor(F.col("n") * 95 / F.lit(100)).cast("int") - 1)
    places = F.array(F.struct(F.lit("median").alias("_what"), F.floor(F.col("n") / 2).cast("long").alias("_at")), F.struct(F.lit("p95").alias("_what"), p95.cast("long").alias("_at")))
    asked = whole.select(*keys, "_low", "_high", F.col("n").alias("_c"), F.inline(places))
    on = [*keys, "_what"]
    while not (asked := written(asked)).where((F.col("_low") < F.col("_high")) & (F.col("_c") > most)).isEmpty():
        share = (F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
        part = F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("int")
        near = rows.join(asked, list(keys)).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        counts = near.groupBy(*on, "_at", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.sum("_c").over(Window.partitionBy(*on).orderBy("_part")) - F.col("_c")
        counts = counts.withColumn("_before", before).where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_c")))
        asked = counts.select(*keys, "_low", "_high", "_c", "_what", (F.col("_at") - F.col("_before")).alias("_at"))
    plain = asked.where("_low = _high").select(*on, F.col("_low").alias("_v"))
    few = rows.join(asked.where("_low < _high"), list(keys)).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    few = few.withColumn("_i", F.row_number().over(Window.partitionBy(*on).orderBy("_v")) - 1).where("_i = _at").select(*on, "_v")
    found = plain.unionByName(few).groupBy(*keys).agg(*(F.max(F.when(F.col("_what") == w, F.col("_v"))).alias(w) for w in ("median", "p95")))
    return whole.drop("_low", "_high").join(found, list(keys))


def majority(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each key; of equals the one that comes first by position."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), F.min(position).alias("_p"))
    w = Window.partitionBy(*keys).orderBy(F.col("_c").desc(), "_p")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_c", "_p")


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def count_where(name: str, condition: Column) -> Column:
    return F.count_if(condition).alias(name)


def joined_text(df: DataFrame, keys: Sequence[str], order: str, text: str, name: str = "text") -> DataFrame:
    """Texts of each key in order, a space between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(*keys).agg(F.array_join(parts, " ").alias(name))


def interleaved(df: DataFrame, stream: str, order: Sequence[Column]) -> DataFrame:
    """Rows of many streams taken in turn, one of each: `turn` and, within it, the stream."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(stream).orderBy(*order)))


def poor_pages(spans: DataFrame, by: list[str], text: str, least: float = 8.0) -> DataFrame:
    """Pages whose spans have fewer letters than that on average, null spans having none: what a recogniser should read again."""
    quality = F.avg(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))))
    return spans.groupBy(*by).agg(quality.alias("quality")).where(F.col("quality") < least)
