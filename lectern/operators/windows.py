"""Sequences: word windows, segments, clusters, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_windows(df: DataFrame, text: str, size: int = 120, overlap: int = 30) -> DataFrame:
    """Rows of `window` (from 0), first_word, n_words and words: windows of `size` words, each `overlap` into the next.

    The first window that reaches the end is the last. Texts are split once and never shuffled.
    """
    step = size - overlap
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    out = df.withColumn("_words", words).withColumn("_n", F.size("_words")).where("_n > 0")
    last = F.greatest(F.ceil((F.col("_n") - size) / F.lit(float(step))), F.lit(0)).cast("int")
    out = out.withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    part = F.slice("_words", F.col("window") * step + 1, F.lit(size))
    return out.withColumns({"first_word": F.col("window") * step, "words": part}).withColumn("n_words", F.size("words")).drop("_words", "_n")


def segments(df: DataFrame, keys: Sequence[str], order: Sequence, starts: Column, name: str = "segment") -> DataFrame:
    """Numbers runs of rows: a new one begins where `starts` holds (it may use lag over the same order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(starts, F.lit(False)).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def previous(column: str, keys: Sequence[str], order: Sequence) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def clusters(df: DataFrame, keys: Sequence[str], start: str, end: str, tolerance: float, name: str = "cluster") -> DataFrame:
    """Intervals that touch within the tolerance make a cluster: gaps and islands over a running maximum."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return segments(df.withColumn("_reach", reach), keys, [start, end], F.col("_reach").isNotNull() & (F.col(start) > F.col("_reach") + tolerance), name).drop("_reach")


def dominant(df: DataFrame, keys: Sequence[str], cluster: str, weight: str) -> DataFrame:
    """The cluster of each key with most rows, then most weight, then the first."""
    g = df.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"))
    w = Window.partitionBy(*keys).orderBy(F.col("rows").desc(), F.col("weight").desc(), cluster)
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def without_adjacent_repeats(text: Column, limit: int = 1200) -> Column:
    """Lines with single spaces, each only once in a row, cut to a limit."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " ")))
    lines = F.filter(lines, lambda s: s != "")
    kept = F.filter(F.transform(lines, lambda s, i: F.when((i == 0) | (s != F.try_element_at(lines, i)), s)), lambda s: s.isNotNull())
    return F.left(F.array_join(kept, "\n"), F.lit(limit))


def around(df: DataFrame, keys: Sequence[str], order: Sequence, text: str, before: int, after: int, name: str) -> DataFrame:
    """Texts of the rows around each row, in order, as an array."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(name, F.collect_list(text).over(w))


def ranked_in_parts(df: DataFrame, keys: list[str], coarse: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """df with each row's place (from 1) within its key, without bringing a key's rows together.

    coarse: expressions that split a key's rows into parts, in the order of `order`; parts are counted and only their own
    rows are ordered. Keys without a limit to their size need one that grows with them, such as an id divided by a number.
    """
    parts = [f"_part{i}" for i in range(len(coarse))]
    rows = df.withColumns(dict(zip(parts, coarse, strict=True)))
    counts = rows.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, *parts, (F.sum("_n").over(Window.partitionBy(*keys).orderBy(*parts)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*order))
    return rows.withColumn("_own", own).join(counts, [*keys, *parts]).withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_own", "_before", *parts)


def summed_in_parts(df: DataFrame, keys: list[str], coarse: Sequence[Column], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """df with running sums of values within its key, up to and with each row, without bringing a key's rows together.

    coarse: as in ranked_in_parts, so that no row of a part comes before one of an earlier part by `order`. Parts are added up first;
    only a part's own rows are ordered. Without keys the first of several parts is added up by itself, the others within it.
    """
    parts = [f"_part{i}" for i in range(len(coarse))]
    rows = df.withColumns({**dict(zip(parts, coarse, strict=True)), **{f"_v_{n}": v for n, v in values.items()}})
    totals = rows.groupBy(*keys, *parts).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    sums = lambda w: {n: F.coalesce(F.sum(f"_t_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in values}
    if keys or len(parts) == 1:
        totals = totals.select(*keys, *parts, *[c.alias(f"_before_{n}") for n, c in sums(Window.partitionBy(*keys).orderBy(*parts)).items()])
    else:
        whole = totals.groupBy(parts[0]).agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in values])
        whole = whole.select(parts[0], *[c.alias(f"_whole_{n}") for n, c in sums(Window.orderBy(parts[0])).items()])
        within = totals.select(*parts, *[c.alias(f"_within_{n}") for n, c in sums(Window.partitionBy(parts[0]).orderBy(*parts[1:])).items()])
        totals = within.join(whole, parts[0]).select(*parts, *[(F.col(f"_whole_{n}") + F.col(f"_within_{n}")).alias(f"_before_{n}") for n in values])
    own = Window.partitionBy(*keys, *parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_own_{n}": F.sum(f"_v_{n}").over(own) for n in values}).join(totals, [*keys, *parts])
    rows = rows.withColumns({n: F.col(f"_before_{n}") + F.col(f"_own_{n}") for n in values})
    return rows.drop(*parts, *[f"{k}{n}" for n in values for k in ("_v_", "_own_", "_before_")])
