"""Documents of many sections as relations of lines, which come from different tables.

A row of such a table has the keys of its document, a path (an array of numbers from 0 up: section, part of it, and so on) and
its own lines. A heading's path begins those of what lies below it, and its lines come first. No document is held in one row or
one task: lines are numbered by parts of their paths, and written in order by ranges. A row's lines stay together until they have
their numbers, so that what is shuffled has a path for each row and not for each line.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import tidy, written

#: How many neighbours on one step of a path are ordered in one part, rows of a document that are ordered as one, and documents longer
#: than that whose keys are sent to all tasks.
SPAN, LONG, BROADCAST = 1024, 16_384, 200_000


def _path(steps: Sequence[Column | int]) -> Column:
    return F.array(*[(c if isinstance(c, Column) else F.lit(c)).cast("long") for c in steps])


def texts(*parts: Column | str | None) -> Column:
    """An array of a row's lines; a null is no line."""
    return F.array(*[c if isinstance(c, Column) else F.lit(c).cast("string") for c in parts])


def lines(df: DataFrame, keys: Sequence[str], path: Sequence[Column | int], own: Column) -> DataFrame:
    """The lines of df's rows (own: an array of texts) at their paths. Nulls in the array are left out."""
    return df.select(*keys, _path(path).alias("path"), own.alias("lines"))


def document(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def headed(sections: DataFrame, below: DataFrame, keys: Sequence[str], path: Sequence[Column | int], some: Column, none: Column) -> DataFrame:
    """Headings of sections, one row each: the lines `some` where any line of `below` lies under the path, else the lines `none`.

    Both may name `_below`, the number of those rows of `below` (lines that are first of theirs). Lines are counted by path, so
    what is folded upwards is one number for each section.
    """
    depth = len(path)
    firsts = below.where(F.try_element_at("lines", F.lit(1)).isNotNull()).groupBy(*keys, F.slice("path", 1, depth).alias("_path")).agg(F.count(F.lit(1)).alias("_below"))
    rows = sections.withColumn("_path", _path(path)).join(firsts, [*keys, "_path"], "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
    return lines(rows, keys, path, F.when(F.col("_below") > 0, some).otherwise(none))


def _placed(doc: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """doc's rows in the order of paths within keys and parts, those of one path as one, with the number of lines before (_own).

    A row's lines are shuffled as one JSON text, about half of what an array of them takes.
    """
    within = Window.partitionBy(*keys, *parts).orderBy("path")
    rows = doc.withColumn("lines", F.to_json("lines"))
    rows = rows.withColumns({"_same": F.collect_list("lines").over(Window.partitionBy(*keys, *parts, "path")), "_last": F.lag("path").over(within)})
    rows = rows.where(~F.col("_last").eqNullSafe(F.col("path")))
    opened = lambda c: F.from_json(c, "array<string>")
    each = F.transform("_same", lambda own: F.filter(F.transform(opened(own), lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"].isNotNull()))
    several = F.transform(F.array_sort(F.flatten(each)), lambda x: x["t"])
    rows = rows.withColumn("lines", F.when(F.size("_same") == 1, F.array_compact(opened(F.col("lines")))).otherwise(several))
    own = F.coalesce(F.sum(F.size("lines").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).select(*keys, *parts, "_own", "lines")


def numbered(doc: DataFrame, keys: Sequence[str], depth: int = 1, span: int = SPAN) -> DataFrame:
    """keys, line (from 1) and text of every line, in the order of paths; rows of one path are taken line by line, then by text.

    A document of at most LONG rows is ordered as it is. Of longer ones lines are counted by the first `depth` steps of their
    paths and by `span` neighbours on the next one; only these parts are ordered. A step that many lines share belongs within the
    depth, one that each line has for itself behind it.
    """
    doc = written(doc.select(*keys, "path", "lines"))  # counted, then ordered
    tidy(doc.sparkSession)
    long = written(doc.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG).select(*keys))
    n = long.count()
    long = F.broadcast(long) if n <= BROADCAST else long
    out = _placed(doc.join(long, [*keys], "left_anti") if n else doc, keys, [])
    if n:
        step = lambda i: F.coalesce(F.try_element_at("path", F.lit(i)), F.lit(-1))
        coarse = [*map(step, range(1, depth + 1)), F.floor(step(depth + 1) / span)]
        parts = [f"_part{i}" for i in range(len(coarse))]
        rows = doc.join(long, [*keys], "left_semi").withColumns(dict(zip(parts, coarse, strict=True)))
        counts = rows.groupBy(*keys, *parts).agg(F.sum(F.size(F.array_compact("lines")).cast("long")).alias("_n"))
        counts = counts.select(*keys, *parts, (F.sum("_n").over(Window.partitionBy(*keys).orderBy(*parts)) - F.col("_n")).alias("_before"))
        rest = _placed(rows, keys, parts).join(counts, [*keys, *parts])
        out = out.unionByName(rest.select(*keys, (F.col("_before") + F.col("_own")).alias("_own"), "lines"))
    out = out.select(*keys, "_own", F.posexplode("lines").alias("_i", "text"))
    return out.select(*keys, (F.col("_own") + F.col("_i") + 1).cast("int").alias("line"), "text")


def digests(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each numbered document: n_lines, n_letters and a digest that depends on all lines and their places."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("line").cast("string"), F.col("text"))), 1, 8), 16, 10).cast("long")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_letters"), F.sum(word).alias("digest"))


def write(doc: DataFrame, key: str, path: str) -> None:
    """Writes each document as text in a folder of its key; a long one has several files, whose names follow its order."""
    order = [key, "path", "text"]
    doc = doc.select(key, "path", F.posexplode("lines").alias("_i", "text")).where("text is not null")
    doc = doc.withColumn("path", F.concat("path", F.array(F.lit(-1).cast("long"), F.col("_i").cast("long"))))
    rows = doc.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(key, F.col("text").alias("value")).write.mode("overwrite").partitionBy(key).text(path)
