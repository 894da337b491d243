"""Balanced, contiguous shards: prefix sums of sizes over all documents, cut at equal targets.

A document's size is what it takes in a file: the UTF-8 bytes of its text and a length of 8 bytes. In the document order
(doc_id, null last; rows of one id by size and checksum) the range of bytes from s to s + size lies at its middle's shard,
so shards follow the order, and each differs from an equal share by at most the size of one document. Sums are exact longs.

Null text: no bytes, size 8. Rows that repeat an id or a text are rows of their own. A table of fewer documents than shards
leaves some empty; an empty table gives no rows. Other columns are ignored, whatever their names.
Only (id, size, checksum) is shuffled, never a text: the rows are dealt by ranges of the order, each range adds up its own
sizes, and one total a range makes the sums global.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._common import Scratch, partitions

#: Bytes of a document besides its text.
FRAME = 8


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32: one row for each of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(FRAME).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"))


def placed_bytes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """measured() rows with `place`, their number in the document order, and `start`, the sizes of all before."""
    rows = scratch.table(rows.withColumn("read", F.monotonically_increasing_id()), "measured")  # `read` splits rows that are alike
    order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32"), F.col("read")]
    parts = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id())
    parts = scratch.table(parts, "parts")
    totals = parts.groupBy("part").agg(F.sum("size").alias("sizes"), F.count(F.lit(1)).alias("n"))  # one row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(f"{c}_before") for c in ("sizes", "n")])
    within = Window.partitionBy("part").orderBy(*order)
    parts = parts.withColumns({"upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(within)})
    return parts.join(F.broadcast(totals), "part").select(  # as many rows as there are shuffle partitions
        "doc_id", "size", "text_crc32", (F.col("sizes_before") + F.col("upto") - F.col("size")).alias("start"), (F.col("n_before") + F.col("nth") - 1).alias("place")
    )


def sharded(docs: DataFrame, shards: int = 24, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (its place there, from 0) of all docs."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.table(placed_bytes(measured(docs), scratch), "placed")
    total = rows.agg(F.sum("size")).first()[0] or 1
    middle = 2 * F.col("start") + F.col("size")
    if total < (1 << 62) // (2 * shards):
        shard = F.expr(f"(2 * start + size) * {shards}L div {2 * total}L")
    else:  # beyond 2**62 / 48 bytes longs don't hold the product
        shard = F.floor(middle.cast("decimal(20,0)") * F.lit(shards).cast("decimal(10,0)") / F.lit(2 * total).cast("decimal(20,0)"))
    rows = rows.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
    firsts = rows.groupBy("shard").agg(F.min("place").alias("first"))  # at most a row a shard
    return rows.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
