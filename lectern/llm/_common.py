"""What the operators share: scratch tables, document order, and text as arrays of symbols.

Documents are any DataFrame with `doc_id` and `text`; further columns are ignored, whatever their names.
A null text counts as empty. A document's order is its doc_id; null ids come last, and rows that repeat
an id are documents of their own, in the order of their texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a packed position that hold the place within a document.
PLACE_BITS = 28
#: Bytes of text that are worked on at once; one longer document makes a larger piece.
CHUNK = 1 << 19


class Scratch:
    """Tables of one run below the folder that driver and executors share."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="lectern-")  # one machine only
            spark.conf.set("spark.checkpoint.dir", root)
        self.folder = f"{root.rstrip('/')}/lectern-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write and reread: what follows no longer depends on how df was made."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def tidy(self) -> None:
        """Lets Spark delete the shuffles of plans that are done with: they go once neither Python nor the JVM refers to them."""
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(docs: DataFrame, scratch: Scratch, whole: bool = False) -> DataFrame:
    """Columns ord, doc_id, text, and if asked for `row`, a struct of all that docs has.
    ord: a number from 0 that follows the document order and fits 35 bits.

    Where ids are unique, not null and span fewer than 2**35 numbers, it is doc_id less the smallest one,
    which costs no shuffle of texts; else the rows are sorted and numbered.
    """
    more = ["row"] if whole else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *([F.struct(*docs.columns).alias("row")] if whole else []))
    n, some, low, high = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if n == 0:
        return docs.select(F.col("doc_id").alias("ord"), "doc_id", "text", *more)
    if some == n and high - low < 1 << 35 and not docs.groupBy("doc_id").count().where("count > 1").head(1):
        return docs.select((F.col("doc_id") - low).alias("ord"), "doc_id", "text", *more)
    key = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = docs.repartitionByRange(partitions(docs.sparkSession), *key[:2], F.rand(7)).sortWithinPartitions(*key)
    rows = scratch.table(rows.withColumn("m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("m", 33)
    firsts, at = {}, 0
    for p, c in sorted(rows.groupBy(part.alias("p")).count().collect()):
        firsts[p], at = at, at + c
    first = F.element_at(F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv]), part)
    return rows.select((first + F.col("m").bitwiseAND((1 << 33) - 1)).cast("long").alias("ord"), "doc_id", "text", *more)


#: Bits of a filter by document number: 16 MB, whatever the number of documents.
FILTER_BITS = 1 << 27


def marked(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """docs with `hit`: false only for documents whose ord isn't among chosen's.

    A bitmap of fixed size is sent to all tasks, so that most texts that a join would drop aren't shuffled for it.
    Beyond that many documents, numbers share bits and more documents are hit.
    """

    def slot(of: DataFrame) -> Column:
        return F.when(F.col("ord") < FILTER_BITS, F.col("ord")).otherwise(F.xxhash64("ord").bitwiseAND(FILTER_BITS - 1))

    bits = chosen.select(slot(chosen).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    table = bits.groupBy(F.shiftright("word", 9).alias("of_slots")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(511), "bits"))).alias("words"))
    table = table.select("of_slots", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(511).cast("long")), lambda i: F.coalesce(F.col("words")[i], F.lit(0).cast("long"))).alias("words"))
    out = docs.withColumn("slot", slot(docs))
    out = out.join(F.broadcast(table), F.shiftright("slot", 15) == F.col("of_slots"), "left")
    hit = F.expr("getbit(words[cast(shiftright(slot, 6) & 511 as int)], cast(slot & 63 as int)) = 1")
    return out.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("slot", "of_slots", "words")


def without(docs: DataFrame, dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs (from ordered(whole=True), as they came) whose ord isn't among dropped's."""
    dropped = scratch.table(dropped.select("ord"), "dropped")
    all_docs = marked(docs.select("ord", "row"), dropped)
    left = all_docs.where("hit").join(dropped, "ord", "left_anti")  # few texts are shuffled
    return all_docs.where("not hit").select("row.*").unionByName(left.select("row.*"))


# -- texts as arrays -------------------------------------------------------------------------------------------------


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the places (n + 1) where its values start and end. Null: empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def release() -> None:
    """Gives memory that a task no longer uses back to the system: workers stay for many tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in runs of about `most` bytes of text: the rows, their texts' bytes, where each text starts and ends."""
    for batch in batches:
        data, at = string_parts(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last
    release()


def _class(inside: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


#: Which bytes belong to words: all but white space; or digits, a-z and whatever isn't ASCII (after lower-casing).
NOT_SPACE = ~_class(b" \t\n\v\f\r")
WORDLIKE = _class(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and where each text's words start and end among them (n + 1)."""
    is_in = np.zeros(len(data) + 1, bool)
    is_in[:-1] = inside[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = is_in[:-1]
    cuts = at[1:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[cuts] = True
    starts = np.flatnonzero(is_in & (~before | cut))
    ends = np.flatnonzero(before & (~is_in | cut))
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_ODD = np.uint64(0x5851F42D4C957F2D)
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # masks of the first i bytes of eight
#: Longer runs of bytes are fingerprinted one by one.
_SHORT = 64


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One fingerprint of two in a row: not a sum of them, as the high bits go into the low ones before they are multiplied."""
    x = a * _ODD
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as little-endian numbers; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 9, np.dtype("<u8"), padded, 0, (1,))


def prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of runs of bytes, of any length: eight bytes at a time, each step a mix of all before.

    Nothing is summed over places, so that no pattern of the bytes makes two runs agree; runs of up to eight bytes and the
    same length never do.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _ODD + np.uint64(0x2545F4914F6CDD1D))
    eights, done = _eights(data), 0
    live = np.flatnonzero((size > 0) & (size <= _SHORT))
    while len(live):
        left = size[live] - done
        out[live] = mix(out[live] * _ODD ^ (eights[starts[live] + done] & _LOW[np.minimum(left, 8)]))
        live, done = live[left > 8], done + 8
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


class Spans:
    """64-bit fingerprints of spans of a row of symbols: bytes, or 64-bit names. Level k holds those of all spans of 2**k
    symbols, each made of two of the level below; any other span is two of these that overlap, and its length."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.bytes = _eights(symbols) if symbols.dtype == np.uint8 else None
        self.levels: dict[int, np.ndarray] = {} if symbols.dtype == np.uint8 else {0: mix(symbols + _ODD)}

    def level(self, k: int) -> np.ndarray:
        have = self.levels.get(k)
        if have is None:
            m, half = max(self.n - (1 << k) + 1, 0), 1 << k >> 1
            if self.bytes is not None and k <= 3:
                have = mix((self.bytes[:m] & _LOW[1 << k]) + np.uint64((k + 1) * int(_ODD) & (1 << 64) - 1))
            else:
                have = join(self.level(k - 1)[:m], self.level(k - 1)[half : half + m])
            self.levels[k] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        top = np.frexp(n.astype(float))[1] - 1  # the largest power of two that fits
        out = np.zeros(len(n), np.uint64)
        for k in np.unique(top[n > 0]).tolist():
            here = np.flatnonzero((top == k) & (n > 0))
            level = self.level(k)
            out[here] = join(level[start[here]], level[end[here] - (1 << k)])
        return mix(out + n.astype(np.uint64) * _ODD)

    def grams(self, k: int) -> np.ndarray:
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        level, size = self.level(k.bit_length() - 1), 1 << (k.bit_length() - 1)
        out = join(level[:m], level[k - size : k - size + m])
        out ^= out >> np.uint64(29)
        out *= _ODD
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column of consecutive runs of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
