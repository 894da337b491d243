"""Exact dedup by block naming (operator 4).

A text without its white space is cut into blocks of a fixed number of bytes. Sorting all blocks gives each
distinct one an integer name; then adjacent names are paired, the pairs sorted and named again, until one name
is left of each document. Two texts are equal just if they have as many blocks and the same last name. Names come
from comparing the blocks and pairs themselves; a hash only sets the order in which they are sorted.

Each sort is by (hash, order of the document), so that a block that a third of all documents have is spread over
as many tasks as it needs; names of a block that lies on both sides of a task's edge are joined afterwards, from the
edges alone: the driver gets the name and the SHA-256 of each block whose hash is a task's first or last.

Null texts are empty; all empty texts are one group. Null ids come last in ties, repeated ids are separate rows.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import Scratch, ordered, partitions

BLOCK = 8192
SPACE = b" \t\n\v\f\r"
_BLOCKS = "ord long, doc_id long, n_points long, text_sha256 string, i int, n_blocks int, block binary"


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ord", pa.int64()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("text_sha256", pa.string()), ("i", pa.int32()), ("n_blocks", pa.int32()), ("block", pa.binary())])
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for order, doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            points = len(raw) if raw.isascii() else len(raw.decode())
            bare = raw.translate(None, SPACE)
            n = max(1, -(-len(bare) // size))
            digest = hashlib.sha256(bare).hexdigest()
            for i in range(n):
                rows.append((order, doc, points, digest if i == 0 else None, i, n, bare[i * size : (i + 1) * size]))
            held += len(bare)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _local_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the distinct blocks of a sorted partition. Last come rows without ord: the partition's first and last blocks, and their count."""
    part = TaskContext.get().partitionId()
    count, last = 0, None  # names given so far; the last block
    first_hash, edge_hash = None, None
    firsts: list[tuple[int, int, bytes]] = []
    edges: list[tuple[int, int, bytes]] = []
    for batch in batches:
        if len(batch) == 0:
            continue
        block, hashes = batch.column("block"), batch.column("hash").to_numpy()
        new = np.empty(len(batch), bool)
        new[0] = last is None or block[0].as_py() != last
        new[1:] = pc.not_equal(block.slice(1), block.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
        names = count - 1 + np.cumsum(new)
        if first_hash is None:
            first_hash = int(hashes[0])
        for i in np.flatnonzero(new & (hashes == first_hash)):
            firsts.append((first_hash, int(names[i]), hashlib.sha256(block[int(i)].as_py()).digest()))
        if edge_hash != int(hashes[-1]):
            edge_hash, edges = int(hashes[-1]), []
        for i in np.flatnonzero(new & (hashes == edge_hash)):
            edges.append((edge_hash, int(names[i]), hashlib.sha256(block[int(i)].as_py()).digest()))
        count, last = int(names[-1]) + 1, block[len(batch) - 1].as_py()
        keep = [c for c in batch.schema.names if c not in ("block", "hash")]
        n = len(batch)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.full(n, part), pa.int32()), pa.array(names, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=[*keep, "part", "local", "edge_hash", "edge"])
    if count:
        keep = [f for f in batch.schema if f.name not in ("block", "hash")]
        rows = [*((h, n, b) for h, n, b in {*firsts, *edges}), (None, count, None)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), f.type) for f in keep), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=[*(f.name for f in keep), "part", "local", "edge_hash", "edge"])


def block_hash() -> Column:
    return F.xxhash64("block")


def named(blocks: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """Replaces column block (binary) by name (long): equal for equal blocks only. Needs ord, never null."""
    spark = blocks.sparkSession
    rows = blocks.withColumn("hash", block_hash())
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name != "block")
    rows = rows.repartitionByRange(partitions(spark), "hash", "ord").sortWithinPartitions("hash", "block", "ord")
    rows = scratch.table(rows.mapInArrow(_local_names, f"{keep}, part int, local long, edge_hash long, edge binary"), table)
    # a few rows for each task: how many names it gave, and its blocks that may lie in another task, too
    base, at, alias = [], 0, []
    running, known = None, {}  # the hash that the parts so far end with, and the names of all its blocks
    ends: dict[int, list] = {}
    for r in rows.where("ord is null").select("part", "local", "edge_hash", "edge").collect():
        ends.setdefault(r.part, []).append(r)
    for part in sorted(ends):
        base.append((part, at))
        own = [(r.edge_hash, bytes(r.edge), r.local) for r in ends[part] if r.edge is not None]
        same = {local: known[block] for h, block, local in own if h == running and block in known}
        alias += [(part, local, name) for local, name in same.items()]
        last = max(h for h, _, _ in own)
        if last != running:
            running, known = last, {}
        for h, block, local in own:
            if h == last:
                known.setdefault(block, at + local)
        at += next(r.local for r in ends[part] if r.edge is None)
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    aliases = F.broadcast(spark.createDataFrame(alias, "part int, local long, same long"))
    out = rows.where("ord is not null").join(bases, "part").join(aliases, ["part", "local"], "left")
    return out.withColumn("name", F.coalesce("same", F.col("base") + F.col("local"))).drop("part", "local", "base", "same", "edge", "edge_hash")


def identities(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """ord, doc_id, n_points, text_sha256, n_blocks, name: equal (n_blocks, name) for equal texts only. docs: from ordered()."""
    long = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    cut = docs.select("ord", "doc_id", "text").mapInArrow(lambda b: _cut(b, block), _BLOCKS)
    level = named(cut, scratch, "names-0")
    heads = level.where("i = 0").drop("i")
    done = heads.where("n_blocks = 1")
    more = level.where("n_blocks > 1").select("ord", F.col("i"), "name")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    k = 0
    while most > 1:
        k, most = k + 1, (most + 1) // 2
        pairs = more.groupBy("ord", F.expr("div(i, 2)").cast("int").alias("j")).agg(F.max(F.expr("if(i % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(i % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        more = named(pairs.select("ord", F.col("j").alias("i"), F.concat(long("a"), long("b")).alias("block")), scratch, f"names-{k}")
    if k:
        last = more.select("ord", F.col("name").alias("last"))
        long_ones = heads.where("n_blocks > 1").drop("name").join(last, "ord").withColumnRenamed("last", "name")
        done = done.unionByName(long_ones)
    return done


def exact_dedup(docs: DataFrame, scratch: Scratch | None = None, block: int = BLOCK, in_order: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space), n_points, ord.

    Of equal texts that with the most code points stays, then the first in document order. in_order: docs is what
    ordered() gave.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs if in_order else ordered(docs, scratch)
    rows = scratch.table(identities(docs, scratch, block), "identities")
    groups = rows.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n_points", -F.col("ord"), "doc_id")).alias("top"))
    groups = groups.select("n_blocks", "name", "group_size", (-F.col("top.col2")).alias("keep_ord"), F.col("top.doc_id").alias("keep_id"))
    groups = scratch.table(groups, "groups")  # a join of plain tables can be split where a group is large
    out = rows.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("ord") == F.col("keep_ord")).alias("kept"), "text_sha256", "n_points", "ord")
