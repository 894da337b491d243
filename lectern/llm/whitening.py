"""Whitening of embeddings by their leading principal components.

Vectors become whole numbers, floor(STEP * c) + SHIFT; each distinct one counts once in the fit. Sums, and n * x - sum, are
exact. Tasks add up outer products of centred vectors, row by row of the matrix, which is solved once (eigen.py): it has the
size of the dimension, not of the data. Directions and scales are then sent to all tasks (16 vectors), which project every row.

A row counts if its vector is not null and holds no null, no infinite number, no NaN and none whose x isn't within a long.
Where lengths differ, the one with the most rows counts (the longer one of ties), and other rows are left out. Components whose
eigenvalue is zero within rounding have no scale and are left out: a single distinct vector, or none, gives no rows. Rows that
repeat an id or a vector each get their results, null ids too. deviation is null where it exceeds a long.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import Scratch, partitions
from lectern.llm.eigen import EPS, leading_pairs

STEP, SHIFT = 64, 1_000_000
#: The largest dimension: tasks hold a matrix of dimension by dimension (128 MB).
MOST = 4096


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x of the rows that count, of any length."""
    v = F.col("embedding").cast("array<double>")
    fits = F.forall(v, lambda c: F.coalesce(F.abs(c) < (2.0**63 - 2 * SHIFT) / STEP, F.lit(False)))  # false for NaN, which is the largest
    x = F.transform(v, lambda c: F.floor(c * STEP) + F.lit(SHIFT).cast("long"))
    return rows.where(F.col("embedding").isNotNull() & fits).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: longs, or Python's numbers where longs could overflow."""
    if len(x) and max(-int(x.min()), int(x.max())) * n + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(dev: np.ndarray) -> list[int | None]:
    most = int(np.abs(dev).max(initial=0))
    if most * most * dev.shape[1] < 1 << 62:
        dev = dev.astype(np.int64)
        return (dev * dev).sum(1).tolist()
    wide = (dev.astype(object) ** 2).sum(1)
    return [s if s < 1 << 63 else None for s in wide]


def column_sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums by dimension: tasks send high and low halves, so that no sum overflows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column("x"), d)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.record_batch({"i": np.arange(d, dtype=np.int32), "high": high, "low": low})

    halves = fit.select("x").mapInArrow(add, "i int, high long, low long").groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)")))
    return [(int(h) << 32) + int(lo) for _, h, lo in sorted(halves.collect())]  # a row a dimension


def product_sums(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """The sum of y y' over the fit, where `of` makes k numbers y of each x. Each task adds up its own rows and sends the
    matrix by rows, which are added up as they come, wherever that row belongs."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            y = of(_matrix(b.column("x"), d))
            total += y.T @ y
        for i in range(0, k, 64):
            yield pa.record_batch({"i": np.arange(i, min(i + 64, k), dtype=np.int32), "row": pa.array([r.tobytes() for r in total[i : i + 64]], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(b.column("i").to_pylist(), b.column("row").to_pylist(), strict=True):
                rows[i] = rows.get(i, 0.0) + np.frombuffer(r)
        yield pa.record_batch({"i": pa.array(list(rows), pa.int32()), "row": pa.array([r.tobytes() for r in rows.values()], pa.binary())})

    parts = fit.select("x").mapInArrow(products, "i int, row binary")
    out = np.zeros((k, k))
    for i, r in parts.repartition(min(k, partitions(fit.sparkSession)), "i").mapInArrow(add, "i int, row binary").toLocalIterator():  # k rows of k numbers
        out[i] += np.frombuffer(r)
    return (out + out.T) / 2


def whitened(rows: DataFrame, most: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each row that counts and each
    of its `most` leading components."""
    scratch = scratch or Scratch(rows.sparkSession)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(rows)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    if d > MOST:
        raise ValueError(f"vectors have {d} numbers, more than {MOST}")
    rows = rows.where(F.size("x") == d)
    fit = scratch.table(rows.select("x").distinct(), "fit") if d else rows
    n = fit.count() if d else 0
    if n < 2:
        return rows.sparkSession.createDataFrame([], schema)
    sums = column_sums(fit, d)
    mean_free = lambda x: (deviations(x, n, sums) / n).astype(float)
    covariance = product_sums(fit, d, mean_free, d) / n
    trace = float(np.trace(covariance))
    values, axes = leading_pairs(covariance, most)
    kept = values > 4 * d * EPS * max(float(values[0]), 0.0)
    values, axes = values[kept], axes[:, kept]
    k = len(values)
    if k == 0:
        return rows.sparkSession.createDataFrame([], schema)
    scaled = axes / np.sqrt(values)
    error = float(np.abs(product_sums(fit, d, lambda x: mean_free(x) @ scaled, k) / n - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            dev = deviations(_matrix(b.column("x"), d), n, sums)
            m, ids = len(b), np.repeat(np.arange(len(b)), k)
            yield pa.record_batch({
                "vec_id": b.column("vec_id").take(pa.array(ids)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, n, np.int64),
                "deviation": pa.array(_squares(dev), pa.int64()).take(pa.array(ids)), "whitened": ((dev / n).astype(float) @ scaled).ravel(),
                "explained": np.tile(explained, m), "identity_error": np.full(m * k, error),
            })

    return rows.mapInArrow(project, schema)
