"""Suffix-array dedup (operator 2): bytes covered by long strings that also start earlier.

Texts are UTF-8 bytes. Every task keeps a logarithmic index family over the suffixes it samples (`_repeats.Family`): each
batch of text gets a suffix array, sorted by the suffixes' bytes, which is scanned together with the levels there are for
equal neighbours and merged with those of like size. Suffixes are sampled so that each string of the given length holds
one at a place that its own bytes decide. What is left of each task's family is dealt by names of its suffixes, and those
that begin alike without being equal are cut shorter and settled the same way, down to single strings.

Null texts are empty, and nothing is removed of texts shorter than the length. Null and repeated ids: see `_common`; rows
that repeat an id count as later documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import Scratch, as_binary, ordered, pieces
from lectern.llm._repeats import Kind, by_text, byte_symbols, repeats, runs_of

LENGTH, GRAM = 100, 24


def covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n symbols lie in some run [first, end)."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for rows, data, at in pieces(batches):
        doc, first, more = runs_of(rows)
        gone = covered(len(data), at[doc] + first, at[doc] + first + more + length)
        kept_at = np.append(0, np.cumsum(~gone))[at]
        starts = gone & ~np.append(False, gone[:-1])
        ends = gone & ~np.append(gone[1:], False)
        cuts = at[1:-1][at[1:-1] < len(data)]  # a run ends with its text
        starts[cuts] |= gone[cuts]
        ends[cuts[cuts > 0] - 1] |= gone[cuts[cuts > 0] - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        place = np.searchsorted(starts, at)
        base = np.repeat(at[:-1], np.diff(place))
        spans = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["first", "end"])
        spans = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(at)), spans, as_binary(data[~gone], kept_at)], names=["doc_id", "n_bytes", "spans", "kept"])


def suffix_dedup(docs: DataFrame, scratch: Scratch | None = None, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (first, end: the removed runs of bytes) and kept (the bytes that stay) of each document."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = ordered(docs, scratch)
    found = repeats(docs, Kind(byte_symbols, length, gram), scratch).select("pos", "more")
    out = by_text(found, docs, "left").select("doc_id", "text", "runs")
    return out.mapInArrow(lambda b: _cut(b, length), "doc_id long, n_bytes long, spans array<struct<first:long,end:long>>, kept binary")


def n_removed(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["first"])
