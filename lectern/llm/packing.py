"""Best-fit packing (operator 9): documents into sequences of a fixed number of tokens.

A document is its token ids and an end id; only one that is longer than a sequence is cut, the first piece taking
what doesn't fill a sequence. Pieces are placed by best-fit decreasing: from the longest on, each goes where the
least room is left that still holds it. Which pieces have the same length doesn't matter to that, so the plan is made
of counts of lengths (as many numbers as a sequence has tokens, whatever the input's size): a segment tree over
the remaining capacities finds the tightest open bins in logarithmic time, and a run of equal pieces is placed at once.
The documents themselves stay where they are: a piece finds its place by its length and its rank among the pieces
of that length, which comes from counts by task.

Null texts are empty and give one piece of the end id. Rows that repeat an id or have none are packed as rows of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._common import NOT_SPACE, Scratch, pieces

SIZE, END = 1024, 2
_PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, local long"
#: The split that byte-level BPE vocabularies of this kind are made with.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of white space, or of anything else, in a row from which `tokenizers` does the work: tiktoken gives up on such runs.
_LONG_RUN = 50_000
_PROBE = "It's  a probe:\n\tÉtat, straße 123 — œuvre　…  'll 漢字 \U0001f600\n\n  end "


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _longest_run(text: str) -> int:
    space = ~NOT_SPACE[np.frombuffer(text.encode(), np.uint8)]
    return int(np.diff(np.flatnonzero(np.concatenate([[True], space[1:] != space[:-1], [True]]))).max())


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to the ids that `tokenizers` gives with the file at path, without special tokens added.

    Byte-level BPE files are read into tiktoken, which gives the same ids several times faster; the two are compared
    on a probe first, and where they differ or the file is of another kind, `tokenizers` itself does the work.
    """
    from tokenizers import Tokenizer

    slow: list = []

    def by_slow(text: str) -> np.ndarray:
        if not slow:
            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    try:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        quick = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        probe = _PROBE + "".join(special) + _PROBE
        same = np.array_equal(quick.encode_to_numpy(probe, allowed_special="all"), by_slow(probe))
        slow.clear()
        if not same:
            return by_slow
    except (ImportError, KeyError, ValueError):  # no tiktoken, or a vocabulary of another kind
        return by_slow

    def by_quick(text: str) -> np.ndarray:
        if len(text) > _LONG_RUN // 4 and _longest_run(text) > _LONG_RUN:
            return by_slow(text)
        return quick.encode_to_numpy(text, allowed_special="all")

    return by_quick


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    encode = encoder(path)
    for rows, data, at in pieces(batches):
        raw = data.tobytes()
        docs: list[int] = []
        piece: list[int] = []
        start: list[int] = []
        ids: list[bytes] = []
        for i, doc in enumerate(rows.column("doc_id").to_pylist()):
            own = np.append(encode(raw[at[i] : at[i + 1]].decode()), np.uint32(end)).astype("<u4", copy=False)
            n = len(own)
            cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
            for k in range(len(cuts) - 1):
                docs.append(doc)
                piece.append(k)
                start.append(cuts[k])
                ids.append(own[cuts[k] : cuts[k + 1]].tobytes())
        length = np.array([len(x) // 4 for x in ids])
        by = np.argsort(length, kind="stable")
        runs = np.flatnonzero(np.diff(length[by], prepend=-1))
        local = np.empty(len(length), np.int64)
        local[by] = np.arange(len(by)) - np.repeat(runs, np.diff(np.append(runs, len(by)))) + seen[length[by]]
        seen += np.bincount(length, minlength=size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), part), pa.int32()), pa.array(local)], names=["doc_id", "piece", "start", "length", "ids", "part", "local"])


def tokenized(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids (little-endian 32-bit), and part and local, which number pieces of one length."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda b: _tokenized(b, path, size, end), _PIECES)


class Capacities:
    """A segment tree over 0..size: for each capacity the open bins that have it left, as runs (first bin, bins)."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, capacity: int) -> None:
        i = self.leaves + capacity
        self.some[i] = bool(self.runs.get(capacity))
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def put(self, capacity: int, first: int, bins: int) -> None:
        if bins and capacity:
            self.runs.setdefault(capacity, []).append((first, bins))
            self._mark(capacity)

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is not below least."""
        i = self.leaves + least
        if not self.some[i]:
            while i > 1 and not (i % 2 == 0 and self.some[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places counts[length] pieces each. Runs: length, first rank, pieces, first bin, pieces of it in each bin, first offset."""
    open_bins, plan, bins = Capacities(size), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = open_bins.tightest(length)
            if capacity is None:
                capacity, first, many = size, bins, -(-left // (size // length))
                bins += many
            else:
                first, many = open_bins.take(capacity)
            each = capacity // length
            full = min(many, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, size - capacity))
                open_bins.put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
                first, many = first + full, many - full
            if many and left:  # fewer than one bin takes
                plan.append((length, rank, left, first, left, size - capacity))
                open_bins.put(capacity - left * length, first, 1)
                first, many, left = first + 1, many - 1, 0
            open_bins.put(capacity, first, many)
    return plan


def placed(pieces: DataFrame, scratch: Scratch, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to tokenized pieces, or to any of their columns with length, part and local."""
    spark = pieces.sparkSession
    rows = scratch.table(pieces, "pieces")
    counts = scratch.table(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    plan = spark.createDataFrame(best_fit(total, size), "length int, rank0 long, many long, bin0 long, each int, offset0 int")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")  # a row for each task and length
    rows = rows.join(counts.select("length", "part", before.alias("earlier")), ["length", "part"])
    rows = rows.withColumn("rank", F.col("earlier") + F.col("local"))
    hit = (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("many"))
    rows = rows.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & hit)
    step = F.col("rank") - F.col("rank0")
    rows = rows.withColumn("sequence_id", F.col("bin0") + F.floor(step / F.col("each"))).withColumn("offset", F.col("offset0") + (step % F.col("each")) * F.col("length"))
    return rows.drop("part", "local", "earlier", "rank", "of", "rank0", "many", "bin0", "each", "offset0")


def pack(docs: DataFrame, path: str, scratch: Scratch | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces with their ids and places: doc_id, piece, start, length, ids, sequence_id, offset."""
    return placed(tokenized(docs, path, size, end), scratch or Scratch(docs.sparkSession), size)
