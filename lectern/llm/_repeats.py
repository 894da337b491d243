"""Windows of symbols that occur again: sparse suffix arrays in every task, then dealt and refined until all are settled.

A window is `width` consecutive symbols (bytes or words) of one document. Its anchor is the k-gram in it with the least
fingerprint, the leftmost of equals; windows of equal symbols have their anchor at the same place. The windows of a
document that share an anchor are a block: a sampled suffix, cut where its last window ends.

Every task keeps a logarithmic family of sorted suffixes (`Family`). A batch of text gives a new level; the levels are
scanned together where neighbours are equal, and merged while they are of like size. What is left of a task's family is
dealt by (anchor, block), so that a passage that a third of all documents have arrives as a row or so from each task, and
a frequent anchor's different blocks are spread over all tasks.

Two equal blocks have the same windows: all but the first repeat it. Different blocks of one anchor may still have windows
in common. They are cut by the anchor's offset within the window into ranges, each named by what all of its windows share,
and settled in the same way; ranges whose name no other block has are done. The ranges shrink down to single windows, so
whatever the frequency of an anchor, there are few rows for each of its blocks.

Dealing goes by 64-bit fingerprints; two blocks are only held against each other if their anchors agree as well. Positions
hold a document's number and a place of up to 28 bits in it; a longer text is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._common import CHUNK, FILTER_BITS, NOT_SPACE, PLACE_BITS, Scratch, Spans, marked, mix, pieces, prints, signed, words

#: Bytes of sort keys that a task holds before it hands on what is left of its entries.
HELD = 40 << 20
#: Suffixes that get sort keys at once.
ADDED = 1 << 15
_ROWS = "anchor long, block long, pos long, more int, off int, first long, gone boolean"
_NAMES = ["anchor", "block", "pos", "more", "off", "first", "gone"]
_PLACE = (1 << PLACE_BITS) - 1


def byte_symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, at


def word_symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, at, NOT_SPACE)
    return prints(data, starts, ends), first


@dataclass(frozen=True)
class Kind:
    """symbols: from a piece's bytes and text places to symbols, and where each text's start and end. steps: the ranges of
    offsets that blocks are cut into, from wide ones to single windows. by_document: a window that occurs again in the same
    document only doesn't count, and the first occurrences are given, too."""

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    width: int
    k: int
    steps: tuple[int, ...] = (32, 8, 1)
    by_document: bool = False

    @property
    def shift(self) -> int:
        return PLACE_BITS if self.by_document else 0


class Blocks:
    """The blocks of a row of texts: text, first and last window, place of the anchor, fingerprints of anchor and block."""

    def __init__(self, spans: Spans, at: np.ndarray, width: int, k: int):
        grams = spans.grams(k)
        if spans.n < width:
            self.doc = self.first = self.last = self.place = np.zeros(0, np.int64)
            self.anchor = self.block = np.zeros(0, np.uint64)
            return
        low = np.uint64(_PLACE)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        size, most = 1, width - k + 1
        while 2 * size <= most:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < most:
            least = np.minimum(least[: len(least) - (most - size)], least[most - size :])
        place = (least & low).astype(np.int64)
        edges = np.zeros(len(place) + 1, np.int32)  # windows that lie within one text
        long = np.flatnonzero(np.diff(at) >= width)
        np.add.at(edges, at[long], 1)
        np.add.at(edges, at[long + 1] - width + 1, -1)
        inside = np.cumsum(edges[:-1]) > 0
        change = np.ones(len(place) + 1, bool)
        change[1:-1] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
        self.first = np.flatnonzero(change[:-1] & inside)
        self.last = np.flatnonzero(change[1:] & inside)
        self.place = place[self.first]
        self.doc = np.searchsorted(at, self.first, "right") - 1
        self.anchor = grams[self.place]
        self.block = spans.of(self.first, self.last + width)


_HIGH = np.array([(1 << 64) - (1 << 8 * (8 - i)) for i in range(9)], np.uint64)


def suffix_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Per suffix (of `size` bytes, `most` at most) a row of big-endian numbers, whose order is that of the bytes; its size last."""
    columns = -(-most // 8)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 9, np.dtype(">u8"), padded, 0, (1,))
    out = np.empty((len(start), columns + 1), np.uint64)
    for j in range(columns):
        out[:, j] = eights[np.minimum(start + 8 * j, len(data) + 8)].astype(np.uint64) & _HIGH[np.clip(size - 8 * j, 0, 8)]
    out[:, columns] = size
    return out


def sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of numbers, and how many numbers each has in common with the one before it (ties keep their order).

    All are sorted by their first number, then only those that tie by the next one, and so on.
    """
    n, width = rows.shape
    order = np.argsort(rows[:, 0], kind="stable")
    first = rows[order, 0]
    tied = np.append(False, first[1:] == first[:-1])[:n]
    common = tied.astype(np.int64)
    for j in range(1, width):
        at = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(at):
            break
        some = order[at]
        by = np.lexsort((rows[some, j], np.cumsum(~tied[at])))
        order[at] = some[by]
        value = rows[order[at], j]
        same = tied[at]
        same[1:] &= value[1:] == value[:-1]
        tied[at] = same
        common[at[same]] = j + 1
    return order, common


class Family:
    """A logarithmic family of suffix arrays. A new batch is sorted into one; while the youngest level isn't larger, the two
    are scanned together and merged. Of equal suffixes the first stays, the others are lost.

    Suffixes are rows of sort keys, with columns anchor, block, pos, more, off. shift: bits of a position that don't count
    when two are compared (entries that tie all stay). follow: runs of the lost are kept apart by where their first is.
    """

    def __init__(self, shift: int = 0, follow: bool = False):
        self.shift, self.follow, self.levels, self.lost = shift, follow, [], []

    def _scan(self, rows: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        order, common = sorted_suffixes(rows)
        pos, more = columns[2][order], columns[3][order]
        heads = np.flatnonzero(common < rows.shape[1])
        first = np.repeat(np.minimum.reduceat(pos, heads), np.diff(np.append(heads, len(pos))))
        lost = pos >> self.shift > first >> self.shift
        if lost.any():
            self.lost.append((pos[lost], more[lost], first[lost]))
        left = order[~lost]
        return rows[left], [c[left] for c in columns]

    def add(self, rows: np.ndarray, *columns: np.ndarray) -> None:
        if len(rows):
            level = self._scan(rows, list(columns))
            while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
                other = self.levels.pop()
                level = self._scan(np.concatenate([other[0], level[0]]), [np.concatenate(x) for x in zip(other[1], level[1], strict=True)])
            self.levels.append(level)

    def held(self) -> int:
        return sum(x[0].nbytes for x in self.levels)

    def all(self) -> list[np.ndarray]:
        """The columns of all that is left, merged into one level."""
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._scan(np.concatenate([a[0], b[0]]), [np.concatenate(x) for x in zip(a[1], b[1], strict=True)]))
        return self.levels[0][1] if self.levels else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)] * 2

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lost ones so far, as runs of neighbouring windows: first position, how many follow, and where the first occurrence is."""
        if not self.lost:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        pos, more, first = (np.concatenate(x) for x in zip(*self.lost, strict=True))
        self.lost = []
        apart = pos - first if self.follow else np.zeros(len(pos), np.int64)
        order = np.lexsort((pos, apart))
        pos, more, first, apart = pos[order], more[order].astype(np.int64), first[order], apart[order]
        heads = np.flatnonzero(np.append(True, (pos[1:] > (pos + more)[:-1] + 1) | (apart[1:] != apart[:-1])))
        end = np.append((pos + more)[heads[1:] - 1], (pos + more)[-1])
        return pos[heads], (end - pos[heads]).astype(np.int32), first[heads] if self.follow else np.zeros(len(heads), np.int64)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is left, and what is lost with names of no meaning, which deal it evenly. Empties the family."""
        anchor, block, pos, more, off = self.all()
        yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor, block, pos, more, off, np.zeros(len(pos), np.int64), np.zeros(len(pos), bool)))], names=_NAMES)
        self.levels = []
        pos, more, first = self.taken()
        yield pa.RecordBatch.from_arrays([*map(pa.array, (signed(mix(pos.astype(np.uint64))), pos, pos, more, np.zeros(len(pos), np.int32), first, np.ones(len(pos), bool)))], names=_NAMES)


def _parts(n: int) -> list[tuple[int, int]]:
    """Runs of a long row of symbols that are worked on one after the other."""
    return [(a, min(n, a + CHUNK)) for a in range(0, n, CHUNK)] or [(0, 0)]


def block_entries(docs: DataFrame, kind: Kind) -> DataFrame:
    """Entries of all blocks of docs (ord, text), each task's repeats settled already."""
    width, by_bytes = kind.width, kind.symbols is byte_symbols

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(kind.shift, kind.by_document)
        for rows, data, at in pieces(batches):
            if len(data) > _PLACE:
                raise ValueError(f"a text of {len(data)} bytes; places are counted up to {_PLACE}")
            symbols, at = kind.symbols(data, at)
            order = rows.column("ord").to_numpy()
            for low, high in _parts(len(symbols)):  # more than one only where the piece is one long text
                own = symbols[low : min(len(symbols), high + width - 1)]
                places = at if high - low == len(symbols) else np.array([0, len(own)])
                b = Blocks(Spans(own), places, width, kind.k)
                more, off = (b.last - b.first).astype(np.int32), (b.place - b.first).astype(np.int32)
                for i in range(0, len(more), ADDED):  # where symbols repeat at once, nearly each begins a block
                    some = slice(i, i + ADDED)
                    keys = suffix_words(own, b.first[some], more[some] + width, 2 * width - kind.k) if by_bytes else np.stack([b.anchor[some], b.block[some]], axis=1)
                    family.add(keys, signed(b.anchor[some]), signed(b.block[some]), (order[b.doc[some]] << PLACE_BITS) | (low + b.first[some] - places[b.doc[some]]), more[some], off[some])
                    if family.held() > HELD:
                        yield from family.rows()
        yield from family.rows()

    return docs.select("ord", "text").mapInArrow(entries, _ROWS)


def _split(batches: Iterator[pa.RecordBatch], kind: Kind, step: int) -> Iterator[pa.RecordBatch]:
    """Entries of a text's open runs, cut into ranges of `step` offsets of the anchor."""
    width, by_bytes = kind.width, kind.symbols is byte_symbols
    family = Family(kind.shift, kind.by_document)
    for rows, data, at in pieces(batches):
        symbols, at = kind.symbols(data, at)
        order = rows.column("ord").to_numpy()
        doc, first, more, off = runs_of(rows, "off")
        for low, high in _parts(len(symbols)):
            start = at[doc] + first
            here = np.flatnonzero((start >= low) & (start < high))
            base = max(0, low - width)
            own = symbols[base : min(len(symbols), high + 3 * width)]
            spans = Spans(own)
            for i in range(0, len(here), 1 << 14):
                some = here[i : i + (1 << 14)]
                lowest, highest = off[some] - more[some], off[some]
                n = highest // step - lowest // step + 1
                of = np.repeat(np.arange(len(some)), n)
                k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + (lowest // step)[of]  # the range
                hi, lo = np.minimum(highest[of], k * step + step - 1), np.maximum(lowest[of], k * step)
                anchor = (start[some] + off[some] - base)[of]
                begin, last = anchor - hi, np.minimum(k * step + step - 1, width - kind.k)
                shared = signed(mix(spans.of(anchor - k * step, anchor - last + width) + k.astype(np.uint64)))
                size = hi - lo + width
                block = mix(spans.of(begin, begin + size) + (hi * 256 + lo).astype(np.uint64))
                keys = suffix_words(own, begin, size, width + step - 1) if by_bytes else np.stack([shared.view(np.uint64), block], axis=1)
                if by_bytes:
                    keys[:, -1] = hi * 256 + lo
                place = (first[some] + off[some])[of] - hi
                family.add(keys, shared, signed(block), (order[doc[some]][of] << PLACE_BITS) | place, (hi - lo).astype(np.int32), hi.astype(np.int32))
                if family.held() > HELD:
                    yield from family.rows()
    yield from family.rows()


def by_text(rows: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """docs with `runs`: the rows' places (positions without the document's number), `more`, and what other columns they have."""
    run = F.struct(F.col("pos").bitwiseAND(_PLACE).alias("first"), "more", *(c for c in rows.columns if c not in ("pos", "more")))
    runs = rows.groupBy(F.shiftright("pos", PLACE_BITS).alias("ord")).agg(F.collect_list(run).alias("runs"))
    all_docs = marked(docs, rows.select(F.shiftright("pos", PLACE_BITS).alias("ord")))
    out = all_docs.where("hit").drop("hit").join(runs, "ord", how)
    return out if how == "inner" else out.unionByName(all_docs.where("not hit").drop("hit"), allowMissingColumns=True)


def runs_of(rows: pa.RecordBatch, *more: str) -> list[np.ndarray]:
    """Of all runs of a batch's rows: row, first, more, and other columns."""
    runs = rows.column("runs")
    n = pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
    flat = runs.flatten()
    return [np.repeat(np.arange(len(rows)), n), *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "more", *more))]


def _settled(entries: DataFrame, kind: Kind) -> DataFrame:
    """Entries with `gone` set also where an equal one of another task is earlier, and then without names."""
    rows = entries.withColumn("least", F.min("pos").over(Window.partitionBy("anchor", "block")))
    later = ~F.col("gone") & (F.shiftright("pos", kind.shift) > F.shiftright("least", kind.shift))
    gone = F.col("gone") | later
    first = F.when(later & F.lit(kind.by_document), F.col("least")).otherwise(F.col("first"))
    return rows.select(F.when(~gone, F.col("anchor")).alias("anchor"), F.when(~gone, F.col("block")).alias("block"), "pos", "more", "off", first.alias("first"), gone.alias("gone"))


def repeats(docs: DataFrame, kind: Kind, scratch: Scratch) -> DataFrame:
    """pos, more and first of all runs of windows (first place, how many follow) that occur earlier. docs: ord, text."""
    docs = docs.select("ord", "text")
    found, entries = None, block_entries(docs, kind)
    for i, step in enumerate([*kind.steps, None]):
        rows = scratch.table(_settled(entries, kind), f"settled{i}")
        lost = scratch.table(rows.where("gone").select("pos", "more", "first"), f"lost{i}")
        found = lost if found is None else found.unionByName(lost)
        if step is None:
            break
        left = rows.where("not gone")
        shared = left.groupBy("anchor").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("anchor")
        shared = scratch.table(shared, f"shared{i}")
        slot = F.col("anchor").bitwiseAND(FILTER_BITS - 1).alias("ord")
        left = marked(left.select("anchor", "pos", "more", "off", slot), shared.select(slot)).where("hit")
        left = scratch.table(left.join(shared, "anchor", "left_semi").select("pos", "more", "off"), f"open{i}")
        scratch.drop(f"settled{i}")
        scratch.tidy()
        entries = by_text(left, docs, "inner").select("ord", "text", "runs").mapInArrow(lambda b, step=step: _split(b, kind, step), _ROWS)
    return found
