"""Benchmark decontamination (operator 3): one Aho-Corasick automaton over all test items' word windows.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and anything outside ASCII. An item's windows are its
runs of 13 words; a shorter item is one window. The automaton's symbols are words. A document is scanned once: words
that no item has can't be part of an occurrence, so only runs of items' words go through the automaton. Each
occurrence is confirmed word by word, and its place is mapped back to the original text.

The automaton is sent to every task, so its size is checked first: items of more than `most_bytes` of text are dealt
into as many automata as keep to that, and a document's hits from all of them are joined.

Null texts have no words: such documents are clean and such items match nothing. Items without an id have the id
''. An item id that repeats counts once. Repeated or null doc_ids are rows of their own. Without items, nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import LOWER, WORDLIKE, pieces, prints, words

WINDOW = 13
_HITS = "doc_id long, row long, n_words long, runs array<array<long>>, items array<string>, spans array<array<long>>"


def _item_words(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low = LOWER[raw]
    starts, ends, _ = words(low, np.array([0, len(low)]), WORDLIKE)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def _fingerprints(of: list[bytes]) -> np.ndarray:
    at = np.cumsum([0, *map(len, of)])
    return prints(np.frombuffer(b"".join(of), np.uint8), at[:-1], at[1:])


class Items:
    """The automaton of a set of items, and the fingerprints of their words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        split = [(name, _item_words(text)) for name, text in items]
        vocabulary = sorted({w for _, ws in split for w in ws})
        codes = {w: i + 1 for i, w in enumerate(vocabulary)}
        names = _fingerprints(vocabulary)
        self.order = np.argsort(names)
        self.names = names[self.order]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        found: dict[tuple[bytes, ...], set[str]] = {}
        for name, ws in split:
            for i in range(max(1, len(ws) - window + 1)) if ws else ():
                found.setdefault(tuple(ws[i : i + window]), set()).add(name)
        for key, names in found.items():
            self.automaton.add_word(tuple(codes[w] for w in key), (key, names))
        self.shortest = min(map(len, found), default=0)
        if found:
            self.automaton.make_automaton()

    def codes(self, names: np.ndarray) -> np.ndarray:
        """The items' codes of words, 0 for words that none has."""
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.order[at] + 1, 0)


def _union(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan(batches: Iterator[pa.RecordBatch], sent, window: int) -> Iterator[pa.RecordBatch]:
    those = Items(sent.value, window)
    for rows, data, at in pieces(batches):
        low = LOWER[data]
        starts, ends, first = words(low, at, WORDLIKE)
        n = len(rows)
        runs: list[list] = [[] for _ in range(n)]
        names: list[set] = [set() for _ in range(n)]
        spans: list[list] = [[] for _ in range(n)]
        if those.shortest and len(starts):
            codes = those.codes(prints(low, starts, ends))
            doc = np.repeat(np.arange(n), np.diff(first))
            known = codes > 0
            cut = np.empty(len(codes), bool)
            cut[0] = True
            cut[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
            heads = np.flatnonzero(cut)
            tails = np.append(heads[1:], len(codes))
            for a, b in zip(heads, tails, strict=True):
                if known[a] and b - a >= those.shortest:
                    for last, (key, own) in those.automaton.iter(tuple(codes[a:b].tolist())):
                        e = a + last + 1
                        s = e - len(key)
                        if all(low[starts[s + j] : ends[s + j]].tobytes() == w for j, w in enumerate(key)):
                            runs[doc[a]].append([int(s - first[doc[a]]), int(e - first[doc[a]])])
                            names[doc[a]] |= own
            for i in range(n):
                if runs[i]:
                    runs[i] = _union(runs[i])
                    points = np.cumsum((data[at[i] : at[i + 1]] & 0xC0) != 0x80)  # code points up to and with each byte
                    for a, b in runs[i]:
                        head, tail = starts[first[i] + a] - at[i], ends[first[i] + b - 1] - at[i]
                        spans[i].append([int(points[head]) - 1, int(points[tail - 1])])
        longs = pa.list_(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("row"), pa.array(np.diff(first), pa.int64()), pa.array(runs, longs), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(spans, longs)],
            names=["doc_id", "row", "n_words", "runs", "items", "spans"],
        )


def _joined(runs: str) -> Column:
    """_union of a column of runs, in the JVM."""
    some = F.array().cast("array<array<long>>")

    def add(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        apart = (F.size(out) == 0) | (r[0] > F.try_element_at(out, F.lit(-1))[1])
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(last[0], F.greatest(last[1], r[1]))))
        return F.when(apart, F.concat(out, F.array(r))).otherwise(longer)

    return F.aggregate(F.array_sort(runs), some, add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = 16 << 20, key: str | None = None) -> DataFrame:
    """doc_id, row, n_words, n_hit, n_items, items (sorted ids), spans (from, to in code points of the text), contaminated.

    Contaminated: words are hit, and at least one in twenty. row: the long column `key`, or else a number of no meaning.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // most_bytes))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(key) if key else F.monotonically_increasing_id()).alias("row"), "text")
    hits = None
    for k in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # most_bytes, give or take a hash's evenness
        one = docs.mapInArrow(lambda b, sent=sent: _scan(b, sent, window), _HITS)
        hits = one if hits is None else hits.unionByName(one)
    if shards > 1:
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        hits = hits.groupBy("doc_id", "row").agg(F.first("n_words").alias("n_words"), flat("runs"), flat("items"), flat("spans"))
        hits = hits.withColumns({"runs": _joined("runs"), "spans": _joined("spans"), "items": F.array_sort(F.array_distinct("items"))})
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    out = hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("runs")

