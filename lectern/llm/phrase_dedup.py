"""Substring dedup (operator 8): words covered by long passages that a smaller document has, too.

1. Confirm: `_repeats` gives the runs of 50-word windows that also occur in a smaller document, and where. These places, in
   the smaller documents, are the recurring passages.
2. Compile: a passage's windows are phrases of an Aho-Corasick automaton. Its symbols are grams of ten words, read at every
   tenth word, so that a phrase is five symbols long; a symbol is two letters of an alphabet of sixteen, as `ahocorasick`
   looks through the letters of a node one after the other. Passages are dealt into shards by the document, and the part of it,
   that they are first found in, which bounds an automaton's size and keeps the copies of a document together.
3. Stream: documents are streamed through the automata of the passages that they have something of, cut into portions where
   many go to one shard. The automaton locates every occurrence; each is compared with the passage word by word.
4. A word goes if an occurrence covers it whose passage is from a smaller document.

Documents without a recurring window have nothing that an automaton could locate and skip steps 2 and 3; of the others
only the parts around their runs are sent.

Null texts have no words. A passage that repeats only within one document stays. Null and repeated ids: see `_common`; rows
that repeat an id count as later documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import NOT_SPACE, PLACE_BITS, Scratch, Spans, as_binary, ordered, partitions, pieces, prints, release, words
from lectern.llm._repeats import Kind, by_text, repeats, runs_of, word_symbols
from lectern.llm.suffix_dedup import covered

WINDOW, SEED = 50, 8
#: Words of a symbol of the automata.
STRIDE = 10
#: Phrases of an automaton (some five hundred bytes each), windows of a document that belong together, and documents that
#: one building of an automaton serves.
SHARD, PART, PORTION = 40_000, 4096, 2000
_PLACE = (1 << PLACE_BITS) - 1
#: A symbol that no gram has.
_BETWEEN = 1 << 8


def _union(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with runs: the words of their passages, and of the parts that are to be streamed, for each shard."""
    for rows, data, at in pieces(batches):
        starts, ends, at_word = words(data, at, NOT_SPACE)
        raw = data.tobytes()
        doc, first, more, shard, source = runs_of(rows, "shard", "source")
        order = rows.column("ord").to_pylist()
        group = (doc * 2 + source) * (1 << 31) + shard
        by = np.argsort(group, kind="stable")
        out: list[tuple] = []
        for own in np.split(by, np.flatnonzero(np.diff(group[by])) + 1) if len(by) else ():
            d, s, is_source = int(doc[own[0]]), int(shard[own[0]]), bool(source[own[0]])
            for a, b in _union(first[own], first[own] + more[own]):
                text = raw[starts[at_word[d] + a] : ends[at_word[d] + b + WINDOW - 1]]
                out.append((s, is_source, order[d], a, b" ".join(text.split())))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "source", "ord", "place", "words"])


def _symbols(spans: Spans) -> np.ndarray:
    """The automaton's symbols: eight bits of each gram's fingerprint."""
    return (spans.grams(STRIDE) >> np.uint64(56)).astype(np.int64)


def _letters(symbols: np.ndarray) -> str:
    """Two letters for each symbol."""
    return np.stack([symbols >> 4, symbols & 15], axis=-1).astype(np.uint8).tobytes().decode("latin-1")


class Passages:
    """The automaton of passages: of equal windows that of the smallest document is kept. Different windows that are one
    phrase by their symbols form a group; where it is located, each of them is compared."""

    def __init__(self, of: list[tuple[int, bytes]]):
        self.raw = b" ".join(text for _, text in of)
        text = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends, _ = words(text, np.array([0, len(text)]), NOT_SPACE)
        spans = Spans(prints(text, self.starts, self.ends))
        size = np.array([text.count(b" ") + 1 for _, text in of])
        begin = np.cumsum(size) - size
        n = size - WINDOW + 1
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        order = np.repeat(np.array([o for o, _ in of]), n)
        names = spans.of(window, window + WINDOW)
        by = np.lexsort((order, names))
        keep = by[np.append(True, names[by][1:] != names[by][:-1])]
        keep.sort()
        window, order, grams = window[keep], order[keep], _symbols(spans)
        phrases = np.stack([grams[window + j] for j in range(0, WINDOW, STRIDE)], axis=1)
        by = np.lexsort(phrases.T)
        self.window, self.order, phrases = window[by], order[by], phrases[by]
        heads = np.flatnonzero(np.append(True, (np.diff(phrases, axis=0) != 0).any(axis=1)))
        self.groups = np.append(heads, len(by))
        letters, size = _letters(phrases[heads]), 2 * phrases.shape[1]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in range(len(heads)):
            self.automaton.add_word(letters[i * size : (i + 1) * size], i)
        self.automaton.make_automaton()

    def located(self, orders: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The windows of texts that a passage of a smaller document has: number of the text, and first word in it."""
        data = b"\n".join(texts)
        raw, data = data, np.frombuffer(data, np.uint8)
        size = np.array([len(t) for t in texts])
        at = np.append(0, np.cumsum(size + 1))
        at[-1] -= 1
        starts, ends, first = words(data, at, NOT_SPACE)
        grams = _symbols(Spans(prints(data, starts, ends)))
        # every text's grams in STRIDE sequences, read one after the other; a symbol that isn't a gram goes between
        n = np.maximum(np.diff(first) - STRIDE + 1, 0)
        text = np.repeat(np.arange(len(texts)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        sequence = text * STRIDE + k % STRIDE
        by = np.argsort(sequence, kind="stable")
        cut = np.flatnonzero(np.diff(sequence[by])) + 1
        place = np.insert((first[text] + k)[by], cut, 0)
        symbols = np.insert(grams[first[text] + k][by], cut, _BETWEEN)
        last, group = np.fromiter(chain.from_iterable(self.automaton.iter(_letters(symbols))), np.int64).reshape(-1, 2).T
        whole = last & 1 == 1  # ends with a symbol, not within one
        last, group = last[whole] >> 1, group[whole]
        if not len(last):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = self.groups[group + 1] - self.groups[group]
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.groups[group], n)
        at, window = np.repeat(place[last], n) - (WINDOW - STRIDE), self.window[number]
        of = np.searchsorted(first, at, "right") - 1
        ok = self.order[number] < orders[of]
        by = np.argsort(at[ok], kind="stable")
        of, at, window = of[ok][by], at[ok][by], window[ok][by]
        same = np.zeros(len(at), bool)
        heads = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(window) != 1) | (np.diff(of) != 0)))[: len(at)]
        tails = np.append(heads[1:], len(at))
        ranges = zip(heads.tolist(), tails.tolist(), starts[at[heads]].tolist(), ends[at[tails - 1] + WINDOW - 1].tolist(), self.starts[window[heads]].tolist(), self.ends[window[tails - 1] + WINDOW - 1].tolist(), strict=True)
        for i, j, a, b, c, d in ranges:
            same[i:j] = raw[a:b] == self.raw[c:d]
            if not same[i]:  # some windows may only agree by name
                for x in range(i, j):
                    same[x] = raw[starts[at[x]] : ends[at[x] + WINDOW - 1]] == self.raw[self.starts[window[x]] : self.ends[window[x] + WINDOW - 1]]
        return of[same], (at - first[of])[same]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by portion, passages first: builds each portion's automaton, then locates its phrases in the documents' parts."""
    open_for, sources, those = None, [], None
    for batch in batches:
        portions = batch.column("portion").to_numpy()
        for run in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(portions)) + 1) if len(batch) else ():
            rows = batch.slice(int(run[0]), len(run))
            if portions[run[0]] != open_for:
                open_for, sources, those = portions[run[0]], [], None
            source = rows.column("source")
            own = rows.filter(source)
            sources += zip(own.column("ord").to_pylist(), own.column("words").to_pylist(), strict=True)
            others = rows.filter(pc.invert(source))
            if len(others) and those is None:
                those, sources = Passages(sources), []
            for some, _, _ in pieces(iter([others]), "words", 1 << 18):
                order, place = some.column("ord").to_numpy(), some.column("place").to_numpy()
                of, at = those.located(order, some.column("words").to_pylist())
                if len(at):
                    pos = (order[of] << PLACE_BITS) | (place[of] + at)
                    heads = np.flatnonzero(np.append(True, np.diff(pos) != 1))
                    yield pa.RecordBatch.from_arrays([pa.array(pos[heads]), pa.array((np.diff(np.append(heads, len(pos))) - 1).astype(np.int32))], names=["pos", "more"])
    release()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in pieces(batches):
        starts, ends, first = words(data, at, NOT_SPACE)
        doc, run, more = runs_of(rows)
        gone = covered(len(starts), first[doc] + run, first[doc] + run + more + WINDOW)
        n_removed = np.diff(np.append(0, np.cumsum(gone))[first])
        kept_doc = np.repeat(np.arange(len(rows)), np.diff(first))[~gone]
        a, b = starts[~gone], ends[~gone]
        follows = np.append(False, kept_doc[1:] == kept_doc[:-1])[: len(a)]  # a space goes before
        size = b - a + follows
        out_at = np.append(0, np.cumsum(size))
        source = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - a + follows, size)
        out = data[np.maximum(source, 0)] if len(data) else data
        out[out_at[:-1][follows]] = 0x20
        text_at = out_at[np.searchsorted(kept_doc, np.arange(len(rows) + 1))]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(first)), pa.array(n_removed), as_binary(out, text_at)], names=["doc_id", "n_words", "n_removed", "kept"])


def located(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """pos and more of all runs of windows that a smaller document has. docs: ord, text."""
    found = repeats(docs, Kind(word_symbols, WINDOW, SEED, (16, 4, 1), by_document=True), scratch)
    # cut where the passage's document comes to its next part
    place = F.col("first").bitwiseAND(_PLACE)
    found = found.withColumn("part", F.explode(F.sequence(F.expr(f"div(first & {_PLACE}, {PART})"), F.expr(f"div((first & {_PLACE}) + more, {PART})"))))
    skip, last = F.greatest(F.lit(0).cast("long"), F.col("part") * PART - place), F.least(F.col("more").cast("long"), (F.col("part") + 1) * PART - 1 - place)
    found = found.select((F.col("pos") + skip).alias("pos"), (last - skip).cast("int").alias("more"), (F.col("first") + skip).alias("first"), "part")
    found = scratch.table(found, "passages")
    windows = found.groupBy("first").agg(F.max("more").alias("more")).agg(F.sum(F.col("more") + 1)).first()[0] or 0  # of one passage, those that begin at different places count each
    shard = F.pmod(F.xxhash64(F.shiftright("first", PLACE_BITS), "part"), F.lit(max(1, -(-windows // SHARD)))).alias("shard")
    streamed = found.select("pos", "more", shard, F.lit(0).alias("source"))
    passages = found.select(F.col("first").alias("pos"), "more", shard, F.lit(1).alias("source")).distinct()
    runs = scratch.table(streamed.union(passages), "runs")
    dealt = by_text(runs, docs.select("ord", "text"), "inner").select("ord", "text", "runs").mapInArrow(_deal, "shard long, source boolean, ord long, place long, words binary")
    # how many portions a shard is served in: a row for each shard
    served = runs.where("source = 0").select(F.shiftright("pos", PLACE_BITS).alias("ord"), "shard").distinct().groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PORTION).alias("portions"))
    dealt = dealt.join(served, "shard")
    of = F.when(~F.col("source"), F.array(F.pmod(F.xxhash64("ord"), "portions"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1))
    dealt = dealt.withColumn("portion_no", F.explode(of)).select((F.col("shard") * (1 << 20) + F.col("portion_no")).alias("portion"), "source", "ord", "place", "words")
    dealt = dealt.repartition(partitions(docs.sparkSession), "portion").sortWithinPartitions("portion", F.col("source").desc())
    return scratch.table(dealt.mapInArrow(_stream, "pos long, more int"), "located")


def phrase_dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8: the words that stay, a space between) of each document."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = ordered(docs, scratch)
    out = by_text(located(docs, scratch), docs, "left").select("doc_id", "text", "runs")
    return out.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")
