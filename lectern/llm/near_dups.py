"""N-gram Jaccard join (operator 10): exact, by prefix filters under several global orders of the shingles.

A document is the set of its five-word shingles. If two sets are similar enough, their prefixes (the first part under any
global order of shingles) have one in common, under every order. All orders here put rare shingles first, by counts in a
table of fixed size, and break ties differently. Postings are made of the first order's prefixes; a pair must further
pass the size and position bounds, and share prefix shingles under all other orders, before its sets are compared.

Documents with equal sets are one class. Of the links between classes only what components need is looked for:

1. each posting's members are compared with its most promising one, and the links found make components;
2. then all pairs of a posting whose components still differ are compared, so no link between components is missed.

Postings that a large share of all documents are in: a task sends only the head of each of its own postings, and in
the second round members of a posting's largest component are dealt over tasks while the few others visit each part.

Texts without words have an empty set and are linked with nothing; null texts, too. Rows that repeat an id or have none
are documents of their own; a component is named by the doc_id of its first document. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._common import LOWER, NOT_SPACE, Scratch, Spans, marked, mix, ordered, partitions, pieces, prints, release, signed, words
from lectern.llm.components import components

GRAM, SHARE = 5, 75  # words in a shingle; least similarity in hundredths
ORDERS = 3
COUNTERS, ROW = 1 << 23, 1 << 14  # counters of shingles, and those in one row of them
HELD = 1 << 18  # postings that a task sorts at once
PORTION = 1000  # documents compared with one in one go
BLOCK = 4000  # postings of one component's that are looked at together
PARITY = 8  # 64-bit words of a set's parity bits
_STEP = np.array([mix(np.array([7919 * i + 1], np.uint64))[0] for i in range(ORDERS)])


def _counter(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(64 - (COUNTERS - 1).bit_length())).astype(np.int64)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted by text and fingerprint, and where each text's start and end."""
    low = LOWER[data]
    starts, ends, first = words(low, at, NOT_SPACE)
    spans = Spans(prints(low, starts, ends))
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(count - GRAM + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    grams = spans.of(start, np.minimum(start + GRAM, first[doc + 1]))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1]))[: len(doc)]
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(at)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: size, two sums that name its set, and its parity bits; then rows of counters."""
    names = ["ord", "doc_id", "n", "name1", "name2", "parity", "row", "counters"]
    counters = np.zeros(COUNTERS, np.uint32)
    for rows, data, at in pieces(batches):
        prints, at = shingles(data, at)
        np.add.at(counters, _counter(prints), 1)
        sums = [np.append(np.uint64(0), np.cumsum(x))[at] for x in (mix(prints ^ np.uint64(0x5DEECE66D)), mix(prints + np.uint64(0xB5297A4D)))]
        k = len(rows)
        bits = np.zeros(k * PARITY, np.uint64)
        word = np.repeat(np.arange(k) * PARITY, np.diff(at)) + (prints % np.uint64(PARITY)).astype(np.int64)
        np.bitwise_xor.at(bits, word, np.uint64(1) << (prints // np.uint64(PARITY) % np.uint64(64)))
        parity = pa.ListArray.from_arrays(pa.array(np.arange(0, k * PARITY + 1, PARITY), pa.int32()), pa.array(signed(bits)))
        yield pa.RecordBatch.from_arrays([rows.column("ord"), rows.column("doc_id"), pa.array(np.diff(at)), *(pa.array(signed(s[1:] - s[:-1])) for s in sums), parity, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
    parts = counters.reshape(-1, ROW)
    some = np.flatnonzero(parts.any(1))
    k = len(some)
    yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(5)), pa.nulls(k, pa.list_(pa.int64())), pa.array(some.astype(np.int32)), pa.array([zlib.compress(_small(parts[i]), 1) for i in some], pa.binary())], names=names)


def _small(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, raw in zip(batch.column("row").to_pylist(), batch.column("counters").to_pylist(), strict=True):
            raw = zlib.decompress(raw)
            sums[row] = sums.get(row, 0) + np.frombuffer(raw, f"u{len(raw) // ROW}").astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_levels(x) for x in sums.values()], pa.binary())], names=["row", "counters"])


def _levels(counts: np.ndarray) -> bytes:
    """Counts on a logarithmic scale, a byte each."""
    return np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8).tobytes()


def prefixes(prints: np.ndarray, at: np.ndarray, levels: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Under one global order the prefix of each set: its text, shingle and position."""
    n = np.diff(at)
    size = np.where(n > 0, n - -(-SHARE * n // 100) + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((mix(prints ^ _STEP[order]), levels[_counter(prints)], doc))
    place = np.arange(len(prints)) - at[doc]
    inside = place < size[doc]
    return doc[inside], prints[by][inside], place[inside]


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles sets of these sizes have in common at least, if they are linked."""
    return -(-SHARE * (a + b) // (100 + SHARE))


def _heads(at: np.ndarray, new: np.ndarray, order: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For sorted postings that begin at `at`: the member to compare with first, -1 for the head itself and where the bounds rule it out."""
    size = np.diff(np.append(at, len(order)))
    spread = lambda x: np.repeat(x[at], size)
    could = np.minimum(n - place, spread(n) - spread(place)) >= _least_common(n, spread(n))
    return np.where(new | ~could, -1, spread(order))


def _postings(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Prefixes under the first order. Of a task's own postings the head is dealt by shingle, the others evenly with the head named."""
    held: list[list[np.ndarray]] = []
    count = 0

    def rows() -> pa.RecordBatch:
        shingle, order, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((order, place, shingle))
        shingle, order, n, place = shingle[by], order[by], n[by], place[by]
        new = np.append(True, shingle[1:] != shingle[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        key = np.where(new, shingle, signed(mix((order * 31 + place).astype(np.uint64))))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(shingle), pa.array(order), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(_heads(at, new, order, n, place)), pa.array(new), pa.array(new & (np.repeat(size, size) > 1))], names=["key", "shingle", "ord", "n", "place", "head", "top", "many"])

    for batch, data, at in pieces(batches):
        prints, at = shingles(data, at)
        doc, prefix, place = prefixes(prints, at, np.frombuffer(sent.value, np.uint8), 0)
        held.append([signed(prefix), batch.column("ord").to_numpy()[doc], np.diff(at)[doc], place])
        count += len(doc)
        if count > HELD:
            yield rows()
            held, count = [], 0
    if count:
        yield rows()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of two members or more, with heads as in _heads. Sorted by shingle: one batch and an open shingle are held."""
    names = ["shingle", "ord", "n", "place", "head"]
    columns = ("shingle", "ord", "n", "place", "many")
    kept = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, bool)]

    def closed(rows: list[np.ndarray]) -> pa.RecordBatch:
        by = np.lexsort((rows[1], rows[3], rows[0]))
        shingle, order, n, place, many = (x[by] for x in rows)
        new = np.append(True, shingle[1:] != shingle[:-1])[: len(shingle)]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        keep = (np.repeat(size, size) > 1) | many
        head = _heads(at, new, order, n, place)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (shingle, order, n, place, head)], names=names)

    for batch in batches:
        top = batch.column("top").to_numpy(zero_copy_only=False)
        rest = batch.filter(pa.array(~top))
        if len(rest):
            yield pa.RecordBatch.from_arrays([rest.column(c) for c in names], names=names)
        rows = [np.append(x, batch.column(c).to_numpy(zero_copy_only=False)[top]) for x, c in zip(kept, columns, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last shingle may go on
        if last:
            yield closed([x[:last] for x in rows])
        kept = [x[last:] for x in rows]
    if len(kept[0]):
        yield closed(kept)
    release()


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of postings' members whose components differ, by the size and position bounds.

    Sorted by part, then shingle. A part has the postings of one large component and some of its members, so a pair that
    shares many shingles meets in one part and is named once.
    """
    found: set[tuple[int, int]] = set()
    held: list[pa.RecordBatch] = []

    def pairs() -> None:
        part = pa.Table.from_batches(held)
        order, n, place, root, visitor = (part.column(c).to_numpy() for c in ("ord", "n", "place", "root", "visitor"))
        stay = ~visitor
        for i in np.flatnonzero(visitor):
            low = np.minimum(n[i] - place[i], n[stay] - place[stay])
            ok = (root[stay] != root[i]) & (low >= _least_common(n[i], n[stay]))
            found.update((min(int(order[i]), y), max(int(order[i]), y)) for y in order[stay][ok].tolist())

    last = None
    for batch in batches:
        if not len(batch):
            continue
        top, part, shingle = (batch.column(c).to_numpy() for c in ("top", "part", "shingle"))
        for run in np.split(np.arange(len(batch)), np.flatnonzero((np.diff(shingle) != 0) | (np.diff(part) != 0) | (np.diff(top) != 0)) + 1):
            key = (top[run[0]], part[run[0]], shingle[run[0]])
            if last not in (None, key):
                pairs()
                held.clear()
                if len(found) > HELD or key[:2] != last[:2] and len(found) > HELD // 4:
                    yield _pairs(found)
                    found.clear()
            last = key
            held.append(batch.slice(run[0], len(run)))
    if held:
        pairs()
    yield _pairs(found)


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Sorted by portion, the document to compare with first: which of the others it is linked with."""
    levels = np.frombuffer(sent.value, np.uint8)
    target, open_for, number = None, None, None
    for batch, data, at in pieces(batches):
        prints, at = shingles(data, at)
        prefix = []
        for order in range(1, ORDERS):
            doc, p, _ = prefixes(prints, at, levels, order)
            prefix.append((p, np.searchsorted(doc, np.arange(len(batch) + 1))))
        a: list[int] = []
        b: list[int] = []
        portions, own, orders = batch.column("portion").to_pylist(), batch.column("own").to_pylist(), batch.column("ord").to_pylist()
        for i in range(len(batch)):
            mine = prints[at[i] : at[i + 1]]
            firsts = [p[q[i] : q[i + 1]] for p, q in prefix]
            if own[i]:
                target, open_for, number = (mine, [np.sort(f) for f in firsts]), portions[i], orders[i]
            elif portions[i] == open_for:
                theirs, sorted_firsts = target
                least = int(_least_common(np.int64(len(mine)), np.int64(len(theirs))))
                if min(len(mine), len(theirs)) >= least and all(_common(f, s) for f, s in zip(firsts, sorted_firsts, strict=True)) and _common(mine, theirs) >= least:
                    a.append(min(number, orders[i]))
                    b.append(max(number, orders[i]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _common(x: np.ndarray, sorted_y: np.ndarray) -> int:
    at = np.searchsorted(sorted_y, x)
    at[at == len(sorted_y)] = 0
    return int(np.count_nonzero(sorted_y[at] == x)) if len(sorted_y) else 0


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sizes and parity bits allow a link. sets: ord, n, parity.

    A bit is the parity of how many of a set's shingles fall on it, so two sets differ in at least as many shingles as bits;
    linked sets differ in no more than their sizes less twice what they must have in common.
    """
    side = lambda c: sets.select(F.col("ord").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    size = F.col("n_a") + F.col("n_b")
    least = F.ceil(SHARE * size / F.lit(100.0 + SHARE) - 1e-9)
    apart = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    fits = (F.least("n_a", "n_b") >= least) & (apart <= size - 2 * least)
    return both.where(fits).drop("n_a", "n_b", "p_a", "p_b")


def linked(pairs: DataFrame, docs: DataFrame, sent, scratch: Scratch, name: str) -> DataFrame:
    """Those pairs (a, b) that are similar enough. docs: ord, text."""
    pairs = scratch.table(pairs.distinct(), f"{name}-pairs")
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PORTION).alias("portions"))
    visits = pairs.join(many, "b").select(F.col("a").alias("ord"), F.struct(F.col("b").alias("to"), F.pmod(F.xxhash64("a"), "portions").alias("no"), F.lit(False).alias("own")).alias("visit"))
    own = many.select(F.col("b").alias("ord"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("no")).select("ord", F.struct(F.col("ord").alias("to"), "no", F.lit(True).alias("own")).alias("visit"))
    visits = scratch.table(visits.union(own).groupBy("ord").agg(F.collect_list("visit").alias("visits")), f"{name}-visits")
    rows = marked(docs.select("ord", "text"), visits).where("hit").join(visits, "ord").select("ord", "text", F.explode("visits").alias("v"))
    rows = rows.select((F.col("v.to") * (1 << 20) + F.col("v.no")).alias("portion"), F.col("v.own").alias("own"), "ord", "text")
    rows = rows.repartition(partitions(docs.sparkSession), "portion").sortWithinPartitions("portion", F.col("own").desc())
    return scratch.table(rows.mapInArrow(lambda b: _compared(b, sent), "a long, b long"), f"{name}-links")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, in_order: bool = False) -> DataFrame:
    """doc_id, ord, n_shingles, component_id and first (true for the first document of each component).

    in_order: docs is what ordered() gave.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs if in_order else ordered(docs, scratch)
    n_parts = partitions(spark)
    rows = scratch.table(docs.mapInArrow(_sets, "ord long, doc_id long, n long, name1 long, name2 long, parity array<long>, row int, counters binary"), "sets")
    levels = np.zeros((COUNTERS // ROW, ROW), np.uint8)
    added = rows.where("row is not null").select("row", "counters").repartition(min(n_parts, COUNTERS // ROW), "row").mapInArrow(_add_counters, "row int, counters binary")
    for r in added.collect():  # COUNTERS bytes
        levels[r["row"]] = np.frombuffer(r["counters"], np.uint8)
    sent = spark.sparkContext.broadcast(levels.tobytes())

    sets = rows.where("ord is not null").drop("row", "counters")
    classes = scratch.table(sets.where("n > 0").groupBy("n", "name1", "name2").agg(F.min("ord").alias("rep")), "classes")
    members = scratch.table(sets.join(classes, ["n", "name1", "name2"], "left").select("ord", "doc_id", "n", F.coalesce("rep", "ord").alias("rep")), "members")
    reps = members.where("n > 0 and ord = rep").select("ord")
    texts = docs.select("ord", "text")
    copies = members.where("ord <> rep").select("ord")
    # texts that aren't a copy of an earlier one's set; a few copies may stay where numbers share a bit
    single = marked(texts, reps).where("hit").drop("hit") if copies.head(1) else texts
    postings = single.mapInArrow(lambda b: _postings(b, sent), "key long, shingle long, ord long, n int, place int, head long, top boolean, many boolean")
    postings = postings.repartition(n_parts, "key").sortWithinPartitions("shingle").mapInArrow(_joined, "shingle long, ord long, n int, place int, head long")
    postings = scratch.table(postings, "postings")

    # of the heads that a document meets, the two that it shares most prefix shingles with; the second round has all others
    met = possible(postings.where("head >= 0").groupBy(F.col("ord").alias("a"), F.col("head").alias("b")).agg(F.count(F.lit(1)).alias("shared")), sets)
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.col("shared").desc(), "b"))).where("nth <= 2")
    links = linked(met.select("a", "b"), texts, sent, scratch, "first")
    roots = components(links, scratch, "first")
    rooted = postings.join(roots.withColumnRenamed("node", "ord"), "ord", "left").select("shingle", "ord", "n", "place", F.coalesce("root", "ord").alias("root"))
    rooted = scratch.table(rooted, "rooted")
    mixed = rooted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("shingle").agg(F.count(F.lit(1)).alias("roots"), F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("top"))
    mixed = mixed.where("roots > 1").select("shingle", F.col("top.root").alias("top"), "size")
    parts = mixed.groupBy("top").agg(F.ceil(F.sum("size") / BLOCK).alias("parts"))
    mixed = scratch.table(mixed.drop("size").join(parts, "top"), "mixed")
    open_rows = rooted.join(mixed, "shingle")
    fields = ["shingle", "ord", "n", "place", "root"]
    stay = open_rows.select("top", F.pmod(F.xxhash64("ord"), "parts").alias("part"), *fields, F.lit(False).alias("visitor"))
    visit = open_rows.where("root <> top").select("top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *fields, F.lit(True).alias("visitor"))
    pairs = stay.union(visit).repartition(n_parts, "top", "part").sortWithinPartitions("top", "part", "shingle").mapInArrow(_differing, "a long, b long")
    scratch.tidy()
    pairs = possible(scratch.table(pairs.distinct(), "differing"), sets)
    more = linked(pairs, texts, sent, scratch, "second")
    roots = components(links.union(more), scratch, "all").withColumnRenamed("node", "rep")

    out = members.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = members.select(F.col("ord").alias("root"), F.col("doc_id").alias("component_id"))
    out = out.join(names, "root")
    return out.select("doc_id", "ord", F.col("n").alias("n_shingles"), "component_id", (F.col("ord") == F.col("root")).alias("first"))
