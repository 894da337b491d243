"""Language-model scoring (operator 5): a Brown class-based bigram model, its classes found by exchange.

The probability of a token is that of its class after the class before it, times that of the token within its class.
Counts of words cover all training texts. Every word of the training texts is an item of the exchange, in two stages.
First words are typed: the most frequent ones (`OWN`) are types of their own, all others start with the words that end
alike. Each round counts, in Spark, the classes to the left and right of every type over all training texts, and then
tries every type in every class, taking the move that raises the likelihood of the class bigrams most. A round gives the
driver types x classes numbers, whatever the input's size. Then all words that share a type move by themselves: their
neighbours' classes are counted word by word, and tasks take each word's best class against the bigrams of the round
before (a batched exchange). The table of words and classes is joined to the texts. Words that no training text has
take the class that most tokens of training words with their ending have. A round of words that doesn't raise the
likelihood isn't taken, except the first.

Counts of the most frequent words (at most `SENT`, 24 bytes each) are sent to all tasks; those of all others are joined.
The classes don't depend on that limit, but for the words of their own in the first stage.

Null texts are empty: one end token. Null ids count as the text '' when folds are dealt, repeated ids are rows of their
own. Without training rows all words are unknown and both scores follow from the same formulas with N = 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import LOWER, NOT_SPACE, Scratch, as_binary, mix, ordered, partitions, pieces, prints, signed, words
from lectern.llm.quality import bucket

OWN, SHAPES, CLASSES, ROUNDS, SENT = 8191, 4096, 48, 5, 1 << 19
WORD_ROUNDS = 2  # at most as many as rounds of types
#: Added to counts within a class, as in the base score; weight of the class's own share in its bigrams.
ADD, BACK_OFF = 0.5, 20.0
TYPES = OWN + 1 + SHAPES  # words of their own, the end, shapes
END_TYPE = OWN
BLOCK = 64  # types in a row of counts
_ENCODED = "ord long, doc_id long, held_out boolean, n_tokens long, known long, sum double, types binary, others binary, rare array<long>, times array<int>"
_ASSIGNED = "word long, class int, n long, frequent boolean"


def word_ids(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of words; the last 12 bits tell how the word ends."""
    shape = prints(low, np.maximum(starts, ends - 3), ends) % np.uint64(SHAPES)
    return (prints(low, starts, ends) & ~np.uint64(SHAPES - 1)) | shape


#: The end's name: no word is a space.
END = int(signed(mix(np.array([0x20], np.uint64)))[0])


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, each text's followed by END, and where each text's start and end."""
    low = LOWER[data]
    starts, ends, first = words(low, at, NOT_SPACE)
    ids = signed(word_ids(low, starts, ends))
    return np.insert(ids, first[1:], END), first + np.arange(len(first))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["word", "n"])

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return ids, np.bincount(at, np.concatenate([p[1] for p in parts]), len(ids)).astype(np.int64)

    parts, held = [], 0
    for _, data, at in pieces(batches, most=1 << 21):
        parts.append(np.unique(_tokens(data, at)[0], return_counts=True))
        held += len(parts[-1][0])
        if held > 1 << 20:
            parts = [summed(parts)]
            held = len(parts[0][0])
            if held > 1 << 20:
                yield rows(*parts[0])
                parts, held = [], 0
    if parts:
        yield rows(*summed(parts))


def _within(ids: np.ndarray, doc: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each id of a document its place in the document's part of flat, which holds it, sorted."""
    names = np.unique(flat)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = of * len(names) + np.searchsorted(names, flat)
    return np.searchsorted(keys, doc * len(names) + np.searchsorted(names, ids)) - first[doc]


def _encode(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    names, counts, own = sent.value  # sorted names of frequent words, their counts, and their type or -1
    logs = np.log10(counts + ADD)
    for rows, data, at in pieces(batches):
        ids, first = _tokens(data, at)
        n = len(rows)
        doc = np.repeat(np.arange(n), np.diff(first))
        place = np.minimum(np.searchsorted(names, ids), len(names) - 1) if len(names) else np.zeros(len(ids), np.int64)
        frequent = names[place] == ids if len(names) else np.zeros(len(ids), bool)
        types = (OWN + 1 + (ids & (SHAPES - 1))).astype("<u2")
        single = frequent & (own[place] >= 0) if len(names) else frequent
        types[single] = own[place[single]] if len(names) else 0
        types[first[1:] - 1] = END_TYPE
        rare, times = [], []
        odd = ~frequent
        odd_ids, odd_first = ids[odd], np.searchsorted(doc[odd], np.arange(n + 1))
        for i in range(n):
            own_ids, own_times = np.unique(odd_ids[odd_first[i] : odd_first[i + 1]], return_counts=True)
            rare.append(own_ids)
            times.append(own_times.astype(np.int32))
        raw = types.tobytes()
        # the words that share a type: their places among the frequent ones, or -1 less that in the text's rare ones
        shared = np.flatnonzero(types > END_TYPE)
        others = place[shared].astype("<i4")
        flat = np.concatenate(rare) if rare else np.zeros(0, np.int64)
        rare_first = np.cumsum([0, *map(len, rare)])
        infrequent = np.flatnonzero(~frequent[shared])
        others[infrequent] = -1 - _within(ids[shared[infrequent]], doc[shared[infrequent]], flat, rare_first)
        shared_first = np.searchsorted(shared, first)
        raw_others = others.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("ord"), rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(first)),
                pa.array(np.bincount(doc[frequent], minlength=n).astype(np.int64)), pa.array(np.bincount(doc[frequent], logs[place[frequent]] if len(names) else None, n).astype(float)),
                pa.array([raw[2 * a : 2 * b] for a, b in zip(first, first[1:], strict=False)], pa.binary()), pa.array([raw_others[4 * a : 4 * b] for a, b in zip(shared_first, shared_first[1:], strict=False)], pa.binary()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())),
            ],
            names=["ord", "doc_id", "held_out", "n_tokens", "known", "sum", "types", "others", "rare", "times"],
        )


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all values of a binary column in a row, and where each value's start."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), (at[:-1] - at[0]) // np.dtype(kind).itemsize


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Types of all texts of a batch in a row, and where each text's start."""
    return _numbers(batch.column("types"), "<u2")


def _before(types: np.ndarray, starts: np.ndarray, end: int = END_TYPE) -> np.ndarray:
    """The type (or class) before each token; a text's first token follows an end."""
    out = np.empty_like(types)
    out[1:] = types[:-1]
    out[starts] = end
    return out


def _others(batch: pa.RecordBatch, types: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that share a type: where they are, their places among the frequent words, or (-1) in all rare words of the batch,
    and these words."""
    at = np.flatnonzero(types > END_TYPE)
    others, _ = _numbers(batch.column("others"), "<i4")
    column = batch.column("rare")
    flat = np.asarray(column.flatten()).astype(np.int64)
    lengths = np.array(column.value_lengths(), np.int64)
    doc = np.searchsorted(starts, at, "right") - 1
    rare = np.where(others < 0, -1 - others + (np.cumsum(lengths) - lengths)[doc], -1)
    return at, np.maximum(others, -1), rare, flat


def contexts(texts: DataFrame, classes: np.ndarray, sent) -> DataFrame:
    """Of all words that share a type, over all training texts: word, and pairs of 32-bit numbers, key (frequent, the word's class,
    the class before, the class after) and how often."""
    end = int(classes[END_TYPE])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value[0]
        for whole in batches:
            for i in range(0, len(whole), 4096):
                batch = whole.slice(i, 4096)
                types, starts = _texts(batch)
                of = classes[types] if "classes" not in batch.schema.names else _numbers(batch.column("classes"), "<u1")[0]
                at, place, rare, flat = _others(batch, types, starts)
                word = np.empty(len(at), np.int64)
                word[place >= 0] = names[place[place >= 0]]
                word[place < 0] = flat[rare[place < 0]]
                before = _before(of, starts, end)
                key = (((place >= 0) * CLASSES + of[at]) * CLASSES + before[at]) * CLASSES + of[at + 1]  # the end is the last
                some, number = np.unique(word, return_inverse=True)
                keys, n = np.unique(number * (2 * CLASSES**3) + key, return_counts=True)
                raw = np.stack([keys % (2 * CLASSES**3), n], axis=1).astype("<i4")
                ends = 8 * np.searchsorted(keys, np.arange(len(some) + 1) * (2 * CLASSES**3))
                yield pa.RecordBatch.from_arrays([pa.array(some), as_binary(raw.view(np.uint8).ravel(), ends)], names=["word", "seen"])

    columns = [c for c in ("types", "others", "rare", "classes") if c in texts.columns]
    return texts.where("not held_out").select(*columns).mapInArrow(count, "word long, seen binary")


def best_classes(group: np.ndarray, key: np.ndarray, n: np.ndarray, pairs: np.ndarray, total: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For words (numbers from 0, in order) with the keys and counts of their contexts: their best classes, and their counts."""
    k, before, after = key // CLASSES**2 % CLASSES, key // CLASSES % CLASSES, key % CLASSES
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    current, size = k[heads], np.add.reduceat(n, heads)
    codes, at = np.unique(np.concatenate([group * 2 * CLASSES + before, (group * 2 + 1) * CLASSES + after]), return_inverse=True)
    times = np.bincount(at, np.concatenate([n, n]))
    of, side = codes // (2 * CLASSES), codes % (2 * CLASSES)
    # by neighbour and count, for all classes
    beside = np.concatenate([pairs, pairs.T])
    kinds, kind = np.unique(times.astype(np.int64) * 2 * CLASSES + side, return_inverse=True)
    near, x = beside[kinds % (2 * CLASSES)], (kinds // (2 * CLASSES))[:, None]
    more, less = _f(near + x) - _f(near), _f(near) - _f(np.maximum(near - x, 0))
    gain = np.add.reduceat(more[kind], np.flatnonzero(np.diff(of, prepend=-1)), axis=0) - 2 * (_f(total + size[:, None]) - _f(total))
    stay = np.bincount(of, less[kind, current[of]], len(size)) - 2 * (_f(total[current]) - _f(total[current] - size))
    gain[np.arange(len(size)), current] = stay
    gain[:, end] = -np.inf
    return np.argmax(gain, 1), size


def assigned(seen: DataFrame, pairs: np.ndarray, end: int, move: bool = True) -> DataFrame:
    """From contexts, each word's class after a round: the best one by itself, all others being where they were."""
    total = pairs.sum(1)

    def settle(word: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        for i in range(0, len(heads), 1024):
            a, b = heads[i], heads[i + 1024] if i + 1024 < len(heads) else len(word)
            some = heads[i : i + 1024]
            group = np.repeat(np.arange(len(some)), np.diff(np.append(some, b)))
            to, size = best_classes(group, key[a:b], n[a:b], pairs, total, end)
            to = to if move else key[some] // CLASSES**2 % CLASSES
            yield pa.RecordBatch.from_arrays([pa.array(word[some]), pa.array(to.astype(np.int32)), pa.array(size.astype(np.int64)), pa.array(key[some] >= CLASSES**3)], names=["word", "class", "n", "frequent"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if len(batch) == 0:
                continue
            flat, starts = _numbers(batch.column("seen"), "<i4")
            word = np.repeat(np.asarray(batch.column("word")), np.diff(np.append(starts, len(flat))) // 2)
            rows = [np.concatenate([x, y]) for x, y in zip(kept, (word, flat[::2], flat[1::2]), strict=True)]
            last = int(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))[-1])  # the last word may go on
            if last:
                yield from settle(*(x[:last] for x in rows))
            keys, at = np.unique(rows[1][last:], return_inverse=True)
            kept = [np.full(len(keys), rows[0][last]), keys, np.bincount(at, rows[2][last:]).astype(np.int64)]
        if len(kept[0]):
            yield from settle(*kept)

    return seen.repartition(partitions(seen.sparkSession), "word").sortWithinPartitions("word").mapInArrow(choose, _ASSIGNED)


def class_pairs(texts: DataFrame, end: int) -> np.ndarray:
    """[a, b]: how often class b follows class a in the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES**2, np.int64)
        for batch in batches:
            of, starts = _numbers(batch.column("classes"), "<u1")
            out += np.bincount(_before(of, starts, end) * CLASSES + of, minlength=len(out))
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["pair", "n"])

    out = np.zeros(CLASSES**2)
    for pair, n in texts.where("not held_out").select("classes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(CLASSES, CLASSES)


def likelihood(pairs: np.ndarray) -> float:
    return float(_f(pairs).sum() - _f(pairs.sum(0)).sum() - _f(pairs.sum(1)).sum())


def neighbours(encoded: DataFrame, classes: np.ndarray) -> np.ndarray:
    """[type, 0, class]: how often the class is to the left of the type; [type, 1, class]: to the right."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(TYPES * 2 * CLASSES, np.int32)
        for batch in batches:
            for i in range(0, len(batch), 256):
                types, starts = _texts(batch.slice(i, 256))
                before = _before(types, starts)
                left = np.bincount(types * 2 * CLASSES + classes[before], minlength=len(out))
                right = np.bincount((before * 2 + 1) * CLASSES + classes[types], minlength=len(out))
                out += (left + right).astype(np.int32)
        out = out.reshape(TYPES // BLOCK, -1)
        some = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([out[k].astype("<i4").tobytes() for k in some], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    parts = encoded.where("not held_out").select("types").mapInArrow(count, "block int, counts binary")
    n = min(partitions(encoded.sparkSession), TYPES // BLOCK)
    out = np.zeros((TYPES // BLOCK, BLOCK * 2 * CLASSES), np.int64)
    for row in parts.repartition(n, "block").mapInArrow(add, "block int, counts binary").collect():
        out[row["block"]] = np.frombuffer(row["counts"], "<i8")
    return out.reshape(TYPES, 2, CLASSES)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(near: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One round: each type, from the most frequent on, moves to the class that raises the likelihood most."""
    classes = classes.copy()
    left, right = near[:, 0].astype(float), near[:, 1].astype(float)
    size = left.sum(1)
    pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(pairs, classes, right)  # pairs[a, b]: class b follows class a
    total = np.bincount(classes, size, CLASSES)
    order = np.argsort(-size, kind="stable")
    for t in order[: np.count_nonzero(size)]:
        if t == END_TYPE:  # a class of its own
            continue
        k = classes[t]
        pairs[k] -= right[t]
        pairs[:, k] -= left[t]
        np.maximum(pairs, 0, out=pairs)
        total[k] -= size[t]
        gain = (_f(pairs + right[t]) - _f(pairs)).sum(1) + (_f(pairs + left[t][:, None]) - _f(pairs)).sum(0) - 2 * (_f(total + size[t]) - _f(total))
        gain[classes[END_TYPE]] = -np.inf
        k = classes[t] = int(np.argmax(gain))
        pairs[k] += right[t]
        pairs[:, k] += left[t]
        total[k] += size[t]
    return classes


def _placed(encoded: DataFrame, moved: DataFrame) -> DataFrame:
    """Of each text with rare words: what they add to sum and known, and the places and classes of those that have one."""
    rare = encoded.select("ord", F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("n")).alias("words")).select("ord", F.posexplode("words").alias("pos", "col")).select("ord", "pos", F.col("col.word").alias("word"), F.col("col.n").alias("n"))
    rare = rare.join(moved.where("not frequent").select("word", "class", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return rare.groupBy("ord").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + ADD)).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.collect_list(F.when(F.col("class").isNotNull(), F.col("pos") * CLASSES + F.col("class"))).alias("placed"),
    )


def _with_classes(encoded: DataFrame, moved: DataFrame, placed: DataFrame, classes: np.ndarray, names: np.ndarray, last: bool = True) -> DataFrame:
    """The texts with the classes of their tokens, and what rare words (_placed) add to sum and known; unless it is the last round, with all that it takes."""
    spark = encoded.sparkSession
    frequent = np.full(len(names), classes[END_TYPE], np.int64)
    known = moved.where("frequent").select("word", "class").toArrow()  # SENT rows at most
    frequent[np.searchsorted(names, np.asarray(known.column("word")))] = np.asarray(known.column("class"))
    # words that no training text has: as most tokens of those that end alike
    unseen = classes[OWN + 1 :].copy()
    by_shape = moved.groupBy(F.col("word").bitwiseAND(SHAPES - 1).alias("shape"), "class").agg(F.sum("n").alias("n")).groupBy("shape").agg(F.max_by("class", F.struct("n", "class")))
    for shape, k in by_shape.collect():
        unseen[shape] = k
    maps = spark.sparkContext.broadcast((classes, frequent, unseen))

    encoded = encoded if not last else encoded.drop("times")
    some = F.size("rare") > 0  # only texts with such words are shuffled
    none = {"rare_sum": F.lit(0.0), "rare_known": F.lit(0).cast("long"), "placed": F.array().cast("array<int>")}
    joined = encoded.where(some).join(placed, "ord").unionByName(encoded.where(~some).withColumns(none))
    narrow = ("doc_id", "held_out", "n_tokens", "known", "sum", "rare_sum", "rare_known")
    kept = narrow if last else (*narrow, "ord", "types", "others", "rare", "times")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_type, of_frequent, of_unseen = maps.value
        for whole in batches:
            for i in range(0, len(whole), 1024):
                batch = whole.slice(i, 1024)
                types, starts = _texts(batch)
                at, place, rare, flat = _others(batch, types, starts)
                lengths = np.array(batch.column("rare").value_lengths(), np.int64)
                placed = np.asarray(batch.column("placed").flatten()).astype(np.int64)
                base = np.repeat(np.cumsum(lengths) - lengths, np.array(batch.column("placed").value_lengths(), np.int64))
                of_rare = of_unseen[flat & (SHAPES - 1)]
                of_rare[base + placed // CLASSES] = placed % CLASSES
                of = of_type[types]
                of[at[place >= 0]] = of_frequent[place[place >= 0]]
                of[at[place < 0]] = of_rare[rare[place < 0]]
                raw, ends = of.astype("<u1").tobytes(), np.append(starts, len(of))
                column = pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], names=[*kept, "classes"])

    more = "" if last else "ord long, types binary, others binary, rare array<long>, times array<int>, "
    return joined.select(*dict.fromkeys((*kept, "types", "others", "rare", "placed"))).mapInArrow(classed, f"doc_id long, held_out boolean, n_tokens long, known long, sum double, rare_sum double, rare_known long, {more}classes binary")


def lm_scores(docs: DataFrame, scratch: Scratch | None = None, folds: int = 5, held_out: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = ordered(docs, scratch).withColumn("held_out", bucket("doc_id", folds) == held_out)
    counts = rows.where("not held_out").select("text").mapInArrow(_count, "word long, n long")
    vocabulary = scratch.table(counts.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    n_all, n_words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    # the frequent words: those of the highest steps of a logarithmic scale that together are few enough
    step = F.floor(F.log2("n") * 16).cast("int")
    least, held = None, 0
    for s, c in sorted(vocabulary.groupBy(step.alias("s")).count().collect(), reverse=True):
        held += c
        if held > SENT:
            break
        least = s
    top = vocabulary.where((step >= least if least is not None else F.lit(False)) | (F.col("word") == END)).toArrow()  # SENT rows, and one
    names, count = (np.asarray(top.column(c)).astype(np.int64) for c in ("word", "n"))
    by = np.argsort(names)
    names, count = names[by], count[by]
    own = np.full(len(names), -1, np.int64)
    first = np.lexsort((names, -count))
    first = first[names[first] != END][:OWN]
    own[first] = np.arange(len(first))
    sent = spark.sparkContext.broadcast((names, count.astype(float), own))
    encoded = scratch.table(rows.mapInArrow(lambda b: _encode(b, sent), _ENCODED), "encoded", "zstd")

    # classes: the end, the most frequent types, and one for all others to start with
    classes = np.full(TYPES, CLASSES - 1)
    classes[: CLASSES - 2] = np.arange(CLASSES - 2)
    classes[END_TYPE] = CLASSES - 2
    for _ in range(rounds if n_all else 0):
        classes = exchange(neighbours(encoded, classes), classes)

    # then every word by itself, as long as that raises the likelihood
    end = int(classes[END_TYPE])
    pairs = np.zeros((CLASSES, CLASSES))
    if n_all:
        np.add.at(pairs, classes, neighbours(encoded, classes)[:, 1])
    scratch.drop("vocabulary")
    texts, n_rounds = encoded, max(1, min(rounds, WORD_ROUNDS))
    for i in range(n_rounds):
        scratch.tidy()
        moved = scratch.table(assigned(contexts(texts, classes, sent), pairs, end, rounds > 0), f"assigned{i}")
        scratch.tidy()
        bare = texts.drop("classes", "rare_sum", "rare_known")
        placed = scratch.table(_placed(bare, moved), f"placed{i}")
        scratch.tidy()  # the shuffles of rare words go before texts are shuffled
        then = scratch.table(_with_classes(bare, moved, placed, classes, names, i + 1 == n_rounds), f"classes{i}", "zstd")
        scratch.drop(f"placed{i}")
        now = class_pairs(then, end)
        if i and likelihood(now) <= likelihood(pairs):
            scratch.drop(f"classes{i}")
            break
        scratch.drop(f"classes{i - 1}" if i else "encoded")  # the new table has all that the next round takes
        texts, words_of, pairs = then, moved, now

    # tokens and distinct words by class
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    kind = np.where(names == END, END_TYPE, own)
    single = kind >= 0
    np.add.at(tokens, classes[kind[single]], count[single])
    np.add.at(distinct, classes[kind[single]], 1)
    for k, n, v in words_of.groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():
        tokens[k] += n
        distinct[k] += v
    share = (tokens + ADD) / (tokens.sum() + ADD * CLASSES)
    follow = np.log10((pairs + BACK_OFF * share) / (pairs.sum(1, keepdims=True) + BACK_OFF))
    within = np.log10(tokens + ADD * (distinct + 1))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ("doc_id", "held_out", "n_tokens", "known", "sum", "rare_sum", "rare_known")
        for batch in batches:
            value = np.zeros(len(batch))
            if len(batch):
                of, starts = _numbers(batch.column("classes"), "<u1")
                value = np.add.reduceat(follow[_before(of, starts, end), of] - within[of], starts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(value)], names=[*kept, "by_class"])

    out = texts.drop("ord", "types", "others", "rare", "times").mapInArrow(by_class, "doc_id long, held_out boolean, n_tokens long, known long, sum double, rare_sum double, rare_known long, by_class double")
    emitted = F.col("sum") + F.col("rare_sum")
    out = out.withColumns({
        "n_known": F.col("known") + F.col("rare_known"),
        "train_tokens": F.lit(n_all).cast("long"),
        "base_score": emitted - F.col("n_tokens") * math.log10(n_all + 0.5 * (n_words + 1)),
        "score": emitted + F.col("by_class"),
    })
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).drop("known", "sum", "by_class", "rare_sum", "rare_known")
