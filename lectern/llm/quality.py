"""Quality classifier (operator 1): kernel ridge on random Fourier features of document statistics, calibrated.

One pass over the texts makes a few statistics of each document; all else works on those narrow rows. Random Fourier
features approximate a Gaussian kernel over the standardised statistics. Each task sums its labelled rows' part of the
normal equations, Spark adds up the parts, and the driver solves a system whose size is the number of features,
whatever the input. The ridge scores of all labelled rows are counted in narrow bins by label; isotonic regression over
the bins turns a score into the share of label 1.

Labels enter the fit only by `label`; a document's language, source or id is no input. Null texts are empty and get a
score, too. Null labels are left out; a document with several labels counts with each. Repeated or null ids are rows of
their own. Without labelled rows every score is 0.5; with one class only, all scores are that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import NOT_SPACE, Scratch, pieces, prints, words

FEATURES, WIDTH, RIDGE, BINS = 192, 0.35, 1.0, 4000
STATISTICS = (
    "log_bytes", "upper", "digits", "symbols", "bars", "stops", "newlines", "spaces", "not_ascii", "log_words",
    "word_length", "word_spread", "distinct_words", "repeats", "top_word", "marked_words", "short_words", "distinct_lines",
)


def _among(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = [_among(bytes(range(65, 91))), _among(b"0123456789"), _among(b"!#$%&*+/<=>@[\\]^_`{}~"), _among(b"|"), _among(b".,;:?"), _among(b"\n"), _among(b" \t"), _among(bytes(range(128, 256)))]


def _distinct(group: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of distinct fingerprints, and how often the most frequent one occurs."""
    by = np.lexsort((names, group))
    group, names = group[by], names[by]
    heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (names[1:] != names[:-1]))) if len(by) else np.zeros(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, group[heads], np.diff(np.append(heads, len(by))))
    return np.bincount(group[heads], minlength=n), most


def statistics_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The statistics of each text, a row each."""
    n, size = len(at) - 1, np.diff(at)
    per = np.maximum(size, 1)
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = np.log1p(size)
    for k, kind in enumerate(_KINDS):
        out[:, 1 + k] = np.diff(np.append(0, np.cumsum(kind[data]))[at]) / per
    starts, ends, first = words(data, at, NOT_SPACE)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    per = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / per
    names = prints(data, starts, ends)
    distinct, most = _distinct(doc, names, n)
    again = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
    out[:, 9] = np.log1p(count)
    out[:, 10] = mean
    out[:, 11] = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per - mean**2, 0))
    out[:, 12] = distinct / per
    out[:, 13] = np.bincount(doc[1:][again], minlength=n) / per
    out[:, 14] = most / per
    out[:, 15] = np.bincount(doc, _KINDS[2][data[ends - 1]], n) / per
    out[:, 16] = np.bincount(doc, length <= 1, n) / per
    is_line = np.ones(256, bool)
    is_line[10] = False
    starts, ends, first = words(data, at, is_line)
    doc = np.repeat(np.arange(n), np.diff(first))
    out[:, 17] = _distinct(doc, prints(data, starts, ends), n)[0] / np.maximum(np.diff(first), 1)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in pieces(batches):
        x = statistics_of(data, at)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), flat], names=["doc_id", "x"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics in the order of STATISTICS."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_statistics, "doc_id long, x array<double>")


def bucket(id_column: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`. A null id is ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(of))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(len(batch), -1)


@dataclass
class Model:
    """Everything that a score needs: some tens of kB."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray = None
    shares: np.ndarray = None

    def features(self, x: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(1)
        w = random.normal(0, WIDTH, (x.shape[1], FEATURES))
        phase = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.append(np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(x), 1)), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.shares)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing numbers nearest to y: neighbours that fall are pooled to their mean."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame) -> Model:
    """A model from columns x and label (0 or 1). Each pass gives the driver a fixed number of sums."""
    spots = [F.col("x")[i] for i in range(len(STATISTICS))]
    row = labelled.agg(F.count(F.lit(1)).alias("n"), *(f(s) for s in spots for f in (F.avg, F.stddev_pop))).first()
    width = len(STATISTICS)
    if not row["n"]:
        return Model(np.zeros(width), np.ones(width), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    model = Model(np.array(row[1::2]), np.maximum(np.array(row[2::2]), 1e-6), None)
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if len(batch):
                f = model.features(_matrix(batch))
                a += f.T @ f
                b += f.T @ np.asarray(batch.column("label"), float)
        values = np.append(a[upper], b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    sums = labelled.mapInArrow(equations, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    values = np.zeros(len(upper[0]) + size)
    values[sums["at"]] = sums["value"]
    a = np.zeros((size, size))
    a[upper] = values[:-size]
    a = a + a.T - np.diag(np.diag(a)) + RIDGE * np.diag(np.append(np.ones(FEATURES), 1e-6))
    model.weights = np.linalg.solve(a, values[-size:])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor((model.raw(_matrix(batch)) + 1) / 3 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label").cast(pa.float64())], names=["at", "label"])

    bins = labelled.mapInArrow(binned, "at int, label double").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).toPandas().sort_values("at")
    model.edges = (bins["at"].to_numpy() + 0.5) * 3 / BINS - 1
    model.shares = isotonic(bins["share"].to_numpy(), bins["n"].to_numpy())
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from statistics()."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)) if len(batch) else np.zeros(0))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(score, "doc_id long, score double")


def good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least threshold, as they came: one pass without a shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in pieces(batches):
            yield rows.filter(pa.array(model.score(statistics_of(data, at)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; the labels of one fold (bucket() = held_out) are never looked at."""
    scratch = scratch or Scratch(docs.sparkSession)
    stats, model = fitted(docs, labels, scratch, folds, held_out)
    out = scored(stats, model)
    return out.select("doc_id", (bucket("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fitted(docs: DataFrame, labels: DataFrame, scratch: Scratch, folds: int = 5, held_out: int = 0) -> tuple[DataFrame, Model]:
    """The documents' statistics as a written table, and the model of all labels but one fold's."""
    stats = scratch.table(statistics(docs), "statistics")
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    learn = learn.where(F.col("label").isin(0, 1) & (bucket("doc_id", folds) != held_out))
    return stats, fit(scratch.table(stats.join(learn, "doc_id"), "labelled"))
