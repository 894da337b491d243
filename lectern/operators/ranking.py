"""Hybrid ranking of evidence for claims: lexical, semantic and reference scores, caps by type."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

K1, B, EPSILON = 1.5, 0.75, 0.25
WEIGHTS = {"lexical": 0.35, "semantic": 0.45, "reference": 0.20, "prior": 0.05}
#: Rows of a table that is sent to all tasks, at most.
BROADCAST = 200_000
#: Texts whose words one task counts, about.
TEXTS = 4096
#: Rows and queries of the vectors that are multiplied in one task at once, and queries of these in one go.
ROWS, QUERIES, PORTION = 8192, 4096, 256
CAPS = {"text_chunk": 3, "table": 2, "figure": 1}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, evidence_id, bm25 of all pairs of one corpus that share a word; other pairs score 0.

    claims: claim_id, corpus, text; evidence: evidence_id, corpus, text. Statistics are those of the corpus. A word that more
    than half of a corpus has would weigh negatively and takes a quarter of the corpus's mean weight instead. Of all words only
    the number of texts that have them is counted; how often a text has a word is counted for asked words alone. Texts are dealt
    anew, by more tasks the more there are, so that what a task counts has a bound.
    """
    tasks = max(int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-evidence.count() // TEXTS))
    doc = evidence.select("corpus", "evidence_id", "text").repartition(tasks, "evidence_id").select("corpus", "evidence_id", tokens(F.col("text")).alias("ts"))
    # Numbers of texts with a word and, at the empty word, of all texts and their words: one pass.
    df = doc.select("corpus", F.size("ts").alias("dl"), F.explode(F.array_append(F.array_distinct("ts"), F.lit(""))).alias("term"))
    df = df.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("words"))
    size = df.where("term = ''").select("corpus", F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("mean_size"))
    df = df.where("term <> ''").select("corpus", "term", "df")
    df = df.join(size, "corpus").withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = df.groupBy("corpus").agg(F.avg("raw").alias("mean_idf"))
    idf = df.join(mean, "corpus").select("corpus", "term", "mean_size", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    asked = claims.select("claim_id", "corpus", F.explode(tokens(F.col("text"))).alias("term")).groupBy("claim_id", "corpus", "term").agg(F.count(F.lit(1)).alias("qf"))
    words = asked.select("corpus", "term").distinct()
    if words.limit(BROADCAST + 1).count() <= BROADCAST:
        words = F.broadcast(words)
    # The empty word is nobody's; a plain explode would have texts without words left out before they are dealt, and so dealt twice.
    terms = doc.select("corpus", "evidence_id", F.size("ts").alias("dl"), F.explode(F.array_append("ts", F.lit(""))).alias("term")).join(words, ["corpus", "term"], "left_semi")
    terms = terms.groupBy("corpus", "evidence_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = asked.join(idf, ["corpus", "term"])
    if asked.limit(BROADCAST + 1).count() <= BROADCAST:
        weights = F.broadcast(weights)  # texts stay where their words were counted, and so do the pairs' sums
    hits = terms.join(weights, ["corpus", "term"])
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_size")))
    return hits.groupBy("claim_id", "evidence_id").agg(F.sum(part).alias("bm25"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column, nx: Column | None = None, ny: Column | None = None) -> Column:
    """0 for a zero query; a zero row has norm 1e-10. nx, ny: the norms, where they were made before the vectors met."""
    nx, ny = norm(x) if nx is None else nx, norm(y) if ny is None else ny
    return F.when(nx == 0, F.lit(0.0)).otherwise(dot(x, y) / (nx * F.when(ny == 0, F.lit(1e-10)).otherwise(ny)))


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of one length as a matrix, with their rows; those that are null or hold a null are left out."""
    vectors = column.combine_chunks()
    some = np.array([v is not None and None not in v for v in vectors.to_pylist()], bool) if vectors.null_count or vectors.flatten().null_count else np.ones(len(vectors), bool)
    length = np.where(some, np.asarray(vectors.value_lengths().fill_null(0)), -1)
    out = {}
    for n in np.unique(length[some]):
        at = np.flatnonzero(length == n)
        out[int(n)] = at, np.asarray(vectors.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), n)
    return out


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added up from left to right as F.aggregate does."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


#: What takes the place of a score: NaN is above all, null below; a row isn't its own neighbour.
_NAN, _NULL, _SELF = 1e18, -1e18, -2e18


def _nearest(key: tuple, queries: pa.Table, rows: pa.Table, caps: int, k: int) -> pa.Table:
    """The rows that may be among the k nearest of a query, with cosine's score.

    A matrix product says which: a score of it is within 1e-9 of cosine's, so that rounded to six digits it has a lowest and a
    highest value. A row is left out if the lowest values of enough others, as (value, smaller id), are above its highest.
    """
    queries, rows = queries.filter(pc.is_valid(queries["vec_id"])), rows.filter(pc.is_valid(rows["other"])).sort_by("other")
    ids, other = np.asarray(queries["vec_id"]), np.asarray(rows["other"])
    labels = rows["label"].combine_chunks().dictionary_encode("encode").indices
    of_label = [np.flatnonzero(np.asarray(labels) == i) for i in range(len(np.unique(np.asarray(labels))))]
    xs, ys = _by_length(queries["x"]), _by_length(rows["embedding"])
    picked_q, picked_r = [], []
    for start in range(0, len(ids), PORTION):
        mine = ids[start : start + PORTION]
        score = np.full((len(mine), len(other)), np.nan)
        known = np.zeros(score.shape, bool)
        for n, (qi, x) in xs.items():
            inside = (qi >= start) & (qi < start + PORTION)
            q, x = qi[inside] - start, x[inside]
            nx = np.sqrt((x * x).sum(1))
            if n in ys:
                ri, y = ys[n]
                ny = np.sqrt((y * y).sum(1))
                with np.errstate(all="ignore"):
                    score[np.ix_(q, ri)] = x @ y.T / (nx[:, None] * np.where(ny == 0, 1e-10, ny))
                known[np.ix_(q, ri)] = True
            score[q[nx == 0]], known[q[nx == 0]] = 0.0, True
        special = np.where(known, _NAN, _NULL)
        plain = known & np.isfinite(score)
        low, high = (np.where(plain, np.floor(np.where(plain, score, 0.0) * 1e6 + m + 0.5), special) for m in (-1e-3, 1e-3))
        own = mine[:, None] == other
        low[own], high[own] = _SELF, _SELF
        keep = high > _SELF
        best, place = [], []
        every = np.arange(len(mine))
        for at in of_label:
            part = low[:, at]
            for _ in range(caps):
                first = part.argmax(1)
                best.append(part[every, first])
                place.append(at[first])
                part[every, first] = _SELF
            least, last = best[-1][:, None], place[-1][:, None]
            if len(at) > caps:
                keep[:, at] &= (high[:, at] > least) | ((high[:, at] == least) & (at <= last))
        if len(best) >= k:
            values, places = np.array(best).T, np.array(place).T
            kth = np.lexsort((places, -values), axis=-1)[:, k - 1]
            least, last = values[every, kth][:, None], places[every, kth][:, None]
            keep &= (high > least) | ((high == least) & (np.arange(len(other)) <= last))
        q, r = np.nonzero(keep)
        picked_q.append(q + start)
        picked_r.append(r)
    q, r = np.concatenate([*picked_q, np.zeros(0, np.int64)]), np.concatenate([*picked_r, np.zeros(0, np.int64)])
    exact, known = np.zeros(len(q)), np.zeros(len(q), bool)
    for n, (qi, x) in xs.items():
        at_q = np.full(len(ids), -1)
        at_q[qi] = np.arange(len(qi))
        zero = np.sqrt(_in_order(x * x)) == 0
        mine = at_q[q] >= 0
        known |= mine & zero[at_q[q]]
        if n in ys:
            ri, y = ys[n]
            at_r = np.full(len(other), -1)
            at_r[ri] = np.arange(len(ri))
            hit = np.flatnonzero(mine & (at_r[r] >= 0))
            a, c = x[at_q[q[hit]]], y[at_r[r[hit]]]
            nx, ny = np.sqrt(_in_order(a * a)), np.sqrt(_in_order(c * c))
            with np.errstate(all="ignore"):
                exact[hit] = np.where(nx == 0, 0.0, _in_order(a * c) / (nx * np.where(ny == 0, 1e-10, ny)))
            known[hit] = True
    return pa.table({"vec_id": pa.array(ids[q], pa.int64()), "other": pa.array(other[r], pa.int64()), "label": rows["label"].take(pa.array(r)), "score": pa.array(exact, pa.float64(), mask=~known)})


def nearest(queries: DataFrame, rows: DataFrame, caps: int, k: int) -> DataFrame:
    """vec_id, other, label and score (cosine's): of each query's other rows at least those among the k nearest with at most `caps`
    of a label, by score to six digits, then id. Others may follow, so the last ranking is the caller's.

    queries: vec_id, x; rows: other, label, embedding. All meet: rows are dealt to parts and queries to blocks of a fixed size, and a
    task multiplies one part and one block, so its memory doesn't grow. A row is sent once a block, a query once a part.
    """
    parts, blocks = (max(1, -(-df.count() // most)) for df, most in ((rows, ROWS), (queries, QUERIES)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col("vec_id").cast("long"), "x", dealt("vec_id", blocks).alias("block"), each(parts).alias("part"))
    r = rows.select(F.col("other").cast("long"), "label", "embedding", dealt("other", parts).alias("part"), each(blocks).alias("block"))
    kind = dict(rows.dtypes)["label"]
    return q.groupBy("part", "block").cogroup(r.groupBy("part", "block")).applyInArrow(lambda key, a, b: _nearest(key, a, b, caps, k), f"vec_id long, other long, label {kind}, score double")


def scaled(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """df with the values as 0..1 within a key; 0 where all are equal. The ends are aggregates, so rows stay where they are."""
    ends = df.groupBy(*keys).agg(*(f(v).alias(f"_{n}_{v}") for v in values for n, f in (("low", F.min), ("high", F.max))))
    if ends.limit(BROADCAST + 1).count() <= BROADCAST:
        ends = F.broadcast(ends)
    out = df.join(ends, [*keys])
    to = {v: F.when(F.col(f"_high_{v}") == F.col(f"_low_{v}"), F.lit(0.0)).otherwise((F.col(v) - F.col(f"_low_{v}")) / (F.col(f"_high_{v}") - F.col(f"_low_{v}"))) for v in values}
    return out.withColumns(to).drop(*(f"_{n}_{v}" for v in values for n in ("low", "high")))


def asked_for(query: Column) -> Column:
    """Whether a query has words that ask for results, and for methods, as a struct."""
    q = F.lower(F.coalesce(query, F.lit("")))
    # fixed values: words that ask for results or for methods
    results = q.rlike(r"\b(table|tab\.|figure|fig\.|ablation|baseline|compare|comparison|result|results|performance|qualitative)\b")
    methods = q.rlike(r"\b(section|method|proof|assumption|definition|theorem)\b")
    return F.struct(results.alias("results"), methods.alias("methods"))


def type_prior(asks: Column, kind: Column) -> Column:
    return F.when(kind.isin("table", "figure") & asks["results"], 1.0).when((kind == "text_chunk") & asks["methods"], 0.4).otherwise(0.0)


def capped(df: DataFrame, keys: Sequence[str], kind: str, caps: Mapping[str, int], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each key in order, at most caps[kind] of each kind; `rank` from 1."""
    most = F.coalesce(*(F.when(F.col(kind) == name, F.lit(n)) for name, n in caps.items()), F.lit(k))
    of_kind = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    # The plain number lets each task keep its own first rows.
    out = df.withColumn("_of_kind", of_kind).where((F.col("_of_kind") <= most) & (F.col("_of_kind") <= max([k, *caps.values()])))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("_of_kind")


def ranked(scored: DataFrame, k: int = 5, caps: Mapping[str, int] = CAPS, digits: int = 9) -> DataFrame:
    """Evidence of each claim by combined score, explicitly named objects first.

    scored: claim_id, evidence_id, kind, asks (asked_for of the query, made before claims meet evidence), bm25, semantic, reference, explicit (of all candidates).
    """
    w = WEIGHTS
    score = w["lexical"] * F.col("bm25") + w["semantic"] * F.col("semantic") + w["reference"] * F.col("reference") + w["prior"] * type_prior(F.col("asks"), F.col("kind"))
    out = scaled(scored, ["claim_id"], ["bm25", "semantic"]).withColumn("score", F.round(score, digits))
    return capped(out, ["claim_id"], "kind", caps, [F.col("explicit").desc(), F.col("score").desc(), "evidence_id"], k)


def seed_candidates(papers: DataFrame, templates: Sequence[str], abstract: str, title: str, most: int = 150) -> DataFrame:
    """papers with i (from 1) and body: each template filled with {title} and {excerpt}, the abstract's beginning, where it may be posted.

    Papers without an abstract have none; a missing title reads 'this topic'. Whatever a text holds is taken as it is.
    """
    text = F.trim(F.coalesce(F.col(abstract), F.lit("")))
    excerpt = F.concat(F.rtrim(F.left(text, F.lit(most))), F.when(F.length(text) > most, "...").otherwise(""))
    values = {"{title}": F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit("this topic")), "{excerpt}": F.col("_excerpt")}
    filled = lambda t: F.concat(*[values.get(p, F.lit(p)) for p in re.split(r"(\{title\}|\{excerpt\})", t) if p])
    bodies = F.array(*(F.struct(F.lit(i).alias("i"), filled(t).alias("body")) for i, t in enumerate(templates, 1)))
    rows = papers.where(text != "").withColumn("_excerpt", excerpt).select(*papers.columns, F.inline(bodies))
    return rows.where(tx.blocked_phrase(F.col("body")).isNull() & (F.trim("body") != ""))
