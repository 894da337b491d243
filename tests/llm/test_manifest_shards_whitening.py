"""The Merkle manifest, the shards and the whitening against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle, queries, sharding, whitening
from lectern.llm.eigen import leading_pairs

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    fields = [doc[c] for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """The top digest, and for each leaf the (left, right) siblings on its way."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(paths):
            run, k = level[at[i] // 8 * 8 : at[i] // 8 * 8 + 8], at[i] % 8
            p.append(("".join(run[:k]), "".join(run[k + 1 :])))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def brute_manifest(docs):
    tops, known = [], []
    for lang in sorted({d["lang"] for d in docs}, key=lambda v: (v is not None, (v or "").encode())):
        own = sorted((d for d in docs if d["lang"] == lang), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
        top, paths = tree([leaf(d, d["text"]) for d in own])
        tops.append(top)
        known.append((own, paths))
    root, above = tree(tops)
    out = []
    for top, upper, (own, paths) in zip(tops, above, known, strict=True):
        for d, p in zip(own, paths, strict=True):
            found = leaf(d, lower(d["text"]) if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 else d["text"])
            for left, right in p + upper:
                found = h(left, found, right)
            out.append((d["doc_id"], leaf(d, d["text"]), top, root, h(*[s for pair in p + upper for s in pair]), found, found == root))
    return sorted(out, key=str)


def op12(docs):
    out = merkle.manifest(docs, queries.lowered, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(), "folded_root", F.col("folded_root") == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def made(sizes):
    """Documents of langs with so many rows each; every fourth text, source and number of characters is null."""
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append({"doc_id": i * 7 % 1009, "text": None if i % 4 == 1 else f"Text {i} ÄÖ 漢", "lang": lang, "source": None if i % 4 == 2 else "s", "n_chars": None if i % 4 == 3 else i})
            i += 1
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 1}, {"a": 8}, {"a": 9, None: 64, "é": 65, "z": 1}, {"a": 513}, {f"l{i}": 1 for i in range(70)}, {**{f"l{i}": i % 3 + 1 for i in range(20)}, "big": 600}])
def test_manifest(spark, sizes):
    docs = made(sizes)
    assert op12(spark.createDataFrame(docs, DOCS)) == brute_manifest(docs)


def test_manifest_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST", -1)
    docs = made({"a": 700, "b": 3, None: 10})
    assert op12(spark.createDataFrame(docs, DOCS)) == brute_manifest(docs)


def test_manifest_of_awkward_rows(spark):
    docs = made({"a": 12, None: 2})
    docs += [docs[0], docs[0], {**docs[1], "doc_id": None}, {**docs[2], "doc_id": None, "text": ""}, {**docs[3], "text": "A" * 300_000}]
    extra = spark.createDataFrame([{**d, "key": 1, "idx": "x", "digest": 2, "root": "r"} for d in docs], DOCS + ", key int, idx string, digest int, root string")
    assert op12(extra) == brute_manifest(docs)
    assert op12(extra.limit(0)) == []
    # A changed byte anywhere fails, an unchanged one doesn't.
    same = merkle.manifest(spark.createDataFrame(docs, DOCS))
    assert same.where("folded_root <> root").count() == 0 and same.count() == len(docs)


def test_manifest_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, SF).collect()), key=str)
    assert got == brute_manifest([r.asDict() for r in docs.collect()])


def brute_shards(docs, shards):
    size = lambda t: len((t or "").encode()) + 8
    rows = sorted(((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in docs))
    total, start, used, out = sum(r[2] for r in rows), 0, [0] * shards, []
    for none, i, z, crc in rows:
        s = min((2 * start + z) * shards // (2 * total), shards - 1)
        out.append((None if none else i, z, crc, s, used[s]))
        used[s] += 1
        start += z
    return sorted(out, key=str)


def test_shards(spark, tricky):
    docs = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    for n in (1, 3, 24):
        assert sorted((tuple(r) for r in sharding.sharded(tricky, n).collect()), key=str) == brute_shards(docs, n)
    copies = spark.createDataFrame([(5, "same")] * 3000 + [(None, None)] * 1000, "doc_id long, text string")
    assert sorted((tuple(r) for r in sharding.sharded(copies, 7).collect()), key=str) == brute_shards([(5, "same")] * 3000 + [(None, None)] * 1000, 7)
    assert sharding.sharded(tricky.limit(0)).count() == 0


def test_shards_of_the_table(spark):
    df = queries.op13_sharding(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
    got = df.toPandas()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got[["doc_id", "size", "text_crc32", "shard", "slot"]].itertuples(index=False, name=None), key=str) == brute_shards(docs, 24)
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and (sizes - got["size"].sum() / 24).abs().max() <= got["size"].max()
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()


@pytest.mark.parametrize(
    "a",
    [
        np.zeros((3, 3)), np.eye(20), np.diag(np.arange(30.0)), np.diag([2.0] * 10) + np.diag([1.0] * 9, 1) + np.diag([1.0] * 9, -1), np.ones((9, 9)), np.array([[3.0]]),
        np.diag(np.abs(np.arange(-10.0, 11))) + np.diag([1.0] * 20, 1) + np.diag([1.0] * 20, -1), np.kron(np.eye(5), np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]])), np.diag([1e8, 1, 1, 1e-6]), 1e-200 * np.ones((4, 4)),
    ],
)
def test_eigenpairs(a):
    values, v = leading_pairs(a, 16)
    want, size = np.linalg.eigvalsh(a)[::-1][:16], max(np.abs(a).max(), 1e-300)
    assert len(values) == min(16, len(a)) and np.abs(values - want).max() <= 1e-14 * size * len(a)
    assert np.abs(a @ v - v * values).max() <= 1e-14 * size * len(a) and np.abs(v.T @ v - np.eye(v.shape[1])).max() <= 1e-13


def test_eigenpairs_of_random_matrices():
    r = np.random.default_rng(0)
    for n, m in ((2, 5), (17, 40), (64, 20), (90, 500)):
        b = r.standard_normal((n, m)) * np.exp(r.standard_normal((n, 1)))
        a = b @ b.T
        values, v = leading_pairs(a, 16)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:16], rtol=1e-12, atol=1e-12 * values[0]) and np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12


def brute_whitening(rows, d):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda x: np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
    y = np.array([centred(x) for x in fit])
    cov = y.T @ y / n
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1][:16], v[:, ::-1][:, :16]
    dev = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in xs]
    return kept, n, dev, np.array([centred(x) for x in xs]) @ v / np.sqrt(w), w / np.trace(cov)


def checked(got, rows, d):
    kept, n, dev, white, explained = brute_whitening(rows, d)
    got = got.toPandas()
    assert len(got) == len(kept) * white.shape[1] and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-8
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert sorted(zip(got["vec_id"].fillna(-1), got["deviation"], strict=True)) == sorted((-1 if i is None else i, e) for (i, _), e in zip(kept, dev, strict=True) for _ in range(white.shape[1]))
    wide = got.assign(vec_id=got["vec_id"].fillna(-1), r=got.groupby(["vec_id", "component"], dropna=False).cumcount()).pivot(index=["vec_id", "r"], columns="component", values="whitened").sort_index()
    want = pd.DataFrame(white).assign(vec_id=[-1 if i is None else i for i, _ in kept]).sort_values("vec_id", kind="stable").drop(columns="vec_id").to_numpy()
    for c in range(white.shape[1]):
        a, b = wide.to_numpy()[:, c], want[:, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    checked(queries.op11_embedding_whitening(spark, SF), rows, 64)


def test_whitening_of_awkward_rows(spark):
    r = np.random.default_rng(3)
    one = (r.standard_normal(5) + 1e6).tolist()
    rows = [(i, (r.standard_normal(5) * [9, 5, 3, 2, 1] + 1e6).tolist()) for i in range(200)] + [(300 + i, one) for i in range(150)]
    rows += [(500, None), (501, [1.0, None, 2.0, 3.0, 4.0]), (502, [float("nan")] * 5), (503, [1.0, float("inf"), 0.0, 0.0, 0.0]), (504, [1e18] * 5), (None, one), (7, [1e6 + 40] * 5), (505, [])]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in rows], "vec_id long, embedding array<double>, component int, n string")
    checked(whitening.whitened(df), [x for x in rows if x[0] != 504], 5)


def test_whitening_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).count() == 0
    got = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).toPandas()
    assert got["component"].tolist() == [1, 1] and sorted(got["whitened"].round(9)) == [-1, 1]  # one direction has variance


def test_deviations_beyond_longs():
    x, n = np.array([[2**61, 5], [-(2**61), 7]]), 1 << 30
    dev = whitening.deviations(x, n, [3, 4])
    assert dev.tolist() == [[2**91 - 3, 5 * n - 4], [-(2**91) - 3, 7 * n - 4]]
    assert whitening._squares(dev) == [None, None] and whitening._squares(np.array([[3, 4]])) == [25]
