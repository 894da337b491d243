"""Ranking of evidence: nearest vectors and BM25 against brute force."""

import math
import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lectern.operators import ranking
from lectern.plans import texts
from oracle import SF


def _nearest_by_hand(rows, queries, caps, k):
    def cosine(x, y):
        nx = math.sqrt(sum(a * a for a in x)) if x is not None and None not in x else None
        if nx == 0:
            return 0.0
        if nx is None or y is None or None in y or len(x) != len(y):
            return None
        ny = math.sqrt(sum(a * a for a in y))
        return sum(a * c for a, c in zip(x, y, strict=True)) / (nx * (ny or 1e-10))

    out = []
    for q, x in queries:
        scored = [(o, label, cosine(x, y)) for o, label, y in rows if o != q]
        scored = sorted(((o, label, s if s is None else round(s, 6)) for o, label, s in scored), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        seen, rank = {}, 0
        for o, label, s in scored:
            seen[label] = seen.get(label, 0) + 1
            if seen[label] <= caps and rank < k:
                rank += 1
                out.append((q, o, s, rank))
    return sorted(out)


def test_nearest_meets_all_parts_and_blocks(spark, monkeypatch):
    """Copies tie, labels and vectors may be null, lengths differ; neither side is one task's."""
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rng.integers(-2, 3, (40, 4))]
    rows = [(i, None if i % 11 == 0 else i % 4, vectors[i % 40]) for i in range(300)] + [(300, 1, None), (301, 2, [0.0] * 4), (302, 3, [1.0, None, 2.0, 0.0]), (303, 0, [1.0, 2.0])]
    queries = [(i, y) for i, _, y in rows if i % 20 == 0 or i >= 300]
    monkeypatch.setattr(ranking, "ROWS", 70)
    monkeypatch.setattr(ranking, "QUERIES", 6)
    r = spark.createDataFrame(rows, "other long, label int, embedding array<float>")
    found = ranking.nearest(spark.createDataFrame(queries, "vec_id long, x array<float>"), r, 2, 5)
    assert found.count() < len(rows) * len(queries) / 4  # most pairs stay within the tasks
    order = [F.round("score", 6).desc(), "other"]
    out = found.withColumn("n", F.row_number().over(Window.partitionBy("vec_id", "label").orderBy(*order))).where("n <= 2")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(*order))).where("rank <= 5")
    assert sorted(map(tuple, out.select("vec_id", "other", F.round("score", 6), "rank").collect())) == _nearest_by_hand(rows, queries, 2, 5)


def test_bm25_counts_words_in_bounded_tasks(spark, monkeypatch):
    """Many texts are dealt to more tasks, and sums by pair are made where the words were counted."""
    monkeypatch.setattr(ranking, "TEXTS", 5)
    texts = [(i, "de" if i % 3 else "en", f"w{i % 7} w{i % 5} all All" if i % 9 else None) for i in range(60)]
    asked = [(0, "de", "w1 w1, all"), (1, "en", "W2 none w3")]
    found = ranking.bm25(spark.createDataFrame(asked, "claim_id long, corpus string, text string"), spark.createDataFrame(texts, "evidence_id long, corpus string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(evidence_id#\d+L?, 12\)", plan) and not re.search(r"hashpartitioning\(claim_id#\d+L?, evidence_id", plan)
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    expected = {}
    for claim, corpus, text in asked:
        own = {i: words(t) for i, c, t in texts if c == corpus}
        mean = sum(map(len, own.values())) / len(own)
        raw = {w: math.log((len(own) - n + 0.5) / (n + 0.5)) for w in {w for ws in own.values() for w in ws} for n in [sum(w in ws for ws in own.values())]}
        idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
        for i, ws in own.items():
            if shared := [w for w in words(text) if w in ws]:
                expected[claim, i] = sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in shared)
    got = {(r.claim_id, r.evidence_id): r.bm25 for r in found.collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], rel_tol=1e-12) for k in got)


def test_hybrid_ranking_reads_claims_before_they_meet_evidence(spark):
    """No text of a claim goes through the join with evidence, so that no pattern is matched for each pair."""
    plan = queries()["r1_hybrid_ranking"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if "Project" in line and "AS explicit" in line]
    assert pairs and not any("regexp_extract_all" in line or "rlike" in line.lower() for line in pairs)


def test_hybrid_ranking_shuffles_no_pairs(spark, monkeypatch):
    """Claims meet evidence where it is, and each task keeps its own first rows; with too many claims to send, pairs go without vectors."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    query = queries()["r1_hybrid_ranking"]
    assert not re.search(r"hashpartitioning\(claim_id#\d+L?, evidence_id", plan(query(spark, SF))) and re.search(r"WindowGroupLimit \[claim_id#\d+L?, kind", plan(query(spark, SF)))
    few = texts.candidate_scores(spark, SF)
    assert not re.search(r"hashpartitioning\(claim_id", plan(few))
    want = sorted(map(tuple, query(spark, SF).collect()))
    monkeypatch.setattr(ranking, "BROADCAST", 100)
    many = texts.candidate_scores(spark, SF)
    dealt = [line for line in plan(many).splitlines() if re.search(r"hashpartitioning\(claim_id#\d+L?, evidence_id", line)]
    assert dealt and "embedding" not in "".join(plan(many).split("hashpartitioning(claim_id")[1].splitlines()[1:3])
    assert few.count() == many.count() and sorted(map(tuple, query(spark, SF).collect())) == want
    assert few.where("bm25 > 0").count() == many.where("bm25 > 0").count() > 0
