"""Audits of recognition against plain loops, for one scope, many and none."""

import random
from collections import Counter

import pytest
from lectern.operators import documents, recognition as rec

FIGURES = "paper_id long, position long, attempted boolean, text string, reason string, confidence string, error_type string, error_message string, elapsed double, label string, page int, outcome string"


def figures(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    return [
        (r.choice([1, 1, 1, 2, 3]), i, r.choice([True, True, False, None]), r.choice(["x", "", " ", None]), r.choice(["caption_only", "inference_failed", "too_short", "", None]), r.choice(["high", "inferred", "", None, "odd"]),
         r.choice(["oom", None, ""]), r.choice(["a", "b" * 200, " c ", "d", "e", "f", "g", "", None]), r.choice([None, round(r.random() * 9, 1), 3.0]), f"F{i}", i % 7, r.choice([None, "", "done"]))
        for i in range(n)
    ]


def plain(rows: list[tuple]) -> dict:
    status = lambda f: rec.NEVER if not f[2] else rec.ACCEPTED if (f[3] or "").strip() else rec.REJECTED
    named = {"reason": lambda f: f[4] or "none", "confidence": lambda f: f[5] or "unknown", "error_type": lambda f: (f[6] or "unknown") if f[4] == rec.FAILED else None}
    out = {"all": [(None, len(rows), *(sum(status(f) == s for f in rows) for s in (rec.ACCEPTED, rec.REJECTED, rec.NEVER)))]}
    for d, of in named.items():
        out[d] = [(v, n, *(sum(status(f) == s and of(f) == v for f in rows) for s in (rec.ACCEPTED, rec.REJECTED, rec.NEVER))) for v, n in Counter(of(f) for f in rows if of(f) is not None).most_common()]
    messages = [(f[7] or "").strip()[:150] for f in rows if f[4] == rec.FAILED]
    out["samples"] = list(dict.fromkeys(m for m in messages if m))[:5]
    timed = [f for f in rows if f[2] and f[8] is not None]
    values = sorted(f[8] for f in timed)
    n = len(values)
    out["latency"] = (n, round(sum(values), 1), values[n // 2], values[max(0, int(0.95 * n) - 1)]) if n else None
    out["slowest"] = [(f[9], f[6 + 4], f[8], f[11] or status(f)) for f in sorted(timed, key=lambda f: -f[8])[:5]]
    return out


@pytest.mark.parametrize("scope", [["paper_id"], []])
def test_against_loops(spark, scope):
    rows = figures(400)
    df = spark.createDataFrame(rows, FIGURES).repartition(5)
    found, times = rec.counts(df, scope).collect(), rec.latencies(df, scope).collect()
    said, slow = rec.samples(df, scope).collect(), rec.slowest(df, scope).collect()
    for p in (1, 2, 3) if scope else (None,):
        want = plain([f for f in rows if p in (None, f[0])])
        mine = lambda rs: sorted((r for r in rs if p is None or r["paper_id"] == p), key=lambda r: r["place"] if "place" in r else 0)  # noqa: E731, B023
        for d in ("all", "reason", "confidence", "error_type"):
            assert [(r["value"], r["n"], r["accepted"], r["rejected"], r["never"]) for r in mine(found) if r["dimension"] == d] == want[d]
        assert [r["message"] for r in mine(said)] == want["samples"]
        t = mine(times)[0]
        assert (t["n_timed"], round(t["total"], 1), t["median"], t["p95"]) == want["latency"]
        assert [(r["label"], r["page"], r["elapsed"], r["outcome"]) for r in mine(slow)] == want["slowest"]


def test_report(spark):
    rows = [(1, 0, True, "x", None, "high", None, None, 2.0, "F1", 3, None), (1, 1, False, None, "caption_only", "odd", None, None, None, "F2", 1, None), (2, 2, True, "", rec.FAILED, "high", "oom", "no memory", None, "F3", 1, None)]
    scopes = spark.createDataFrame([(1,), (2,), (3,)], "paper_id long")
    lines = documents.numbered(rec.report(scopes, spark.createDataFrame(rows, FIGURES), "paper_id", "now"), ["paper_id"]).collect()
    text = {p: "\n".join(r["text"] for r in sorted(lines, key=lambda r: r["line"]) if r["paper_id"] == p) for p in (1, 2, 3)}
    assert text[3] == "# Figure OCR Audit Report\n\n**Paper:** `3`  \n**Generated:** now  \n\n_No figure evidence objects found._"
    assert "| Acceptance rate (among attempted) | 100.0% |" in text[1] and "| `F1` | 3 | 2.0s | accepted |" in text[1] and "Inference Failure" not in text[1]
    assert "- 50% of figures (1/2) were never attempted" in text[1] and "- caption_only is the leading skip reason (1/2 figures)" in text[1]
    assert "| `oom` | 1 |\n\n### Sample Error Messages\n\n- `no memory`" in text[2] and "_No timing data available._" in text[2] and "(most common: inference_failed)." in text[2]
    assert text[1].index("| `high` | 1 | 1 | 1 | 0 | 0 |") < text[1].index("| `odd` | 1 | 0 | 0 | 0 | 1 |") < text[1].index("## Latency Statistics") < text[1].index("## Interpretation Notes")


@pytest.mark.parametrize("scope", [["paper_id"], []])
def test_nothing(spark, scope):
    df = spark.createDataFrame([], FIGURES)
    found = rec.counts(df, scope)
    assert all(x.isEmpty() for x in (found, rec.notes(found, scope), rec.samples(df, scope), rec.latencies(df, scope), rec.slowest(df, scope)))


def test_boxes(spark):
    rows = [(1, 0, "table", "a", True, 0.5), (1, 1, "figure", "a", True, 0.0), (1, 2, "figure", "b", False, 0.9), (1, 3, "figure", "a", True, 0.7)]
    got = rec.box_audit(spark.createDataFrame(rows, "paper_id long, position long, object_type string, source string, refined boolean, score double"), ["paper_id"]).collect()
    assert {(r["dimension"], r["value"], r["place"], r["n"], r["refined"], r["mean_score"]) for r in got} == {
        ("all", None, 1, 4, 3, 0.6), ("type", "figure", 1, 3, 2, 0.7), ("type", "table", 2, 1, 1, 0.5), ("source", "a", 1, 3, 3, 0.6), ("source", "b", 2, 1, 0, None),
    }
