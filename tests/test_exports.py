"""Exports: every file in its place and order, the same twice, with counts that were taken while it was written."""

import datetime as dt
import gzip
import json
from pathlib import Path

from pyspark.sql import functions as F

from lectern.plans import writes
from lectern.sources import exports
from oracle import SF

T = dt.datetime


def tables(spark):
    papers = spark.createDataFrame([(f"p{i % 40:02d}", f"Title {i}", "REVIEW_ACTIVE", T(2024, 1, 1)) for i in range(40)], "paper_id string, title string, state string, open_time timestamp_ntz").repartition(3)
    comments = spark.createDataFrame([(f"c{i}", f"p{i % 7}", T(2024, 1, 1 + i % 5), i % 3 == 0, i % 2 == 0, "a \"b\"\n ü" if i else None) for i in range(300)], "comment_id string, paper_id string, created_at timestamp_ntz, is_ours boolean, is_citable boolean, text string").repartition(5)
    actions = spark.createDataFrame([(i, f"p{i % 40:02d}", "view", T(2024, 1, 1), '{"reason": {"a": [1, 2]}}' if i % 2 else "{not json", "dry_run") for i in range(100)], "action_id long, paper_id string, action_type string, created_at timestamp_ntz, details string, status string").repartition(4)
    verdicts = spark.createDataFrame([("p01", "ELIGIBLE", True)], "paper_id string, eligibility_state string, submitted boolean")
    return {"papers": papers, "comments": comments, "actions": actions, "verdict_state": verdicts}


def read(root, name):
    path = Path(root) / exports.FILES[name].folder / name
    return "".join(p.read_text() for p in sorted(path.iterdir()) if p.name.startswith("part-"))


def test_export(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    manifest = {r["file"]: r.asDict() for r in exports.export(tables(spark), one, spark, generated_at="2024-01-01").collect()}
    again = {r["file"]: r.asDict() for r in exports.export(tables(spark), two, spark, generated_at="2024-01-01").collect()}
    assert manifest == again and list(manifest) == list(exports.FILES)
    for name, f in exports.FILES.items():
        text = read(one, name)
        assert text == read(two, name)
        rows = [json.loads(x) for x in text.splitlines()]
        assert len(rows) == manifest[name]["rows"] and manifest[name]["folder"] == f.folder
        keys = [tuple(str(r[c]).zfill(6) if isinstance(r[c], int) else r[c] for c in f.order if c in r) for r in rows]
        assert keys == sorted(keys), name
    assert {n: m["rows"] for n, m in manifest.items() if m["rows"]} == {"papers.jsonl": 40, "comments.jsonl": 300, "actions.jsonl": 100, "verdict_state.jsonl": 1, "run_summary.jsonl": 40, "action_traces.jsonl": 100}
    assert [json.loads(x) for x in "".join(p.read_text() for p in (Path(one) / "manifest").iterdir() if p.name.startswith("part-")).splitlines()] == list(manifest.values())
    summary = {r["paper_id"]: r for r in map(json.loads, read(one, "run_summary.jsonl").splitlines())}
    assert summary["p01"]["eligibility_state"] == "ELIGIBLE" and summary["p02"]["eligibility_state"] is None and summary["p01"]["action_count"] == 3
    traces = {r["action_id"]: r for r in map(json.loads, read(one, "action_traces.jsonl").splitlines())}
    assert traces[1]["details"] == {"reason": {"a": [1, 2]}} and traces[2]["details"] == "{not json" and traces[1]["external_id"] is None
    assert {r["comment_id"]: r["text"] for r in map(json.loads, read(one, "comments.jsonl").splitlines())}["c1"] == 'a "b"\n ü'
    stats = "".join(p.read_text() for p in (Path(one) / "reports" / "summary_stats.md").iterdir() if p.name.startswith("part-"))
    assert "| Our comments | 100 |" in stats and "| Citable other-agent comments | 100 |" in stats and "| Reactive drafts | 0 |" in stats
    card = "".join(p.read_text() for p in (Path(one) / "reports" / "dataset_card.md").iterdir() if p.name.startswith("part-"))
    assert "- `comments.jsonl`: 300 rows" in card and "Generated" in card and "Privacy" in card


def test_export_of_nothing(spark, tmp_path):
    assert all(r["rows"] == 0 for r in exports.export({}, str(tmp_path / "x"), spark).collect())
    assert all(read(tmp_path / "x", n) == "" for n in exports.FILES)


def test_a_line_is_made_once(spark, tmp_path, monkeypatch):
    """Sampling the ranges must not make the lines as well."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(s):
        made.add(1)
        return s

    monkeypatch.setattr(exports, "opened", lambda c: counted(c))
    papers = tables(spark)["papers"].select("paper_id").orderBy(F.col("paper_id").desc())
    seen = exports._written(papers, exports.FILES["papers.jsonl"], str(tmp_path / "raw" / "papers.jsonl"), "once")
    assert seen["rows"] == 40 and made.value == 40
    assert [json.loads(x)["paper_id"] for x in read(tmp_path, "papers.jsonl").splitlines()] == [f"p{i:02d}" for i in range(40)]


def test_parts_may_be_compressed(spark, tmp_path, monkeypatch):
    """The same lines in the same order, and the query's own export leaves no plain text on disk."""
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    plain, packed = (sorted(map(tuple, exports.export(tables(spark), root, spark, compression=c).collect())) for root, c in ((one, "none"), (two, "gzip")))
    assert plain == packed
    for name, f in exports.FILES.items():
        parts = sorted(p for p in (Path(two) / f.folder / name).iterdir() if p.name.startswith("part-"))
        assert all(p.suffix == ".gz" for p in parts if f.table in {*tables(spark), "run_summary"})
        assert "".join(gzip.decompress(p.read_bytes()).decode() if p.suffix == ".gz" else p.read_text() for p in parts) == read(one, name), name
    monkeypatch.setattr(writes, "shared_folder", lambda spark: str(tmp_path / "query"))
    assert writes.dataset_export(spark, SF).where("lines = rows").count() == len(exports.FILES)
    large = [p for p in (tmp_path / "query").rglob("part-*") if p.stat().st_size > 5000]
    assert large and all(p.suffix == ".gz" for p in large)


def test_ties_and_maps_have_one_order(spark, tmp_path):
    """Equal keys, and tables with columns that have no order, give the same bytes however rows are dealt."""
    seen = []
    listed = lambda df, name: exports._written(df, exports.FILES["actions.jsonl"], str(tmp_path / name / "raw" / "actions.jsonl"), name) and read(tmp_path / name, "actions.jsonl")
    rows = spark.createDataFrame([(i % 3, T(2024, 1, 1), i % 2, {"a": i // 10}, f"t{i % 5}") for i in range(60)], "paper_id long, created_at timestamp_ntz, action_id long, m map<string, int>, t string")
    for name, df in (("a", rows.drop("m")), ("b", rows.drop("m").repartition(7, "t")), ("c", rows), ("d", rows.repartition(5, "t"))):
        seen.append(listed(df, name))
    assert seen[0] == seen[1] and seen[2] == seen[3] and len(seen[0].splitlines()) == len(seen[2].splitlines()) == 60
    keys = [(r["paper_id"], r["created_at"], r["action_id"]) for r in map(json.loads, seen[0].splitlines())]
    assert keys == sorted(keys)
