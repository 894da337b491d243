"""Documents of lines: headings, places, files, and reports of papers with very many rows."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from lectern.operators import documents, reports
from lectern.plans import bindings


def test_numbers_and_files(spark, tmp_path):
    items = spark.createDataFrame([(p, i, f"item {i}") for p in (1, 2) for i in reversed(range(3000 if p == 1 else 2))], "p long, i long, t string")
    heads = spark.createDataFrame([(1,), (2,), (3,)], "p long")
    below = documents.lines(items, ["p"], [4, F.col("i")], documents.texts(F.col("t"), None))
    some = documents.texts("## Items", F.concat(F.lit("n: "), F.col("_below")))
    doc = documents.document(below, documents.headed(heads, below, ["p"], [4], some, documents.texts("## Items", "none")), documents.lines(heads, ["p"], [0], documents.texts("# Head")))
    want = {p: ["# Head", "## Items", f"n: {n}", *(f"item {i}" for i in range(n))] for p, n in ((1, 3000), (2, 2))} | {3: ["# Head", "## Items", "none"]}
    got = documents.numbered(doc, ["p"], span=64).collect()
    for p, lines in want.items():
        assert [r["text"] for r in sorted((r for r in got if r["p"] == p), key=lambda r: r["line"])] == lines
        assert sorted(r["line"] for r in got if r["p"] == p) == list(range(1, len(lines) + 1))
    documents.write(doc, "p", str(tmp_path / "out"))
    for p, lines in want.items():
        files = sorted((tmp_path / "out" / f"p={p}").glob("part-*"))
        assert "".join(f.read_text() for f in files).splitlines() == lines


def test_digests_see_order(spark):
    rows = lambda *t: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(t)], "p long, line int, text string")
    digest = lambda df: documents.digests(df, ["p"]).first()
    assert digest(rows("a", "b")) != digest(rows("b", "a")) and digest(rows("a", "b"))["n_letters"] == 2


PLANS = "paper_id long, title string, citable_other int, agents int, strongest double, reacts int, unclear int"


def test_verdict_plans(spark):
    rows = [(1, "a", 2, 3, 0.9, 1, 0), (2, "b", 9, 9, 0.9, 1, 0), (3, "c", 0, 0, None, 0, 1), (4, "d", 5, 5, 0.5, 1, 0), (5, "e", 2, 2, 0.8, 1, 0), (6, None, 4, 4, 0.75, 1, 0), (7, "g", 2, 3, None, 0, 0)]
    got = {r["paper_id"]: r for r in reports.verdict_plans(spark.createDataFrame(rows, PLANS)).collect()}
    assert [got[i]["reason_code"] for i in range(1, 8)] == ["eligible", "saturated_low_value_v0", "cold_no_override", "crowded_no_override", "insufficient_distinct_other_agent_citations", "eligible", "no_react_signal"]
    assert [got[i]["score"] for i in range(1, 8)] == [3.5, None, None, None, None, 4.5, None]
    assert got[1]["status"] == "dry_run" and got[2]["status"] == "skipped" and "(confidence 0.90)" in got[1]["rationale"]


def test_draft(spark):
    plans = reports.verdict_plans(spark.createDataFrame([(1, "T", 2, 3, 0.9, 1, 0), (2, None, 5, 5, 0.8, 1, 0), (3, "x", 9, 9, 0.9, 1, 0)], PLANS))
    cited = spark.createDataFrame([(1, 30, "z"), (1, 4, "y"), (1, 5, None), (3, 1, "q")], "paper_id long, comment_id long, author_id string")
    named = spark.createDataFrame([(1, i, 10 + i, 0.9) for i in range(1, 6)], "paper_id long, place int, comment_id long, confidence double")
    got = documents.numbered(reports.verdict_drafts(plans, cited, named, "now"), ["paper_id"]).collect()
    text = {p: [r["text"] for r in sorted(got, key=lambda r: r["line"]) if r["paper_id"] == p] for p in (1, 2, 3)}
    assert text[3] == []
    at = text[1].index("## Citable other-agent comments (3 minimum required for submission)")
    assert text[1][at + 1 : at + 7] == ["- Comment 4 by agent y", "- Comment 5 by agent unknown", "- Comment 30 by agent z", "", "## Reactive evidence summary", "- Comment 11: refuted claim detected (confidence 0.90)"]
    assert sum("refuted claim detected" in x for x in text[1]) == 3 and "- No refuted claims detected." in text[2] and text[2][1] == "Paper: 2 — "


def test_long_report(spark):
    """A paper of 10⁵ evidence rows: its lines are in the order of a plain sort, and no part of it is long."""
    papers = spark.createDataFrame([(1, "T"), (2, None)], "paper_id long, title string")
    claims = spark.range(20_000).select(
        F.lit(1).cast("long").alias("paper_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("review_id"), F.element_at(F.array(F.lit("questions"), F.lit("summary"), F.lit(" "), F.lit("x")), (F.col("id") % 4 + 1).cast("int")).alias("field"),
        F.col("id").alias("claim_index"), F.col("id").alias("claim_id"), F.lit("success").alias("status"), F.lit("Refuted ").alias("verdict"), (F.col("id") / 20_000).alias("confidence"), F.lit("c").alias("text"),
    )
    evidence = spark.range(100_000).select((F.col("id") % 19_999).alias("claim_id"), F.floor(F.col("id") / 19_999 + 1).alias("rank"), F.lit(1).alias("page"), F.lit("S").alias("section"), F.repeat(F.lit("y"), 30).alias("text"))
    got = documents.numbered(reports.verification_report(papers, claims, evidence, "now", most=20), ["paper_id"], depth=3).where("paper_id = 1").toPandas().sort_values("line")["text"].tolist()
    reviews = [x for x in got if x.startswith("## Review `")]
    assert reviews == ["## Review `1`", "## Review `2`", "## Review `unknown`"]
    assert [x for x in got if x.startswith("### Field")][:4] == ["### Field: `summary`", "### Field: `questions`", "### Field: `unknown`", "### Field: `x`"]
    cards = [int(x.split()[1][1:]) for x in got if x.startswith("##### C")]
    field = {1: 0, 0: 1, 2: 2, 3: 3}
    assert cards == sorted(range(20_000), key=lambda i: ((i % 3 or 9), field[i % 4], i))
    assert sum(x.startswith("**Evidence #") for x in got) == 100_000 and got.count("_No parseable evidence_chunk_ids._") == 1 and "> " + "y" * 20 + "…" in got
    assert got.count("### Quick links (top refuted)") == 3 and sum("[jump]" in x for x in got) == 9 and sum(x.startswith("- unknown / C") or x.startswith("- 1 / C") or x.startswith("- 2 / C") for x in got) == 10


def test_no_claims(spark):
    papers = spark.createDataFrame([(2, None)], "paper_id long, title string")
    claims = spark.createDataFrame([], "paper_id long, review_id long, field string, claim_index long, claim_id long, status string, verdict string, confidence double, text string")
    evidence = spark.createDataFrame([], "claim_id long, rank int, page int, section string, text string")
    got = [r["text"] for r in documents.numbered(reports.verification_report(papers, claims, evidence, dt.date(2024, 1, 1).isoformat()), ["paper_id"]).orderBy("line").collect()]
    assert got[0] == "# Verification Report — 2" and "- Rows: 0" in got and got[-2] == "## Reviews" and "### Quick links (top contradicted)" not in got


def test_retrieval_report(spark):
    """A paper with everything, one whose claim finds no chunk of its own, and one without chunks."""
    papers = spark.createDataFrame([(1, "T"), (2, None), (3, " ")], "paper_id long, title string")
    chunks = spark.createDataFrame([(1, i, i, "A" if i < 3 else None, i, f" text\n{i} " + "z" * 90 * (i == 1)) for i in range(7)] + [(2, 50, 0, "B", None, None)], "paper_id long, chunk_id long, chunk_index long, section string, page long, text string")
    embeddings = spark.createDataFrame([(0, "old", 1), (1, "old", 1), (0, "new", 2)], "chunk_id long, model string, at long")
    retrieved = spark.createDataFrame([(1, c, f"claim {c}", r, 1.0, None, 0.25, r) for c in range(5) for r in range(1, 7)] + [(2, 9, None, 1, 1.0, 1.0, 1.0, 999)], "paper_id long, claim_id long, claim_text string, rank int, bm25 double, semantic double, combined double, chunk_id long")
    rows = documents.numbered(reports.retrieval_report(papers, chunks, embeddings, retrieved, "now"), ["paper_id"], depth=2).collect()
    text = {p: [r["text"] for r in sorted(rows, key=lambda r: r["line"]) if r["paper_id"] == p] for p in (1, 2, 3)}
    assert text[1][0] == "# Retrieval Report — 1 — T" and text[2][0] == "# Retrieval Report — 2" and "- Paper title: `T`" in text[1] and not any("title" in x for x in text[3])
    assert "- Embedding model: **new**" in text[1] and "- Embedded chunks: **1**" in text[1] and "- Embedding model: **(none)**" in text[2]
    assert [x for x in text[1] if x.startswith("| 1 | `") or x.startswith("| 2 | `")][:2] == ["| 1 | `A` | 0 | 8 |", "| 2 | `unknown` | 3 | 8 |"]
    assert text[1].index("| `unknown` | 4 |") < text[1].index("| `A` | 3 |") and "unknown" + " " * 14 + "████" in text[1]
    assert [x for x in text[1] if x.startswith("### Query")] == ["### Query #1", "### Query #2", "### Query #3"] and sum(x.startswith("##### Rank") for x in text[1]) == 15
    assert "| `1` | `A` | 1 | yes | text 1 " + "z" * 73 + "… |" in text[1] and "| `2` | `A` | 2 | no | text 2 |" in text[1] and "| 1 | `A` | 1 | 1.000 | 0.000 | 0.250 |" in text[1]
    assert "_No retrieval results found._" in text[2] and "- page: `None`" in text[2] and "## 5. Retrieval Coverage" not in text[2]
    assert "> No parsed sections found." in text[3] and text[3][-1] == "> No retrieval preview rows found." and not any("Chunk Distribution" in x for x in text[3])


def test_shares_round_as_in_sql(spark):
    """9725 / 500000 is a double below 0.01945."""
    prices = [9725.0, 9775.0, 25.0, 75.0, 313_475.0, 100_025.0]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in prices], "p double").select(bindings.rounded(F.col("p") / 500000, 4)).collect()]
    assert got == [duckdb.execute(f"SELECT round({p}::DOUBLE / 500000, 4)").fetchall()[0][0] for p in prices] and got[0] == 0.0194


def test_lines_stay_together_until_they_are_numbered(spark, monkeypatch):
    """A report has far fewer rows than lines, and short and long documents are numbered alike, also where rows have one path and lines are null."""
    papers = spark.createDataFrame([(1, "T")], "paper_id long, title string")
    claims = spark.range(50).select(F.lit(1).cast("long").alias("paper_id"), F.lit(1).alias("review_id"), F.lit("summary").alias("field"), "id", F.col("id").alias("claim_id"), F.lit("success").alias("status"), F.lit("supported").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("c").alias("text")).withColumnRenamed("id", "claim_index")
    evidence = spark.range(5000).select((F.col("id") % 49).alias("claim_id"), F.floor(F.col("id") / 49 + 1).alias("rank"), F.lit(1).alias("page"), F.lit("S").alias("section"), F.lit("y").alias("text"))
    report = reports.verification_report(papers, claims, evidence, "now")
    lines = documents.numbered(report, ["paper_id"], depth=3).orderBy("line").collect()
    assert len(lines) > 20_000 and report.count() < len(lines) / 50
    assert [int(r["text"].split()[1][1:].rstrip("*")) for r in lines if r["text"].startswith("**Evidence #")] == [i for c in range(49) for i in range(1, 104 if c < 2 else 103)]

    rows = spark.createDataFrame([(d, [d % 3, i // 40], ["b", f"{i}", None, 'q"\\\n'] if i % 2 else ["a", None, "z"]) for d in range(4) for i in range(30 * d + 1)], "d long, path array<long>, lines array<string>")
    plain = {d: [t for *_, t in sorted(([*p, i], t) for r in rows.collect() if r["d"] == d for p in [r["path"]] for i, t in enumerate(r["lines"]) if t is not None)] for d in range(4)}
    for long in (0, 31, 1000):
        monkeypatch.setattr(documents, "LONG", long)
        got = documents.numbered(rows, ["d"], depth=1, span=2).orderBy("d", "line").collect()
        assert {d: [r["text"] for r in got if r["d"] == d] for d in range(4)} == plain
        assert [r["line"] for r in got] == [i + 1 for d in range(4) for i in range(len(plain[d]))]
