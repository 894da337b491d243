"""Queries on reports of many sections, with the SQL that each must agree with: line by line, or by a digest of all lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.operators import documents, reports
from lectern.plans import audits, review
from lectern.plans import bindings as b
from lectern.plans.bindings import NOW, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AT = NOW.isoformat()


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return add


def citations(spark: SparkSession, d: str) -> DataFrame:
    """The first comment of each other agent; a comment's number is its thread's and its place."""
    comment = F.col("thread_id") * 10 + F.col("position")
    first = F.min_by(comment, F.struct("created_at", comment.alias("comment_id")))
    return b.comments(spark, d).where("not is_ours and is_citable").groupBy("paper_id", "author_id").agg(first.alias("comment_id"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Contradicted comments of each paper in their order."""
    contra = rules.is_contradiction(F.col("verdict"))
    found = b.verifications(spark, d).where("status = 'success'").where(contra).groupBy("paper_id", F.col("review_id").alias("comment_id")).agg(F.max("confidence").alias("confidence"))
    return found.where("confidence >= 0.5").withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy("comment_id")))


def plans(spark: SparkSession, d: str) -> DataFrame:
    agents = citations(spark, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("agents"))
    rows = review.summarised(spark, d).join(agents, "paper_id", "left").na.fill(0, ["agents"])
    return reports.verdict_plans(rows.withColumn("citable_other", F.col("others")))


_PLANS = f"""{review._SUMMARISED}, cited AS (SELECT paper_id, author_id, arg_min(thread_id * 10 + position, (created_at, thread_id * 10 + position)) AS comment_id FROM comments WHERE NOT is_ours AND is_citable GROUP BY 1, 2),
    agents AS (SELECT paper_id, count(*) AS agents FROM cited GROUP BY 1), banded AS (SELECT *, {review._BAND} AS heat_band FROM summarised LEFT JOIN agents USING (paper_id)),
    gated AS (SELECT *, CASE WHEN heat_band = 'saturated' THEN 'saturated_low_value_v0' WHEN coalesce(strongest, -1) < 0.75 THEN CASE heat_band WHEN 'cold' THEN 'cold_no_override' WHEN 'crowded' THEN 'crowded_no_override' ELSE 'no_react_signal' END
        WHEN coalesce(agents, 0) < 3 THEN 'insufficient_distinct_other_agent_citations' ELSE 'eligible' END AS reason_code FROM banded),
    plans AS (SELECT *, reason_code = 'eligible' AS eligible, CASE WHEN reason_code = 'eligible' THEN 'dry_run' ELSE 'skipped' END AS status,
        CASE WHEN reason_code = 'eligible' THEN CASE WHEN strongest >= 0.85 THEN 3.5 WHEN strongest >= 0.65 THEN 4.5 WHEN reacts = 0 AND unclear > 0 THEN 5.5 ELSE 6.5 END END::DOUBLE AS score,
        CASE WHEN reason_code = 'eligible' THEN round(strongest, 4) END AS confidence FROM gated)"""


@query("e15_verdict_plans", sql(f"{_PLANS} SELECT paper_id, eligible, reason_code, heat_band, others AS citable_other, status, score, confidence FROM plans", "papers", "comments", "verifications"))
def verdict_plans(spark: SparkSession, d: str) -> DataFrame:
    """Both gates, score and state of every paper's verdict."""
    return plans(spark, d).select("paper_id", "eligible", "reason_code", "heat_band", "citable_other", "status", "score", "confidence")


@query("e16_verdict_drafts", sql(f"""{_PLANS}, p AS (SELECT * FROM plans WHERE eligible), found AS (SELECT paper_id, review_id, max(confidence) AS conf FROM verifications WHERE status = 'success' AND verdict = 'refuted' GROUP BY 1, 2 HAVING max(confidence) >= 0.5),
    named AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY review_id) AS place FROM found),
    l AS (SELECT paper_id, unnest([
            ([0, 0], '# Verdict Draft (DRY-RUN — not submitted)'), ([0, 1], 'Paper: ' || paper_id || ' — ' || title), ([0, 2], 'Generated: {AT}'), ([0, 3], 'Heat band: ' || heat_band), ([0, 4], 'Distinct citable other agents: ' || others), ([0, 5], ''),
            ([1, 0], '## Why this paper is eligible'), ([1, 1], '- ' || CASE heat_band {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.BANDS.items())} END), ([1, 2], '- Strongest contradiction confidence: ' || printf('%.2f', strongest)), ([1, 3], ''),
            ([2, -1], '## Citable other-agent comments (3 minimum required for submission)'), ([3, -2], ''), ([3, -1], '## Reactive evidence summary'),
            ([4, 0], ''), ([4, 1], '## Verdict Score'), ([4, 2], '- Score: ' || printf('%.1f', score) || ' / 10.0'), ([4, 3], '- Source: heuristic_v0'), ([4, 4], '- Confidence: ' || printf('%.4f', confidence)),
            ([4, 5], '- Rationale: ' || CASE score WHEN 3.5 THEN replace('{reports.REASONS[3.5]}', '%.2f', printf('%.2f', strongest)) ELSE replace('{reports.REASONS[4.5]}', '%.2f', printf('%.2f', strongest)) END),
            ([5, 0], ''), ([5, 1], '## Proposed verdict rationale'), ([5, 2], '- Reactive evidence suggests at least one claim in citable other-agent comments is contradicted by the paper.'), ([5, 3], '- Manual review and score assignment required before any live submission.'),
            ([5, 4], ''), ([5, 5], '## Suggested next step'), ([5, 6], '- Manual review required before any live verdict submission.')]) AS x FROM p
        UNION ALL SELECT paper_id, ([2, comment_id], '- Comment ' || comment_id || ' by agent ' || author_id) FROM cited SEMI JOIN p USING (paper_id)
        UNION ALL SELECT paper_id, ([3, place], '- Comment ' || review_id || ': refuted claim detected (confidence ' || printf('%.2f', conf) || ')') FROM named SEMI JOIN p USING (paper_id) WHERE place <= 3)
    SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY x[1], x[2]) AS INT) AS line, x[2] AS text FROM l""", "papers", "comments", "verifications"))  # fmt: skip
def verdict_drafts(spark: SparkSession, d: str) -> DataFrame:
    """The drafts of all eligible papers, line by line."""
    drafts = reports.verdict_drafts(plans(spark, d), citations(spark, d), candidates(spark, d), AT)
    return documents.numbered(drafts, ["paper_id"])


def report_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims with a review (by the dearest digit of their price), a place in it and a state."""
    shares = F.floor(F.col("confidence") * 5)
    return audits.claims(spark, d).select(
        "paper_id", shares.alias("review_id"), "field", F.floor(F.col("confidence") * 100).alias("claim_index"), "claim_id", F.when(F.col("confidence") < 0.9, "success").otherwise("error").alias("status"), "verdict", "confidence", "text",
    )


def report_evidence(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy("position", "tie"))
    text = F.when(F.col("has_text"), F.concat(F.lit("Value "), F.col("section_number"), F.lit("\nof "), F.col("kind")))
    return audits.evidence(spark, d).select("claim_id", rank.alias("rank"), F.nullif("page", F.lit(0)).alias("page"), "section", text.alias("text"))


def _badge(v: str) -> str:
    return f"CASE {v} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in reports.BADGES.items()) + " END"


_MINI = " || ".join(f"'{x}: **' || {v} || '**, '" for v, x in reports.BADGES.items())


@query("f29_verification_reports", f"""WITH {audits._CLAIMS}, {audits._EVIDENCE}, papers AS (SELECT c_custkey AS paper_id, c_name AS title FROM customer),
    c AS (SELECT paper_id, CAST(floor(confidence * 5) AS BIGINT) AS review_id, field, CAST(floor(confidence * 100) AS BIGINT) AS ci, claim_id, CASE WHEN confidence < 0.9 THEN 'success' ELSE 'error' END AS status, verdict, confidence AS conf, text FROM claims),
    f AS (SELECT *, dense_rank() OVER (PARTITION BY paper_id ORDER BY review_id) AS r, row_number() OVER (PARTITION BY paper_id, review_id ORDER BY field) AS fi FROM (SELECT DISTINCT paper_id, review_id, field FROM c)),
    p AS (SELECT c.*, r, fi, {_badge("verdict")} AS badge, 'review-' || review_id || '-c' || ci AS anchor FROM c JOIN f USING (paper_id, review_id, field) JOIN papers USING (paper_id)),
    e AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY position, tie) AS k, nullif(page, 0) AS page, section, CASE WHEN has_text THEN 'Value ' || section_number || chr(10) || '> of ' || kind ELSE '' END AS t FROM evidence),
    u AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY conf DESC, review_id, field, ci, claim_id) AS b10, row_number() OVER (PARTITION BY paper_id, review_id ORDER BY conf DESC, review_id, field, ci, claim_id) AS b3 FROM p WHERE verdict = 'refuted' AND status = 'success'),
    s AS (SELECT 1 AS sec, paper_id, verdict AS v, (review_id, field, ci, claim_id) AS seen FROM p UNION ALL SELECT 2, paper_id, status, (review_id, field, ci, claim_id) FROM p UNION ALL SELECT 3, paper_id, field, (review_id, field, ci, claim_id) FROM p),
    g AS (SELECT sec, paper_id, v, count(*) AS n, min(seen) AS first FROM s GROUP BY 1, 2, 3), h AS (SELECT paper_id, r, review_id, count(*) FILTER (status = 'success') AS n, {", ".join(f"count(*) FILTER (status = 'success' AND verdict = '{v}') AS {v}" for v in reports.BADGES)} FROM p GROUP BY 1, 2, 3),
    l AS (SELECT paper_id, unnest([([0, 0], '# Verification Report — ' || paper_id || ' — ' || title), ([0, 1], ''), ([0, 2], '- Generated at: {AT}'), ([0, 3], '- Rows: ' || (SELECT count(*) FROM p WHERE p.paper_id = papers.paper_id)), ([0, 4], '- Paper title: `' || title || '`'), ([0, 5], ''), ([0, 6], '## Summary'), ([0, 7], ''),
            ([1, -2], '### Verdicts'), ([1, -1], ''), ([2, -3], ''), ([2, -2], '### Status'), ([2, -1], ''), ([3, -3], ''), ([3, -2], '### Source fields'), ([3, -1], ''), ([5, 0], ''), ([5, 1], '## Reviews'), ([5, 2], '')]) AS x FROM papers
        UNION ALL SELECT paper_id, ([sec, row_number() OVER (PARTITION BY sec, paper_id ORDER BY n DESC, first)], '- ' || v || ': ' || n) FROM g
        UNION ALL SELECT paper_id, unnest([([4, -3], ''), ([4, -2], '### Quick links (top contradicted)'), ([4, -1], '')]) FROM u WHERE b10 = 1
        UNION ALL SELECT paper_id, ([4, b10], '- ' || review_id || ' / C' || ci || ': [' || badge || '](#' || anchor || ')') FROM u WHERE b10 <= 10
        UNION ALL SELECT paper_id, unnest([([6, r, -1, 0], '---'), ([6, r, -1, 1], '## Review `' || review_id || '`'), ([6, r, -1, 2], ''), ([6, r, -1, 3], '**Mini summary**'), ([6, r, -1, 4], ''), ([6, r, -1, 5], '- total verified claims: **' || n || '** (' || {_MINI} || 'unknown: **0**)'), ([6, r, -1, 6], '')]) FROM h
        UNION ALL SELECT paper_id, ([6, r, 0, -1], '### Quick links (top refuted)') FROM u WHERE b3 = 1
        UNION ALL SELECT paper_id, ([6, r, 0, b3], '  - C' || ci || ' (conf=' || conf || '): [jump](#' || anchor || ')') FROM u WHERE b3 <= 3
        UNION ALL SELECT paper_id, unnest([([6, r, fi, -1, 0], '### Field: `' || field || '`'), ([6, r, fi, -1, 1], ''), ([6, r, fi, -1, 2], '#### Claims & Verification'), ([6, r, fi, -1, 3], '')]) FROM f SEMI JOIN papers USING (paper_id)
        UNION ALL SELECT paper_id, unnest([([6, r, fi, ci, claim_id, -1, 0], '<a id="' || anchor || '"></a>'), ([6, r, fi, ci, claim_id, -1, 1], '##### C' || ci || ' — ' || badge), ([6, r, fi, ci, claim_id, -1, 2], ''), ([6, r, fi, ci, claim_id, -1, 3], '- status: `' || status || '`'), ([6, r, fi, ci, claim_id, -1, 4], '- verification_confidence: `' || conf || '`'),
            ([6, r, fi, ci, claim_id, -1, 5], ''), ([6, r, fi, ci, claim_id, -1, 6], '**Claim**'), ([6, r, fi, ci, claim_id, -1, 7], ''), ([6, r, fi, ci, claim_id, -1, 8], '> ' || text), ([6, r, fi, ci, claim_id, -1, 9], ''), ([6, r, fi, ci, claim_id, -1, 10], '**Evidence (paper chunks)**'), ([6, r, fi, ci, claim_id, -1, 11], '')]) FROM p
        UNION ALL SELECT paper_id, unnest([([6, r, fi, ci, claim_id, 0, 0], '_No parseable evidence_chunk_ids._'), ([6, r, fi, ci, claim_id, 0, 1], '')]) FROM p ANTI JOIN e USING (claim_id)
        UNION ALL SELECT paper_id, unnest([([6, r, fi, ci, claim_id, k, 0], '**Evidence #' || k || '** — page ' || coalesce(CAST(page AS VARCHAR), 'None') || ', section=' || coalesce(section, 'None')), ([6, r, fi, ci, claim_id, k, 1], ''), ([6, r, fi, ci, claim_id, k, 2], '> ' || t), ([6, r, fi, ci, claim_id, k, 3], '')]) FROM e JOIN p USING (claim_id)),
    n AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY x[1], x[2]) AS line, x[2] AS text FROM l)
    SELECT paper_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_letters, CAST(sum(CAST('0x' || left(md5(line || ':' || text), 8) AS BIGINT)) AS BIGINT) AS digest FROM n GROUP BY 1""")  # fmt: skip
def verification_reports(spark: SparkSession, d: str) -> DataFrame:
    """every paper's report on its verified claims, as a digest of all its lines."""
    papers = b.table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"))
    claims = report_claims(spark, d).join(papers.select("paper_id"), "paper_id", "left_semi")
    report = reports.verification_report(papers, claims, report_evidence(spark, d), AT)
    return documents.digests(documents.numbered(report, ["paper_id"], depth=3), ["paper_id"])


def _line(path: str, *texts: str) -> str:
    return ", ".join(f"([{path}, {i}], {t})" for i, t in enumerate(texts))


def _of(path: str, rows: str, *texts: str) -> str:
    return f"SELECT paper_id, unnest([{_line(path + ', -1', *texts)}]) AS x FROM {rows}"


_INDEXED = ["'- Indexed chunks: **' || chunks || '**'", "'- Embedded chunks: **' || coalesce(embedded, 0) || '**'", "'- Embedding model: **' || coalesce(model, '(none)') || '**'", "''"]
_HIT = ["'- chunk_id: `' || chunk_id || '`'", "'- section: `' || section || '`'", "'- page: `' || page || '`'", "''", "'```'", "trim(text)", "'```'", "''"]


@query("f32_retrieval_reports", f"""WITH c AS (SELECT lang AS paper_id, doc_id AS chunk_id, doc_id AS chunk_index, source AS section, n_chars % 50 + 1 AS page, text FROM documents),
    e AS (SELECT vec_id AS chunk_id, 'm' || label % 3 AS model, label AS made FROM embeddings), p AS (SELECT paper_id, 'Texts in ' || paper_id AS title FROM (SELECT DISTINCT paper_id FROM c)),
    r AS (SELECT paper_id, l_orderkey AS claim_id, row_number() OVER (PARTITION BY paper_id, l_orderkey ORDER BY l_linenumber, l_extendedprice) AS rank, l_discount * 10 AS bm25, l_tax AS semantic, l_quantity / 50 AS combined, chunk_id FROM lineitem JOIN c ON chunk_id = l_partkey),
    s AS (SELECT paper_id, section, count(*) AS n, min(page) AS page, min(chunk_index) AS met, arg_min(length(text), chunk_index) AS letters, max(page) AS last FROM c GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY met) AS i, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, section) AS j FROM s),
    m AS (SELECT paper_id, arg_max(model, (made, model)) AS model, arg_max(embedded, (made, model)) AS embedded FROM (SELECT paper_id, model, count(*) AS embedded, max(made) AS made FROM e JOIN c USING (chunk_id) GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT * FROM p JOIN (SELECT paper_id, max(last) AS pages, count(*) AS sections, CAST(sum(n) AS BIGINT) AS chunks FROM s GROUP BY 1) USING (paper_id) LEFT JOIN m USING (paper_id)),
    f AS (SELECT *, trim(replace(text, chr(10), ' ')) AS flat FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) AS k FROM c) WHERE k <= 5),
    q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY claim_id) AS q FROM (SELECT DISTINCT paper_id, claim_id FROM r)) WHERE q <= 3),
    h AS (SELECT q.paper_id, q.q, q.claim_id, r.rank AS k, bm25, semantic, combined, r.chunk_id, section, page, text FROM q JOIN r ON r.paper_id = q.paper_id AND r.claim_id = q.claim_id JOIN c ON c.chunk_id = r.chunk_id WHERE r.rank <= 5),
    g AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, first) AS j FROM (SELECT paper_id, section, count(*) AS n, min((q, k)) AS first FROM h GROUP BY 1, 2)),
    l AS ({_of("0", "t", "'# Retrieval Report — ' || paper_id || ' — ' || title", "''", f"'- Generated at: {AT}'", "'- Paper title: `' || title || '`'", "''", "'## Pipeline Summary'", "''", "'- Pages parsed: **' || pages || '**'", "'- Sections detected: **' || sections || '**'", "'- Chunks generated: **' || chunks || '**'", *_INDEXED, "'## 1. Parsing'", "''")}
        UNION ALL {_of("1", "p", "'### Detected Sections'", "''", "'| # | Section | Start Page | Length (chars) |'", "'|---:|---|---:|---:|'")} UNION ALL {_of("1, i", "b", "'| ' || i || ' | `' || section || '` | ' || page || ' | ' || letters || ' |'")}
        UNION ALL {_of("2", "t", "''", "'## 2. Chunking'", "''", "'- Total chunks: **' || chunks || '**'", "''")} UNION ALL {_of("3", "p", "'### Chunk Distribution by Section'", "''", "'| Section | #Chunks |'", "'|---|---:|'")} UNION ALL {_of("3, j", "b", "'| `' || section || '` | ' || n || ' |'")}
        UNION ALL {_of("4", "p", "''", "'```'")} UNION ALL {_of("4, j", "b", "rpad(section, CAST(greatest(length(section), 20) AS INT), ' ') || ' ' || repeat('█', least(n, 30))")} UNION ALL {_of("5", "p", "'```'", "''", "'### Example Chunks'", "''")}
        UNION ALL {_of("5, k", "(FROM f WHERE k <= 3)", "'#### Chunk #' || chunk_index", "''", *_HIT)} UNION ALL {_of("6", "t", "'## 3. Index / Embedding'", "''", *_INDEXED)}
        UNION ALL {_of("7", "p", "'### Indexed Chunk Examples'", "''", "'| Chunk ID | Section | Page | Embedded | Preview |'", "'|---|---|---:|---|---|'")}
        UNION ALL {_of("7, k", "f", "'| `' || chunk_id || '` | `' || section || '` | ' || page || ' | ' || CASE WHEN chunk_id IN (SELECT chunk_id FROM e) THEN 'yes' ELSE 'no' END || ' | ' || left(flat, 80) || CASE WHEN length(flat) > 80 THEN '…' ELSE '' END || ' |'")}
        UNION ALL {_of("8", "p", "''", "'## 4. Retrieval Preview'", "''")} UNION ALL {_of("8, 1", "(FROM p WHERE paper_id NOT IN (SELECT paper_id FROM q))", "'> No retrieval preview rows found.'")}
        UNION ALL {_of("9, q", "q", "'### Query #' || q", "''", "'- claim_id: `' || claim_id || '`'", "''", "'```'", "'Order ' || claim_id", "'```'", "''", "'| Rank | Section | Page | BM25 | Semantic | Score |'", "'|---:|---|---:|---:|---:|---:|'")}
        UNION ALL {_of("9, q, 1, k", "h", "'| ' || k || ' | `' || section || '` | ' || page || ' | ' || printf('%.3f', bm25) || ' | ' || printf('%.3f', semantic) || ' | ' || printf('%.3f', combined) || ' |'")}
        UNION ALL {_of("9, q, 2", "q", "''", "'#### Evidence Snippets'", "''")} UNION ALL {_of("9, q, 2, k", "h", "'##### Rank #' || k", "''", *_HIT)}
        UNION ALL {_of("10", "(SELECT DISTINCT paper_id FROM q)", "'## 5. Retrieval Coverage'", "''", "'| Section | Retrieved Count |'", "'|---|---:|'")} UNION ALL {_of("10, j", "g", "'| `' || section || '` | ' || n || ' |'")}),
    n AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY x[1], x[2]) AS line, x[2] AS text FROM l)
    SELECT paper_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_letters, CAST(sum(CAST('0x' || left(md5(line || ':' || text), 8) AS BIGINT)) AS BIGINT) AS digest FROM n GROUP BY 1""")  # fmt: skip
def retrieval_reports(spark: SparkSession, d: str) -> DataFrame:
    """F32: reports on what was parsed, chunked, embedded and retrieved, as digests of all their lines; a language is a paper."""
    chunks = b.table(spark, d, "documents").select(F.col("lang").alias("paper_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_index"), F.col("source").alias("section"), (F.col("n_chars") % 50 + 1).alias("page"), "text")
    embeddings = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("m"), F.col("label") % 3).alias("model"), F.col("label").alias("at"))
    papers = chunks.select("paper_id").distinct().withColumn("title", F.concat(F.lit("Texts in "), F.col("paper_id")))
    rank = F.row_number().over(Window.partitionBy("paper_id", "l_orderkey").orderBy("l_linenumber", "l_extendedprice"))
    retrieved = b.table(spark, d, "lineitem").join(chunks.select("paper_id", "chunk_id"), F.col("chunk_id") == F.col("l_partkey")).select(
        "paper_id", F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("Order "), F.col("l_orderkey")).alias("claim_text"), rank.alias("rank"), (F.col("l_discount") * 10).alias("bm25"), F.col("l_tax").alias("semantic"), (F.col("l_quantity") / 50).alias("combined"), "chunk_id",
    )
    report = reports.retrieval_report(papers, chunks, embeddings, retrieved, AT)
    return documents.digests(documents.numbered(report, ["paper_id"], depth=2), ["paper_id"])
