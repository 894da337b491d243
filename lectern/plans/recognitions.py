"""Queries on audits of recognised figures and of boxes, and on recognised tables, with the SQL that each must agree with.

Figures are lines of orders whose state, tax, discount and quantity say what a recogniser did with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.rules import choose
from lectern.operators import matching
from lectern.operators import recognition as rec
from lectern.plans import bindings as b

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return add


def figures(spark: SparkSession, d: str) -> DataFrame:
    c = {x: F.col(x) for x in ("l_linestatus", "l_tax", "l_discount", "l_quantity", "l_returnflag", "l_extendedprice")}
    tried, failed = c["l_linestatus"] == "F", c["l_discount"] < 0.03
    reason = F.when(~tried, choose((c["l_discount"] < 0.05, "caption_only"), (c["l_discount"] < 0.08, "no_bbox"), other="disabled")).when(c["l_tax"] > 0.04, choose((failed, rec.FAILED), (c["l_discount"] < 0.06, "too_short"), other="low_quality"))
    fails = reason == rec.FAILED
    error = F.when(fails, choose((c["l_quantity"] < 15, "oom"), (c["l_quantity"] < 30, "timeout")))
    message = F.when(fails, F.concat(F.lit("  device "), F.floor(c["l_quantity"] % 7).cast("string"), F.repeat(F.lit(" out of memory"), F.floor(c["l_quantity"] / 3).cast("int"))))
    return b.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("paper_id"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("position"), tried.alias("attempted"), F.when(tried & (c["l_tax"] <= 0.04), "read").alias("text"), reason.alias("reason"),
        choose((c["l_returnflag"] == "R", "high"), (c["l_returnflag"] == "A", "inferred"), (c["l_quantity"] < 10, "")).alias("confidence"), error.alias("error_type"), message.alias("error_message"),
        F.when(c["l_tax"] > 0.01, c["l_extendedprice"] / 100).alias("elapsed"), F.concat(F.lit("Figure "), F.col("l_linenumber")).alias("label"), (F.col("l_partkey") % 5).alias("page"), F.when(c["l_discount"] > 0.07, "slow").alias("outcome"),
    )


_FIGURES = """f0 AS (SELECT *, l_suppkey AS paper_id, (l_orderkey, l_linenumber, l_extendedprice) AS pos, l_linestatus = 'F' AS tried FROM lineitem),
    f1 AS (SELECT *, CASE WHEN NOT tried THEN CASE WHEN l_discount < 0.05 THEN 'caption_only' WHEN l_discount < 0.08 THEN 'no_bbox' ELSE 'disabled' END WHEN l_tax > 0.04 THEN CASE WHEN l_discount < 0.03 THEN 'inference_failed' WHEN l_discount < 0.06 THEN 'too_short' ELSE 'low_quality' END END AS reason,
        CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'inferred' ELSE 'unknown' END AS confidence, CASE WHEN NOT tried THEN 'never_attempted' WHEN l_tax <= 0.04 THEN 'accepted' ELSE 'rejected_after_inference' END AS status FROM f0),
    figures AS (SELECT *, CASE WHEN reason = 'inference_failed' THEN CASE WHEN l_quantity < 15 THEN 'oom' WHEN l_quantity < 30 THEN 'timeout' ELSE 'unknown' END END AS error_type FROM f1),
    pairs AS (SELECT paper_id, pos, status, unnest(['all', 'reason', 'confidence', 'error_type']) AS dimension, unnest([NULL, coalesce(reason, 'none'), confidence, error_type]) AS value FROM figures),
    counted AS (SELECT *, row_number() OVER (PARTITION BY paper_id, dimension ORDER BY n DESC, first) AS place FROM (SELECT paper_id, dimension, value, count(*) AS n, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected_after_inference') AS rejected,
        count(*) FILTER (status = 'never_attempted') AS never, min(pos) AS first FROM pairs WHERE dimension = 'all' OR value IS NOT NULL GROUP BY 1, 2, 3))"""


@query("f35_recognition_counts", f"WITH {_FIGURES} SELECT paper_id, dimension, value, CAST(place AS INT) AS place, n, accepted, rejected, never FROM counted")
def recognition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reasons, confidences and errors of each paper's figures, with outcomes, in one pass."""
    return rec.counts(figures(spark, d), ["paper_id"]).select("paper_id", "dimension", "value", "place", "n", "accepted", "rejected", "never")


@query("f35_recognition_samples", f"""WITH {_FIGURES}, m AS (SELECT paper_id, left('device ' || CAST(floor(l_quantity % 7) AS INT) || repeat(' out of memory', CAST(floor(l_quantity / 3) AS INT)), 150) AS cut, min(pos) AS first FROM figures WHERE reason = 'inference_failed' GROUP BY 1, 2)
    SELECT paper_id, CAST(place AS INT) AS place, cut AS message FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY first) AS place FROM m) WHERE place <= 5""")
def recognition_samples(spark: SparkSession, d: str) -> DataFrame:
    """the first five different messages of each paper's failures."""
    return rec.samples(figures(spark, d), ["paper_id"]).select("paper_id", "place", "message")


@query("f35_recognition_latencies", f"""WITH {_FIGURES}, t AS (SELECT paper_id, l_extendedprice / 100 AS s FROM figures WHERE tried AND l_tax > 0.01), l AS (SELECT paper_id, list(s ORDER BY s) AS v, count(*) AS n, avg(s) AS mean FROM t GROUP BY 1)
    SELECT paper_id, n AS n_timed, round(mean * n, 1) AS total, round(mean, 1) AS mean, round(v[n // 2 + 1], 1) AS median, round(v[greatest(0, CAST(floor(n * 95 / 100) AS INT) - 1) + 1], 1) AS p95 FROM l""")
def recognition_latencies(spark: SparkSession, d: str) -> DataFrame:
    """A17 by paper, F35: exact statistics of the seconds that recognition took."""
    return rec.latencies(figures(spark, d), ["paper_id"])


@query("f35_recognition_slowest", f"""WITH {_FIGURES}, t AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY l_extendedprice / 100 DESC, pos) AS place FROM figures WHERE tried AND l_tax > 0.01)
    SELECT paper_id, CAST(place AS INT) AS place, 'Figure ' || l_linenumber AS label, l_partkey % 5 AS page, round(l_extendedprice / 100, 1) AS elapsed, CASE WHEN l_discount > 0.07 THEN 'slow' ELSE status END AS outcome FROM t WHERE place <= 5""")
def recognition_slowest(spark: SparkSession, d: str) -> DataFrame:
    """each paper's five slowest figures."""
    return rec.slowest(figures(spark, d), ["paper_id"])


@query("f36_recognition_notes", f"""WITH {_FIGURES}, s AS (SELECT paper_id, sum(n) FILTER (dimension = 'all') AS n, sum(accepted) FILTER (dimension = 'all') AS a, sum(rejected) FILTER (dimension = 'all') AS r, sum(never) FILTER (dimension = 'all') AS v, coalesce(sum(n) FILTER (value = 'caption_only'), 0) AS c,
        arg_min(value, place) FILTER (dimension = 'reason' AND value NOT IN ({", ".join(f"'{x}'" for x in (*rec.NOT_TRIED, "none"))})) AS why, coalesce(sum(n) FILTER (value = 'high'), 0) AS hn, coalesce(sum(accepted) FILTER (value = 'high'), 0) AS ha, coalesce(sum(never) FILTER (value = 'high'), 0) AS hv FROM counted GROUP BY 1),
    l AS (SELECT paper_id, list_filter([CAST(round_even(100.0 * v / n, 0) AS INT) || '% of figures (' || v || '/' || n || ') were never attempted — OCR did not run, typically due to caption_only bbox or missing dependencies.',
        CASE WHEN a + r = 0 THEN 'No OCR inference was attempted for any figure in this set.' ELSE 'Of ' || (a + r) || ' attempted figures, ' || a || ' were accepted (' || CAST(round_even(100.0 * a / (a + r), 0) AS INT) || '% acceptance rate).' END,
        CASE WHEN c / n > 0.35 THEN 'caption_only is the leading skip reason (' || c || '/' || n || ' figures) — these figures have no reliable crop region because only a caption span was found.' END,
        CASE WHEN r > 0 THEN r || ' figures passed inference but were rejected by quality filter (' || CAST(round_even(100.0 * r / (a + r), 0) AS INT) || '% of attempted)' || coalesce(' (most common: ' || why || ')', '') || '.' END,
        CASE WHEN hn > 0 THEN 'Figures with ''high'' bbox confidence: ' || ha || '/' || hn || ' accepted, ' || hv || ' never attempted — ' || CASE WHEN ha > hv THEN 'high-confidence bboxes show better OCR coverage.' ELSE 'even high-confidence bboxes have significant never-attempted figures.' END END], lambda x: x IS NOT NULL) AS x FROM s)
    SELECT paper_id, CAST(unnest(range(1, len(x) + 1)) AS INT) AS place, unnest(x) AS note FROM l""")
def recognition_notes(spark: SparkSession, d: str) -> DataFrame:
    """up to five sentences on each paper's figures."""
    return rec.notes(rec.counts(figures(spark, d), ["paper_id"]), ["paper_id"])


@query("f34_box_audit", """WITH o AS (SELECT user_id AS paper_id, event_id, event_type, coalesce(nullif(split_part(CAST(floor(value / 40) AS VARCHAR), '.', 1), '0'), 'unknown') AS source, value >= 80 AS refined, CASE WHEN value >= 80 AND floor(value) <> 100 THEN round(value / 500, 3) ELSE 0 END AS score FROM events),
    p AS (SELECT paper_id, event_id, refined, score, unnest(['all', 'type', 'source']) AS dimension, unnest([NULL, event_type, source]) AS value FROM o),
    g AS (SELECT paper_id, dimension, value, count(*) AS n, count(*) FILTER (refined) AS refined, count(*) FILTER (refined AND score <> 0) AS k, CAST(sum(round(score * 1000)) FILTER (refined AND score <> 0) AS BIGINT) AS s, min(event_id) AS first FROM p GROUP BY 1, 2, 3)
    SELECT paper_id, dimension, value, CAST(row_number() OVER (PARTITION BY paper_id, dimension ORDER BY n DESC, first) AS INT) AS place, n, refined, CASE WHEN k > 0 THEN (2 * s + k) // (2 * k) / 1000.0 END AS mean_score FROM g""")
def box_audit(spark: SparkSession, d: str) -> DataFrame:
    """A paper's objects by type and by the source of their boxes."""
    step, value = F.floor(F.col("value") / 40).cast("string"), F.col("value")
    rows = b.table(spark, d, "events").select(
        F.col("user_id").alias("paper_id"), F.col("event_id").alias("position"), F.col("event_type").alias("object_type"), F.coalesce(F.nullif(step, F.lit("0")), F.lit("unknown")).alias("source"), (value >= 80).alias("refined"),
        F.when((value >= 80) & (F.floor(value) != 100), b.rounded(value / 500, 3)).otherwise(0.0).alias("score"),
    )
    return rec.box_audit(rows, ["paper_id"]).select("paper_id", "dimension", "value", "place", "n", "refined", "mean_score")


_TITLES = r"""words AS (SELECT doc_id, n_chars, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents),
    objects AS (SELECT doc_id AS object_id, doc_id // 10 + CASE WHEN n_chars % 9 = 0 THEN 1000000 ELSE 0 END AS page, CASE WHEN n_chars % 7 > 0 THEN 'table' ELSE 'figure' END AS kind, CASE n_chars % 3 WHEN 0 THEN 'Table ' || n_chars % 10 WHEN 1 THEN 'TABLE ' || n_chars % 10 || '.' END AS label, array_to_string(w[1:12], ' ') AS caption, n_chars % 5 = 0 AS enriched FROM words),
    tables AS (SELECT doc_id AS table_id, doc_id // 10 AS page, n_chars AS place, CASE WHEN n_chars % 4 > 0 THEN 'Table ' || n_chars % 10 || CASE WHEN n_chars % 2 = 1 THEN ': ' ELSE '' END END AS label, array_to_string(w[6:30], ' ') AS caption FROM words WHERE n_chars % 6 > 0)"""


@query("j7_topk_enrichment", rf"""WITH {_TITLES}, r AS (SELECT l_partkey AS object_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS rank FROM lineitem),
    due AS (SELECT * FROM objects WHERE kind = 'table' AND object_id IN (SELECT object_id FROM r WHERE rank <= 2)), n AS (SELECT page, count(*) AS n FROM tables GROUP BY 1),
    p AS (SELECT object_id, table_id, place, n, lower(trim(o.label)) AS a, lower(trim(t.label)) AS b, len(list_intersect(list_distinct(regexp_extract_all(lower(o.caption), '[\p{{L}}\p{{N}}_]+')), list_distinct(regexp_extract_all(lower(t.caption), '[\p{{L}}\p{{N}}_]+')))) AS shared FROM due o JOIN tables t USING (page) JOIN n USING (page) WHERE NOT enriched),
    m AS (SELECT *, CASE WHEN a = b THEN 0 WHEN regexp_replace(a, '[:\.\s]+$', '') = regexp_replace(b, '[:\.\s]+$', '') THEN 1 WHEN shared >= 4 THEN 2 WHEN n = 1 THEN 3 END AS mode FROM p),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY mode, CASE WHEN mode = 2 THEN -shared END, place, table_id) AS k FROM m WHERE mode IS NOT NULL) WHERE k = 1)
    SELECT object_id, CASE WHEN enriched THEN 'skipped_already' WHEN table_id IS NULL THEN 'no_match' ELSE 'enriched' END AS outcome, table_id, ['exact_label_page', 'label_page', 'caption_page', 'page_only'][mode + 1] AS mode FROM due LEFT JOIN best USING (object_id)""")  # fmt: skip
def topk_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The tables among claims' first two pieces of evidence that aren't enriched yet, and the recognised table of each.

    Objects and tables are documents, ten to a page; their captions are parts of the texts.
    """
    n = F.col("n_chars")
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\S+"), F.lit(0))
    rows = b.table(spark, d, "documents").select("doc_id", "n_chars", words.alias("w"))
    page, number = F.floor(F.col("doc_id") / 10), (n % 10).cast("string")
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    objects = rows.select(
        F.col("doc_id").alias("object_id"), (page + F.when(n % 9 == 0, 1_000_000).otherwise(0)).alias("page"), F.when(n % 7 > 0, "table").otherwise("figure").alias("kind"),
        choose((n % 3 == 0, F.concat(F.lit("Table "), number)), (n % 3 == 1, F.concat(F.lit("TABLE "), number, F.lit(".")))).alias("label"), part(1, 12).alias("caption"), (n % 5 == 0).alias("enriched"),
    )
    label = F.when(n % 4 > 0, F.concat(F.lit("Table "), number, F.when(n % 2 == 1, ": ").otherwise("")))
    tables = rows.where("n_chars % 6 > 0").select(F.col("doc_id").alias("table_id"), page.alias("page"), n.alias("place"), label.alias("label"), part(6, 25).alias("caption"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice"))
    retrieved = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("object_id"), rank.alias("rank"))
    return matching.topk_enrichment(retrieved, objects, tables, ["page"], 2).select("object_id", "outcome", "table_id", "mode")
