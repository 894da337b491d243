"""Queries that read, reshape and write relations, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import upserts, windows
from lectern.plans import bindings as b
from lectern.plans.bindings import sql
from lectern.sources import sinks, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return add


@query("s7_conform", "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS paper_id, CAST(doc_id AS INT) AS chunk_index, source AS section, CAST(NULL AS INT) AS page, text, CAST(NULL AS VARCHAR) AS span_ids FROM documents")
def conform(spark: SparkSession, d: str) -> DataFrame:
    """Any table in a relation's shape."""
    rows = b.table(spark, d, "documents").withColumnsRenamed({"lang": "paper_id", "source": "section"}).withColumns({"ID": F.col("doc_id"), "chunk_index": F.col("doc_id")})
    return tables.conform(rows, tables.SCHEMAS["chunks"])


@query("s11_ordered_evidence", """SELECT doc_id, lang AS paper_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN n_chars % 3 = 0 THEN 0 WHEN n_chars % 3 = 1 THEN 1 ELSE 2 END, coalesce(nullif(n_chars % 7, 0), 99999), doc_id) AS INT) AS place FROM documents""")
def ordered_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Tables first, then figures, then the rest, by page."""
    kind = F.when(F.col("n_chars") % 3 == 0, 0).when(F.col("n_chars") % 3 == 1, 1).otherwise(2)
    page = F.coalesce(F.nullif(F.col("n_chars") % 7, F.lit(0)), F.lit(99999))
    docs = b.table(spark, d, "documents").select("doc_id", F.col("lang").alias("paper_id"), kind.alias("kind"), page.alias("page"))
    out = windows.ranked_in_parts(docs, ["paper_id"], [F.col("kind"), F.col("page"), F.expr("div(doc_id, 100000)")], [F.col("doc_id")], "place")
    return out.select("doc_id", "paper_id", "place")


@query("s9_latest_model", sql("""m AS (SELECT arg_max(action_type, (created_at, action_id)) AS model FROM actions) SELECT paper_id, count(*) AS vectors, min(action_id) AS first_vector FROM actions WHERE action_type = (SELECT model FROM m) GROUP BY 1""", "actions"))
def latest_model(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the model that was used last."""
    a = b.actions(spark, d)
    model = a.agg(F.max_by("action_type", F.struct("created_at", "action_id")).alias("action_type"))  # one row
    return a.join(F.broadcast(model), "action_type", "left_semi").groupBy("paper_id").agg(F.count(F.lit(1)).alias("vectors"), F.min("action_id").alias("first_vector"))


@query("s17_lookup", sql("""k AS (SELECT DISTINCT CAST(json_extract_string(details, '$.k') AS BIGINT) AS paper_id FROM actions WHERE action_type = 'view') SELECT p.paper_id, p.title FROM papers p SEMI JOIN k USING (paper_id)""", "papers", "actions"))
def lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a list of ids."""
    k = b.actions(spark, d).where("action_type = 'view'").select(F.get_json_object("details", "$.k").cast("long").alias("paper_id"))
    return b.papers(spark, d).join(k, "paper_id", "left_semi").select("paper_id", "title")


@query("s28_aliases", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), CAST(user_id AS VARCHAR)) AS name, CAST(value AS VARCHAR) IS NOT NULL AS has_value FROM events")
def aliases(spark: SparkSession, d: str) -> DataFrame:
    """The first alias that has a value."""
    rows = b.table(spark, d, "events").withColumn("label", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    out = tables.aliased(rows, {"event_id": ["event_id"], "name": ["missing", "label", "user_id"], "value": ["value"]})
    return out.select(F.col("event_id").cast("long").alias("event_id"), "name", F.col("value").isNotNull().alias("has_value"))


@query("s25_reply_kinds", """SELECT event_id, CASE event_type WHEN 'click' THEN 'review' WHEN 'view' THEN 'rebuttal' WHEN 'signup' THEN 'meta_review' WHEN 'purchase' THEN 'decision' ELSE 'other' END AS kind FROM events""")
def reply_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Replies by their invitations."""
    end = {"click": "Official_Review", "view": "Rebuttal", "signup": "Meta_Review", "purchase": "Decision", "error": "Comment"}
    name = F.create_map(*(F.lit(x) for kv in end.items() for x in kv))[F.col("event_type")]
    return b.table(spark, d, "events").select("event_id", tables.reply_kind(F.array(F.lit("Venue/-/Submission"), F.concat(F.lit("Venue/Paper1/-/"), name))).alias("kind"))


@query("s34_paper_windows", sql("SELECT paper_id, open_time, open_time + INTERVAL 48 HOUR AS review_end, open_time + INTERVAL 72 HOUR AS verdict_end, strftime(open_time, '%Y-%m-%dT%H:%M:%S.000Z') AS text FROM papers", "papers"))
def paper_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows from a time that came as text."""
    text = F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    p = b.papers(spark, d).select("paper_id", text.alias("text")).withColumn("open_time", tables.timestamp(F.col("text")))
    return p.select("paper_id", "open_time", (F.col("open_time") + F.expr("interval 48 hours")).alias("review_end"), (F.col("open_time") + F.expr("interval 72 hours")).alias("verdict_end"), "text")


@query("s38_shredded", "SELECT 'turns' AS name, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations UNION ALL SELECT 'threads', count(DISTINCT conv_id), NULL FROM conversations")
def shredded(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents built, then shredded into tables again."""
    nested = b.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("replies"))
    turns = nested.select("conv_id", F.explode("replies").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("r.text")).alias("chars"))
    return turns.select(F.lit("turns").alias("name"), "n", "chars").union(nested.agg(F.count(F.lit(1)).alias("n")).select(F.lit("threads"), "n", F.lit(None).cast("long")))


@query("s39_json_lines", "SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines and read again."""
    path = f"{tables.workspace(spark)}/documents.jsonl"
    docs = b.table(spark, d, "documents")
    sinks.write_json_lines(docs, path)
    return spark.read.schema(docs.schema).json(path).select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


@query("s42_csv", "SELECT event_id, event_type, value, props FROM events")
def csv(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read again."""
    path = f"{tables.workspace(spark)}/events.csv"
    events = b.table(spark, d, "events")
    fields = ["event_id", "event_type", "value", "props"]
    sinks.write_csv(events, path, fields)
    return spark.read.schema(events.select(*fields).schema).option("header", "true").option("escape", "\\").csv(path)


@query("s41_markdown", """SELECT c_custkey, '## ' || c_name || chr(10) || '- **c_mktsegment**: ' || coalesce(c_mktsegment, '—') || chr(10) || '- **c_nationkey**: ' || coalesce(CAST(c_nationkey AS VARCHAR), '—') AS markdown FROM customer""")
def markdown(spark: SparkSession, d: str) -> DataFrame:
    """A report's sections."""
    return sinks.markdown_rows(b.table(spark, d, "customer"), F.col("c_name"), ["c_mktsegment", "c_nationkey"]).select("c_custkey", "markdown")


@query("s49_audit_records", """WITH p AS (SELECT p_partkey, p_name, 'audit/' || p_partkey || '/verdict-' || left(sha256('verdict:' || p_partkey), 12) || '.md' AS path FROM part)
    SELECT left(sha256(path), 16) AS artifact_id, path, 'https://example.org/' || path AS url, p_name AS content FROM p""")
def audit_records(spark: SparkSession, d: str) -> DataFrame:
    """Audit files and their addresses."""
    return sinks.audit_records(b.table(spark, d, "part"), "verdict", "https://example.org/", "p_partkey", "p_name")


@query("u20_metadata", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM events""")
def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Keys merged into JSON."""
    old = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit("old").alias("state")))
    new = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit("new").alias("state")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"))))
    m = upserts.merged_metadata(old, new)
    return b.table(spark, d, "events").select("event_id", m["k"].alias("k"), m["kind"].alias("kind"), m["state"].alias("state"))


@query("u36_cache_states", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN user_id % 2 = 0 AND event_type IN ('view', 'click') THEN 'cache_hit_positive' WHEN user_id % 2 = 0 THEN 'cache_hit_negative' WHEN value < 5 THEN 'fresh_ocr_rejected' ELSE 'fresh_ocr' END AS state FROM events""")
def cache_states(spark: SparkSession, d: str) -> DataFrame:
    """What a cached or fresh outcome means."""
    from lectern.functions.rules import choose

    same, kind = F.col("user_id") % 2 == 0, F.col("event_type")
    state = choose((kind == "error", "error"), (same & kind.isin("view", "click"), "cache_hit_positive"), (same, "cache_hit_negative"), (F.col("value") < 5, "fresh_ocr_rejected"), other="fresh_ocr")
    return b.table(spark, d, "events").select("event_id", state.alias("state"))


@query("f1_effect_stub", "SELECT doc_id, CAST(length(text) % 5 + 1 AS BIGINT) AS score FROM documents")
def effect_stub(spark: SparkSession, d: str) -> DataFrame:
    """External effects: a scorer plugged in as a batched column, here a deterministic stub."""
    docs = b.table(spark, d, "documents").select("doc_id", "text")
    return sinks.with_effect(docs, ["text"], "score", "long", lambda batch: batch["text"].str.len() % 5 + 1).select("doc_id", "score")
