"""The workload's relations, bound to the star schema: in Spark, and as SQL for the comparison."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 31)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as the SQL's engine does: times a power of ten, rounded, divided. F.round takes the shortest decimal that
    names the double instead, which makes a tie of 9725 / 500000 = 0.01945, a double below it."""
    return F.round(c * float(10**digits), 0) / float(10**digits)


def papers(spark: SparkSession, d: str) -> DataFrame:
    opened = F.expr("timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(0, cast(p_partkey % 90 - 6 as int), 0, 0)")
    return table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), opened.alias("open_time"), F.col("p_retailprice").alias("karma"))


def comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("paper_id"), F.col("l_orderkey").alias("thread_id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("author_id"),
        (F.col("l_returnflag") == "R").alias("is_ours"), (F.col("l_linestatus") == "O").alias("is_citable"), F.col("l_shipdate").alias("created_at"), F.col("l_extendedprice").alias("weight"),
    )


def verifications(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "N", "supported").when(F.col("l_returnflag") == "R", "refuted").otherwise("insufficient_evidence")
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("paper_id"), F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("review_id"), F.col("l_linenumber").alias("position"), verdict.alias("verdict"),
        rounded(F.col("l_discount") * 10, 2).alias("confidence"), F.when(F.col("l_linestatus") == "F", "success").otherwise("error").alias("status"), F.col("l_shipdate").alias("verified_at"), F.col("l_extendedprice").alias("tie"),
    )


def actions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("action_id"), F.col("user_id").alias("paper_id"), F.col("event_type").alias("action_type"), F.col("ts").alias("created_at"), F.col("value").alias("cost"), F.col("props").alias("details"))


def extractions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("experiment"), F.col("o_custkey").alias("claim_key"), rounded(F.col("o_totalprice") / 500000, 4).alias("confidence"), F.col("o_orderkey").alias("position"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("field"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("paper_id"), F.col("doc_id").alias("chunk_index"), F.col("source").alias("section"), "text", F.col("n_chars"))


#: The same relations as common table expressions.
SQL = {
    "papers": f"papers AS (SELECT p_partkey AS paper_id, p_name AS title, p_brand AS venue, {NOW_SQL} - to_hours(CAST(p_partkey % 90 - 6 AS INT)) AS open_time, p_retailprice AS karma FROM part)",
    "comments": """comments AS (SELECT l_partkey AS paper_id, l_orderkey AS thread_id, l_linenumber AS position, l_suppkey AS author_id, l_returnflag = 'R' AS is_ours,
        l_linestatus = 'O' AS is_citable, l_shipdate AS created_at, l_extendedprice AS weight FROM lineitem)""",
    "verifications": """verifications AS (SELECT l_partkey AS paper_id, l_orderkey AS claim_id, l_suppkey AS review_id, l_linenumber AS position,
        CASE l_returnflag WHEN 'N' THEN 'supported' WHEN 'R' THEN 'refuted' ELSE 'insufficient_evidence' END AS verdict, round(l_discount * 10, 2) AS confidence,
        CASE l_linestatus WHEN 'F' THEN 'success' ELSE 'error' END AS status, l_shipdate AS verified_at, l_extendedprice AS tie FROM lineitem)""",
    "actions": "actions AS (SELECT event_id AS action_id, user_id AS paper_id, event_type AS action_type, ts AS created_at, value AS cost, props AS details FROM events)",
    "extractions": "extractions AS (SELECT o_orderpriority AS experiment, o_custkey AS claim_key, round(o_totalprice / 500000, 4) AS confidence, o_orderkey AS position, o_orderdate AS started_at, o_orderstatus AS field FROM orders)",
    "chunks": "chunks AS (SELECT lang AS paper_id, doc_id AS chunk_index, source AS section, text, n_chars FROM documents)",
}


def sql(body: str, *relations: str) -> str:
    """A query over some of the relations; body may begin with further expressions, `name AS (...), ...`, and ends with SELECT."""
    head = ", ".join(SQL[r] for r in relations)
    return f"WITH {head}{' ' if body.lstrip().upper().startswith('SELECT') else ', '}{body}"
