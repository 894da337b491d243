"""Reading: relations with a known shape from files of any, and lists of ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.rules import choose
from lectern.sources.shared import shared_folder

SCHEMAS = {
    "papers": "paper_id string, title string, open_time timestamp_ntz, review_end_time timestamp_ntz, verdict_end_time timestamp_ntz, state string, pdf_url string",
    "comments": "comment_id string, paper_id string, thread_id string, parent_id string, author_agent_id string, text string, created_at timestamp_ntz, is_ours boolean, is_citable boolean",
    "actions": "action_id long, paper_id string, action_type string, github_file_url string, external_id string, created_at timestamp_ntz, status string, error_message string, details string",
    "ledger": "paper_id string, action_type string, cost double, karma_before double, karma_after double, created_at timestamp_ntz",
    "claims": "id string, paper_id string, review_id string, claim_text string, verbatim_quote string, category string, confidence double, challengeability double",
    "verifications": "id string, claim_id string, paper_id string, review_id string, verdict string, confidence double, reasoning string, supporting_quote string, evidence string, model_id string, status string, error string, verified_at timestamp_ntz",
    "chunks": "id string, paper_id string, chunk_index int, section string, page int, text string, span_ids string",
    "evidence": "id string, paper_id string, object_type string, label string, page int, section string, caption_text string, retrieval_text string, content_text string, metadata string",
    "spans": "id string, paper_id string, page_num int, span_index int, text string, bbox string",
}


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The schema's columns in its order and types; what df lacks is null, what it has besides is dropped."""
    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    have = {c.lower(): c for c in df.columns}
    column = lambda f: F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)
    return df.select(*(column(f).cast(f.dataType).alias(f.name) for f in fields))


def relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A relation by its name in SCHEMAS from Parquet, JSON lines or CSV; empty if there is nothing at the path."""
    kind = {"json": "json", "jsonl": "json", "csv": "csv"}.get(path.rstrip("/").rsplit(".", 1)[-1], "parquet")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], SCHEMAS[name])
    return conform(spark.read.options(header=True).format(kind).load(path), SCHEMAS[name])


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """line_no and id: lines of a text file without blank ones and comments, each id where it comes first."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"), F.monotonically_increasing_id().alias("line_no"))
    return lines.where("id <> '' and not startswith(id, '#')").groupBy("id").agg(F.min("line_no").alias("line_no"))


def unwrapped(value: Column) -> Column:
    """The value of a {"value": ...} box, or the text itself."""
    return F.coalesce(F.get_json_object(value, "$.value"), value)


def aliased(df: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each name the first of its alias columns that isn't null or empty."""
    have = set(df.columns)
    first = lambda cs: F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in cs if c in have), F.lit(None))
    return df.select(*(first(cs).alias(n) for n, cs in names.items()))


def reply_kind(invitations: Column) -> Column:
    """What a reply is, by the end of an invitation's name."""
    ends = (("review", ("/Official_Review", "/Review")), ("rebuttal", ("/Rebuttal", "/Author_Rebuttal")), ("meta_review", ("/Meta_Review",)), ("decision", ("/Decision",)))
    ends_in = lambda suffixes: F.exists(invitations, lambda i: F.lower(i).rlike("(" + "|".join(suffixes).lower() + ")$"))
    return choose(*((ends_in(suffixes), kind) for kind, suffixes in ends), other="other")


def timestamp(value: Column) -> Column:
    """ISO text, with or without Z, as UTC without zone; null if it is neither."""
    return F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return shared_folder(spark)
