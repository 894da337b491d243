"""A corpus made ready for training: STAGES in order, each over all that the one before kept.

Quality, exact copies, near copies and contamination each drop documents; what is left is packed into sequences. Each
stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of docs, whatever they
are. The stages are written and reread in between, so a later one never runs an earlier one again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._common import Scratch, ordered, without
from lectern.llm.decontaminate import decontaminate
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.near_dups import near_duplicates
from lectern.llm.packing import placed, tokenized
from lectern.llm.quality import fitted, good
from lectern.llm.queries import TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier (1) rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good(docs, fitted(docs, labels, Scratch(spark))[1])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of those with equal texts (4)."""
    scratch = Scratch(spark)
    rows = ordered(docs, scratch, whole=True)
    return without(rows, exact_dedup(rows, scratch, in_order=True).where("not kept"), scratch)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that links of shingle similarity make (10)."""
    scratch = Scratch(spark)
    rows = ordered(docs, scratch, whole=True)
    return without(rows, near_duplicates(rows, scratch, in_order=True).where("not first"), scratch)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages contaminate (3)."""
    scratch = Scratch(spark)
    rows = ordered(docs, scratch, whole=True)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(rows, decontaminate(rows, benchmark, key="ord").where("contaminated").select(F.col("row").alias("ord")), scratch)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences (9)."""
    pieces = tokenized(docs, TOKENIZER).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return placed(pieces, Scratch(spark)).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL has no classifier or tokenizer; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
