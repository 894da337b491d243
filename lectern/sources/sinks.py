"""Writing: JSON lines, CSV, Markdown reports, audit records, and effects that are not Spark's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> int:
    """An object for each row, nulls included; returns how many."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.text(path).count()


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The listed columns, with a header; nested ones as JSON."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")}
    df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in fields)).write.mode("overwrite").option("header", "true").csv(path)


def markdown_rows(df: DataFrame, title: Column, fields: Sequence[str], name: str = "markdown") -> DataFrame:
    """A section for each row: its title, then a list of its fields, `—` for nulls."""
    items = [F.concat(F.lit(f"- **{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit("—"))) for c in fields]
    return df.withColumn(name, F.concat_ws("\n", F.concat(F.lit("## "), title), *items))


def write_markdown(df: DataFrame, path: str, column: str = "markdown") -> None:
    """Sections as text files, a blank line between, in the order of df's partitions."""
    df.select(column).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def audit_records(df: DataFrame, kind: str, base_url: str, key: str, body: str) -> DataFrame:
    """artifact_id, path, url and content of one audit file per row: the same row always has the same name."""
    name = F.concat(F.lit(f"{kind}-"), F.left(F.sha2(F.concat_ws(":", F.lit(kind), F.col(key).cast("string")), 256), F.lit(12)), F.lit(".md"))
    path = F.concat_ws("/", F.lit("audit"), F.col(key).cast("string"), name)
    return df.select(F.left(F.sha2(path, 256), F.lit(16)).alias("artifact_id"), path.alias("path"), F.concat(F.lit(base_url.rstrip("/") + "/"), path).alias("url"), F.col(body).alias("content"))


def with_effect(df: DataFrame, inputs: Sequence[str], output: str, kind: str, effect: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """df with a column from outside Spark (a model, a service, a recogniser), in batches; tests give a deterministic stub."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield effect(batch.set_axis(list(inputs), axis=1)).set_axis(batch.index)

    call = F.pandas_udf(run, kind)  # type: ignore[call-overload]
    return df.withColumn(output, call(F.struct(*inputs)))
