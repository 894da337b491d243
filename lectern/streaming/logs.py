"""Agent logs as steps: JSON lines without state, plain text with it; the same functions serve batch and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = """type string, subtype string, model string, session_id string, cost_usd double, num_turns long, rate_limit_info struct<status:string>,
    message struct<model:string, content:array<struct<type:string, text:string, thinking:string, id:string, name:string, input:string, tool_use_id:string, content:string>>,
    usage:struct<input_tokens:long, output_tokens:long, cache_read_input_tokens:long, cache_creation_input_tokens:long>>"""


def steps(lines: DataFrame, keep_all: bool = False) -> DataFrame:
    """agent, seq, line to agent, seq, source, message, reasoning, tool_calls, results, prompt_tokens, completion_tokens, cost.

    One line is one step at most; blank lines, lists, empty messages and allowed rate limits give none. What isn't JSON is
    a system message. Tool results come as `results` of a row without message, for attach(). keep_all: lines that give none
    are rows, too, without message, calls or results.
    """
    line = F.trim("line")
    e = F.from_json(line, EVENT, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_line", line).withColumn("e", e)
    rows = rows if keep_all else rows.where("_line <> ''")
    is_json = F.try_parse_json("_line").isNotNull()
    blocks = F.coalesce(F.col("e.message.content"), F.from_json(F.lit("[]"), "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"))
    of = lambda kind, field: F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: F.trim(b[field])), lambda t: t != "")
    kind = F.col("e.type")
    assistant = kind == "assistant"
    ended = F.concat(F.lit("session ended turns="), F.coalesce(F.col("e.num_turns").cast("string"), F.lit("None")), F.when(F.col("e.cost_usd") > 0, F.format_string(" cost=$%.4f", F.col("e.cost_usd"))).otherwise(""))
    message = (
        F.when(~is_json, F.col("_line"))
        .when((kind == "system") & (F.col("e.subtype") == "init"), F.concat(F.lit("session started model="), F.coalesce("e.model", F.lit("?"))))
        .when(assistant, F.nullif(F.array_join(of("text", "text"), "\n\n"), F.lit("")))
        .when(kind == "result", ended)
        .when((kind == "rate_limit_event") & (F.coalesce("e.rate_limit_info.status", F.lit("?")) != "allowed"), F.concat(F.lit("rate limit: "), F.coalesce("e.rate_limit_info.status", F.lit("?"))))
    )
    call = lambda b: F.struct(b["id"].alias("id"), F.coalesce(b["name"], F.lit("?")).alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("arguments"))
    calls = F.when(assistant, F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), call))
    results = F.when(kind == "user", F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), lambda b: F.struct(F.coalesce(b["tool_use_id"], F.lit("")).alias("id"), F.coalesce(b["content"], F.lit("")).alias("content"))))
    usage = F.col("e.message.usage")
    out = rows.select(
        "agent", "seq", F.when(assistant, "agent").otherwise("system").alias("source"), message.alias("message"), F.when(assistant, F.nullif(F.array_join(of("thinking", "thinking"), "\n\n"), F.lit(""))).alias("reasoning"),
        calls.alias("tool_calls"), results.alias("results"), (F.coalesce(usage["input_tokens"], F.lit(0)) + F.coalesce(usage["cache_read_input_tokens"], F.lit(0)) + F.coalesce(usage["cache_creation_input_tokens"], F.lit(0))).alias("prompt_tokens"),
        F.coalesce(usage["output_tokens"], F.lit(0)).alias("completion_tokens"), F.col("e.cost_usd").alias("cost"),
    )
    if keep_all:
        return out.withColumn("message", F.nullif(F.col("message"), F.lit("")))
    return out.where("message is not null or reasoning is not null or size(tool_calls) > 0 or size(results) > 0")


def numbered(step_rows: DataFrame) -> DataFrame:
    """step_id from 1 within each agent, and running totals of tokens, for a batch of steps."""
    w = Window.partitionBy("agent").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = step_rows.where("size(results) is null or size(results) <= 0")
    return rows.withColumns({"step_id": F.row_number().over(w), "total_prompt": F.sum("prompt_tokens").over(run), "total_completion": F.sum("completion_tokens").over(run)})


def attach(step_rows: DataFrame) -> DataFrame:
    """agent, seq of the step, id, content: a tool's result belongs to the last step before it that made that call; seq null for orphans."""
    calls = step_rows.select("agent", F.col("seq").alias("call_seq"), F.explode("tool_calls").alias("c")).select("agent", "call_seq", F.col("c.id").alias("id"))
    results = step_rows.select("agent", F.col("seq").alias("result_seq"), F.posexplode("results").alias("position", "r")).select("agent", "result_seq", "position", F.col("r.id").alias("id"), F.col("r.content").alias("content"))
    both = results.join(calls, ["agent", "id"], "left").where("call_seq is null or call_seq < result_seq")
    found = both.groupBy("agent", "result_seq", "position", "id").agg(F.max("call_seq").alias("seq"))
    return results.join(found, ["agent", "result_seq", "position", "id"], "left").select("agent", "seq", "id", "content", "result_seq", "position")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Plain-text logs in batch: consecutive lines make a step; blank lines and harness lines ('[...] ...') end it.

    agent, seq (of the first line), source, message.
    """
    rows = lines.withColumn("_t", F.rtrim("line")).withColumn("_own", F.col("_t").rlike(r"^\[[A-Za-z]"))
    breaks = (F.col("_t") == "") | F.col("_own") | F.lag("_own", default=False).over(Window.partitionBy("agent").orderBy("seq"))
    w = Window.partitionBy("agent").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_new", breaks.cast("int")).withColumn("_group", F.sum("_new").over(w)).where("_t <> ''")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_t"))), lambda x: x["_t"])
    out = rows.groupBy("agent", "_group").agg(F.min("seq").alias("seq"), F.bool_or("_own").alias("_sys"), F.array_join(texts, "\n").alias("message"))
    return out.select("agent", "seq", F.when(F.col("_sys"), "system").otherwise("agent").alias("source"), "message")


STEP = "agent string, seq long, source string, message string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """paragraphs() with the open paragraph kept between micro-batches; a quiet stream is flushed when its timer ends."""
    first, text = state.get if state.exists else (None, "")
    out: list[tuple] = []

    def close() -> None:
        nonlocal first, text
        if text:
            out.append((key[0], first, "agent", text))
        first, text = None, ""

    if state.hasTimedOut:
        close()
    else:
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, line in zip(rows["seq"], rows["line"], strict=True):
            line = (line or "").rstrip()
            own = len(line) > 1 and line[0] == "[" and line[1].isalpha() and line[1].isascii()
            if not line or own:
                close()
                if own:
                    out.append((key[0], seq, "system", line))
            else:
                first, text = (seq, line) if first is None else (first, f"{text}\n{line}")
    if text:
        state.update((int(first), text))
        state.setTimeoutDuration(30_000)
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["agent", "seq", "source", "message"])


def paragraphs_stream(lines: DataFrame) -> DataFrame:
    """The same for a stream of agent, seq, line."""
    return lines.groupBy("agent").applyInPandasWithState(_fold, STEP, "first long, text string", "append", GroupStateTimeout.ProcessingTimeTimeout)
