"""Agents' logs as trajectories while they grow: numbered steps, with each tool's result at the step that called it.

A log's lines have numbers, so their order is known whenever they come. Lines that come early wait for those before them; lines
that don't come within a while are given up, and if they come after all, they are steps behind those that there are by then.
Lines that come twice count once. What a batch gives goes into a store by key in one write, so that a batch that is run again after
a failure changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lectern.sources.files import write_files, write_many
from lectern.sources.store import Store, Table
from lectern.streaming import logs

VERSION = "ATIF-v1.4"
#: What a line gives: a step, or an observation at the step whose number it has.
EVENT = "agent string, step_id long, seq long, position int, kind string, source string, message string, calls string, call_id string, content string, prompt_tokens long, completion_tokens long, cost double"
EVENTS = Table(EVENT, ["agent", "seq", "position", "kind"], by=["agent"])
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def parsed(lines: DataFrame) -> DataFrame:
    """agent, seq and `payload`, the JSON of what the line says; a row for every line."""
    said = F.struct("source", "message", "reasoning", "tool_calls", "results", "prompt_tokens", "completion_tokens", "cost")
    return logs.steps(lines, keep_all=True).select("agent", "seq", F.to_json(said).alias("payload"))


class Steps(StatefulProcessor):
    """State of an agent: the number of the next line and step, which step made a call, lines that wait, and gaps given up."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "seq long, step long")
        self.calls = handle.getMapState("calls", "id string", "step long")
        self.waiting = handle.getMapState("waiting", "seq long", "payload string")
        self.gaps = handle.getMapState("gaps", "first long", "last long")

    def _events(self, agent: str, seq: int, payload: str | None, step: int) -> tuple[int, list[tuple]]:
        """What a line gives, and the number of the next step after it."""
        e: dict[str, Any] = json.loads(payload) if payload else {}
        out: list[tuple] = []
        for i, r in enumerate(e.get("results") or []):
            found = self.calls.getValue((r["id"],))[0] if self.calls.containsKey((r["id"],)) else None
            if found is None:
                out.append((agent, step, seq, i, "step", "system", f"orphan tool_result for {r['id']}", None, None, None, 0, 0, None))
                found, step = step, step + 1
            out.append((agent, found, seq, i, "observation", None, None, None, r["id"], r.get("content", ""), 0, 0, None))
        if e.get("message") is not None or e.get("reasoning") is not None or e.get("tool_calls"):
            for c in e.get("tool_calls") or []:
                self.calls.updateValue((c.get("id"),), (step,))
            calls = json.dumps(e["tool_calls"], ensure_ascii=False, sort_keys=True) if e.get("tool_calls") else None
            out.append((agent, step, seq, -1, "step", e["source"], e.get("message"), calls, None, None, e["prompt_tokens"], e["completion_tokens"], e.get("cost")))
            step += 1
        return step, out

    def _ahead(self, agent: str, seq: int, step: int) -> tuple[int, int, list[tuple]]:
        """All that waits and is next in turn."""
        out: list[tuple] = []
        while self.waiting.containsKey((seq,)):
            payload = self.waiting.getValue((seq,))[0]
            self.waiting.removeKey((seq,))
            step, more = self._events(agent, seq, payload, step)
            seq, out = seq + 1, out + more
        return seq, step, out

    def _in_gap(self, seq: int) -> bool:
        """Whether the line was given up; if so, it no longer is."""
        for (first,), (last,) in list(self.gaps.iterator()):
            if first <= seq <= last:
                self.gaps.removeKey((first,))
                if first < seq:
                    self.gaps.updateValue((first,), (seq - 1,))
                if seq < last:
                    self.gaps.updateValue((seq + 1,), (last,))
                return True
        return False

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        agent = key[0]
        seq, step = self.at.get() if self.at.exists() else (1, 1)
        out: list[tuple] = []
        for frame in rows:
            for n, payload in zip(frame["seq"].tolist(), frame["payload"].tolist(), strict=True):
                payload = payload if isinstance(payload, str) else None
                if n == seq:
                    step, more = self._events(agent, n, payload, step)
                    seq, step, then = self._ahead(agent, seq + 1, step)
                    out += more + then
                elif n > seq:
                    self.waiting.updateValue((n,), (payload,))
                elif self._in_gap(n):
                    step, more = self._events(agent, n, payload, step)
                    out += more
        self.at.update((seq, step))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The first missing lines are given up; what waits behind them goes on."""
        seq, step = self.at.get()
        first = min((k for (k,) in self.waiting.keys()), default=None)
        out: list[tuple] = []
        if first is not None:
            self.gaps.updateValue((seq,), (first - 1,))
            seq, step, out = self._ahead(key[0], first, step)
            self.at.update((seq, step))
            if any(True for _ in self.waiting.keys()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def events_stream(lines: DataFrame, patience_ms: int = 30_000) -> DataFrame:
    """Events of a stream of agent, seq (from 1, without holes) and line. Needs the RocksDB state store."""
    return parsed(lines).groupBy("agent").transformWithStateInPandas(Steps(patience_ms), EVENT, "Append", "ProcessingTime")


def start(lines: DataFrame, store: Store, checkpoint: str, patience_ms: int = 30_000) -> StreamingQuery:
    """Writes a stream's events into the store's table `events`, a batch as one write."""
    done = lambda batch, n: store.put({"events": batch}, "trajectories", n)
    return events_stream(lines, patience_ms).writeStream.foreachBatch(done).option("checkpointLocation", checkpoint).outputMode("append").start()


def events(lines: DataFrame) -> DataFrame:
    """The same in batch, for logs whose lines are all there."""
    rows = logs.steps(lines)
    own = rows.where("message is not null or reasoning is not null or size(tool_calls) > 0").select(
        "agent", "seq", F.lit(-1).alias("position"), "source", "message", F.when(F.size("tool_calls") > 0, F.to_json("tool_calls")).alias("calls"), "prompt_tokens", "completion_tokens", "cost",
    )
    results = logs.attach(rows).select("agent", F.col("result_seq").alias("seq"), "position", F.col("id").alias("call_id"), "content", F.col("seq").alias("call_seq"))
    orphan = results.where("call_seq is null").select("agent", "seq", "position", F.lit("system").alias("source"), F.concat(F.lit("orphan tool_result for "), F.col("call_id")).alias("message"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
    numbered = own.unionByName(orphan, allowMissingColumns=True).withColumn("kind", F.lit("step"))
    numbered = numbered.withColumn("step_id", F.row_number().over(Window.partitionBy("agent").orderBy("seq", "position")).cast("long"))
    at = numbered.select("agent", F.col("seq").alias("at_seq"), F.col("position").alias("at_position"), "step_id")
    called = results.where("call_seq is not null").join(at, (at["agent"] == results["agent"]) & (at["at_seq"] == F.col("call_seq")) & (at["at_position"] == -1)).drop(at["agent"])
    lost = results.where("call_seq is null").join(at, (at["agent"] == results["agent"]) & (at["at_seq"] == F.col("seq")) & (at["at_position"] == F.col("position"))).drop(at["agent"])
    observed = called.unionByName(lost).select("agent", "step_id", "seq", "position", F.lit("observation").alias("kind"), "call_id", "content", F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
    return numbered.unionByName(observed, allowMissingColumns=True).select(*COLUMNS)


def final_metrics(rows: DataFrame) -> DataFrame:
    """Totals of each agent's trajectory."""
    steps = rows.where("kind = 'step'")
    return steps.groupBy("agent").agg(F.count(F.lit(1)).alias("total_steps"), F.sum("prompt_tokens").alias("total_prompt_tokens"), F.sum("completion_tokens").alias("total_completion_tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost_usd"))


def trajectory_lines(rows: DataFrame) -> DataFrame:
    """file (the agent), place and line: a JSON document of each agent, its head, a line for each step, and its metrics."""
    results = rows.where("kind = 'observation'").groupBy("agent", "step_id").agg(F.array_sort(F.collect_list(F.struct("seq", "position", F.struct(F.col("call_id").alias("source_call_id"), "content").alias("result")))).alias("all"))  # of one step
    steps = rows.where("kind = 'step'").join(results, ["agent", "step_id"], "left")
    last = F.lead("step_id").over(Window.partitionBy("agent").orderBy("step_id")).isNull()
    observation = F.when(F.col("all").isNotNull(), F.struct(F.transform("all", lambda r: r["result"]).alias("results")))
    step = F.to_json(F.struct("step_id", "source", "message", F.try_parse_json("calls").alias("tool_calls"), observation.alias("observation")))
    body = steps.select(F.col("agent").alias("file"), F.col("step_id").alias("place"), F.concat(step, F.when(last, "").otherwise(",")).alias("line"))
    agents = final_metrics(rows)
    head = agents.select(F.col("agent").alias("file"), F.lit(0).cast("long").alias("place"), F.concat(F.lit(f'{{"schema_version":"{VERSION}","agent":'), F.to_json(F.struct(F.col("agent").alias("name"))), F.lit(',"steps":[')).alias("line"))
    tail = agents.select(F.col("agent").alias("file"), F.lit(2**62).alias("place"), F.concat(F.lit('],"final_metrics":'), F.to_json(F.struct(*[c for c in agents.columns if c != "agent"])), F.lit("}")).alias("line"))
    return head.unionByName(body).unionByName(tail)


def write_trajectories(rows: DataFrame, root: str) -> None:
    """A JSON document for each agent below root, at file=<agent>."""
    write_files(trajectory_lines(rows), root, ["place"])


def write_documents(rows: DataFrame, root: str) -> None:
    """The same documents where agents are many: all their lines in one table, with the agent as file, and place."""
    write_many(trajectory_lines(rows), root, ["place"])
