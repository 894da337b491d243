"""Log translation: batch and stream give the same steps."""

import json
import time

from lectern.streaming import logs

LINES = [
    ("a", 1, json.dumps({"type": "system", "subtype": "init", "model": "m"})),
    ("a", 2, "[harness] started"),
    ("a", 3, "  "),
    ("a", 4, json.dumps({"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "run", "input": {"x": 1}}], "usage": {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 3}}})),
    ("a", 5, json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}, {"type": "tool_result", "tool_use_id": "zz", "content": "lost"}]}})),
    ("a", 6, json.dumps({"type": "rate_limit_event", "rate_limit_info": {"status": "allowed"}})),
    ("a", 7, json.dumps({"type": "result", "cost_usd": 0.5, "num_turns": 3})),
    ("a", 8, "[1, 2]"),
]


def test_steps(spark):
    steps = logs.steps(spark.createDataFrame(LINES, "agent string, seq long, line string")).cache()
    got = [(r["step_id"], r["source"], r["message"], r["total_prompt"]) for r in logs.numbered(steps).orderBy("step_id").collect()]
    assert got == [(1, "system", "session started model=m", 0), (2, "system", "[harness] started", 0), (3, "agent", "hi", 8), (4, "system", "session ended turns=3 cost=$0.5000", 8)]
    assert {(r["id"], r["seq"], r["content"]) for r in logs.attach(steps).collect()} == {("t1", 4, "done"), ("zz", None, "lost")}


PLAIN = [("a", 1, "one"), ("a", 2, "two "), ("a", 3, ""), ("a", 4, "[run] note"), ("a", 5, "three"), ("b", 1, "only"), ("b", 2, "")]


def test_paragraphs(spark, tmp_path):
    schema = "agent string, seq long, line string"
    batch = {tuple(r) for r in logs.paragraphs(spark.createDataFrame(PLAIN, schema)).collect()}
    assert batch == {("a", 1, "agent", "one\ntwo"), ("a", 4, "system", "[run] note"), ("a", 5, "agent", "three"), ("b", 1, "agent", "only")}
    for i, part in enumerate((PLAIN[:2], PLAIN[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q = logs.paragraphs_stream(stream).writeStream.format("memory").queryName("steps").outputMode("append").start()
    # with a timer the query never runs out of batches, and the last open paragraph waits for its timer
    want, until = batch - {("a", 5, "agent", "three")}, time.time() + 90
    while (got := {tuple(r) for r in spark.table("steps").collect()}) != want and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert got == want
