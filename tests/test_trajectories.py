"""Trajectories of a stream: the batch's rows after a restart, out of order, twice, late, and with lines lost."""

import json
import os
import random
import time
from pathlib import Path

import pytest

from lectern.sources.store import Store
from lectern.streaming import trajectories

LINE = "agent string, seq long, line string"


def log(agent, n, seed):
    r, out, open_calls = random.Random(seed), [], []
    for seq in range(1, n + 1):
        kind = r.randrange(6)
        if kind == 0:
            line = ""
        elif kind == 1:
            line = f"[harness] {seq}"
        elif kind == 2 and open_calls:
            ids = [r.choice(open_calls), "zz"][: r.randrange(1, 3)]
            line = json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": f"{seq} done"} for i in ids]}})
        elif kind == 3:
            open_calls.append(f"t{r.randrange(4)}")
            line = json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": f"step {seq}"}, {"type": "tool_use", "id": open_calls[-1], "name": "run", "input": {"x": seq}}], "usage": {"input_tokens": seq, "output_tokens": 2}}})
        else:
            line = json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": f"\"{seq}\" äö"}], "usage": {"input_tokens": 1, "output_tokens": 1}}})
        out.append((agent, seq, line))
    return out


def told(rows):
    """Rows of events, with calls parsed: their JSON may be spaced in other ways."""
    return sorted((r["agent"], r["step_id"], r["seq"], r["position"], r["kind"], r["source"], r["message"], json.dumps([c["id"] for c in json.loads(r["calls"])]) if r["calls"] else None, r["call_id"], r["content"], r["prompt_tokens"], r["completion_tokens"]) for r in rows.collect())


@pytest.fixture
def streaming(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def fed(spark, folder, batches, first=0):
    for i, batch in enumerate(batches, first):
        part = f"{folder}/in/{i:03d}.json"
        Path(folder, "in").mkdir(exist_ok=True)
        Path(part).write_text("\n".join(json.dumps(dict(zip(("agent", "seq", "line"), x, strict=True))) for x in batch))
        t = time.time() - 1000 + i
        os.utime(part, (t, t))
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def run(spark, folder, store, stream, until, patience_ms):
    q = trajectories.start(stream, store, f"{folder}/checkpoint", patience_ms)
    end = time.time() + 120
    try:
        while time.time() < end and q.exception() is None:
            if until(store):
                return
            time.sleep(0.5)
        raise AssertionError(q.exception() or told(store.rows("events")))
    finally:
        q.stop()


def test_a_restarted_stream_gives_the_batch_rows(streaming, tmp_path):
    spark, store = streaming, Store(streaming, str(tmp_path / "store"), {"events": trajectories.EVENTS}, 4)
    lines = log("a", 60, 1) + log("b", 40, 2) + log("c", 1, 3)
    r = random.Random(5)
    late = sorted(lines, key=lambda x: x[1] + r.randrange(12))  # out of order by some lines
    batches = [late[:30], late[30:60] + late[10:20], late[60:]]  # and some twice
    want = told(trajectories.events(spark.createDataFrame(lines, LINE)))
    half = lambda s: s._state()[1]["writes"].get("trajectories", -1) >= 0
    run(spark, tmp_path, store, fed(spark, tmp_path, batches[:1]), half, 600_000)
    assert told(store.rows("events")) != want
    run(spark, tmp_path, store, fed(spark, tmp_path, batches[1:], 1), lambda s: told(s.rows("events")) == want, 600_000)
    # The files are those of the batch, byte for byte, and JSON.
    trajectories.write_trajectories(trajectories.events(spark.createDataFrame(lines, LINE)), str(tmp_path / "batch"))
    for agent, n in (("a", 60), ("b", 40)):
        files = [p for p in (tmp_path / "batch" / f"file={agent}").iterdir() if p.name.startswith("part-")]
        doc = json.loads("".join(p.read_text() for p in files))
        assert len(files) == 1 and doc["agent"] == {"name": agent} and [s["step_id"] for s in doc["steps"]] == list(range(1, len(doc["steps"]) + 1))
        assert doc["final_metrics"]["total_steps"] == len(doc["steps"]) and sum(len(s.get("observation", {"results": []})["results"]) for s in doc["steps"]) == sum(x[0] == agent and x[4] == "observation" for x in want)


def test_lost_and_late_lines(streaming, tmp_path):
    spark, store = streaming, Store(streaming, str(tmp_path / "store"), {"events": trajectories.EVENTS}, 2)
    lines = [("a", i, f"[x] {i}") for i in range(1, 8)]
    without = [x for x in lines if x[1] not in (3, 4)]
    seen = lambda s: [(x[1], x[6]) for x in told(s.rows("events"))]
    first = [(1, "[x] 1"), (2, "[x] 2"), (3, "[x] 5"), (4, "[x] 6"), (5, "[x] 7")]
    run(spark, tmp_path, store, fed(spark, tmp_path, [without]), lambda s: seen(s) == first, 1500)
    # The fourth line comes after it was given up, and once more; the third never does.
    run(spark, tmp_path, store, fed(spark, tmp_path, [[lines[3]], [lines[3], lines[0]]], 1), lambda s: seen(s) == [*first, (6, "[x] 4")], 1500)
