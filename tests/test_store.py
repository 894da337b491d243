"""Writes that replace rows: as a whole, once, and only their own buckets."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.sources.store import EXTRACTIONS, Store, Table, save_extractions

SPANS = Table("id string, paper_id string, at long, text string", ["id"], last=["at"])


def rows(store, name="spans"):
    return sorted(tuple(r) for r in store.rows(name).collect())


def test_put_replaces_by_key(spark, tmp_path):
    store, want, r = Store(spark, str(tmp_path / "s"), {"spans": SPANS}, 8), {}, random.Random(1)
    assert rows(store) == []
    for write in range(4):
        new = [(f"k{r.randrange(60)}", f"p{r.randrange(5)}", at, f"{write}.{at}") for at in range(40)]
        assert store.put({"spans": spark.createDataFrame(new, SPANS.schema)}, "test", write)
        want |= {x[0]: x for x in new}
        assert rows(store) == sorted(want.values())
    assert not store.put({"spans": spark.createDataFrame([("k1", "p", 0, "again")], SPANS.schema)}, "test", 3) and rows(store) == sorted(want.values())
    assert store.put({"spans": spark.createDataFrame([], SPANS.schema)}, "test", 4) and rows(store) == sorted(want.values())
    assert store.vacuum() > 0 and rows(store) == sorted(want.values()) and store.vacuum() == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"spans": SPANS}, 16)
    store.put({"spans": spark.createDataFrame([(f"k{i}", "p", i, "x") for i in range(100)], SPANS.schema)}, "a", 0)
    before = store._state()[1]["tables"]["spans"]
    store.put({"spans": spark.createDataFrame([("k7", "p", 0, "y")], SPANS.schema)}, "a", 1)
    after = store._state()[1]["tables"]["spans"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1


def test_a_scope_is_replaced_as_a_whole(spark, tmp_path):
    table = Table("claim string, model string, place int", ["claim", "model", "place"], by=["claim"], scope=["claim", "model"])
    store = Store(spark, str(tmp_path / "s"), {"hits": table}, 4)
    first = [(f"c{c}", m, p) for c in range(6) for m in ("a", "b", None) for p in range(3)]
    store.put({"hits": spark.createDataFrame(first, table.schema)}, "t", 0)
    store.put({"hits": spark.createDataFrame([("c1", "a", 9), ("c2", None, 9)], table.schema)}, "t", 1)
    want = [x for x in first if x[:2] not in (("c1", "a"), ("c2", None))] + [("c1", "a", 9), ("c2", None, 9)]
    assert sorted((tuple(r) for r in store.rows("hits").collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "t"), {"hits": Table("a string, b string", ["a", "b"], scope=["a"])})


def test_a_write_killed_before_its_marker_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), {"spans": SPANS}, 4)
    store.put({"spans": spark.createDataFrame([(f"k{i}", "p", i, "old") for i in range(20)], SPANS.schema)}, "t", 0)
    old, new = rows(store), spark.createDataFrame([(f"k{i}", "p", i, "new") for i in range(10, 30)], SPANS.schema)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            store.put({"spans": new}, "t", 1)
    assert rows(Store(spark, store.path, store.tables, 4)) == old
    assert store.put({"spans": new}, "t", 1) and not store.put({"spans": new}, "t", 1)
    assert rows(store) == sorted([x for x in old if int(x[0][1:]) < 10] + [tuple(r) for r in new.collect()])


def test_two_writers_of_one_marker(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"spans": SPANS}, 4)
    store.put({"spans": spark.createDataFrame([("k", "p", 0, "x")], SPANS.schema)}, "t", 0)
    with pytest.raises(RuntimeError):
        store._publish(1, {"writes": {}, "tables": {}})
    assert rows(store) == [("k", "p", 0, "x")]


def test_misses_are_filled_once(spark, tmp_path):
    table = Table("claim string, place int, text string", ["claim", "place"], by=["claim"], scope=["claim"])
    store, asked = Store(spark, str(tmp_path / "s"), {"hits": table}, 4), []

    def make(missing):
        asked.append(sorted(r[0] for r in missing.collect()))
        return missing.select("claim", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("place"), F.lit("found").alias("text"))

    for i, wanted in enumerate((["a", "b", "b"], ["b", "c"], ["a"])):
        got = store.filled("hits", spark.createDataFrame([(w,) for w in wanted], "claim string"), make, "live", i, ["claim"])
        assert sorted((r["claim"], r["place"]) for r in got.collect()) == sorted((w, p) for w in set(wanted) for p in (0, 1))
    assert asked == [["a", "b"], ["c"], []]


def test_extractions(spark, tmp_path):
    schema = "review_id string, paper_id string, model_id string, status string, started_at timestamp_ntz, claims array<struct<id:string,claim_index:int,claim_text:string,confidence:double>>"
    import datetime as dt

    day = lambda h: dt.datetime(2024, 1, 1, h)
    store = Store(spark, str(tmp_path / "s"), EXTRACTIONS, 4)
    batches = [
        [("r2", "p", "m", "success", day(2), [("c1", 0, "one", 0.5), ("c2", 1, "two", 0.6)]), ("r1", "p", "m", "error", day(2), None)],
        [("r1", "p", "m", "success", day(1), [("c2", 0, "two again", 0.7), ("c3", 1, "three", 0.1)]), ("r3", "p", "m", "success", day(0), [])],
    ]
    for i in (0, 1, 1):
        save_extractions(store, spark.createDataFrame(batches[i], schema), "run", i)
    assert [(r["run_id"], r["review_id"], r["status"], r["claims_count"]) for r in store.rows("runs").orderBy("run_id").collect()] == [(1, "r1", "error", 0), (2, "r2", "success", 2), (3, "r3", "success", 0), (4, "r1", "success", 2)]
    assert [(r["id"], r["run_id"], r["claim_text"]) for r in store.rows("claims").orderBy("id").collect()] == [("c1", 2, "one"), ("c2", 4, "two again"), ("c3", 4, "three")]
