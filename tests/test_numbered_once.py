"""Extractions are numbered once for both of their tables, and a write that is done isn't made again."""

from lectern.sources import store as stores
from lectern.sources.store import EXTRACTIONS, Store, save_extractions


def test_extractions_are_numbered_once(spark, tmp_path, monkeypatch):
    store, plans = Store(spark, str(tmp_path / "s"), EXTRACTIONS, 4), []
    results = spark.sql("SELECT 'r' || id AS review_id, 'p' AS paper_id, 'm' AS model_id, 'ok' AS status, timestamp_ntz'2024-01-01 00:00:00' AS started_at, array(struct('c' || id AS id, 0 AS claim_index, 't' AS claim_text, 0.5D AS confidence)) AS claims FROM range(9)")
    put = Store.put
    monkeypatch.setattr(Store, "put", lambda self, changes, *a: plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in changes.values()) or put(self, changes, *a))
    assert save_extractions(store, results, "run", 0)
    assert len(plans) == 2 and not any("Window" in p for p in plans)
    assert sorted(r["run_id"] for r in store.rows("claims").collect()) == list(range(1, 10))
    monkeypatch.setattr(stores, "ranked_in_parts", None)
    assert not save_extractions(store, results, "run", 0)  # a write that is done isn't made again
