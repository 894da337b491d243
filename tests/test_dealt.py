"""Tables of many rows are dealt to more tasks, whatever the number of shuffle partitions."""

import re

import pytest

from __spark_entry__ import oracle_sql, queries
from lectern.sources import shared
from oracle import SF, answer, rows


@pytest.mark.parametrize(("name", "key", "exchanges"), [("w20_clusters", "item", 1), ("u22_pending_claims", "claim_id", 2), ("a7_experiment_overview", "position", 2)])
def test_parts_grow_with_rows(spark, monkeypatch, name, key, exchanges):
    monkeypatch.setattr(shared, "ROWS", 500)
    found = queries()[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    own = re.findall(rf"Exchange hashpartitioning\({key}#\d+L?, (\d+)\)", plan)
    assert len(own) == exchanges and all(int(n) > 4 for n in own)  # and no other shuffle by the key
    assert rows(found.toPandas()) == rows(answer(oracle_sql()[name]))
