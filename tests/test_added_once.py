"""Rows are added up before dimensions are told apart."""

from lectern.plans import recognitions

from oracle import SF


def test_rows_are_added_up_before_they_are_expanded(spark):
    for name in ("f35_recognition_counts", "f36_recognition_notes", "f34_box_audit"):
        plan = recognitions.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan[plan.index("Expand") :], name
