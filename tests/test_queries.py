"""Every query of the review workload agrees with its SQL, also after an extra shuffle of its tables."""

import pytest

from lectern.plans import audits, crops, documents, layout, recognitions, reports, review, runs, stores, texts, writes

from oracle import SF, answer, rows

QUERIES = review.QUERIES | texts.QUERIES | stores.QUERIES | audits.QUERIES | reports.QUERIES | layout.QUERIES | runs.QUERIES | writes.QUERIES | documents.QUERIES | recognitions.QUERIES | crops.QUERIES
ORACLE = review.ORACLE | texts.ORACLE | stores.ORACLE | audits.ORACLE | reports.ORACLE | layout.ORACLE | runs.ORACLE | writes.ORACLE | documents.ORACLE | recognitions.ORACLE | crops.ORACLE


@pytest.mark.parametrize("name", ORACLE)
def test_agrees_with_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(answer(ORACLE[name]))


def test_queries_without_sql(spark):
    assert QUERIES.keys() - ORACLE.keys() == {"r22_quote_spans", "w15_captions"}
    best = QUERIES["r22_quote_spans"](spark, SF).toPandas()
    assert len(best) and best["score"].between(0, 1).all() and not best.duplicated(["conv_id", "turn", "position"]).any()


@pytest.mark.parametrize("name", ["e20_run_summary", "a17_latency", "w7_word_windows", "r1_hybrid_ranking"])
def test_empty_tables(spark, name, tmp_path):
    for t in ("part", "lineitem", "events", "documents", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["e20_run_summary", "j1_verification_rows", "u22_pending_claims", "o3_pairwise_diff", "p5_field_policy"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "EvalPython" not in plan and "InPandas" not in plan
