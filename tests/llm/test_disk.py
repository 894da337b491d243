"""What lies on disk at once while op5 runs."""

import pyarrow.parquet as pq

from lectern.llm import brown_lm
from lectern.llm._common import Scratch


def test_rare_words_are_placed_before_texts_are_shuffled(spark, tmp_path):
    """The shuffles of rare words and of texts don't lie on disk together, and tables with texts are packed closely."""
    plans, codecs = {}, {}

    class Watched(Scratch):
        def table(self, df, name, *more):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            out = super().table(df, name, *more)
            codecs[name] = {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for f in out.inputFiles()}
            return out

    docs = spark.createDataFrame([(i, f"some words {i} and {i % 7} more") for i in range(200)], "doc_id long, text string")
    was, brown_lm.SENT = brown_lm.SENT, 4  # most words are rare
    try:
        assert brown_lm.lm_scores(docs, Watched(spark), rounds=1).count() == 200
    finally:
        brown_lm.SENT = was
    assert "Join" in plans["classes0"] and "Generate" not in plans["classes0"]
    assert codecs["encoded"] == codecs["classes0"] == {"ZSTD"}
