"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._common import Scratch
from lectern.llm.brown_lm import lm_scores
from lectern.llm.decontaminate import decontaminate
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.licences import licences
from lectern.llm.merkle import manifest, proof_digest
from lectern.llm.near_dups import near_duplicates
from lectern.llm.packing import placed, tokenized
from lectern.llm.phrase_dedup import phrase_dedup
from lectern.llm.quality import quality
from lectern.llm.sharding import sharded
from lectern.llm.suffix_dedup import n_removed, suffix_dedup
from lectern.llm.warc import derivatives, responses
from lectern.llm.whitening import whitened

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", n_removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derivatives(responses(_table(spark, sf_dir, "pages")), keep="page_id")
    fields = {c: F.col("headers")[h] for c, h in (("block_digest", "WARC-Block-Digest"), ("source_digest", "WARC-Source-Payload-Digest"))}
    return out.withColumns(fields).select("page_id", "type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", "source_digest", F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences(_table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return out.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenized(_table(spark, sf_dir, "documents"), TOKENIZER)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")  # before the shuffle, as only the digest is asked for
    out = placed(pieces, Scratch(spark))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"))


def lowered(text: Column) -> Column:
    """text with A-Z made lower-case, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document (by crc32) is checked as if its text had been lower-cased since the manifest was made."""
    out = manifest(_table(spark, sf_dir, "documents"), lowered, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_licence_scan": op7_licence_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sharding": op13_sharding,
}

#: The CRC-32 of bytes, bit by bit for the table of 256, then byte by byte. `{h}`: their hexadecimal digits.
_CRC_TABLE = "bits AS (SELECT list(CAST(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS BIGINT) ORDER BY b) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({h}) // 2 + 1), lambda i: CAST('0x' || ({h})[2 * i - 1 : 2 * i] AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])))"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


ORACLE_SQL: dict[str, str] = {
    # Levels from the leaves up, then each leaf folded along its own way; tree -1 stands above the langs.
    "op12_merkle_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE},
             ids AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, {_leaf_sql(_LOWER)} AS lowered, {_CRC.format(h="hex(encode(CAST(doc_id AS VARCHAR)))")} % 3 AS third FROM documents, bits),
             leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM ids),
             langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM (SELECT DISTINCT lang FROM leaves)),
             low AS (SELECT j AS g, 0 AS h, i, n, leaf AS d FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang
                     UNION ALL SELECT g, h + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, h, i // 8),
             tops AS (SELECT g, d AS subroot FROM low WHERE n = 1),
             high AS (SELECT 0 AS h, g AS i, (SELECT max(m) FROM langs) AS n, subroot AS d FROM tops
                      UNION ALL SELECT h + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY h, i // 8),
             kids AS (SELECT g, h, i, d FROM low WHERE n > 1 UNION ALL SELECT -1, h, i, d FROM high WHERE n > 1),
             sides AS (SELECT g, h, i, coalesce(string_agg(d, '' ORDER BY i) OVER (PARTITION BY g, h, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                              coalesce(string_agg(d, '' ORDER BY i) OVER (PARTITION BY g, h, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM kids),
             folded AS (SELECT row_number() OVER () AS row, j AS g, j, 0 AS h, i, doc_id, leaf, CASE WHEN third = 0 THEN lowered ELSE leaf END AS f, '' AS p FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang
                        UNION ALL SELECT row, CASE WHEN s.g IS NULL THEN -1 ELSE a.g END, j, CASE WHEN s.g IS NULL THEN 0 ELSE a.h + 1 END, CASE WHEN s.g IS NULL THEN a.g ELSE a.i // 8 END, doc_id, leaf,
                                         CASE WHEN s.g IS NULL THEN f ELSE sha256(s.l || f || s.r) END, p || coalesce(s.l || s.r, '')
                                  FROM folded a LEFT JOIN sides s ON s.g = a.g AND s.h = a.h AND s.i = a.i WHERE a.g >= 0 OR s.g IS NOT NULL),
             ends AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY g, h DESC) AS last FROM folded)
        SELECT doc_id, leaf, subroot, (SELECT d FROM high WHERE n = 1) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT d FROM high WHERE n = 1) AS verified
        FROM ends JOIN tops ON tops.g = ends.j WHERE last = 1
    """,
    "op13_sharding": f"""
        WITH {_CRC_TABLE},
             d AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
             c AS (SELECT doc_id, size, {_CRC.format(h="h")} AS text_crc32 FROM d, bits),
             s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM c),
             p AS (SELECT *, CAST(least((2 * start + size) * 24 // (2 * total), 23) AS INTEGER) AS shard FROM s)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
    """,
    "op3_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             win AS (SELECT DISTINCT item_id, w[i : i + 12] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
             sizes AS (SELECT DISTINCT len(win) AS n FROM win),
             grams AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
             occ AS (SELECT doc_id, i, n, w[i : i + n - 1] AS win FROM grams),
             hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM occ JOIN win USING (win)),
             hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
             hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
    """,
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY bare) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
    """,
}
