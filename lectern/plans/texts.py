"""Queries on texts, boxes, evidence ranking and logs, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as geo
from lectern.functions import rules
from lectern.functions import evidence as ev
from lectern.functions import text as tx
from lectern.operators import aggregates, matching, ranking, windows
from lectern.plans import bindings as b
from lectern.sources.shared import dealt, tidy, written
from lectern.streaming import logs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: length(w) >= {1}))"


@query("w7_word_windows", r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS ws FROM documents),
    n AS (SELECT *, len(ws) AS n, unnest(range(0, CAST(greatest(ceil((len(ws) - 120) / 90.0), 0) AS INT) + 1)) AS "window" FROM d WHERE len(ws) > 0)
    SELECT doc_id, CAST("window" AS INT) AS "window", CAST("window" * 90 AS INT) AS first_word, len(ws["window" * 90 + 1 : "window" * 90 + 120])::INT AS n_words, sha256(array_to_string(ws["window" * 90 + 1 : "window" * 90 + 120], ' ')) AS text_sha256 FROM n""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of 120 words."""
    out = windows.word_windows(b.table(spark, d, "documents"), "text")
    return out.select("doc_id", "window", "first_word", "n_words", F.sha2(F.array_join("words", " "), 256).alias("text_sha256"))


@query("w9_segments", """WITH e AS (SELECT *, event_type <> lag(event_type) OVER w OR ts - lag(ts) OVER w > INTERVAL 6 HOUR AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM e)
    SELECT user_id, segment, count(*) AS n, min(event_id) AS first_event, any_value(event_type) AS event_type FROM g GROUP BY 1, 2""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    """A new segment at a change or a gap."""
    keys, order = ["user_id"], ["ts", "event_id"]
    e = b.table(spark, d, "events").withColumns({"p": windows.previous("event_type", keys, order), "t": windows.previous("ts", keys, order)})
    e = windows.segments(e, keys, order, (F.col("event_type") != F.col("p")) | (F.col("ts") - F.col("t") > F.expr("interval 6 hours")))
    return e.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.any_value("event_type").alias("event_type"))


@query("w12_carried_headings", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events""")
def carried(spark: SparkSession, d: str) -> DataFrame:
    """A heading holds until the next one."""
    return windows.carried(b.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "heading").select("event_id", "heading")


@query("w19_context", """SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS context FROM events""")
def context(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring rows."""
    out = windows.around(b.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 2, 2, "context")
    return out.select("event_id", F.array_join("context", ",").alias("context"))


_BOXES = """boxes AS (SELECT l_orderkey AS item, l_linenumber AS part, l_partkey % 3 AS page, CAST(l_suppkey AS DOUBLE) * 6 AS x0, l_quantity * 15.0 AS y0, CAST(l_suppkey AS DOUBLE) * 6 + 5 + l_linenumber * 8 AS x1, l_quantity * 15.0 + 10 + l_linenumber * 4 AS y1, l_extendedprice AS tie FROM lineitem)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    x0, y0, n = F.col("l_suppkey") * 6.0, F.col("l_quantity") * 15.0, F.col("l_linenumber")
    return b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), n.alias("part"), (F.col("l_partkey") % 3).alias("page"), F.array(x0, y0, x0 + 5 + n * 8, y0 + 10 + n * 4).alias("box"), F.col("l_extendedprice").alias("tie"))


@query("w20_clusters", f"""WITH {_BOXES}, r AS (SELECT *, max(x1) OVER (PARTITION BY item ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes),
    c AS (SELECT *, CAST(sum(CASE WHEN reach IS NOT NULL AND x0 > reach + 12 THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY x0, x1) AS BIGINT) AS cluster FROM r),
    g AS (SELECT item, cluster, count(*) AS rows, round(sum(greatest(x1 - x0, 0) * greatest(y1 - y0, 0)), 4) AS weight, min(x0) AS x0, max(x1) AS x1 FROM c GROUP BY 1, 2)
    SELECT item, cluster, rows, weight FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY rows DESC, weight DESC, cluster) AS n FROM g) WHERE n = 1""")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Columns of boxes, and each item's dominant one."""
    rows = dealt(boxes(spark, d), "item").withColumns({"x0": F.col("box")[0], "x1": F.col("box")[2], "area": geo.area(F.col("box"))})
    out = windows.dominant(windows.clusters(rows, ["item"], "x0", "x1", 12.0), ["item"], "cluster", "area")
    return out.select("item", "cluster", "rows", F.round("weight", 4).alias("weight"))


@query("g2_union_boxes", f"WITH {_BOXES} SELECT item, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(sum(greatest(x1 - x0, 0) * greatest(y1 - y0, 0)), 4) AS area, count(*) FILTER (y1 <= 0.06 * 800 OR y0 >= 0.94 * 800) AS in_margin FROM boxes GROUP BY 1")
def union_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Enclosing boxes."""
    g = boxes(spark, d).groupBy("item").agg(geo.union(F.col("box")).alias("u"), F.round(F.sum(geo.area(F.col("box"))), 4).alias("area"), F.count_if(geo.in_margin(F.col("box"), F.lit(800.0))).alias("in_margin"))
    return g.select("item", *(F.col("u")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), "area", "in_margin")


@query("g15_box_audit", f"""WITH {_BOXES}, a AS (SELECT *, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) AS area FROM boxes)
    SELECT CASE WHEN area <= 0 THEN 'invalid_bbox' WHEN area < 300 THEN 'too_small' WHEN area / 480000 > 0.85 THEN 'covers_page' ELSE 'usable' END AS status, CASE WHEN part <= 2 THEN 'caption_only' WHEN part < 5 THEN 'inferred' ELSE 'high' END AS confidence, count(*) AS n FROM a GROUP BY 1, 2""")
def box_audit(spark: SparkSession, d: str) -> DataFrame:
    """Why detections are dropped."""
    box = F.col("box")
    status = F.coalesce(geo.reject_reason(box, F.lit(480000.0)), F.lit("usable"))
    return boxes(spark, d).groupBy(status.alias("status"), geo.confidence(F.col("part"), F.lit(2)).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("j17_nearest_box", f"""WITH {_BOXES}, a AS (SELECT * FROM boxes WHERE part <= 3), d AS (SELECT * FROM boxes WHERE part > 3),
    m AS (SELECT a.item, a.tie AS t, a.page, d.tie AS other, sqrt(pow((a.x0 + a.x1) / 2 - (d.x0 + d.x1) / 2, 2) + pow((a.y0 + a.y1) / 2 - (d.y0 + d.y1) / 2, 2)) AS dist FROM a JOIN d ON a.item = d.item AND a.page = d.page)
    SELECT item, t AS tie, page, other, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY item, t, page ORDER BY round(dist, 6), other) AS n FROM m) WHERE n = 1""")
def nearest_box(spark: SparkSession, d: str) -> DataFrame:
    """The nearest detection on the same page."""
    rows = boxes(spark, d)
    a = rows.where("part <= 3")
    o = rows.where("part > 3").select("item", "page", F.col("tie").alias("other"), F.col("box").alias("other_box"))
    m = a.join(o, ["item", "page"]).withColumn("distance", F.round(geo.distance(F.col("box"), F.col("other_box")), 6))
    best = m.groupBy("item", "tie", "page").agg(F.min(F.struct("distance", "other")).alias("m"))
    return best.select("item", "tie", "page", F.col("m.other").alias("other"), F.col("m.distance").alias("distance"))


@query("j18_box_overlaps", f"""WITH {_BOXES}, a AS (SELECT * FROM boxes WHERE part <= 3), d AS (SELECT * FROM boxes WHERE part > 3)
    SELECT a.item, a.tie, count(*) AS n, min(d.tie) AS least FROM a JOIN d ON a.item = d.item AND a.page = d.page AND a.x0 - 20 <= d.x1 AND d.x0 <= a.x1 + 20 AND a.y0 - 20 <= d.y1 AND d.y0 <= a.y1 + 20 GROUP BY 1, 2""")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that overlap on the same page."""
    rows = boxes(spark, d)
    a = rows.where("part <= 3")
    o = rows.where("part > 3").select("item", "page", F.col("tie").alias("other"), F.col("box").alias("other_box"))
    return a.join(o, ["item", "page"]).where(geo.overlaps(F.col("box"), F.col("other_box"))).groupBy("item", "tie").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("least"))


@query("w25_clean_ocr", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(regexp_replace(s, '[ \t]+', ' ', 'g'), ' ')), lambda s: s <> '') AS ls FROM documents)
    SELECT doc_id, sha256(left(array_to_string(list_filter(ls, lambda s, i: i = 1 OR s <> ls[i - 1]), chr(10)), 1200)) AS text_sha256 FROM l""")
def clean_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated in a row count once."""
    return b.table(spark, d, "documents").select("doc_id", F.sha2(windows.without_adjacent_repeats(F.col("text")), 256).alias("text_sha256"))


@query("t1_text_functions", r"""WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)
    SELECT doc_id, sha256(lower(c)) AS normalized_sha256, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(left(c, 77)) || '...' END AS truncated, CASE WHEN length(text) <= 30 THEN text ELSE left(text, 30) || '…' END AS shortened,
        sha256(regexp_replace(text, '[\\/:*?"<>|]+', '_', 'g')) AS filename_sha256 FROM c""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """T1-T5, T20, T32."""
    t = F.col("text")
    return b.table(spark, d, "documents").select("doc_id", F.sha2(tx.normalized(t), 256).alias("normalized_sha256"), tx.truncated(t, 80).alias("truncated"), tx.shortened(t, 30).alias("shortened"), F.sha2(tx.safe_filename(t), 256).alias("filename_sha256"))


@query("p7_moderation", """WITH p AS (SELECT unnest(['idiot', 'clown', 'pathetic', 'fraud', 'worthless']) AS p, unnest([1, 2, 3, 4, 5]) AS i)
    SELECT doc_id, (SELECT min_by(p, i) FROM p WHERE contains(lower(coalesce(text, '')), p)) AS phrase FROM documents""")
def moderation(spark: SparkSession, d: str) -> DataFrame:
    """The first listed phrase in each text."""
    return b.table(spark, d, "documents").select("doc_id", tx.blocked_phrase(F.col("text"), ("idiot", "clown", "pathetic", "fraud", "worthless")).alias("phrase"))


@query("p5_field_policy", """WITH f AS (SELECT doc_id, source, length(trim(text)) AS n, ['summary', 'rating', 'soundness', 'other_notes', 'weaknesses'][doc_id % 5 + 1] AS field FROM documents)
    SELECT doc_id, field, CASE WHEN field = 'rating' THEN 'tier_c_metadata_only' WHEN field IN ('summary', 'weaknesses') AND n = 0 THEN 'tier_a_empty' WHEN field IN ('summary', 'weaknesses') THEN 'tier_a' WHEN field = 'soundness' AND n >= 100 THEN 'tier_b_substantive_text'
        WHEN field = 'soundness' THEN 'tier_b_insufficient_text' WHEN n >= 100 THEN 'unknown_substantive_heuristic' ELSE 'unknown_insufficient_text' END AS reason FROM f""")
def field_policy(spark: SparkSession, d: str) -> DataFrame:
    """Which review fields are read."""
    raw = F.element_at(F.array(*map(F.lit, ("Review Summary", "score", "Soundness", "other-notes", "Weakness"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = b.table(spark, d, "documents").withColumn("field", tx.field_name(raw))
    return rows.select("doc_id", "field", tx.field_policy(F.col("field"), F.col("text"))["reason"].alias("reason"))


@query("r20_seed_scores", """WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations)
    SELECT conv_id, turn, round(CASE WHEN t = '' OR contains(lower(t), 'idiot') THEN 0 ELSE 0.6 * least(length(t) / 400.0, 1) + 0.4 * CASE WHEN contains(t, '?') THEN 1 ELSE 0 END END, 6)::DOUBLE AS score FROM t""")
def seed_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well a comment opens a discussion."""
    t = F.col("text")
    return b.table(spark, d, "conversations").select("conv_id", "turn", F.round(rules.seed_score(t, tx.blocked_phrase(t, ("idiot",)).isNotNull()), 6).alias("score"))


@query("r24_token_overlap", "WITH p AS (SELECT x.conv_id, x.turn, " + _TOKENS.format("x.text", 1) + " AS a, " + _TOKENS.format("y.text", 1) + """ AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)
    SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS overlap FROM p""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared words of a turn and the next."""
    c = b.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard(F.col("text"), F.col("reply")), 6).alias("overlap"))


@query("t11_best_sentence", r"""WITH q AS (SELECT x.conv_id, x.turn, x.text AS claim, y.text AS raw FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
    s AS (SELECT conv_id, turn, claim, unnest(list_filter(list_transform(string_split(regexp_replace(trim(raw), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS sentence, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(trim(raw), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> ''), 1) AS i FROM q),
    h AS (SELECT conv_id, turn, sentence, i, len(list_intersect(""" + _TOKENS.format("sentence", 3) + ", " + _TOKENS.format("claim", 3) + ")) AS hits, len(" + _TOKENS.format("claim", 3) + """) AS n FROM s),
    b AS (SELECT conv_id, turn, arg_max(CASE WHEN hits > 0 THEN sentence ELSE '' END, (hits, -i)) AS sentence, max(hits) AS hits, max(n) AS n FROM h GROUP BY 1, 2)
    SELECT conv_id, turn, sentence, round(CASE WHEN n > 0 THEN hits / sqrt(n) ELSE 0 END, 6)::DOUBLE AS score FROM b""")
def best_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of the reply that shares most with a turn."""
    c = b.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("raw"))
    out = c.join(nxt, ["conv_id", "turn"]).withColumn("best", tx.best_sentence(F.col("raw"), F.col("text"))).where(F.trim("raw") != "")
    return out.select("conv_id", "turn", F.col("best.sentence").alias("sentence"), F.round("best.score", 6).alias("score"))


@query("r22_quote_spans")
def quote_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a reply that a turn matches; turns are numbered anew, as some numbers repeat (matching blocks have no SQL; tested by themselves)."""
    c = b.table(spark, d, "conversations")
    c = c.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", F.length("text"), F.sha2("text", 256))))
    lines = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.posexplode(F.split("text", "\n")).alias("position", "text")).withColumn("page", F.lit(1))
    rows = c.select("conv_id", "turn", F.col("text").alias("quote")).join(lines, ["conv_id", "turn"])
    return matching.quote_spans(rows, ["conv_id", "turn"]).where("chosen").select("conv_id", "turn", "position", "score")


_REFS = """t AS (SELECT event_id, ['See Table ' || k || ' and fig. 2', 'Figure ' || k || ' shows it; Section 3.' || k, 'no reference', 'Compare table 3 with Table 3'][event_id % 4 + 1] AS text FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events))"""


@query("r8_references", f"""WITH {_REFS}, r AS (SELECT event_id, text, regexp_extract_all(text, '(?i)\\btable\\s*(\\d+(?:\\.\\d+)*)', 1) AS ts, regexp_extract_all(text, '(?i)\\b(?:figure|fig\\.)\\s*(\\d+(?:\\.\\d+)*)', 1) AS fs,
    regexp_extract_all(text, '(?i)\\b(?:section|sec\\.)\\s*(\\d+(?:\\.\\d+)*)', 1) AS ss FROM t)
    SELECT event_id, array_to_string(list_concat(list_transform(list_distinct(ts), lambda n: 'Table ' || n), list_transform(list_distinct(fs), lambda n: 'Figure ' || n), list_transform(list_distinct(ss), lambda n: 'Section ' || n)), '|') AS refs,
        len(regexp_extract_all(text, '(?i)section')) AS n_sections FROM r""")
def references(spark: SparkSession, d: str) -> DataFrame:
    """Tables, figures and sections that texts name."""
    k = F.get_json_object("props", "$.k")
    texts = F.array(F.concat(F.lit("See Table "), k, F.lit(" and fig. 2")), F.concat(F.lit("Figure "), k, F.lit(" shows it; Section 3."), k), F.lit("no reference"), F.lit("Compare table 3 with Table 3"))
    t = b.table(spark, d, "events").withColumn("t", F.element_at(texts, (F.col("event_id") % 4 + 1).cast("int")))
    return t.select("event_id", F.array_join(tx.references(F.col("t")), "|").alias("refs"), F.size(F.regexp_extract_all(F.lower("t"), F.lit("section"), F.lit(0))).cast("long").alias("n_sections"))


@query("r5_cosine_top", """WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id, e.vec_id AS other, e.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
    c AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY score DESC, other) AS n FROM p) SELECT vec_id, other, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rank FROM c WHERE n <= 2) WHERE rank <= 5""")
def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of a stated query set, at most two of a label."""
    e = b.table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    found = ranking.nearest(e.where("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("x")), e.withColumnRenamed("vec_id", "other"), caps=2, k=5)
    order = [F.round("score", 6).desc(), "other"]
    out = found.withColumn("n", F.row_number().over(Window.partitionBy("vec_id", "label").orderBy(*order))).where("n <= 2")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(*order))).where("rank <= 5")
    return out.select("vec_id", "other", F.round("score", 6).alias("score"), "rank")


_BM25 = """ev AS (SELECT doc_id AS evidence_id, lang AS corpus, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts, CASE WHEN n_chars % 3 = 0 THEN 'table' WHEN n_chars % 3 = 1 THEN 'figure' ELSE 'text_chunk' END AS kind FROM documents),
    cl AS (SELECT item_id AS claim_id, ['en', 'de', 'fr', 'es'][item_id % 4 + 1] AS corpus, regexp_extract_all(lower(coalesce(text, '') || [' See Table ' || (item_id % 9) || '.', ' Figure ' || (item_id % 9) || ' shows it.', ' By the proof in Section ' || (item_id % 9) || '.2.'][item_id % 3 + 1]), '[a-z0-9]+') AS ts FROM benchmark),
    size AS (SELECT corpus, count(*) AS n, avg(len(ts)) AS mean_size FROM ev GROUP BY 1),
    terms AS (SELECT corpus, evidence_id, dl, term, count(*) AS tf FROM (SELECT corpus, evidence_id, len(ts) AS dl, unnest(ts) AS term FROM ev) GROUP BY 1, 2, 3, 4),
    raw AS (SELECT corpus, term, n, mean_size, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT corpus, term, count(*) AS df FROM terms GROUP BY 1, 2) JOIN size USING (corpus)),
    idf AS (SELECT corpus, term, mean_size, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY corpus) ELSE raw END AS idf FROM raw),
    asked AS (SELECT claim_id, corpus, term, count(*) AS qf FROM (SELECT claim_id, corpus, unnest(ts) AS term FROM cl) GROUP BY 1, 2, 3),
    bm AS (SELECT claim_id, evidence_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_size))) AS bm25 FROM asked JOIN idf USING (corpus, term) JOIN terms USING (corpus, term) GROUP BY 1, 2)"""


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    corpus = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("item_id") % 4 + 1).cast("int"))
    n = F.col("item_id") % 9
    said = F.element_at(F.array(F.concat(F.lit(" See Table "), n, F.lit(".")), F.concat(F.lit(" Figure "), n, F.lit(" shows it.")), F.concat(F.lit(" By the proof in Section "), n, F.lit(".2."))), (F.col("item_id") % 3 + 1).cast("int"))
    claims = b.table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), corpus.alias("corpus"), F.concat(F.coalesce("text", F.lit("")), said).alias("text"))
    kind = F.when(F.col("n_chars") % 3 == 0, "table").when(F.col("n_chars") % 3 == 1, "figure").otherwise("text_chunk")
    return claims, b.table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("lang").alias("corpus"), "text", kind.alias("kind"))


@query("r3_bm25", f"WITH {_BM25} SELECT claim_id, evidence_id, round(bm25, 6) AS bm25, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(bm25, 6) DESC, evidence_id) AS rank FROM bm) WHERE rank <= 10")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each claim's corpus."""
    claims, evidence = _claims(spark, d)
    out = ranking.bm25(claims, evidence).withColumn("bm25", F.round("bm25", 6))
    w = Window.partitionBy("claim_id").orderBy(F.col("bm25").desc(), "evidence_id")
    return out.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("r1_hybrid_ranking", f"""WITH {_BM25}, cv AS (SELECT item_id AS claim_id, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON vec_id = item_id), xv AS (SELECT vec_id AS evidence_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    cand AS (SELECT cl.claim_id, ev.evidence_id, ev.kind, coalesce(bm25, 0) AS lex, coalesce(list_cosine_similarity(cv.v, xv.v), 0) AS sem, CASE WHEN cl.claim_id % 3 = 2 THEN CASE WHEN ev.kind <> 'text_chunk' THEN 0.0 WHEN ev.evidence_id % 20 = cl.claim_id % 9 THEN 0.4 ELSE 0.0 END WHEN ev.evidence_id % 20 = cl.claim_id % 9 AND ev.kind = ['table', 'figure'][cl.claim_id % 3 + 1] THEN 1.0 ELSE 0.0 END AS ref,
            ev.evidence_id % 20 = cl.claim_id % 9 AND cl.claim_id % 3 < 2 AND ev.kind = CASE cl.claim_id % 3 WHEN 0 THEN 'table' ELSE 'figure' END AS explicit, CASE WHEN ev.kind <> 'text_chunk' AND cl.claim_id % 3 < 2 THEN 1.0 WHEN ev.kind = 'text_chunk' AND cl.claim_id % 3 = 2 THEN 0.4 ELSE 0.0 END AS prior
        FROM cl JOIN ev USING (corpus) LEFT JOIN bm ON bm.claim_id = cl.claim_id AND bm.evidence_id = ev.evidence_id LEFT JOIN cv ON cv.claim_id = cl.claim_id LEFT JOIN xv ON xv.evidence_id = ev.evidence_id),
    mm AS (SELECT *, min(lex) OVER w AS l0, max(lex) OVER w AS l1, min(sem) OVER w AS s0, max(sem) OVER w AS s1 FROM cand WINDOW w AS (PARTITION BY claim_id)),
    sc AS (SELECT *, round(0.35 * CASE WHEN l1 = l0 THEN 0 ELSE (lex - l0) / (l1 - l0) END + 0.45 * CASE WHEN s1 = s0 THEN 0 ELSE (sem - s0) / (s1 - s0) END + 0.2 * ref + 0.05 * prior, 6) AS score FROM mm),
    n AS (SELECT *, row_number() OVER (PARTITION BY claim_id, kind ORDER BY explicit DESC, score DESC, evidence_id) AS of_kind FROM sc),
    k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY explicit DESC, score DESC, evidence_id) AS rank FROM n WHERE of_kind <= CASE kind WHEN 'text_chunk' THEN 3 WHEN 'table' THEN 2 ELSE 1 END)
    SELECT claim_id, evidence_id, kind, score::DOUBLE AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""")
def hybrid_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking of every claim's candidates.

    A claim's candidates are all evidence of its corpus, as asked for. Their scores are written once, as they are scaled by minima and
    maxima of all of a claim's; these are joined to them, and each task keeps its own best rows before the last sort.
    """
    scored = written(candidate_scores(spark, d))
    explicit = (F.col("kind").isin("table", "figure")) & (F.col("reference") == 1.0)
    return ranking.ranked(scored.withColumn("explicit", explicit), digits=6).select("claim_id", "evidence_id", "kind", "score", "rank")


def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """claim_id, evidence_id, kind, asks, bm25, semantic and reference of every claim's candidates.

    What follows from a claim or a vector alone is made before they meet. The claims are sent to the evidence, after a check of their
    number, and BM25's scores are joined to the evidence before that, a map of claims to each, so that no pair is shuffled; if claims
    are too many for that, pairs are, without their vectors.
    """
    claims, evidence = _claims(spark, d)
    vectors = b.table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = claims.join(vectors, F.col("claim_id") == F.col("vec_id"), "left")
    asked = asked.select("claim_id", "corpus", ev.reference_names(F.col("text")).alias("names"), ranking.asked_for(F.col("text")).alias("asks"), F.col("embedding").alias("x"), ranking.norm(F.col("embedding")).alias("nx"))
    number = (F.col("evidence_id") % 20).cast("string")
    label = F.when(F.col("kind") != "text_chunk", F.concat(F.initcap("kind"), F.lit(" "), number))
    given = evidence.join(vectors, F.col("evidence_id") == F.col("vec_id"), "left").select("evidence_id", "corpus", "kind", label.alias("label"), F.when(F.col("kind") == "text_chunk", number).alias("section_number"), F.col("embedding").alias("y"), ranking.norm(F.col("embedding")).alias("ny"))
    reference = ev.reference_boost(F.lit(None), F.col("kind"), F.col("label"), F.col("section_number"), F.lit(None).cast("string"), F.col("names"))
    semantic = F.coalesce(ranking.cosine(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")), F.lit(0.0)).alias("semantic")
    lexical = ranking.bm25(claims, evidence)
    if claims.limit(ranking.BROADCAST // 100 + 1).count() <= ranking.BROADCAST // 100:  # a few kB each
        of = lexical.where("claim_id is not null").groupBy("evidence_id").agg(F.map_from_entries(F.collect_list(F.struct("claim_id", "bm25"))).alias("of"))
        of = written(of)  # a join's condition would reach the texts otherwise, so that they were dealt twice
        tidy(spark)
        pairs = given.join(of, "evidence_id", "left").join(F.broadcast(asked), "corpus")
        return pairs.select("claim_id", "evidence_id", "kind", "asks", F.coalesce(F.try_element_at("of", F.col("claim_id")), F.lit(0.0)).alias("bm25"), semantic, reference.alias("reference"))
    pairs = given.join(asked, "corpus").select("claim_id", "evidence_id", "kind", "asks", semantic, reference.alias("reference"))
    return pairs.join(lexical, ["claim_id", "evidence_id"], "left").select("claim_id", "evidence_id", "kind", "asks", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "semantic", "reference")


@query("s29_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 1 AND 5 THEN round((2 * CAST(json_extract_string(props, '$.k') AS INT) - 1) / 10.0, 2)::DOUBLE END AS share FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Values out of JSON."""
    k = tx.json_or_null(F.col("props"), "k int")["k"]
    return b.table(spark, d, "events").select("event_id", k.alias("k"), tx.score_share(k).cast("double").alias("share"))


@query("t24_urls", r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS source, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-')[1:80] AS slug FROM pages")
def urls(spark: SparkSession, d: str) -> DataFrame:
    """T23-T27."""
    u = F.col("url")
    return b.table(spark, d, "pages").select("page_id", tx.query_parameter(u, "page").alias("page"), tx.query_parameter(u, "utm_source").alias("source"), tx.slug(u).alias("slug"))


@query("x7_steps", """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text), sha256(text)) AS seq FROM conversations WHERE trim(text) <> '')
    SELECT conv_id::VARCHAR AS agent, seq, CASE role WHEN 'assistant' THEN 'agent' ELSE 'system' END AS source, row_number() OVER (PARTITION BY conv_id ORDER BY seq)::INT AS step_id,
        CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq) AS BIGINT) AS total_prompt FROM t""")
def steps(spark: SparkSession, d: str) -> DataFrame:
    """JSON log lines (made of the conversations) as numbered steps with running totals."""
    c = b.table(spark, d, "conversations").where("trim(text) <> ''")
    c = c.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", F.length("text"), F.sha2("text", 256))).cast("long"))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    message = F.struct(block.alias("content"), F.struct(F.length("text").alias("input_tokens")).alias("usage"))
    line = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("assistant").alias("type"), message.alias("message")))).otherwise(F.concat(F.lit("[harness] "), F.col("text")))
    lines = c.select(F.col("conv_id").cast("string").alias("agent"), "seq", line.alias("line"))
    return logs.numbered(logs.steps(lines)).select("agent", "seq", "source", "step_id", "total_prompt")


@query("x14_interleaved", "SELECT conv_id, turn, role, text_n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text_n) AS INT) AS turn_no FROM (SELECT conv_id, turn, role, length(text) AS text_n FROM conversations)")
def interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Many logs, a line of each in turn."""
    c = b.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("t"), "role", F.length("text").cast("long").alias("text_n"))
    return aggregates.interleaved(c, "conv_id", ["t", "role", "text_n"]).select("conv_id", F.col("t").alias("turn"), "role", "text_n", F.col("turn").alias("turn_no"))


@query("x2_paragraphs", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), t AS (SELECT doc_id, seq, rtrim(line) AS t FROM l),
    g AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS g FROM t)
    SELECT doc_id::VARCHAR AS agent, min(seq)::BIGINT AS seq, 'agent' AS source, sha256(string_agg(t, chr(10) ORDER BY seq)) AS message_sha256 FROM g WHERE t <> '' GROUP BY doc_id, g""")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """X2-X5 in batch: lines of plain text folded into paragraphs."""
    lines = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("agent"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    out = logs.paragraphs(lines.withColumn("seq", F.col("seq").cast("long")))
    return out.select("agent", "seq", "source", F.sha2("message", 256).alias("message_sha256"))
