"""Queries on claims, their evidence, objects on pages, artifacts and exports, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import evidence as ev
from lectern.functions import rules
from lectern.functions import text as tx
from lectern.operators import matching, ranking
from lectern.plans import bindings as b
from lectern.plans.bindings import sql
from lectern.plans.review import _SUMMARISED, summarised

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _pick(n: Column, *values: Column | str) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("o_custkey") % 9 + 1).cast("string")
    said = _pick(
        F.col("o_custkey"), F.concat(F.lit("in Table "), n), F.concat(F.lit("in Fig. "), n), F.concat(F.lit("of Section "), n, F.lit("."), (F.col("o_custkey") % 4).cast("string")),
        "is depicted, as shown in the plot", F.concat(F.lit("in Figure "), n, F.lit(" and Table "), n), "is not convincing",
    )
    verdict = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "insufficient_evidence").otherwise("refuted")
    return b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderstatus").alias("field"), b.rounded(F.col("o_totalprice") / 500000, 4).alias("confidence"),
        verdict.alias("verdict"), F.concat(F.lit("The "), F.lower("o_orderpriority"), F.lit(" comparison "), said, F.lit(".")).alias("text"),
    )


def evidence(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("l_suppkey") % 9 + 1).cast("string")
    kind = F.when(F.col("l_returnflag") == "R", "figure").when(F.col("l_returnflag") == "A", "table").otherwise("text_chunk")
    label = F.when((kind == "table") | ((kind == "figure") & (F.col("l_linenumber") == 7)), F.concat(F.lit("Table "), n)).when(kind == "figure", F.concat(F.lit("Figure "), n))
    number = F.when(F.col("l_linenumber") % 2 == 0, F.concat(n, F.lit("."), (F.col("l_linenumber") % 4).cast("string"))).otherwise(n)
    return b.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("position"), F.col("l_extendedprice").alias("tie"), kind.alias("kind"), label.alias("label"), number.alias("section_number"),
        F.when(F.col("l_linenumber") == 3, F.concat(F.lit("Section "), number)).alias("section"), (F.col("l_partkey") % 5).alias("page"), F.col("l_discount").alias("score"), (F.col("l_tax") > 0).alias("has_text"),
    )


_CLAIMS = """claims AS (SELECT o_orderkey AS claim_id, o_custkey AS paper_id, o_orderstatus AS field, round(o_totalprice / 500000, 4) AS confidence,
        CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'insufficient_evidence' ELSE 'refuted' END AS verdict,
        'The ' || lower(o_orderpriority) || ' comparison ' || CASE o_custkey % 6 WHEN 0 THEN 'in Table ' || (o_custkey % 9 + 1) WHEN 1 THEN 'in Fig. ' || (o_custkey % 9 + 1) WHEN 2 THEN 'of Section ' || (o_custkey % 9 + 1) || '.' || (o_custkey % 4)
            WHEN 3 THEN 'is depicted, as shown in the plot' WHEN 4 THEN 'in Figure ' || (o_custkey % 9 + 1) || ' and Table ' || (o_custkey % 9 + 1) ELSE 'is not convincing' END || '.' AS text FROM orders)"""
_EVIDENCE = """evidence AS (SELECT *, CASE WHEN position = 3 THEN 'Section ' || section_number END AS section FROM (SELECT l_orderkey AS claim_id, l_linenumber AS position, l_extendedprice AS tie,
        CASE l_returnflag WHEN 'R' THEN 'figure' WHEN 'A' THEN 'table' ELSE 'text_chunk' END AS kind,
        CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linenumber = 7) THEN 'Table ' || (l_suppkey % 9 + 1) WHEN l_returnflag = 'R' THEN 'Figure ' || (l_suppkey % 9 + 1) END AS label,
        CASE WHEN l_linenumber % 2 = 0 THEN (l_suppkey % 9 + 1) || '.' || (l_linenumber % 4) ELSE CAST(l_suppkey % 9 + 1 AS VARCHAR) END AS section_number,
        l_partkey % 5 AS page, l_discount AS score, l_tax > 0 AS has_text FROM lineitem))"""
_ORDER = ["position", "tie"]


def _found(claim: str, kind: str) -> str:
    pattern = {"table": r"\b(?:Table|Tab\.)\s+(\d+(?:\.\d+)*)\b", "figure": r"\b(?:Figure|Fig\.)\s+(\d+(?:\.\d+)*)\b", "section": r"\b(?:Section|Sec\.)\s+(\d+(?:\.\d+)*)\b"}[kind]
    return f"regexp_extract_all({claim}, '(?i){pattern}', 1)"


@query("r7_reference_boost", f"""WITH {_CLAIMS}, {_EVIDENCE}, r AS (SELECT e.*, {_found('c.text', 'table')} AS ts, {_found('c.text', 'figure')} AS fs, {_found('c.text', 'section')} AS ss FROM evidence e JOIN claims c USING (claim_id)),
    s AS (SELECT claim_id, position, tie, CAST(CASE WHEN (kind = 'table' AND list_contains(list_transform(ts, lambda n: 'Table ' || n), label)) OR (kind = 'figure' AND list_contains(list_transform(fs, lambda n: 'Figure ' || n), label)) THEN 1.0
        WHEN list_contains(list_concat(list_transform(ts, lambda n: 'Table ' || n), list_transform(fs, lambda n: 'Figure ' || n)), label) THEN 0.9
        WHEN list_contains(ss, section_number) OR len(list_filter(ss, lambda n: contains(coalesce(section, ''), 'Section ' || n))) > 0 THEN 0.7
        WHEN len(list_filter(ss, lambda n: contains(n, '.') AND split_part(n, '.', 1) = section_number)) > 0 THEN 0.4 ELSE 0 END AS DOUBLE) AS boost FROM r)
    SELECT claim_id, position, tie, boost, boost > 0 AS matched FROM s""")
def reference_boosts(spark: SparkSession, d: str) -> DataFrame:
    """What a claim's references add to each of its evidence's score."""
    rows = evidence(spark, d).join(claims(spark, d).select("claim_id", ev.reference_names(F.col("text")).alias("names")), "claim_id")
    out = rows.withColumn("boost", ev.reference_boost(F.lit(None), F.col("kind"), F.col("label"), F.col("section_number"), F.col("section"), F.col("names")))
    return out.select("claim_id", "position", "tie", "boost", (F.col("boost") > 0).alias("matched"))


def _has(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


_EXPLICIT = r"""(e.kind = 'figure' AND list_contains(list_transform(regexp_extract_all(c.text, '(?i)\b(?:Figure|Fig\.)\s*(\d+)\b', 1), lambda n: 'Figure ' || n), e.label)
        OR e.kind = 'table' AND list_contains(list_transform(regexp_extract_all(c.text, '(?i)\bTable\s*(\d+)\b', 1), lambda n: 'Table ' || n), e.label))"""


@query("r13_prompt_order", f"""WITH {_CLAIMS}, {_EVIDENCE}, x AS (SELECT e.*, coalesce({_EXPLICIT}, FALSE) AS explicit, {_has('c.text', ev.TABLE_WORDS)} AS wants_table, {_has('c.text', ev.FIGURE_WORDS)} AS wants_figure,
        e.position % 3 = 0 AS matched FROM evidence e JOIN claims c USING (claim_id) WHERE has_text OR label IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY position, tie) AS i FROM x), g AS (SELECT claim_id, list(page) FILTER (explicit) AS pages FROM p GROUP BY 1),
    s AS (SELECT p.claim_id, min(i) AS i FROM p JOIN g USING (claim_id) WHERE kind = 'text_chunk' AND NOT explicit AND list_contains(pages, page) GROUP BY 1),
    t AS (SELECT p.*, CASE WHEN explicit THEN 0 WHEN s.i IS NOT NULL THEN 1 ELSE 2 END AS tier, CASE WHEN explicit THEN 0 WHEN matched THEN 1 ELSE 0 END AS ref,
        CASE WHEN explicit THEN 0 WHEN wants_table AND kind = 'table' OR wants_figure AND kind = 'figure' THEN 0.6 WHEN kind = 'text_chunk' THEN 0.1 ELSE 0 END AS bonus FROM p LEFT JOIN s ON s.claim_id = p.claim_id AND s.i = p.i),
    a AS (SELECT claim_id, min(i) AS attached FROM t WHERE kind = 'figure' AND score > 0 AND page <> 0 AND (matched OR wants_figure) GROUP BY 1)
    SELECT t.claim_id, position, tie, tier, CAST(row_number() OVER (PARTITION BY t.claim_id ORDER BY tier, ref DESC, bonus DESC, score DESC, position, tie) AS INT) AS place, coalesce(attached = i, FALSE) AS attach FROM t LEFT JOIN a USING (claim_id)""")
def prompt_order(spark: SparkSession, d: str) -> DataFrame:
    """Evidence as a prompt lists it; a figure's image goes with at most one of each claim."""
    c = claims(spark, d).select("claim_id", F.col("text").alias("claim"))
    rows = evidence(spark, d).join(c, "claim_id").where(F.col("has_text") | F.col("label").isNotNull())
    explicit = F.lit(False)
    for kind in ("figure", "table"):
        explicit = explicit | ((F.col("kind") == kind) & ev.label_matches(F.col("label"), ev.explicit_labels(F.col("claim"), kind)))
    by = Window.partitionBy("claim_id")
    place = F.struct(*_ORDER)
    rows = rows.withColumns({"explicit": explicit, "matched": F.col("position") % 3 == 0})
    rows = rows.withColumn("pages", F.collect_set(F.when(F.col("explicit"), F.col("page"))).over(by))
    near = ~F.col("explicit") & (F.col("kind") == "text_chunk") & F.array_contains("pages", F.col("page"))
    wants_figure = ev.prefers_figure(F.col("claim"))
    attachable = (F.col("kind") == "figure") & (F.col("score") > 0) & (F.col("page") != 0) & (F.col("matched") | wants_figure)
    rows = rows.withColumns({"supplement": F.min(F.when(near, place)).over(by), "attached": F.min(F.when(attachable, place)).over(by)})
    tier = rules.choose((F.col("explicit"), 0), (place == F.col("supplement"), 1), other=2)
    bonus = rules.choose((F.col("explicit"), 0.0), ((ev.prefers_table(F.col("claim")) & (F.col("kind") == "table")) | (wants_figure & (F.col("kind") == "figure")), 0.6), (F.col("kind") == "text_chunk", 0.1), other=0.0)
    rows = rows.withColumns({"tier": tier, "ref": ~F.col("explicit") & F.col("matched"), "bonus": bonus})
    order = by.orderBy("tier", F.col("ref").desc(), F.col("bonus").desc(), F.col("score").desc(), *_ORDER)
    return rows.select("claim_id", *_ORDER, "tier", F.row_number().over(order).alias("place"), F.coalesce(place == F.col("attached"), F.lit(False)).alias("attach"))


def _cues(c: str, patterns) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({c}), '{p}') THEN '{n}' END" for p, n in patterns) + "], lambda x: x IS NOT NULL)"


@query("e25_escalation", rf"""WITH {_CLAIMS}, {_EVIDENCE}, n AS (SELECT e.*, row_number() OVER (PARTITION BY claim_id ORDER BY position, tie) AS i FROM evidence e),
    f AS (SELECT n.claim_id, min(i) FILTER (kind = 'figure') AS top_rank, arg_min(label, i) FILTER (kind = 'figure') AS top_label FROM n GROUP BY 1),
    m AS (SELECT e.claim_id, arg_min(e.label, i) AS named FROM n e JOIN claims c USING (claim_id) WHERE e.kind = 'figure' AND {_EXPLICIT} GROUP BY 1),
    x AS (SELECT c.claim_id, verdict, confidence, top_rank, top_label, coalesce(named, top_label) AS enriched, regexp_matches(text, '(?i)\b(?:Figures?|Fig\.?)\s*\d+\b') AS ref, {_cues('text', ev.STRONG_CUES)} AS strong, {_cues('text', ev.WEAK_CUES)} AS weak
        FROM claims c LEFT JOIN f USING (claim_id) LEFT JOIN m USING (claim_id)),
    y AS (SELECT *, len(strong) >= 1 OR len(weak) >= 2 AS gate, CASE WHEN top_rank IS NULL THEN 'no_figure' WHEN ref THEN 'explicit' WHEN verdict = 'insufficient_evidence' THEN CASE WHEN top_rank <= 3 THEN 'insufficient_with_figure_rank_le_3' ELSE 'rank' END
        WHEN confidence < 0.55 THEN CASE WHEN top_rank <= 2 THEN 'low_confidence_with_figure_rank_le_2' ELSE 'rank' END ELSE 'none' END AS step FROM x)
    SELECT claim_id, CASE step WHEN 'explicit' THEN TRUE WHEN 'no_figure' THEN FALSE WHEN 'rank' THEN FALSE WHEN 'none' THEN FALSE ELSE gate END AS escalate,
        CASE WHEN step = 'explicit' THEN 'explicit_figure_ref' WHEN step IN ('no_figure', 'rank', 'none') THEN NULL ELSE step END AS cause,
        CASE step WHEN 'no_figure' THEN 'no_figure' WHEN 'rank' THEN 'rank_policy' WHEN 'none' THEN 'trigger_not_met' WHEN 'explicit' THEN NULL ELSE CASE WHEN NOT gate THEN 'lexical_gate_failed' END END AS skipped, array_to_string(strong, ',') AS strong, array_to_string(weak, ',') AS weak, enriched FROM y""")
def escalation(spark: SparkSession, d: str) -> DataFrame:
    """Whether a claim's first figure is read more closely, and which one is enriched."""
    c = claims(spark, d)
    rows = evidence(spark, d).join(c.select("claim_id", "text"), "claim_id")
    named = ev.label_matches(F.col("label"), ev.explicit_labels(F.col("text"), "figure"))
    figure = F.col("kind") == "figure"
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("claim_id").orderBy(*_ORDER)))
    top = rows.where(figure).groupBy("claim_id").agg(F.min("i").alias("top_rank"), F.min_by("label", "i").alias("top_label"), F.min_by("label", F.when(named, F.col("i"))).alias("named"))
    x = c.join(top, "claim_id", "left").withColumn("gate", ev.lexical_gate(F.col("text")))
    rank = lambda n, name: rules.choose((F.col("top_rank") <= n, name), other="rank_policy")
    step = rules.choose(
        (F.col("top_rank").isNull(), "no_figure"), (ev.names_figure(F.col("text")), "explicit_figure_ref"), (F.col("verdict") == "insufficient_evidence", rank(3, "insufficient_with_figure_rank_le_3")),
        (F.col("confidence") < 0.55, rank(2, "low_confidence_with_figure_rank_le_2")), other="trigger_not_met",
    )
    x = x.withColumn("step", step)
    stopped, sure = F.col("step").isin("no_figure", "rank_policy", "trigger_not_met"), F.col("step") == "explicit_figure_ref"
    return x.select(
        "claim_id", (sure | (~stopped & F.col("gate"))).alias("escalate"), F.when(~stopped, F.col("step")).alias("cause"), rules.choose((stopped, F.col("step")), (~sure & ~F.col("gate"), "lexical_gate_failed")).alias("skipped"),
        F.array_join(ev.cues(F.col("text"), ev.STRONG_CUES), ",").alias("strong"), F.array_join(ev.cues(F.col("text"), ev.WEAK_CUES), ",").alias("weak"), F.coalesce("named", "top_label").alias("enriched"),
    )


_LINES = "list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '')"
_CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
_OBJECTS = """objects AS (SELECT doc_id, text, CASE n_chars % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text_chunk' END AS kind, CASE WHEN doc_id % 4 = 0 THEN source ELSE 'Tab. ' || (doc_id % 30) END AS label,
        CASE WHEN doc_id % 5 = 0 THEN text ELSE 'table ' || (doc_id % 7) || ': ' || source END AS caption, CASE WHEN n_chars % 11 > 0 THEN n_chars % 11 / 20.0 END AS fraction FROM documents)"""


def objects(spark: SparkSession, d: str) -> DataFrame:
    n, i = F.col("n_chars"), F.col("doc_id")
    return b.table(spark, d, "documents").select(
        "doc_id", "text", F.when(n % 3 == 0, "table").when(n % 3 == 1, "figure").otherwise("text_chunk").alias("kind"), F.when(i % 4 == 0, F.col("source")).otherwise(F.concat(F.lit("Tab. "), i % 30)).alias("label"),
        F.when(i % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("table "), i % 7, F.lit(": "), F.col("source"))).alias("caption"), F.when(n % 11 > 0, n % 11 / F.lit(20.0)).alias("fraction"),
    )


@query("g13_object_audit", rf"""WITH {_OBJECTS}, l AS (SELECT *, {_LINES.format('text')} AS ls FROM objects), p AS (SELECT *, len(list_filter(ls, lambda s: length(s) > 80)) AS long FROM l),
    q AS (SELECT *, long >= 2 OR (len(ls) > 3 AND (len(ls) - long) / len(ls) < 0.6) AS prose FROM p)
    SELECT doc_id, prose, kind = 'table' AND (NOT regexp_matches(trim(label), '(?i)^(table|tab\.?)\s*\d+') OR prose OR coalesce(fraction > 0.3, FALSE) OR NOT regexp_matches(trim(caption), '(?i)^(table|tab\.?)\s*\d+')) AS false_table,
        kind IN ('figure', 'table') AND (coalesce(fraction > 0.25, FALSE) OR len(ls) > 15 OR prose) AS mixed_visual FROM q""")
def object_audit(spark: SparkSession, d: str) -> DataFrame:
    """Objects that may not be what they are taken for."""
    o = objects(spark, d)
    return o.select(
        "doc_id", ev.prose_preview(F.col("text")).alias("prose"), ev.false_table(F.col("kind"), F.col("label"), F.col("caption"), F.col("text"), F.col("fraction")).alias("false_table"),
        ev.mixed_visual(F.col("kind"), F.col("fraction"), F.size(ev.lines_of(F.col("text"))), F.col("text")).alias("mixed_visual"),
    )


@query("p21_table_text", rf"""WITH {_OBJECTS}, t AS (SELECT *, {_CLEAN.format('text')} AS t, {_CLEAN.format('caption')} AS c, {_LINES.format('text')} AS ls FROM objects), p AS (SELECT *, len(list_filter(ls, lambda s: length(s) > 80)) AS long FROM t)
    SELECT doc_id, CASE WHEN t = '' THEN 'empty_text' WHEN length(t) < 80 THEN 'too_short' WHEN c <> '' AND t = c THEN 'identical_to_caption' WHEN NOT (contains(t, '|') OR (c <> '' AND length(t) > length(c) * 1.8)) THEN 'not_substantially_better_than_caption' END AS reason,
        len(ls) > 0 AND ((length(ls[1]) <= 120 AND regexp_matches(ls[1], '{ev.BLOCK_HEADING}')) OR long >= 2 OR (len(ls) - long) / len(ls) < 0.6) AS prose_block,
        coalesce(fraction > 0.3, FALSE) AS too_tall FROM p""")
def table_text(spark: SparkSession, d: str) -> DataFrame:
    """Whether a table's recognised text is worth more than its caption."""
    return objects(spark, d).select("doc_id", ev.table_text_reason(F.col("text"), F.col("caption")).alias("reason"), ev.prose_block(ev.lines_of(F.col("text"))).alias("prose_block"), F.coalesce(F.col("fraction") > 0.30, F.lit(False)).alias("too_tall"))


@query("p19_line_rules", rf"""WITH l AS (SELECT doc_id, unnest({_LINES.format('text')}) AS s FROM documents), m AS (SELECT doc_id, s FROM l UNION ALL SELECT doc_id, ['Table 1, as said', 'Figure 2 also shows it', 'Table 3 and Table 4 differ', 'Table 5: results', '3.1 Setup', 'RELATED WORK', 'Related work', 'Finally, we close'][doc_id % 8 + 1] AS s FROM documents)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({' OR '.join(f"regexp_matches({_CLEAN.format('s')}, '{p}')" for p in ev.INLINE)}) AS inline, count(*) FILTER (length(s) <= 120 AND NOT regexp_matches(s, '[.?!,;:]$') AND regexp_matches(s, '{ev.HEADING}')) AS headings,
        count(*) FILTER (length(s) <= 80 AND (regexp_matches(s, '{ev.SECTION_HEADING[0]}') OR regexp_matches(s, '{ev.SECTION_HEADING[1]}'))) AS sections,
        count(*) FILTER (regexp_matches({_CLEAN.format('s')}, '^\d+(?:\.\d+)*\s+[A-Z]') OR (upper(s) = s AND lower(s) <> s AND length({_CLEAN.format('s')}) <= 80)) AS capitals, count(*) FILTER (regexp_matches({_CLEAN.format('s')}, '{ev.OPENERS}')) AS openers FROM m GROUP BY 1""")
def line_rules(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of lines in each document, and in a line of each kind."""
    docs = b.table(spark, d, "documents")
    more = _pick(F.col("doc_id"), "Table 1, as said", "Figure 2 also shows it", "Table 3 and Table 4 differ", "Table 5: results", "3.1 Setup", "RELATED WORK", "Related work", "Finally, we close")
    lines = docs.select("doc_id", F.explode(F.concat(ev.lines_of(F.col("text")), F.array(more))).alias("s"))
    s = F.col("s")
    kinds = {"inline": ev.inline_reference(s), "headings": ev.heading_like(s), "sections": ev.section_heading(s), "capitals": ev.caption_heading(s), "openers": ev.paragraph_start(s)}
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), *(F.count_if(c).alias(k) for k, c in kinds.items()))


_META = """meta AS (SELECT event_id, value, CASE event_id % 8 WHEN 0 THEN '{"bbox_source":"rtdetr","rtdetr_score":' || value || '}' WHEN 1 THEN '{"detected_bbox":[1,2,3,4],"dino_score":' || value || '}' WHEN 2 THEN '{"detected_bbox":[1,2,3],"paddlex_layout_matched":true}'
        WHEN 3 THEN '{"object_bbox_confidence":"caption"}' WHEN 4 THEN '{"object_bbox_confidence":"inferred","inferred_bbox":[0,0,9,9]}' WHEN 5 THEN '{"highlight_mode":"row","caption_bbox":[5,300,60,310]}' WHEN 6 THEN '{"caption_bbox":[5,30,60,50]}' ELSE '{}' END AS m FROM events)"""


def metadata(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value").cast("string")
    m = _pick(
        F.col("event_id"), F.concat(F.lit('{"bbox_source":"rtdetr","rtdetr_score":'), v, F.lit("}")), F.concat(F.lit('{"detected_bbox":[1,2,3,4],"dino_score":'), v, F.lit("}")), '{"detected_bbox":[1,2,3],"paddlex_layout_matched":true}',
        '{"object_bbox_confidence":"caption"}', '{"object_bbox_confidence":"inferred","inferred_bbox":[0,0,9,9]}', '{"highlight_mode":"row","caption_bbox":[5,300,60,310]}', '{"caption_bbox":[5,30,60,50]}', "{}",
    )
    return b.table(spark, d, "events").select("event_id", "value", m.alias("m"))


_SOURCE = "CASE event_id % 8 WHEN 0 THEN 'rtdetr' WHEN 1 THEN 'groundingdino' WHEN 2 THEN 'paddlex_layout' WHEN 3 THEN 'caption_only' WHEN 4 THEN 'caption_anchor' WHEN 5 THEN 'highlight_row' ELSE 'unknown' END"
_REFINED = "event_id % 8 < 3"


@query("t45_box_sources", f"""WITH {_META}, s AS (SELECT *, {_SOURCE} AS source, CASE WHEN event_id % 8 < 2 THEN round(value, 3) END AS score,
        CASE WHEN json_array_length(m, '$.detected_bbox') = 4 THEN m->'$.detected_bbox' WHEN json_array_length(m, '$.inferred_bbox') = 4 THEN m->'$.inferred_bbox' END AS own FROM meta)
    SELECT event_id, source, {_REFINED} AS refined, CASE event_id % 8 WHEN 0 THEN 'rtdetr' WHEN 1 THEN 'groundingdino' WHEN 2 THEN 'paddlex_layout' END AS detector, score,
        CASE WHEN json_array_length(m, '$.detected_bbox') = 4 THEN 'detected_bbox' WHEN own IS NOT NULL THEN 'inferred_bbox' WHEN event_id % 8 IN (5, 6) THEN 'caption_fallback' ELSE 'none' END AS box_source,
        CASE WHEN own IS NOT NULL THEN CAST(own->>'$[1]' AS DOUBLE) WHEN event_id % 8 IN (5, 6) THEN greatest(0, CAST(m->>'$.caption_bbox[1]' AS DOUBLE) - greatest(8 * (CAST(m->>'$.caption_bbox[3]' AS DOUBLE) - CAST(m->>'$.caption_bbox[1]' AS DOUBLE)), 100)) END AS top FROM s""")
def box_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where a box comes from, out of an object's metadata."""
    rows = metadata(spark, d).withColumn("source", ev.box_source(F.col("m")))
    box = ev.figure_box(F.col("m"), F.lit(None).cast("array<double>"))
    name = F.coalesce(F.when(F.col("source").isin(*(n for _, n in ev.DETECTORS)), F.col("source")), ev.detector(F.col("m")))
    return rows.select("event_id", "source", ev.refined(F.col("m"), F.col("source")).alias("refined"), name.alias("detector"), F.round(ev.detector_score(F.col("m"), F.col("source")), 3).alias("score"), box["source"].alias("box_source"), box["box"][1].alias("top"))


@query("a19_box_stats", f"""WITH {_META}, s AS (SELECT *, {_SOURCE} AS source, {_REFINED} AS refined FROM meta) SELECT source, count(*) AS total, count(*) FILTER (refined) AS refined, round(avg(CASE WHEN event_id % 8 < 2 THEN value END), 3) AS mean_score FROM s GROUP BY 1""")
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    """Objects and mean detector scores by source of their boxes."""
    rows = metadata(spark, d).withColumn("source", ev.box_source(F.col("m")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(ev.refined(F.col("m"), F.col("source"))).alias("refined"), F.round(F.avg(ev.detector_score(F.col("m"), F.col("source"))), 3).alias("mean_score"))


@query("g7_box_stats", """WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '[1, 2]' WHEN event_id % 5 = 1 THEN 'none' WHEN event_id % 5 = 2 THEN NULL ELSE '[10, 20, ' || (10 + CAST(floor(value) AS INT)) || '.5, ' || (20 + CAST(floor(value) AS INT)) || ']' END AS raw, value FROM events)
    SELECT event_id, event_id % 5 > 2 AS has_box, CASE WHEN event_id % 5 > 2 THEN round(greatest(CAST(raw->>'$[2]' AS DOUBLE) - 10, 0), 1) END AS width, CASE WHEN event_id % 5 > 2 THEN round(greatest(CAST(raw->>'$[3]' AS DOUBLE) - 20, 0) / 1000, 4) END AS share FROM r""")
def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of boxes that are kept as JSON, and their share of a page's height."""
    v, i = F.floor("value").cast("int"), F.col("event_id")
    raw = rules.choose((i % 5 == 0, "[1, 2]"), (i % 5 == 1, "none"), (i % 5 == 2, F.lit(None).cast("string")), other=F.concat(F.lit("[10, 20, "), 10 + v, F.lit(".5, "), 20 + v, F.lit("]")))
    box = ev.parsed_box(raw)
    zero = F.lit(0.0)
    return b.table(spark, d, "events").select("event_id", box.isNotNull().alias("has_box"), F.when(box.isNotNull(), F.round(F.greatest(box[2] - box[0], zero), 1)).alias("width"), F.when(box.isNotNull(), F.round(F.greatest(box[3] - box[1], zero) / 1000, 4)).alias("share"))


_URL = "CASE paper_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'TODO: publish' WHEN 2 THEN 'https://github.com/test-mode-only/x/blob/main/a.md' WHEN 3 THEN 'https://github.com/other/repo/blob/main/a.md' ELSE 'https://github.com/own/Repo/blob/main/logs/' || paper_id || '/' || replace(replace(title, '/', '_'), '.', '_') || '.md' END"


@query("p8_preflight", sql(f"""{_SUMMARISED}, u AS (SELECT *, {_URL} AS url, CASE WHEN paper_id % 7 = 0 THEN '  ' WHEN paper_id % 7 = 1 THEN title || ' is a FRAUD' ELSE title END AS body, karma % 12 - 0.5 AS score, karma % 2 AS left_karma, ours > 0 AS participated FROM summarised)
    SELECT paper_id, url, CASE WHEN NOT (h >= 0 AND h <= 48) THEN 'phase' WHEN left_karma < CASE WHEN participated THEN 0.1 ELSE 1.0 END THEN 'karma' WHEN url = '' OR starts_with(url, 'TODO:') THEN 'url' WHEN contains(lower(body), 'fraud') THEN 'moderation' WHEN trim(body) = '' THEN 'empty' END AS comment_failure,
        CASE WHEN url = '' OR starts_with(url, 'TODO:') THEN 'url' WHEN NOT (score BETWEEN 0 AND 10) THEN 'score' WHEN others < 3 THEN 'citations' WHEN NOT (h > 48 AND h <= 72) THEN 'eligibility' END AS verdict_failure,
        CASE WHEN NOT (score BETWEEN 0 AND 10) THEN 'invalid_verdict_score' END AS score_failure, CASE WHEN url = '' THEN 'empty' WHEN starts_with(url, 'TODO:') THEN 'placeholder' WHEN contains(url, 'test-mode-only') THEN 'test_mode' WHEN contains(url, 'other/repo') THEN 'other_repository' END AS artifact_failure,
        CASE WHEN others <= 0 THEN 'deprioritize' WHEN others = 1 THEN 'neutral' WHEN others <= 3 THEN 'prefer' ELSE 'deprioritize' END AS tier, CASE WHEN others <= 0 THEN 'too_cold_no_social_proof' WHEN others > 3 THEN 'too_crowded_low_marginal_value' END AS note FROM u""", "papers", "comments", "verifications"))
def preflight(spark: SparkSession, d: str) -> DataFrame:
    """The first check that keeps a comment or a verdict from being posted."""
    i, title = F.col("paper_id"), F.col("title")
    own = F.concat_ws("/", F.lit("https://github.com/own/Repo/blob/main/logs"), i, F.concat(F.translate(title, "/.", "__"), F.lit(".md")))
    url = _pick(i, "", "TODO: publish", "https://github.com/test-mode-only/x/blob/main/a.md", "https://github.com/other/repo/blob/main/a.md", own, own)
    body = rules.choose((i % 7 == 0, "  "), (i % 7 == 1, F.concat(title, F.lit(" is a FRAUD"))), other=title)
    p = summarised(spark, d).withColumns({"url": url, "body": body, "score": F.col("karma") % 12 - 0.5, "left_karma": F.col("karma") % 2})
    phase, note = rules.phase(F.col("h")), ev.crowding_note(rules.heat_band(F.col("others")))
    cost = rules.action_cost(F.lit("comment"), F.col("ours") > 0)
    return p.select(
        "paper_id", "url", ev.comment_failure(phase, F.col("left_karma"), cost, F.col("url"), tx.blocked_phrase(F.col("body")), F.col("body")).alias("comment_failure"),
        ev.verdict_failure(F.col("url"), F.col("score"), F.col("others"), phase == "VERDICT_ACTIVE").alias("verdict_failure"), ev.verdict_score_failure(F.col("score")).alias("score_failure"),
        ev.artifact_failure(F.col("url"), F.lit("github"), F.lit("https://github.com/own/Repo"), "own/repo").alias("artifact_failure"), note["tier"].alias("tier"), note["reason"].alias("note"),
    )


@query("t50_badges", """WITH s AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 7 AS k, [' Supported', 'contradicted', 'not verifiable', 'insufficient-evidence', 'who knows'][event_id % 5 + 1] AS v, CASE WHEN event_id % 3 > 0 THEN value / 500 END AS c FROM events)
    SELECT event_id, CASE k WHEN 5 THEN 'highly faithful' WHEN 4 THEN 'mostly faithful' WHEN 3 THEN 'borderline / paraphrase drift' WHEN 2 THEN 'substantial drift' WHEN 1 THEN 'unsupported / hallucinated' ELSE 'score unavailable' END AS label,
        CASE WHEN k <= 2 THEN '🔴' WHEN k = 3 THEN '🟠' WHEN k >= 4 THEN '🟢' ELSE '⚪' END AS badge, ['supported', 'refuted', 'not_verifiable', 'insufficient_evidence', 'unknown'][event_id % 5 + 1] AS verdict, coalesce(c, 0) >= 0.6 AND coalesce(k / 6, 0) >= 0.5 AS kept FROM s""")
def badges(spark: SparkSession, d: str) -> DataFrame:
    """Scores and verdicts as a report shows them, and which claims are kept."""
    k = F.get_json_object("props", "$.k").cast("int") % 7
    v = _pick(F.col("event_id"), " Supported", "contradicted", "not verifiable", "insufficient-evidence", "who knows")
    confidence = F.when(F.col("event_id") % 3 > 0, F.col("value") / 500)
    kept = (F.coalesce(confidence, F.lit(0.0)) >= 0.6) & (F.coalesce(k / 6, F.lit(0.0)) >= 0.5)
    return b.table(spark, d, "events").select("event_id", ev.score_label(k).alias("label"), ev.score_badge(k).alias("badge"), tx.verdict(v).alias("verdict"), kept.alias("kept"))


@query("t44_tool_calls", """WITH t AS (SELECT event_id, event_type, ['Bash', 'WebFetch', 'Edit', 'Skill', 'Grep', 'Glob', 'Other'][event_id % 7 + 1] AS name FROM events)
    SELECT event_id, CASE name WHEN 'Bash' THEN event_type WHEN 'WebFetch' THEN 'http://' || event_type WHEN 'Edit' THEN '/' || event_type WHEN 'Skill' THEN event_type WHEN 'Grep' THEN event_type WHEN 'Glob' THEN 'q' || event_type ELSE '{"x":"' || event_type || '"}' END AS summary FROM t""")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """What a tool was called for."""
    e = F.col("event_type")
    name = _pick(F.col("event_id"), "Bash", "WebFetch", "Edit", "Skill", "Grep", "Glob", "Other")
    j = lambda k, v: F.concat(F.lit(f'{{"{k}":"'), v, F.lit('"}'))
    arguments = _pick(F.col("event_id"), j("command", F.concat(F.lit(" "), e)), j("url", F.concat(F.lit("http://"), e)), j("file_path", F.concat(F.lit("/"), e)), j("skill", e), j("pattern", e), j("query", F.concat(F.lit("q"), e)), j("x", e))
    return b.table(spark, d, "events").select("event_id", ev.tool_summary(name, arguments).alias("summary"))


@query("t58_verdict_files", sql("""g AS (SELECT paper_id, list(DISTINCT CAST(thread_id AS VARCHAR) ORDER BY CAST(thread_id AS VARCHAR)) AS cited FROM comments WHERE NOT is_ours AND is_citable GROUP BY 1),
    f AS (SELECT p.paper_id, '- **paper_id**: ' || p.paper_id || chr(10) || '- **score**: ' || (p.paper_id % 11) || chr(10) || chr(10) || '## Verdict Content' || chr(10) || chr(10) || title || CASE WHEN cited IS NULL THEN '' ELSE chr(10) || chr(10) || '## Cited Comments' || chr(10) || chr(10) || array_to_string(list_transform(cited, lambda c: '- [[comment:' || c || ']]'), chr(10)) END AS content FROM papers p LEFT JOIN g USING (paper_id))
    SELECT paper_id, sha256(content) AS content_sha256, len(regexp_extract_all(content, '\\[\\[comment:[^\\]]+\\]\\]')) AS n_cited FROM f""", "papers", "comments"))
def verdict_files(spark: SparkSession, d: str) -> DataFrame:
    """A verdict's file and the comments that it cites."""
    cited = b.comments(spark, d).where("not is_ours and is_citable").groupBy("paper_id").agg(F.sort_array(F.collect_set(F.col("thread_id").cast("string"))).alias("cited"))
    p = b.papers(spark, d).join(cited, "paper_id", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<string>")))
    content = ev.verdict_artifact(F.col("paper_id").cast("string"), (F.col("paper_id") % 11).cast("string"), F.col("title"), F.col("cited"))
    return p.select("paper_id", F.sha2(content, 256).alias("content_sha256"), F.size(ev.cited_comments(content)).cast("long").alias("n_cited"))


@query("t19_chunk_keys", """WITH g AS (SELECT event_id, user_id AS u, event_type AS e FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN u || '|' || e WHEN 1 THEN u || '|' || e WHEN 2 THEN '' ELSE e END AS keys FROM g""")
def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    """Ids out of JSON lists, lists with commas, and nothing."""
    u, e = F.col("user_id").cast("string"), F.col("event_type")
    raw = _pick(F.col("event_id"), F.concat(F.lit("["), u, F.lit(', "'), e, F.lit('", " "]')), F.concat(u, F.lit(" , "), e, F.lit(",")), " ", e)
    return b.table(spark, d, "events").select("event_id", F.array_join(ev.chunk_keys(raw), "|").alias("keys"))


_RAW = "['Figure Caption', 'table', 'Page Header', 'IMAGE ', 'Table note', 'Dining table', 'text', 'Bar chart', 'TV'][l_partkey % 9 + 1]"


@query("p48_labels", f"""SELECT raw, CASE raw WHEN 'Figure Caption' THEN 'caption' WHEN 'table' THEN 'table' WHEN 'IMAGE ' THEN 'figure' WHEN 'Dining table' THEN 'table' WHEN 'Bar chart' THEN 'figure' END AS layout,
    CASE raw WHEN 'Figure Caption' THEN 'figure' WHEN 'table' THEN 'table' WHEN 'Table note' THEN 'table' WHEN 'Dining table' THEN 'table' WHEN 'Bar chart' THEN 'figure' WHEN 'TV' THEN 'figure' END AS detected, count(*) AS n FROM (SELECT {_RAW} AS raw FROM lineitem) GROUP BY raw""")
def labels(spark: SparkSession, d: str) -> DataFrame:
    """detectors' labels as kinds of objects."""
    raw = _pick(F.col("l_partkey"), "Figure Caption", "table", "Page Header", "IMAGE ", "Table note", "Dining table", "text", "Bar chart", "TV")
    n = b.table(spark, d, "lineitem").groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("raw", ev.layout_label(F.col("raw")).alias("layout"), ev.detected_label(F.col("raw")).alias("detected"), "n")


@query("t33_errors", """SELECT event_id, '{''name'': ''' || event_type || ''', ''reqId'':''<redacted>'', ''status'': 404}' AS error, 'lightonocr2_tok' || (event_id % 3 * 256) || '_t' || CAST(floor(value) AS INT) || '_side1024_scale2.5' AS cache_key FROM events""")
def errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors without what is particular to a request; keys of caches that follow from settings."""
    raw = F.concat(F.lit("{'name': '"), F.col("event_type"), F.lit("', 'reqId' : '"), F.col("event_id"), F.lit("-x', 'status': 404}"))
    key = ev.config_key(F.col("event_id") % 3 * 256, F.col("value"), F.lit(1024), F.lit(2.5))
    return b.table(spark, d, "events").select("event_id", ev.redacted_error(raw).alias("error"), key.alias("cache_key"))


@query("s53_participation", sql("""f AS (SELECT paper_id, bool_or(is_ours) AS ours FROM comments GROUP BY 1) SELECT p.paper_id, coalesce(ours, FALSE) AS participated FROM papers p LEFT JOIN f USING (paper_id)""", "papers", "comments"))
def participation(spark: SparkSession, d: str) -> DataFrame:
    """Whether we have taken part, false for papers without comments."""
    flags = b.comments(spark, d).groupBy("paper_id").agg(F.bool_or("is_ours").alias("ours"))
    return b.papers(spark, d).join(flags, "paper_id", "left").select("paper_id", F.coalesce("ours", F.lit(False)).alias("participated"))


_ASKED = "asked AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS paper_id FROM events WHERE event_type = 'purchase')"


def asked(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").where("event_type = 'purchase'").select(F.get_json_object("props", "$.k").cast("long").alias("paper_id")).distinct()


@query("s54_rows_by_key", f"""WITH {_ASKED}, {_CLAIMS} SELECT paper_id, claim_id, field, text, CAST(NULL AS VARCHAR) AS quote, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY claim_id) AS INT) AS place FROM claims SEMI JOIN asked USING (paper_id)""")
def rows_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Claims of asked papers in order, with a column that older tables don't have."""
    rows = claims(spark, d).join(asked(spark, d), "paper_id", "left_semi")
    have = {c: F.col(c) for c in rows.columns}
    columns = [have.get(c, F.lit(None).cast("string")).alias(c) for c in ("paper_id", "claim_id", "field", "text", "quote")]
    return rows.select(*columns).withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy("claim_id")))


@query("s56_paper_lists", """SELECT event_id, k, len(xs) AS n, xs[1] AS first FROM (SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN [] ELSE [event_type, CAST(user_id AS VARCHAR)] END AS xs FROM events)""")
def paper_lists(spark: SparkSession, d: str) -> DataFrame:
    """A header's lists, which are kept as JSON; what isn't a list is empty."""
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("not a list")).otherwise(F.to_json(F.array("event_type", F.col("user_id").cast("string"))))
    xs = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return b.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(xs).cast("long").alias("n"), F.try_element_at(xs, F.lit(1)).alias("first"))


def paper_scope(default: DataFrame, papers: DataFrame, ids: DataFrame | None = None, venue: str | None = None) -> DataFrame:
    """paper_id of the papers that a command works on: named ones, else those of a venue, else the default."""
    if ids is not None:
        return papers.join(ids, "paper_id", "left_semi").select("paper_id")
    return papers.where(F.col("venue") == venue).select("paper_id") if venue else default.select("paper_id").distinct()


@query("s60_scopes", sql(f"""{_ASKED} SELECT 'ids' AS scope, count(*) AS n, sum(paper_id)::BIGINT AS ids FROM papers SEMI JOIN asked USING (paper_id) UNION ALL SELECT 'venue', count(*), sum(paper_id)::BIGINT FROM papers WHERE venue = 'Brand#13'
    UNION ALL SELECT 'reviewed', count(*), sum(paper_id)::BIGINT FROM (SELECT DISTINCT paper_id FROM comments) UNION ALL SELECT 'all', count(*), sum(paper_id)::BIGINT FROM papers""", "papers", "comments"))
def scopes(spark: SparkSession, d: str) -> DataFrame:
    """Which papers a command takes."""
    p, c = b.papers(spark, d), b.comments(spark, d)
    some = {"ids": paper_scope(c, p, ids=asked(spark, d)), "venue": paper_scope(c, p, venue="Brand#13"), "reviewed": paper_scope(c, p), "all": paper_scope(p, p)}
    out = [df.agg(F.lit(name).alias("scope"), F.count(F.lit(1)).alias("n"), F.sum("paper_id").alias("ids")) for name, df in some.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("s64_objects_by_id", f"""WITH {_ASKED}, o AS (SELECT doc_id, lang, nullif(n_chars % 7, 0) AS page, nullif(n_chars % 5, 0) AS page_start FROM documents) SELECT o.doc_id, coalesce(page, page_start, 99999) AS page FROM o JOIN asked ON asked.paper_id = o.doc_id""")
def objects_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Objects of a list of ids, with the page that orders them."""
    page = F.coalesce(F.nullif(F.col("n_chars") % 7, F.lit(0)), F.nullif(F.col("n_chars") % 5, F.lit(0)), F.lit(99999))
    return b.table(spark, d, "documents").join(asked(spark, d).withColumnRenamed("paper_id", "doc_id"), "doc_id", "left_semi").select("doc_id", page.alias("page"))


_DRAFT = """draft AS (SELECT paper_id, string_agg('Claim: ' || text || chr(10) || 'Verdict: refuted (confidence ' || printf('%d.%02d', (CAST(round(confidence * 10000) AS INT) + 50) // 10000, (CAST(round(confidence * 10000) AS INT) + 50) // 100 % 100) || ')' || chr(10) || chr(10), '' ORDER BY claim_id) AS body, count(*) AS refuted FROM claims WHERE verdict = 'refuted' AND confidence >= 0.5 GROUP BY 1)"""


@query("s52_reactive", f"""WITH {_CLAIMS}, {_DRAFT}, g AS (SELECT paper_id, count(*) AS n_claims, count(*) FILTER (verdict <> 'supported') AS disputed FROM claims GROUP BY 1)
    SELECT paper_id, n_claims, disputed, coalesce(refuted, 0) AS refuted, CASE WHEN refuted > 0 THEN 'react' WHEN disputed > 0 THEN 'unclear' ELSE 'skip' END AS recommendation,
        sha256('[DRY-RUN — not posted]' || chr(10) || 'Reactive fact-check draft for comment ' || paper_id || ':' || rtrim(chr(10) || chr(10) || coalesce(body, ''), chr(10))) AS draft_sha256,
        sha256('Reactive fact-check draft for comment ' || paper_id || ':' || rtrim(chr(10) || chr(10) || coalesce(body, ''), chr(10))) AS posted_sha256 FROM g LEFT JOIN draft USING (paper_id)""")
def reactive(spark: SparkSession, d: str) -> DataFrame:
    """A comment's claims, what was found, and the draft of a reply to it."""
    c = claims(spark, d)
    parts = F.round(F.col("confidence") * 10000).cast("int") + 50  # of ten thousand, so that both engines round alike
    sure = F.format_string("%d.%02d", F.expr("div(x, 10000)"), F.expr("div(x, 100) % 100"))
    lines = F.concat(F.lit("Claim: "), F.col("text"), F.lit("\nVerdict: refuted (confidence "), sure, F.lit(")\n\n"))
    refuted = rules.is_contradiction(F.col("verdict")) & (F.col("confidence") >= 0.5)
    g = c.withColumn("x", parts).groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("verdict") != "supported").alias("disputed"), F.count_if(refuted).alias("refuted"),
        F.array_sort(F.collect_list(F.when(refuted, F.struct("claim_id", lines.alias("lines"))))).alias("drafts"),
    )
    body = F.array_join(F.transform("drafts", lambda x: x["lines"]), "")
    draft = F.regexp_replace(F.concat(F.lit("[DRY-RUN — not posted]\nReactive fact-check draft for comment "), F.col("paper_id"), F.lit(":\n\n"), body), r"\n+$", "")
    advice = rules.choose((F.col("refuted") > 0, "react"), (F.col("disputed") > 0, "unclear"), other="skip")
    return g.select("paper_id", "n_claims", "disputed", "refuted", advice.alias("recommendation"), F.sha2(draft, 256).alias("draft_sha256"), F.sha2(ev.posted_body(draft), 256).alias("posted_sha256"))


@query("a16_ocr_audit", """WITH s AS (SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'never_attempted' WHEN 1 THEN 'rejected' ELSE 'accepted' END AS status, CASE event_id % 5 WHEN 0 THEN 'caption_only' WHEN 1 THEN 'too_short' END AS reason FROM events),
    g AS (SELECT event_type, count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'never_attempted') AS never, count(*) FILTER (reason = 'caption_only') AS caption_only FROM s GROUP BY 1)
    SELECT *, round(accepted / nullif(total - never, 0), 4) AS accepted_rate, CASE WHEN total = never THEN 'No OCR inference was attempted for any figure in this set.' ELSE 'Of ' || (total - never) || ' attempted figures, ' || accepted || ' were accepted.' END || CASE WHEN caption_only / total > 0.35 THEN ' caption_only is the leading skip reason.' ELSE '' END AS said FROM g""")
def ocr_audit(spark: SparkSession, d: str) -> DataFrame:
    """How often recognition was tried and accepted, and sentences on it."""
    i = F.col("event_id") % 5
    status, reason = rules.choose((i == 0, "never_attempted"), (i == 1, "rejected"), other="accepted"), rules.choose((i == 0, "caption_only"), (i == 1, "too_short"))
    g = b.table(spark, d, "events").withColumns({"status": status, "reason": reason}).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(n) for n, s in (("accepted", "accepted"), ("rejected", "rejected"), ("never", "never_attempted"))), F.count_if(F.col("reason") == "caption_only").alias("caption_only"))
    tried = F.col("total") - F.col("never")
    first = rules.choose((tried == 0, "No OCR inference was attempted for any figure in this set."), other=F.concat(F.lit("Of "), tried, F.lit(" attempted figures, "), F.col("accepted"), F.lit(" were accepted.")))
    second = F.when(F.col("caption_only") / F.col("total") > 0.35, " caption_only is the leading skip reason.").otherwise("")
    return g.withColumns({"accepted_rate": F.round(F.col("accepted") / F.nullif(tried, F.lit(0)), 4), "said": F.concat(first, second)})


@query("a36_run_counters", sql(f"""{_SUMMARISED} SELECT count(*) AS processed, count(*) FILTER (h < 0) AS not_open, count(*) FILTER (h BETWEEN 0 AND 48 AND ours = 0) AS can_seed, count(*) FILTER (h BETWEEN 0 AND 48 AND reacts > 0) AS reactive, count(*) FILTER (h > 48 AND h <= 72 AND others >= 3) AS verdict_ready,
    count(*) FILTER (h > 48 AND h <= 72 AND others < 3) AS verdict_blocked, count(*) FILTER (h > 72) AS expired FROM summarised""", "papers", "comments", "verifications"))
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a run over all papers would find, by phase."""
    phase, n = rules.phase(F.col("h")), F.count_if
    open_, verdict = phase == "REVIEW_ACTIVE", phase == "VERDICT_ACTIVE"
    return summarised(spark, d).agg(
        F.count(F.lit(1)).alias("processed"), n(phase == "NEW").alias("not_open"), n(open_ & (F.col("ours") == 0)).alias("can_seed"), n(open_ & (F.col("reacts") > 0)).alias("reactive"),
        n(verdict & (F.col("others") >= rules.MIN_OTHERS)).alias("verdict_ready"), n(verdict & (F.col("others") < rules.MIN_OTHERS)).alias("verdict_blocked"), n(phase == "EXPIRED").alias("expired"),
    )


@query("a38_workspace", f"""WITH {_CLAIMS}, r AS (SELECT paper_id, field, count(*) AS n, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY CASE field WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 999 END, confidence, claim_id) AS ids FROM claims GROUP BY 1, 2)
    SELECT paper_id, count(*) AS n_reviews, CAST(sum(n) AS BIGINT) AS n_claims, string_agg(field || ':' || ids, ';' ORDER BY field) AS claims FROM r GROUP BY 1""")
def workspace(spark: SparkSession, d: str) -> DataFrame:
    """A paper's reviews, and their claims in the order of fields."""
    rank = rules.choose((F.col("field") == "F", 0), (F.col("field") == "O", 1), other=999)
    c = claims(spark, d).withColumn("key", F.struct(rank.alias("rank"), "confidence", "claim_id"))
    r = c.groupBy("paper_id", "field").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("key")), lambda k: k["claim_id"].cast("string")), ",").alias("ids"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("field", "ids"))), lambda x: F.concat(x["field"], F.lit(":"), x["ids"]))
    return r.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum("n").alias("n_claims"), F.array_join(listed, ";").alias("claims"))


@query("w23_primary_page", f"""WITH {_EVIDENCE}, e AS (SELECT claim_id, position, tie, page, position % 5 = 4 AS matched, score + 0.01 AS area FROM evidence), p AS (SELECT claim_id, page, round(sum(area), 6) AS area, min((position, tie)) AS seen FROM e GROUP BY 1, 2),
    t AS (SELECT claim_id, arg_min(page, (-area, seen)) AS largest, count(*) AS pages FROM p GROUP BY 1), m AS (SELECT claim_id, arg_min(page, (position, tie)) AS named FROM e WHERE matched GROUP BY 1)
    SELECT claim_id, coalesce(named, largest) AS page, pages FROM t LEFT JOIN m USING (claim_id)""")
def primary_page(spark: SparkSession, d: str) -> DataFrame:
    """The page to show for a claim: that of the first box it names, else the one with the largest area."""
    e = evidence(spark, d).select("claim_id", "page", F.struct(*_ORDER).alias("seen"), (F.col("position") % 5 == 4).alias("matched"), (F.col("score") + 0.01).alias("area"))
    p = e.groupBy("claim_id", "page").agg(F.round(F.sum("area"), 6).alias("area"), F.min("seen").alias("seen"), F.min(F.when(F.col("matched"), F.col("seen"))).alias("named"))
    out = p.groupBy("claim_id").agg(F.min_by("page", "named").alias("named"), F.min_by("page", F.struct(-F.col("area"), F.col("seen"))).alias("largest"), F.count(F.lit(1)).alias("pages"))
    return out.select("claim_id", F.coalesce("named", "largest").alias("page"), "pages")


@query("w26_evidence_keys", f"""WITH {_EVIDENCE}, k AS (SELECT claim_id, CASE WHEN position % 2 = 0 THEN [CAST(page AS VARCHAR), section_number] ELSE [CAST(page AS VARCHAR)] END AS ids, position, tie FROM evidence),
    u AS (SELECT claim_id, id, min((position, tie, i)) AS seen FROM (SELECT claim_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i, position, tie FROM k) GROUP BY 1, 2) SELECT claim_id, string_agg(id, ',' ORDER BY seen) AS keys FROM u GROUP BY 1""")
def evidence_keys(spark: SparkSession, d: str) -> DataFrame:
    """All keys of a claim's evidence, each once, in the order they are met."""
    page = F.col("page").cast("string")
    ids = F.when(F.col("position") % 2 == 0, F.array(page, F.col("section_number"))).otherwise(F.array(page))
    rows = evidence(spark, d).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, ids.alias("ids")))).alias("rows"))
    return rows.select("claim_id", F.array_join(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["ids"]))), ",").alias("keys"))


#: The templates that the query binds; a user's come from a table or a parameter of their own.
_TEMPLATES = ('Which figures of {title} bear out "{excerpt}"?', "{excerpt} On {title}: we have run this and agree.", '"{excerpt}" holds for which inputs?')


def _body_sql(template: str) -> str:
    parts = template.replace("'", "''").replace("{title}", "' || coalesce(nullif(source, ''), 'this topic') || '").replace("{excerpt}", "' || excerpt || '")
    return f"'{parts}'"


@query("r19_best_seed", r"""WITH a AS (SELECT doc_id, source, trim(text) AS t FROM documents), x AS (SELECT doc_id, source, rtrim(left(t, 150)) || CASE WHEN length(t) > 150 THEN '...' ELSE '' END AS excerpt FROM a WHERE t <> ''),
    c AS (__BODIES__), s AS (SELECT doc_id, i, body, round(0.6 * least(length(body) / 400.0, 1) + 0.4 * CASE WHEN contains(body, '?') THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM c WHERE NOT regexp_matches(lower(body), '__BLOCKED__'))
    SELECT doc_id, CAST(arg_min(i, (-score, i)) AS INT) AS best, max(score) AS score, count(*) AS candidates FROM s GROUP BY 1""".replace("__BLOCKED__", "|".join(tx.BLOCKED)).replace("__BODIES__", " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {_body_sql(t)} AS body FROM x" for i, t in enumerate(_TEMPLATES, 1))))
def best_seed(spark: SparkSession, d: str) -> DataFrame:
    """Comments made of an abstract's beginning by templates, and the best of those that may be posted."""
    c = ranking.seed_candidates(b.table(spark, d, "documents").withColumn("title", F.col("source")), _TEMPLATES, "text", "title").withColumn("score", F.round(rules.seed_score(F.col("body"), F.lit(False)), 6))
    return c.groupBy("doc_id").agg(F.min_by("i", F.struct(-F.col("score"), F.col("i"))).alias("best"), F.max("score").alias("score"), F.count(F.lit(1)).alias("candidates"))


@query("j8_table_match", f"""WITH {_EVIDENCE}, c AS (SELECT claim_id, position, tie, label, page FROM evidence WHERE kind = 'table'), t AS (SELECT claim_id, position AS i, tie AS j, page, CASE WHEN position % 2 = 0 THEN label ELSE upper(label) || '.: ' END AS label FROM evidence WHERE kind <> 'text_chunk'),
    n AS (SELECT claim_id, page, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT c.*, t.i, t.j, CASE WHEN lower(trim(c.label)) = lower(trim(t.label)) THEN 1 WHEN lower(trim(c.label)) = regexp_replace(lower(trim(t.label)), '[:\\.\\s]+$', '') THEN 2 WHEN n = 1 THEN 4 END AS mode FROM c JOIN t USING (claim_id, page) JOIN n USING (claim_id, page))
    SELECT claim_id, position, tie, CASE mode WHEN 1 THEN 'exact_label_page' WHEN 2 THEN 'label_page' ELSE 'page_only' END AS mode, i AS matched FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, position, tie ORDER BY mode, i, j) AS k FROM m WHERE mode IS NOT NULL) WHERE k = 1""")
def table_match(spark: SparkSession, d: str) -> DataFrame:
    """A claim's tables against those recognised on the same page: by label, by label without its end, or the only one."""
    e = evidence(spark, d)
    c = e.where("kind = 'table'").select("claim_id", *_ORDER, "label", "page")
    other = F.when(F.col("position") % 2 == 0, F.col("label")).otherwise(F.concat(F.upper("label"), F.lit(".: ")))
    t = e.where("kind <> 'text_chunk'").groupBy("claim_id", "page").agg(F.collect_list(F.struct(F.col("position").alias("i"), F.col("tie").alias("j"), other.alias("other"))).alias("tables"))
    rows = c.join(t, ["claim_id", "page"]).withColumn("only", F.size("tables") == 1).select("claim_id", *_ORDER, "label", "only", F.inline("tables"))
    own, low = F.lower(F.trim("label")), F.lower(F.trim("other"))
    mode = rules.choose((own == low, 1), (own == F.regexp_replace(low, r"[:\.\s]+$", ""), 2), (F.col("only"), 4))
    best = rows.withColumn("mode", mode).where("mode is not null").groupBy("claim_id", *_ORDER).agg(F.min(F.struct("mode", "i", "j")).alias("m"))
    return best.select("claim_id", *_ORDER, rules.choose((F.col("m.mode") == 1, "exact_label_page"), (F.col("m.mode") == 2, "label_page"), other="page_only").alias("mode"), F.col("m.i").alias("matched"))


@query("x9_final_metrics", """SELECT user_id AS agent, arg_max(value, (ts, event_id)) FILTER (event_id % 3 > 0) AS cost, arg_max(event_type, (ts, event_id)) AS last_type, arg_min(event_id, (ts, event_id)) AS session, count(*) AS steps FROM events GROUP BY 1""")
def final_metrics(spark: SparkSession, d: str) -> DataFrame:
    """An agent's totals, of each the last value that isn't null; its session is its first event's."""
    at = F.struct("ts", "event_id")
    known = F.when(F.col("event_id") % 3 > 0, at)
    return b.table(spark, d, "events").groupBy(F.col("user_id").alias("agent")).agg(F.max_by("value", known).alias("cost"), F.max_by("event_type", at).alias("last_type"), F.min_by("event_id", at).alias("session"), F.count(F.lit(1)).alias("steps"))


@query("u12_batch_replace", """WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice, 0 AS batch FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice, 1 FROM lineitem WHERE l_linestatus = 'O')
    SELECT l_orderkey AS object_id, l_linenumber AS model, max_by(l_extendedprice, (batch, l_extendedprice)) AS value, max(batch) = 1 AS replaced FROM o GROUP BY 1, 2""")
def batch_replace(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a batch take the place of those with the same key."""
    rows = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("model"), F.col("l_extendedprice").alias("value"), (F.col("l_linestatus") == "O").alias("batch"))
    return rows.groupBy("object_id", "model").agg(F.max_by("value", F.struct("batch", "value")).alias("value"), F.bool_or("batch").alias("replaced"))


@query("u10_runs", f"""WITH {_CLAIMS}, r AS (SELECT field, count(*) AS n, min(confidence) AS least FROM claims WHERE confidence >= 0.5 GROUP BY 1) SELECT sha256('extract|' || field) AS run_id, field, n, least, '{{"field":"' || field || '"}}' AS params FROM r""")
def runs(spark: SparkSession, d: str) -> DataFrame:
    """A run's row and how many claims carry its key, which follows from what the run is."""
    c = claims(spark, d).where("confidence >= 0.5").withColumn("run_id", F.sha2(F.concat(F.lit("extract|"), F.col("field")), 256))
    return c.groupBy("run_id", "field").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least")).withColumn("params", F.to_json(F.struct("field")))


@query("f22_index_status", sql(f"""{_EVIDENCE}, e AS (SELECT claim_id AS paper_id, kind, page, position, tie FROM evidence), n AS (SELECT paper_id, count(*) AS n, count(*) FILTER (kind = 'text_chunk') AS texts FROM e GROUP BY 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY kind, page, position, tie) AS i FROM e), s AS (SELECT paper_id, round(sum(CASE WHEN kind = 'text_chunk' THEN 0.6 ELSE 0.4 END), 2)::DOUBLE AS sure FROM f WHERE i <= 5 GROUP BY 1)
    SELECT p.paper_id, CASE WHEN n IS NULL THEN 'build' WHEN texts = n THEN 'rebuild' ELSE 'skip' END AS status, coalesce(sure, 0) AS confidence FROM papers p LEFT JOIN n USING (paper_id) LEFT JOIN s USING (paper_id)""", "papers"))
def index_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether a paper's evidence has to be built, and the first five pieces of it."""
    e = evidence(spark, d).withColumnRenamed("claim_id", "paper_id")
    text = F.col("kind") == "text_chunk"
    first = e.withColumn("i", F.row_number().over(Window.partitionBy("paper_id").orderBy("kind", "page", *_ORDER)))
    n = first.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(text).alias("texts"), F.round(F.sum(F.when(F.col("i") <= 5, F.when(text, 0.6).otherwise(0.4))), 2).alias("sure"))
    status = rules.choose((F.col("n").isNull(), "build"), (F.col("texts") == F.col("n"), "rebuild"), other="skip")
    return b.papers(spark, d).join(n, "paper_id", "left").select("paper_id", status.alias("status"), F.coalesce("sure", F.lit(0.0)).alias("confidence"))


EXPORTS = {"raw/papers": "part", "raw/comments": "lineitem", "raw/actions": "events", "raw/documents": "documents", "structured/claims": "orders", "structured/verdicts": "missing"}


def counted(spark: SparkSession, d: str, name: str) -> DataFrame:
    """n of a table, 0 where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return b.table(spark, d, name).agg(F.count(F.lit(1)).alias("n")) if there else spark.range(1).select(F.lit(0).cast("long").alias("n"))


@query("f24_export_counts", " UNION ALL ".join(f"SELECT '{file}' AS file, {'0' if name == 'missing' else f'(SELECT count(*) FROM {name})'}::BIGINT AS n" for file, name in EXPORTS.items()))
def export_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each exported file."""
    out = None
    for file, name in EXPORTS.items():
        one = counted(spark, d, name).select(F.lit(file).alias("file"), "n")
        out = one if out is None else out.union(one)
    return out


@query("w15_captions")
def captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of lines on pages, where each line goes on or ends them (no SQL; tested on lines by hand)."""
    i = F.col("l_linenumber")
    text = _pick(F.col("l_partkey"), F.concat(F.lit("Table "), F.col("l_suppkey"), F.lit(": prices")), "of all parts", "3.1 Setup", F.concat(F.lit("Fig. "), F.col("l_suppkey"), F.lit(" shows them")), "We evaluate all of them", "and more")
    left = F.col("l_quantity") % 3 * 10.0
    lines = b.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    lines = lines.select(F.col("l_orderkey").cast("string").alias("paper_id"), F.lit(1).alias("page_num"), i.alias("span_index"), F.lit("").alias("section"), text.alias("text"), F.array(left, i * 12.0, left + 100, i * 12.0 + 10).alias("box"))
    return matching.best_captions(matching.captions(lines)).select("paper_id", "label", "first_span", "n_spans", "text")


_INVITATIONS = "['V/-/Submission', 'V/P1/-/Official_Review', 'V/P1/-/Rebuttal', 'V/P1/-/Meta_Review', 'V/P1/-/Decision'][event_id % 5 + 1]"


@query("p52_forum_replies", f"""WITH r AS (SELECT event_id, {_INVITATIONS} AS inv, event_type, value FROM events) SELECT event_id, contains(inv, 'Submission') AS submission, CASE WHEN contains(inv, 'Meta_Review') THEN 'meta_review' WHEN contains(inv, 'Official_Review') THEN 'review' WHEN contains(inv, 'Rebuttal') THEN 'rebuttal' WHEN contains(inv, 'Decision') THEN 'decision' END AS kind,
    CASE WHEN contains(inv, 'Rebuttal') THEN event_type WHEN contains(inv, 'Official_Review') THEN 'S ' || event_type WHEN contains(inv, 'Meta') THEN 'M ' || event_type WHEN contains(inv, 'Decision') THEN 'Accept' END AS text FROM r""")
def forum_replies(spark: SparkSession, d: str) -> DataFrame:
    """Notes of a forum told apart by their invitations, and the text of each kind."""
    e = F.col("event_type")
    inv = F.lower(_pick(F.col("event_id"), "V/-/Submission", "V/P1/-/Official_Review", "V/P1/-/Rebuttal", "V/P1/-/Meta_Review", "V/P1/-/Decision"))
    content = _pick(F.col("event_id"), F.to_json(F.struct(e.alias("title"))), F.to_json(F.struct(F.concat(F.lit("S "), e).alias("summary"))), F.to_json(F.struct(F.lit("").alias("comment"), e.alias("rebuttal"))), F.to_json(F.struct(F.concat(F.lit("M "), e).alias("metareview"))), F.lit('{"decision":"Accept"}'))
    #: What invitations of notes other than submissions hold.
    tokens = ("official_review", "review", "official_comment", "comment", "official_rebuttal", "rebuttal", "author_response", "official_decision", "decision", "meta_review", "metareview", "senior_area_chair", "withdrawal", "desk_rejection")
    kind = rules.choose((F.contains(inv, F.lit("meta_review")), "meta_review"), (F.contains(inv, F.lit("official_review")), "review"), (F.contains(inv, F.lit("rebuttal")), "rebuttal"), (F.contains(inv, F.lit("decision")), "decision"))
    of = lambda *ks: F.coalesce(*(F.nullif(F.get_json_object(content, f"$.{k}"), F.lit("")) for k in ks))
    text = rules.choose((kind == "review", of("summary")), (kind == "rebuttal", of("comment", "rebuttal")), (kind == "meta_review", of("metareview")), (kind == "decision", of("decision")))
    return b.table(spark, d, "events").select("event_id", (~ev.has_any(inv, tokens)).alias("submission"), kind.alias("kind"), text.alias("text"))


_KEYED = "['results', 'items', 'data', 'x'][event_id % 4 + 1]"


@query("s32_lists", f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 WHEN {_KEYED} = 'x' THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 5 = 0 OR {_KEYED} <> 'x' THEN event_type END AS first FROM events""")
def lists(spark: SparkSession, d: str) -> DataFrame:
    """A response's list, bare or below one of its usual names."""
    e = F.col("event_type")
    item = F.struct(e.alias("id"))
    keyed = F.concat(F.lit('{"'), _pick(F.col("event_id"), "results", "items", "data", "x"), F.lit('":'), F.to_json(F.array(item)), F.lit("}"))
    body = F.when(F.col("event_id") % 5 == 0, F.to_json(F.array(item, item))).otherwise(keyed)
    found = F.coalesce(F.when(body.startswith("["), body), *(F.get_json_object(body, f"$.{k}") for k in ("results", "items", "data", "comments", "papers")))
    xs = F.coalesce(F.from_json(found, "array<struct<id:string>>"), F.array().cast("array<struct<id:string>>"))
    return b.table(spark, d, "events").select("event_id", F.size(xs).alias("n"), F.try_element_at(xs, F.lit(1))["id"].alias("first"))


@query("t43_retrieval_text", rf"""WITH {_OBJECTS} SELECT doc_id, sha256(label || CASE WHEN caption <> '' THEN chr(10) || 'Caption: ' || {_CLEAN.format('caption')} ELSE '' END || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || CASE kind WHEN 'table' THEN 'Table text/context: ' ELSE 'Figure context: ' END || {_CLEAN.format('text')} ELSE '' END) AS text_sha256 FROM objects""")
def retrieval_text(spark: SparkSession, d: str) -> DataFrame:
    """The text that an object is found by."""
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(head, tx.clean(c)))
    of_text = rules.choose((F.col("kind") == "table", "Table text/context: "), other="Figure context: ")
    return objects(spark, d).select("doc_id", F.sha2(F.concat_ws("\n", "label", part(F.lit("Caption: "), F.col("caption")), part(of_text, F.col("text"))), 256).alias("text_sha256"))
