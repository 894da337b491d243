"""Queries on marked texts, evidence as prompts show it and poor pages, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import report
from lectern.functions.rules import choose
from lectern.operators import aggregates
from lectern.plans import bindings as b
from lectern.plans.audits import _CLAIMS, _EVIDENCE, claims, evidence

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return add


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) >= 3))"
#: From q (raw, claim, and a key of both): each one's best sentence, null without shared words.
_BEST = rf"""s AS (SELECT k, claim, unnest(ls) AS sentence, generate_subscripts(ls, 1) AS i FROM (SELECT k, claim, list_filter(list_transform(string_split(regexp_replace(raw, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM q)),
    h AS (SELECT k, sentence, i, len(list_intersect({_WORDS.format('sentence')}, {_WORDS.format('claim')})) AS hits, len({_WORDS.format('claim')}) AS n FROM s),
    best AS (SELECT k, arg_max(sentence, (hits, -i)) AS sentence, max(hits) / sqrt(max(n)) AS score FROM h WHERE hits > 0 GROUP BY k)"""
_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("t13_sentence_offsets", rf"""WITH q AS (SELECT row_number() OVER () AS k, x.conv_id, x.turn, coalesce(x.text, '') AS claim, coalesce(y.text, '') AS raw FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1), {_BEST}
    SELECT conv_id, turn, round(coalesce(score, 0), 6)::DOUBLE AS score, CAST(strpos(raw, sentence) - 1 AS INT) AS start, CAST(strpos(raw, sentence) - 1 + length(sentence) AS INT) AS "end",
        sha256(CASE WHEN sentence IS NULL THEN {_ESCAPED.format('raw')} ELSE {_ESCAPED.format('left(raw, strpos(raw, sentence) - 1)')} || '<mark>' || {_ESCAPED.format('sentence')} || '</mark>' || {_ESCAPED.format('raw[strpos(raw, sentence) + length(sentence):]')} END) AS marked_sha256 FROM q LEFT JOIN best USING (k)""")
def sentence_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where in the reply the sentence is that shares most with a turn, and the reply with it marked."""
    c = b.table(spark, d, "conversations").select("conv_id", "turn", "text")
    rows = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("raw")), ["conv_id", "turn"])
    best = F.col("best")
    rows = rows.withColumn("best", report.best_sentence_at(F.col("raw"), F.col("text")))
    return rows.select("conv_id", "turn", F.round(best["score"], 6).alias("score"), best["start"].alias("start"), best["end"].alias("end"), F.sha2(report.marked(F.col("raw"), best["sentence"]), 256).alias("marked_sha256"))


@query("t15_marked_fields", rf"""WITH f AS (SELECT conv_id, arg_min(coalesce(text, ''), (turn, role, coalesce(text, ''))) AS raw, min(turn) AS first_turn FROM conversations GROUP BY 1),
    q AS (SELECT row_number() OVER () AS k, conv_id, turn, coalesce(text, '') AS claim, raw FROM conversations JOIN f USING (conv_id) WHERE turn > first_turn), {_BEST},
    m AS (SELECT conv_id, raw, sentence, array_to_string(list_transform(list_sort(list(DISTINCT turn)), lambda t: 'C' || t), ',') AS labels, strpos(raw, sentence) - 1 AS pos FROM q JOIN best USING (k) GROUP BY 1, 2, 3),
    g AS (SELECT *, pos + length(sentence) AS e, max(pos + length(sentence)) OVER (PARTITION BY conv_id ORDER BY pos, -length(sentence) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
    n AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY pos), 0) AS prev FROM g WHERE reach IS NULL OR pos >= reach),
    o AS (SELECT conv_id, count(*) AS n_marks, max(e) AS e, string_agg({_ESCAPED.format('raw[prev + 1:pos]')} || '<mark>[' || labels || '] ' || {_ESCAPED.format('sentence')} || '</mark>', '' ORDER BY pos) AS html FROM n GROUP BY 1)
    SELECT conv_id, (SELECT count(*) FROM m WHERE m.conv_id = f.conv_id) AS n_sentences, sha256(coalesce(html, '') || {_ESCAPED.format('raw[coalesce(e, 0) + 1:]')}) AS marked_sha256 FROM f LEFT JOIN o USING (conv_id)""")
def marked_fields(spark: SparkSession, d: str) -> DataFrame:
    """The first text of a conversation with the sentences marked that later turns are about, labelled with these turns."""
    c = b.table(spark, d, "conversations")
    text = F.coalesce("text", F.lit(""))
    fields = c.groupBy("conv_id").agg(F.min_by(text, F.struct("turn", "role", text)).alias("raw"), F.min("turn").alias("first_turn"))
    asked = c.select("conv_id", "turn", F.col("text").alias("claim")).join(fields, "conv_id").where("turn > first_turn")
    found = asked.withColumn("sentence", report.best_sentence_at(F.col("raw"), F.col("claim"))["sentence"]).where("sentence <> ''").select("conv_id", "turn", "sentence", F.call_function("locate", "sentence", "raw").alias("at"))
    hits = found.groupBy("conv_id", "sentence", "at").agg(F.collect_set("turn").alias("turns"))
    hit = F.struct((F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("sentence")).alias("end"), report.joined_labels(F.col("turns")).alias("label"))
    of = hits.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.collect_list(hit).alias("hits"))  # as many as the text has sentences
    out = fields.join(of, "conv_id", "left")
    return out.select("conv_id", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), F.sha2(report.marked_all(F.col("raw"), F.col("hits")), 256).alias("marked_sha256"))


_LINE = "CASE WHEN {0} THEN chr(10) || {1} ELSE '' END"


@query("t42_evidence_block", f"""WITH {_CLAIMS}, {_EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY position, tie) AS rank, position % 2 = 1 AS odd FROM evidence),
    i AS (SELECT claim_id, rank, '[Evidence E' || rank || ' | Type: ' || CASE kind WHEN 'table' THEN 'Table' WHEN 'figure' THEN 'Figure' ELSE 'Text' END || ']' || chr(10) || 'Section: ' || coalesce(section, 'unknown') || chr(10) || 'Page: ' || CASE WHEN page = 0 THEN '?' ELSE CAST(page AS VARCHAR) END
        || {_LINE.format('label IS NOT NULL', "'Label: ' || label")} || CASE WHEN position % 3 = 0 THEN chr(10) || 'Reference match: yes' WHEN score > 0 THEN chr(10) || 'Reference boost: ' || printf('%.2f', score) ELSE '' END || {_LINE.format("kind <> 'text_chunk'", "'Caption:' || chr(10) || label || ' of part ' || section_number")}
        || CASE WHEN kind = 'figure' THEN {_LINE.format('odd', "'Figure summary: Bars by ' || section_number")} || {_LINE.format('odd', "'Key observations:' || chr(10) || '- rises' || chr(10) || '- falls' || chr(10) || '- ends'")} || {_LINE.format('odd', "'Possible verification use:' || chr(10) || '- trend' || chr(10) || '- scale'")}
            || {_LINE.format('odd AND page = 1', "'Needs precise OCR: yes'")} || {_LINE.format('has_text', "'Figure text (OCR):' || chr(10) || 'axis ' || section_number")} ELSE '' END
        || chr(10) || 'Content:' || chr(10) || CASE WHEN has_text THEN rtrim(left(repeat('Value ' || section_number || ' ', 230), CASE WHEN kind = 'table' THEN 1797 ELSE 1397 END)) || '...' WHEN kind = 'table' THEN '(No extracted table text available)' WHEN kind = 'figure' THEN '(No extracted figure context available)' ELSE '(No text available)' END AS item FROM r)
    SELECT c.claim_id, count(item) AS n, sha256(coalesce(string_agg(item, chr(10) || chr(10) ORDER BY rank), '(No evidence items retrieved.)')) AS block_sha256 FROM claims c LEFT JOIN i USING (claim_id) GROUP BY 1""")
def evidence_block(spark: SparkSession, d: str) -> DataFrame:
    """A claim's evidence as its prompt shows it."""
    e, number = evidence(spark, d), F.col("section_number")
    odd, has = F.col("position") % 2 == 1, F.col("has_text")
    semantics = F.when(odd, F.struct(
        F.concat(F.lit("Bars by "), number).alias("figure_summary"), F.array(*map(F.lit, ("rises", "falls", "ends", "unread"))).alias("key_observations"),
        F.array(*map(F.lit, ("trend", "scale", "unread"))).alias("possible_verification_use"), (F.col("page") == 1).alias("needs_precise_ocr"),
    ))
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy("position", "tie"))
    given = F.when(has, F.repeat(F.concat(F.lit("Value "), number, F.lit(" ")), F.lit(230)))
    e = e.withColumn("rank", rank).withColumns({"given": given, "semantics": semantics})  # texts are made behind the window, which would sort them
    item = report.evidence_item(
        F.col("rank"), F.col("kind"), F.col("section"), F.col("page"), F.col("label"), F.col("position") % 3 == 0, F.col("score"), F.concat("label", F.lit(" of part "), number), F.col("given"),
        F.when(has, F.concat(F.lit("axis "), number)), F.col("semantics"),
    )
    listed = e.select("claim_id", "rank", item.alias("item")).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("items"))
    items = F.coalesce(F.col("items")["item"], F.array().cast("array<string>"))
    rows = claims(spark, d).select("claim_id").join(listed, "claim_id", "left").select("claim_id", items.alias("items"))
    return rows.select("claim_id", F.size("items").cast("long").alias("n"), F.sha2(report.evidence_block(F.col("items")), 256).alias("block_sha256"))


@query("a33_poor_pages", r"""SELECT doc_id, round(avg(length(w)), 6)::DOUBLE AS quality FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\s+')) AS w FROM documents) GROUP BY 1 HAVING avg(length(w)) < 8""")
def poor_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages (texts) whose spans (words) have too few letters on average."""
    spans = b.table(spark, d, "documents").select("doc_id", F.explode(F.split(F.trim("text"), r"\s+")).alias("span"))
    out = aggregates.poor_pages(spans, ["doc_id"], "span")
    return out.select("doc_id", F.round("quality", 6).alias("quality"))


@query("t49_figure_answers", """WITH t AS (SELECT conv_id, turn, role, text, length(text) AS n, left(trim(text, E' \\t\\n\\r'), 400) AS said FROM conversations), ok AS (SELECT *, n % 4 < 3 AS good FROM t WHERE text IS NOT NULL)
    SELECT conv_id, turn, n AS letters, CASE WHEN good AND n % 3 = 0 THEN 'bar_chart' ELSE 'other' END AS figure_type, CASE WHEN good THEN sha256(said) ELSE sha256('') END AS summary_sha256,
        CASE WHEN good THEN len(list_filter(string_split(text, ' ')[1:3], lambda x: x <> '' AND x <> '0')) ELSE 0 END AS n_observations, good AND role = 'assistant' AS needs_precise_ocr FROM ok""")
def figure_answers(spark: SparkSession, d: str) -> DataFrame:
    """The fields of models' answers, made of turns: plain, fenced, with words around, or cut off."""
    n, role = F.length("text"), F.col("role")
    json = F.to_json(F.struct(F.when(n % 3 == 0, " Bar_chart").otherwise("pie").alias("figure_type"), F.col("text").alias("figure_summary"), F.split("text", " ").alias("key_observations"), F.when(role == "assistant", "yes").otherwise("no").alias("needs_precise_ocr")))
    raw = choose((n % 4 == 0, json), (n % 4 == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))), (n % 4 == 2, F.concat(F.lit("It shows: "), json, F.lit(" as asked"))), other=F.substr(json, F.lit(1), F.length(json) - 2))
    a = F.col("a")
    rows = b.table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", n.alias("letters"), report.figure_answer(raw).alias("a"))
    return rows.select("conv_id", "turn", "letters", a["figure_type"].alias("figure_type"), F.sha2(a["figure_summary"], 256).alias("summary_sha256"), F.size(a["key_observations"]).alias("n_observations"), a["needs_precise_ocr"].alias("needs_precise_ocr"))
