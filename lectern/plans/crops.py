"""Queries on captions that have no object: is there room for one above, and are they captions at all? With the SQL that each must agree with.

The lines are those of the layout queries, each twice as long, some of them with words of code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import crops
from lectern.operators import layout as operators
from lectern.plans import layout
from lectern.sources.shared import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return layout.lines(spark, d).withColumn("text", F.when(F.length("text") % 17 == 0, F.concat(text, F.lit(" SELECT x FROM t"))).otherwise(F.concat(text, F.lit(" "), text)))


def captions(rows: DataFrame) -> DataFrame:
    """Lines that begin as captions; of some only the label is known, some are before the paper begins."""
    label = F.regexp_extract("text", r"^(?i:(?:table|tab\.?|figure|fig\.?)\s*\d+)", 0)
    n = F.length("text")
    found = rows.where(F.lower("text").rlike(operators.CAPTION_LIKE)).select(
        F.struct("paper_id", "span_index").alias("caption_id"), "paper_id", "page_num", F.when(F.lower("text").startswith("tab"), "table").otherwise("figure").alias("kind"), label.alias("label"), F.regexp_extract(label, r"\d+", 0).cast("int").alias("number"),
        F.when(n % 4 == 0, "Preamble").otherwise(F.col("section")).alias("section"), F.when(n % 3 == 0, label).otherwise(F.col("text")).alias("text"), "box", F.col("span_index").alias("first_span"), (n % 2 + 1).alias("n_spans"),
    )
    return found


_CAPS = f"""{layout._LINES}, coded AS (SELECT * REPLACE (CASE WHEN length(text) % 17 = 0 THEN text || ' SELECT x FROM t' ELSE text || ' ' || text END AS text) FROM lines),
    caps AS (SELECT *, regexp_extract(text, '^(?i:(?:table|tab\\.?|figure|fig\\.?)\\s*\\d+)') AS label, length(text) % 2 + 1 AS n_spans FROM coded WHERE regexp_matches(lower(text), '{operators.CAPTION_LIKE}'))"""


@query("g10_crop_regions", f"""WITH {_CAPS}, ends AS (SELECT paper_id, page_num, max(x1) AS e FROM coded WHERE boxed GROUP BY 1, 2),
    sized AS (SELECT c.*, CASE WHEN page_num % 5 = 0 THEN coalesce(e, 0) ELSE 612 END AS width, CASE WHEN page_num % 7 = 0 THEN 0.0 ELSE 700.0 END AS height FROM caps c LEFT JOIN ends USING (paper_id, page_num)),
    r AS (SELECT *, greatest(0, x0 - 20) AS c0, greatest(0, y0 - least(280, greatest(60, height * 0.35))) AS c1, least(width, x1 + 20) AS c2, y1 AS c3 FROM sized),
    early AS (SELECT *, CASE WHEN NOT boxed THEN 'no_caption_bbox' WHEN height <= 0 THEN 'unknown_page_height' WHEN width <= 0 THEN 'unknown_page_width' WHEN c2 - c0 < 40 OR c3 - c1 < 60 THEN 'degenerate_box(w=' || printf('%.0f', c2 - c0) || ',h=' || printf('%.0f', c3 - c1) || ')' WHEN c3 - c1 < 3 * greatest(y1 - y0, 1) THEN 'not_larger' END AS reason FROM r),
    n AS (SELECT paper_id, span_index, count(*) AS n FROM early c JOIN coded l USING (paper_id, page_num) WHERE c.reason IS NULL AND l.boxed AND length(trim(l.text)) > 80 AND NOT l.span_index BETWEEN c.span_index AND c.span_index + c.n_spans - 1 AND l.y0 >= c1 - 2 AND l.y1 <= c.y0 + 2 AND l.x0 >= c0 - 10 AND l.x1 <= c2 + 10 GROUP BY paper_id, c.span_index),
    s AS (SELECT *, coalesce(reason, CASE WHEN n >= 3 THEN 'prose_dense(long_lines=' || n || ')' END, 'ok') AS why FROM early LEFT JOIN n USING (paper_id, span_index))
    SELECT paper_id, span_index, why AS reason, CASE WHEN why = 'ok' THEN c0 END AS x0, CASE WHEN why = 'ok' THEN c1 END AS y0, CASE WHEN why = 'ok' THEN c2 END AS x1, CASE WHEN why = 'ok' THEN c3 END AS y1 FROM s""".replace("JOIN coded l USING (paper_id, page_num) WHERE", "JOIN coded l ON l.paper_id = c.paper_id AND l.page_num = c.page_num WHERE").replace("n AS (SELECT paper_id, span_index, count(*)", "n AS (SELECT c.paper_id, c.span_index, count(*)").replace("GROUP BY paper_id, c.span_index)", "GROUP BY 1, 2)"))  # fmt: skip
def crop_regions(spark: SparkSession, d: str) -> DataFrame:
    """The region above each caption that may be its figure, or why there is none."""
    rows = written(lines(spark, d))
    page = F.col("page_num")
    pages = rows.select("paper_id", "page_num").distinct().select("paper_id", "page_num", F.when(page % 5 == 0, 0.0).otherwise(612.0).alias("width"), F.when(page % 7 == 0, 0.0).otherwise(700.0).alias("height"))
    found = crops.regions(captions(rows), rows, pages)
    return found.select("caption_id.paper_id", "caption_id.span_index", "reason", *[F.col("crop")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("p20_caption_checks", f"""WITH {_CAPS}, t AS (SELECT paper_id, page_num, span_index, n_spans, label, CASE WHEN length(text) % 4 = 0 THEN 'Preamble' ELSE section END AS section, CASE WHEN length(text) % 3 = 0 THEN label ELSE text END AS text FROM caps),
    near AS (SELECT t.paper_id, t.span_index, string_agg(trim(l.text), ' ' ORDER BY l.span_index) AS around FROM t JOIN coded l ON l.paper_id = t.paper_id AND l.page_num = t.page_num AND l.span_index BETWEEN t.span_index - 5 AND t.span_index + t.n_spans - 1 + 20 GROUP BY 1, 2),
    s AS (SELECT paper_id, span_index, list_filter([CASE WHEN length(trim(regexp_replace(text[length(label) + 1 :], '^[:. ]+', ''))) < 5 THEN 'bare_caption' END, CASE WHEN section = 'Preamble' THEN 'suspicious_section' END,
        CASE WHEN len(regexp_extract_all(around, '{crops.CODE}')) >= 2 THEN 'code_sql_context (' || len(regexp_extract_all(around, '{crops.CODE}')) || ' tokens)' END], lambda x: x IS NOT NULL) AS signals FROM t JOIN near USING (paper_id, span_index))
    SELECT paper_id, span_index, len(signals) < 2 AS valid, CASE WHEN len(signals) >= 2 THEN array_to_string(signals, '; ') END AS reason FROM s""")
def caption_checks(spark: SparkSession, d: str) -> DataFrame:
    """P20: captions that two signals speak against."""
    rows = written(lines(spark, d))
    found = crops.caption_checks(captions(rows), rows)
    return found.select("caption_id.paper_id", "caption_id.span_index", "valid", "reason")
