"""Regions above captions that may hold a figure, and captions that are none, from the lines around them.

Lines meet captions by tiles of a page (by bands of their numbers for neighbours), so that a page with very many lines is never
compared as a whole. A line has one tile, that of its upper left corner; a region has all tiles that it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as geo
from lectern.functions import text as tx
from lectern.functions.rules import choose

PAGE = ["paper_id", "page_num"]
#: How far a region reaches to the sides and up (a share of the page's height, between two bounds), its least width,
#: height and height in captions, and which lines are long, and how many of them make prose.
SIDE, SHARE, LEAST_UP, MOST_UP, WIDTH, HEIGHT, CAPTIONS, LONG, PROSE = 20.0, 0.35, 60.0, 280.0, 40.0, 60.0, 3.0, 80, 3
#: Tiles: so many across a page, each so high. Bands of lines' numbers.
ACROSS, HIGH, BAND = 8, 64.0, 32
#: Tokens of code, sections before a paper begins, and how many lines before and after a caption are looked at.
CODE = (
    r"(?i)(?:\b(?:SELECT|FROM\s+\w|WHERE\s+\w|(?:LEFT|RIGHT|INNER|OUTER)\s+JOIN|JOIN\s+\w|WITH\s+\w+\s+AS|CASE\s+WHEN|GROUP\s+BY|ORDER\s+BY|INSERT\s+INTO|UPDATE\s+\w|CREATE\s+TABLE|ALTER\s+TABLE)\b"
    r"|\{\{|\}\}|dbt\.)"
)
EARLY, BEFORE, AFTER = r"(?i)^(preamble)\b", 5, 20


def regions(captions: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """caption_id, crop (a box or null) and reason for captions without an object: is there room for one above?

    captions: caption_id, paper_id, page_num, box, first_span and n_spans; lines: paper_id, page_num, span_index, text and box;
    pages: paper_id, page_num, width and height (0 or null where unknown; the width then is where lines end). The region above a
    caption is used if it is large enough and has fewer than three long lines of other spans wholly inside.
    """
    boxed = lines.where(geo.valid(F.col("box")))
    ends = boxed.groupBy(*PAGE).agg(F.max(F.col("box")[2]).alias("_end"))
    sizes = pages.join(ends, PAGE, "full_outer").select(*PAGE, F.coalesce("height", F.lit(0.0)).alias("_height"), F.when(F.col("width") > 0, F.col("width")).otherwise(F.greatest(F.coalesce("_end", F.lit(0.0)), F.lit(0.0))).alias("_width"))
    x0, y0, x1, y1 = (F.col("box")[i] for i in range(4))
    up = F.least(F.lit(MOST_UP), F.greatest(F.lit(LEAST_UP), F.col("_height") * SHARE))
    zero = F.lit(0.0)
    of = captions.join(sizes, PAGE, "left").withColumn("crop", F.array(F.greatest(zero, x0 - SIDE), F.greatest(zero, y0 - up), F.least(F.col("_width"), x1 + SIDE), y1))
    crop = [F.col("crop")[i] for i in range(4)]
    w, h, tall = crop[2] - crop[0], crop[3] - crop[1], F.greatest(y1 - y0, F.lit(1.0))
    whole = lambda c: F.format_string("%.0f", F.bround(c, 0))
    early = choose(
        (~geo.valid(F.col("box")), "no_caption_bbox"), (F.coalesce("_height", zero) <= 0, "unknown_page_height"), (F.coalesce("_width", zero) <= 0, "unknown_page_width"),
        ((w < WIDTH) | (h < HEIGHT), F.concat(F.lit("degenerate_box(w="), whole(w), F.lit(",h="), whole(h), F.lit(")"))), (h < tall * CAPTIONS, F.concat(F.lit("not_larger_than_caption(ratio="), F.format_string("%.1f", h / tall), F.lit(")"))),
    )
    of = of.withColumn("_early", early).withColumn("_top", y0)
    across = lambda x: F.floor(x * ACROSS / F.col("_width")).cast("int")
    band = lambda y: F.floor(y / HIGH).cast("int")
    open_ = of.where("_early is null").withColumn("_x", F.explode(F.sequence(across(crop[0] - 10), across(crop[2] + 10))))
    open_ = open_.withColumn("_y", F.explode(F.sequence(band(crop[1] - 2), band(F.col("_top") + 2)))).select("caption_id", *PAGE, "_x", "_y", "crop", "_top", "first_span", "n_spans")
    long = boxed.where(F.length(tx.clean(F.col("text"))) > LONG).join(sizes.where("_width > 0"), PAGE)
    long = long.select(*PAGE, across(x0).alias("_x"), band(y0).alias("_y"), "span_index", F.col("box").alias("_box"))
    inside = (F.col("_box")[1] >= crop[1] - 2) & (F.col("_box")[3] <= F.col("_top") + 2) & (F.col("_box")[0] >= crop[0] - 10) & (F.col("_box")[2] <= crop[2] + 10)
    own = F.col("span_index").between(F.col("first_span"), F.col("first_span") + F.col("n_spans") - 1)
    found = open_.join(long, [*PAGE, "_x", "_y"]).where(inside & ~F.coalesce(own, F.lit(False))).groupBy("caption_id").agg(F.count(F.lit(1)).alias("_long"))
    prose = F.when(F.col("_long") >= PROSE, F.concat(F.lit("prose_dense(long_lines="), F.col("_long").cast("string"), F.lit(")")))
    reason = F.coalesce("_early", prose, F.lit("ok"))
    return of.join(found, "caption_id", "left").select("caption_id", F.when(reason == "ok", F.col("crop")).alias("crop"), reason.alias("reason"))


def caption_checks(captions: DataFrame, lines: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """caption_id, valid and reason of captions: two signals or more against one reject it.

    captions: caption_id, paper_id, page_num, kind, label, number, section, text, first_span and n_spans; lines: paper_id,
    page_num, span_index and text. Signals: no text behind the label, a section before the paper begins, code around it, a number
    that is ten times the largest of `references` (columns as captions; without it of the captions themselves, which none can be).
    """
    text, label = tx.clean(F.coalesce("text", F.lit(""))), tx.clean(F.coalesce("label", F.lit("")))
    after = F.regexp_replace(F.substr(text, F.length(label) + 1), r"^[:. ]+", "")
    body = F.when((label != "") & F.startswith(F.lower(text), F.lower(label)), F.trim(after)).otherwise(text)
    bare = F.length(body) < 5
    early = tx.clean(F.coalesce("section", F.lit(""))).rlike(EARLY)
    low, high = F.col("first_span") - BEFORE, F.col("first_span") + F.col("n_spans") - 1 + AFTER
    near = captions.select("caption_id", *PAGE, low.alias("_low"), high.alias("_high"), F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND))).alias("_band"))
    spans = lines.select(*PAGE, "span_index", F.floor(F.col("span_index") / BAND).alias("_band"), tx.clean(F.coalesce("text", F.lit(""))).alias("_text"))
    around = near.join(spans, [*PAGE, "_band"]).where(F.col("span_index").between(F.col("_low"), F.col("_high")))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("span_index", "_text")))["_text"], " ")  # 26 lines and the caption's own
    code = around.groupBy("caption_id").agg(F.regexp_count(joined, F.lit(CODE)).alias("_code"))
    known = (captions if references is None else references).where("number is not null").groupBy("paper_id", "kind").agg(F.count(F.lit(1)).alias("_numbers"), F.max("number").alias("_largest"))
    extreme = (F.col("_numbers") >= 3) & (F.col("number") > F.col("_largest") * 10) & (F.col("number") > 20)
    signals = F.filter(F.array(
        F.when(bare, "bare_caption"), F.when(early, "suspicious_section"), F.when(F.col("_code") >= 2, F.concat(F.lit("code_sql_context ("), F.col("_code").cast("string"), F.lit(" tokens)"))),
        F.when(extreme, F.concat(F.lit("extreme_number ("), F.col("number").cast("string"), F.lit(", max_normal="), F.col("_largest").cast("string"), F.lit(")"))),
    ), lambda s: s.isNotNull())
    rows = captions.join(code, "caption_id", "left").join(known, ["paper_id", "kind"], "left").withColumn("_signals", signals)
    valid = F.size("_signals") < 2
    return rows.select("caption_id", valid.alias("valid"), F.when(~valid, F.array_join("_signals", "; ")).alias("reason"))
