"""Lines on pages: regions that grow from a caption, and chunks of lines within segments.

Lines: paper_id, page_num, span_index (unique within a paper, in reading order), section, text and box (x0, y0, x1, y1, or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as geo
from lectern.functions.text import clean
from lectern.sources.shared import ROWS, written

#: The lines that a table or a figure may take, gaps in heights of the caption (of a table, of a figure, of the one
#: line below either), the least such height, and how far to the side of its caption a figure's line may lie.
TABLE_LINES, FIGURE_LINES, TABLE_GAP, FIGURE_GAP, BELOW_GAP, LEAST_HEIGHT, ASIDE = 40, 28, 6.5, 6.0, 2.0, 18.0, 220
#: How captions, numbered headings and paragraphs after a table, above a figure and above a figure with its caption begin.
CAPTION_LIKE = r"^(table|tab\.?|figure|fig\.?)\s*\d+"
NUMBERED = r"^\d+(?:\.\d+)*\s+[A-Z]"
AFTER_TABLE = r"^(For each domain,|For each prompt,|We construct|We evaluate|In this section,|In our experiments,|To this end,|Recent efforts|Finally,|The following sections)\b"
ABOVE_FIGURE = r"^(For each|We construct|We evaluate|In this section|In our experiments|To this end|Recent efforts|Finally,|The following)\b"
ABOVE_CAPTIONED = r"^(For each|We construct|We evaluate|In this section|In our experiments|To this end|Recent efforts|Finally,|The following|To examine|We analyze|Figure \d+ demonstrates)\b"
#: Lines in a block, by which captions and lines meet; a region reaches over three at most.
BLOCK = 40


def caption_like(text: Column) -> Column:
    """Whether a line begins as a caption; most are told by their first letters."""
    return text.rlike(r"^(?i:tab|fig)") & F.lower(text).rlike(CAPTION_LIKE)


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with `rank`: how many lines with a box their page has up to and with them; and what makes a region stop there. Marks are
    made of the texts once, before lines meet, and written; what follows reads no text."""
    text = clean(F.col("text"))
    rows = lines.select("paper_id", "page_num", "span_index", clean(F.col("section")).alias("section"), "box", text.alias("text"))
    marks = {"caption": caption_like(F.col("text")), "numbered": F.col("text").rlike(NUMBERED), "after_table": F.col("text").rlike(AFTER_TABLE), "above_figure": F.col("text").rlike(ABOVE_FIGURE), "above_captioned": F.col("text").rlike(ABOVE_CAPTIONED)}
    page = Window.partitionBy("paper_id", "page_num").orderBy("span_index").rowsBetween(Window.unboundedPreceding, 0)
    return written(rows.withColumns(marks).drop("text").withColumn("rank", F.sum(geo.valid(F.col("box")).cast("int")).over(page)))


def _seeds(lines: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions with where their lines begin and end among their page's, and the box of these."""
    own = captions.select("paper_id", "caption_id", F.col("page_num").alias("of_page"), F.posexplode("spans").alias("nth", "span_index"))
    own = own.join(lines.select("paper_id", "page_num", "span_index", "box", "rank"), ["paper_id", "span_index"])
    there = F.col("page_num") == F.col("of_page")
    side = lambda i: F.coalesce(F.when(geo.valid(F.col("box")), F.col("box")[i]), F.lit(0.0))
    found = own.groupBy("paper_id", "caption_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "span_index"))).alias("found"), geo.union(F.col("box")).alias("seed"), F.min(F.when(there, F.col("rank") - geo.valid(F.col("box")).cast("int"))).alias("before"), F.max(F.when(there, F.col("rank"))).alias("upto"),
        F.max(side(3)).alias("bottom"), F.min(side(1)).alias("top"), F.min(side(0)).alias("left"), F.max(side(2)).alias("right"),
    )
    return captions.join(found, ["paper_id", "caption_id"], "left")


def _grown(lines: Column, start: Column, gap_of: Column, edges: tuple[int, int], stop, most: int, up: bool) -> Column:
    """How many of the lines a region takes one after the other: until one stops it, or lies further than the gap from all taken."""
    far, near = edges  # the side of a line that its distance counts from, and the side that the region then reaches to
    first = F.struct(start.cast("double").alias("edge"), F.lit(0).alias("n"), F.lit(False).alias("stopped"))

    def step(at: Column, line: Column) -> Column:
        distance = at["edge"] - line["box"][far] if up else line["box"][far] - at["edge"]
        stopped = at["stopped"] | (at["n"] >= most) | stop(line) | (F.greatest(distance, F.lit(0.0)) > gap_of)
        reach = F.least(at["edge"], line["box"][near]) if up else F.greatest(at["edge"], line["box"][near])
        return F.struct(F.when(stopped, at["edge"]).otherwise(reach).alias("edge"), (at["n"] + F.when(stopped, 0).otherwise(1)).alias("n"), stopped.alias("stopped"))

    return F.aggregate(lines, first, step)["n"]


def regions(lines: DataFrame, captions: DataFrame, with_captions: bool = False) -> DataFrame:
    """captions with object_spans and object_box: the lines that their table or figure takes, in reading order, and the box around.

    captions: paper_id, caption_id (unique within a paper), page_num, kind, section, spans (array of span_index) and box. A table
    grows downward from its caption, a figure upward; each line is measured from the edge that the lines before have reached.
    Growth ends at another section, a gap, another caption, or a paragraph that begins as prose; one line below the caption may
    follow. with_captions: every caption is a figure's, which also ends at numbered headings and at what lies aside, and takes no
    line below. A caption without lines on its page, or whose region has no more lines than it, stays as it is.

    No page is collected: captions meet the blocks of lines that they can reach, so that a caption holds 120 lines at most.
    """
    lines, captions = _placed(lines), written(captions)
    seeds = _seeds(lines, captions)
    height = F.greatest(F.coalesce(F.when(geo.valid(F.coalesce("seed", "box")), F.coalesce("seed", "box")[3] - F.coalesce("seed", "box")[1]), F.lit(0.0)), F.lit(LEAST_HEIGHT))
    down = (F.col("kind") == "table") if not with_captions else F.lit(False)
    first, last = F.when(down, F.col("upto") + 1).otherwise(F.col("before") - FIGURE_LINES + 1), F.when(down, F.col("upto") + TABLE_LINES).otherwise(F.col("upto") + 1)
    seeds = seeds.withColumns({"height": height, "down": down, "first": F.greatest(first, F.lit(1)), "last": last, "of": clean(F.col("section"))})
    seeds = written(seeds)
    reach = seeds.where("upto is not null").select("paper_id", "caption_id", "page_num", "first", "last", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}"))).alias("block"))
    boxed = lines.where(geo.valid(F.col("box"))).withColumn("block", F.expr(f"rank div {BLOCK}")).withColumnRenamed("section", "line_section")
    near = reach.join(boxed, ["paper_id", "page_num", "block"]).where("rank between first and last")
    line = F.struct("rank", "span_index", "box", F.col("line_section").alias("section"), "caption", "numbered", "after_table", "above_figure", "above_captioned")
    near = near.groupBy("paper_id", "caption_id").agg(F.array_sort(F.collect_list(line)).alias("near"))
    rows = seeds.join(near, ["paper_id", "caption_id"], "left")
    none = F.filter("near", lambda x: F.lit(False))
    below = F.coalesce(F.filter("near", lambda x: x["rank"] > F.col("upto")), none)
    above = F.reverse(F.coalesce(F.filter("near", lambda x: x["rank"] <= F.col("before")), none))
    rows = rows.withColumns({"below": below, "above": above})
    elsewhere = lambda x: (F.col("of") != "") & (x["section"] != "") & (x["section"] != F.col("of"))
    if with_captions:
        aside = lambda x: (x["box"][2] < F.col("left") - ASIDE) | (x["box"][0] > F.col("right") + ASIDE)
        n_up = _grown(F.col("above"), F.col("top"), F.col("height") * FIGURE_GAP, (3, 1), lambda x: elsewhere(x) | x["caption"] | x["numbered"] | x["above_captioned"] | aside(x), FIGURE_LINES, up=True)
        n_down, one = F.lit(0), F.lit(0)
    else:
        n_down = F.when(F.col("down"), _grown(F.col("below"), F.col("bottom"), F.col("height") * TABLE_GAP, (1, 3), lambda x: elsewhere(x) | x["caption"] | x["after_table"], TABLE_LINES, up=False)).otherwise(0)
        n_up = F.when(F.col("down"), 0).otherwise(_grown(F.col("above"), F.col("top"), F.col("height") * FIGURE_GAP, (3, 1), lambda x: elsewhere(x) | x["caption"] | x["above_figure"], FIGURE_LINES, up=True))
        next_line = F.get("below", F.lit(0))
        one = F.when(next_line.isNotNull() & ~elsewhere(next_line) & ~next_line["caption"] & ~next_line["numbered"] & (next_line["box"][1] - F.col("bottom") <= F.col("height") * BELOW_GAP), 1).otherwise(0)
    rows = rows.withColumns({"n_up": F.coalesce(n_up, F.lit(0)), "n_down": F.greatest(F.coalesce(n_down, F.lit(0)), F.coalesce(one, F.lit(0)))})
    taken_up, taken_down = F.reverse(F.slice("above", F.lit(1), F.col("n_up"))), F.slice("below", F.lit(1), F.col("n_down"))
    own = F.transform("found", lambda x: x["span_index"])
    rows = rows.withColumn("object_spans", F.array_distinct(F.concat(F.coalesce(F.transform(taken_up, lambda x: x["span_index"]), F.array().cast("array<int>")), own, F.coalesce(F.transform(taken_down, lambda x: x["span_index"]), F.array().cast("array<int>")))))
    boxes = F.concat(F.coalesce(F.transform(taken_up, lambda x: x["box"]), F.array().cast("array<array<double>>")), F.filter(F.array("seed"), lambda b: b.isNotNull()), F.coalesce(F.transform(taken_down, lambda x: x["box"]), F.array().cast("array<array<double>>")))
    edge = lambda i, best: best(F.transform(boxes, lambda b: b[i]))
    around = F.when(F.size(boxes) > 0, F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)))
    grew = F.coalesce(F.col("upto").isNotNull() & (F.size("object_spans") > F.size("spans")), F.lit(False))
    return rows.select(*captions.columns, F.when(grew, F.col("object_spans")).otherwise(F.col("spans")).alias("object_spans"), F.when(grew, F.coalesce(around, "box")).otherwise(F.col("box")).alias("object_box"))


#: Pages of a paper that one task orders and numbers.
PAGES = 256
#: Lines of a chunk and how many it shares with the one before, its least characters, the band at a page's head and
#: foot that holds no text, the gap in line heights that ends a segment, a heading's most characters and how none ends.
CHUNK, SHARED, LEAST_CHARS, BAND, GAP, HEADING_CHARS = 8, 2, 40, 0.06, 1.8, 120
HEADING = r"^(?:[A-Z]\d*\.)?(?:\d+\.)*\d+\s+[A-Z]|^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"
SENTENCE_END = r"[.?!,;:]$"


def _stripped(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\f\r"))  # what \s names


def looks_like_heading(text: Column) -> Column:
    return (F.length(text) <= HEADING_CHARS) & (text != "") & ~text.rlike(SENTENCE_END) & text.rlike(HEADING)


def layout_hints(objects: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a layout model adds: lines of figures and tables (objects: paper_id, spans), and headings (sections: paper_id, heading)
    in lower case, each once."""
    spans = objects.select("paper_id", F.explode("spans").alias("span_index")).distinct()
    headings = sections.select("paper_id", F.lower(_stripped(F.col("heading"))).alias("heading")).where("heading <> ''").distinct()
    return spans, headings


def _part() -> Column:
    return F.expr(f"page_num div {PAGES}").alias("part")


def text_lines(lines: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Lines with text that lie in no band at their page's head or foot; the page's height is its lowest box's lower edge. `part`
    is the run of pages that a line lies in; lines are dealt and ordered by it once. hints lie among the lines, each before its own,
    as a join would shuffle the texts by other keys."""
    rows = lines.select("paper_id", "page_num", _part(), "span_index", F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("unknown")).alias("section"), _stripped(F.col("text")).alias("text"), "box").where("text <> '' and paper_id is not null and page_num is not null")
    rows = rows.withColumn("kind", F.lit(1))
    if hints is not None:
        rows = rows.unionByName(hints.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    else:
        rows = rows.withColumns({"is_object": F.lit(False), "headings": F.lit(None).cast("array<string>")})
    page = Window.partitionBy("paper_id", "part", "page_num").orderBy("span_index", "kind")
    top = F.max(F.when(geo.valid(F.col("box")), F.col("box")[3])).over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.lag(F.struct("kind", "span_index", "is_object", "headings")).over(page)
    rows = rows.repartition(_parts(lines), "paper_id", "part").withColumns({"page_height": F.greatest(F.coalesce(top, F.lit(0.0)), F.lit(0.0)), "before": before}).where("kind = 1")
    hint = F.when((F.col("before.kind") == 0) & (F.col("before.span_index") == F.col("span_index")), F.col("before"))
    rows = rows.withColumns({"is_object": F.coalesce(hint["is_object"], F.lit(False)), "hinted": F.coalesce(F.array_contains(hint["headings"], F.lower("text")), F.lit(False))})
    band = geo.valid(F.col("box")) & (F.col("page_height") > 0) & ((F.col("box")[3] <= BAND * F.col("page_height")) | (F.col("box")[1] >= F.col("page_height") - BAND * F.col("page_height")))
    return rows.where(~F.coalesce(band, F.lit(False))).drop("page_height", "before", "kind", "headings")


def _parts(lines: DataFrame) -> int:
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // ROWS))


def _hinted(lines: DataFrame, object_spans: DataFrame | None, headings: DataFrame | None) -> DataFrame | None:
    """paper_id, part, page_num, span_index of the lines that hints may name: is_object, and the headings to compare them with. Lines
    meet headings by a hash of their text, so that no text is shuffled."""
    at, found = ["paper_id", "page_num", "span_index"], []
    if object_spans is not None:
        found.append(lines.select(*at).join(object_spans, ["paper_id", "span_index"]).select(*at, F.lit(True).alias("is_object"), F.lit(None).cast("string").alias("heading")))
    if headings is not None:
        low = F.lower(_stripped(F.col("text")))
        found.append(lines.select(*at, F.xxhash64(low).alias("h")).join(headings.select("paper_id", "heading", F.xxhash64("heading").alias("h")), ["paper_id", "h"]).select(*at, F.lit(False).alias("is_object"), "heading"))
    if not found:
        return None
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.withColumn("part", _part()).groupBy("paper_id", "part", "page_num", "span_index").agg(F.max("is_object").alias("is_object"), F.collect_set("heading").alias("headings"))


def segmented(rows: DataFrame) -> DataFrame:
    """Lines of text_lines with `segment` (numbered within their page) and `nth` (their place in it, from 0).

    A segment ends with its page, its section, before a heading (a hint's, or one that looks like it), at a wide gap, and at lines
    of a figure or table, which belong to none.
    """
    page = Window.partitionBy("paper_id", "part", "page_num").orderBy("span_index")
    box, last = F.col("box"), F.lag("box").over(page)
    tallest = F.greatest(box[3] - box[1], last[3] - last[1], F.lit(0.0))
    wide = F.coalesce(geo.valid(box) & geo.valid(last) & (tallest > 0) & (box[1] - last[3] > F.greatest(GAP * tallest, F.lit(0.0))), F.lit(False))
    other = F.trim(F.lag("section").over(page)) != F.trim("section")
    starts = F.coalesce(F.lag("is_object").over(page), F.lit(True)) | F.coalesce(other, F.lit(True)) | F.col("hinted") | looks_like_heading(F.col("text")) | wide
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("starts", starts).where("not is_object").withColumns({"segment": F.sum(F.col("starts").cast("int")).over(upto), "at": F.row_number().over(page)})
    first = F.last(F.when(F.col("starts"), F.col("at")), ignorenulls=True).over(upto)
    return rows.withColumn("nth", F.col("at") - first).drop("starts", "is_object", "hinted", "at")


def line_chunks(lines: DataFrame, object_spans: DataFrame | None = None, headings: DataFrame | None = None, size: int = CHUNK, overlap: int = SHARED, least: int = LEAST_CHARS) -> DataFrame:
    """Chunks of `size` lines within segments, each `overlap` lines into the next: paper_id, chunk_index, chunk_id, section (most
    lines', the first of ties), page, page_start, page_end, text, char_start, char_end and span_ids.

    Short chunks are dropped before the others are numbered. Texts are shuffled once, by paper and run of `PAGES` pages; chunks are
    numbered within a run, and only where a paper has several runs are their chunks written and counted, so a long paper isn't one task.
    lines are read several times and should be written.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive, and overlap at least 0 and below size")
    step, page = size - overlap, Window.partitionBy("paper_id", "part", "page_num").orderBy("span_index")
    rows = segmented(text_lines(lines, _hinted(lines, object_spans, headings)))
    line = F.struct("segment", "span_index", "section", "text")
    own = [F.lead(line, i).over(page) for i in range(1, size)]  # the lines that follow on the page: no line is sent to several chunks, and none sorted again
    rows = rows.select("paper_id", "part", "page_num", "span_index", "nth", line.alias("l0"), *[c.alias(f"l{i + 1}") for i, c in enumerate(own)]).where(F.col("nth") % step == 0)
    of = [F.col("l0"), *[F.when(F.col(f"l{i}")["segment"] == F.col("l0")["segment"], F.col(f"l{i}")) for i in range(1, size)]]
    rows = rows.select("paper_id", "part", "page_num", "span_index", "nth", F.array_compact(F.array(*of)).alias("own"))
    rows = rows.select("paper_id", "part", "page_num", "span_index", "nth", "own", F.col("own")["span_index"].alias("span_ids"), F.array_join(F.col("own")["text"], "\n").alias("text"), F.array_distinct(F.col("own")["section"]).alias("sections"))
    # Lines that all lie in the window before make none: that one reached the end.
    chunks = rows.where(((F.col("nth") == 0) | (F.size("own") > overlap)) & (F.length("text") >= least))
    most = F.array_max(F.transform("own", lambda x, i: F.struct(F.size(F.filter("own", lambda y: y["section"] == x["section"])).alias("n"), (-i).alias("at"), x["section"].alias("section"))))["section"]
    section = F.when(F.size("sections") == 1, F.col("sections")[0]).otherwise(most)
    index = F.row_number().over(Window.partitionBy("paper_id", "part").orderBy("page_num", "span_index")) - 1
    chunks = chunks.select("paper_id", "part", "page_num", "span_index", section.alias("section"), "text", "span_ids")
    chunks = chunks.withColumn("index", index)
    if not lines.where(f"page_num div {PAGES} <> 0").isEmpty():
        chunks = written(chunks)
        counts = chunks.groupBy("paper_id", "part").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("paper_id").orderBy("part")) - F.col("n")
        chunks = chunks.join(counts.select("paper_id", "part", before.cast("int").alias("before")), ["paper_id", "part"]).withColumn("index", F.col("index") + F.col("before"))
    index = F.col("index")
    return chunks.select("paper_id", index.alias("chunk_index"), F.concat(F.col("paper_id").cast("string"), F.lit("_chunk_"), index).alias("chunk_id"), "section", F.col("page_num").alias("page"), F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"), "text", F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "span_ids")
