"""Where a quote comes from, captions, and tables matched by label or caption; only the first needs a little Python, in batches."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import evidence as ev
from lectern.functions import text as tx

#: Limits of a caption's lines, characters in all and in a line, gap in line heights, shift to the side, jump in
#: line numbers, and how much further right a paragraph may reach.
LINES, CHARS, LINE_CHARS, GAP, SHIFT, JUMP, WIDER = 4, 500, 260, 1.8, 24.0, 2, 80.0


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)


def bound(a: Column, b: Column) -> Column:
    """What similarity can't exceed: matching blocks can't be longer than the shorter text."""
    x, y = F.length(tx.normalized(a)), F.length(tx.normalized(b))
    return 0.7 * 2 * F.least(x, y) / F.greatest(x + y, F.lit(1)) + 0.3 * tx.jaccard(tx.normalized(a), tx.normalized(b))


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """0.7 of the share of matching blocks plus 0.3 of the shared words, of normalised texts; 0 if one is empty.

    Blocks are only looked for where the bound reaches least; below that, the result is smaller than least as well.
    """
    x, y = tx.normalized(a), tx.normalized(b)
    ratio = F.pandas_udf(_ratio, "double")(F.when(bound(a, b) >= least, x), y)
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(0.7 * ratio + 0.3 * tx.jaccard(x, y))


def quote_spans(rows: DataFrame, keys: list[str], top: int = 3, least: float = 0.25) -> DataFrame:
    """rows with `score` and `chosen`: the spans that a quote matches best, and one neighbour of each that matches nearly as well.

    rows: the keys of a quote, page, position, quote and text of each of its candidate spans.
    """
    scored = rows.withColumn("score", F.round(similarity(F.col("quote"), F.col("text"), 0.75 * least), 6))
    by_score = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "page", "position")
    near = Window.partitionBy(*keys).orderBy("page", "position")
    best = scored.withColumn("best", (F.row_number().over(by_score) <= top) & (F.col("score") >= least))
    fits = lambda step: (F.lead("page", step).over(near) == F.col("page")) & (F.lead("score", step).over(near) >= 0.75 * least) & ~F.lead("best", step).over(near)
    best = best.withColumn("takes", F.when(F.col("best") & fits(1), 1).when(F.col("best") & fits(-1), -1))
    taken = (F.lag("takes", 1).over(near) == 1) | (F.lead("takes", 1).over(near) == -1)
    return best.withColumn("chosen", F.col("best") | F.coalesce(taken, F.lit(False))).drop("takes", "best")


def _continues(at: Column, first: Column, line: Column) -> Column:
    """May the line go on with a caption (its lines so far: n, chars, last) that began with the first? Each reason to stop in turn."""
    last, text = at["last"], line["clean"]
    fits = (text != "") & line["kind"].isNull() & ~line["is_heading"] & (F.length(text) <= LINE_CHARS) & (at["n"] < LINES) & (at["chars"] + F.length(text) <= CHARS)
    section = lambda x: F.coalesce(x["section"], F.lit(""))
    same = (section(last) == "") | (section(line) == "") | (section(last) == section(line))
    near = (line["span_index"] - last["span_index"] <= JUMP) & (F.abs(line["box"][0] - first["box"][0]) <= SHIFT)
    below = F.greatest(F.lit(0.0), line["box"][1] - last["box"][3]) <= GAP * F.greatest(last["box"][3] - last["box"][1], F.lit(1.0))
    opens = line["opens"] & ((at["n"] >= 3) | (line["box"][2] - last["box"][2] > WIDER))
    return F.coalesce(fits & same & near & below & ~opens, F.lit(False))


def captions(spans: DataFrame) -> DataFrame:
    """Captions of positioned lines (paper_id, page_num, span_index, section, text, box): paper_id, page_num, kind, label, number,
    first_span, n_spans, text and box.

    Each line that begins as a caption opens one, whatever was before, and it takes a few lines at most: so it needs those that
    follow on its page, and no page is collected.
    """
    clean = tx.clean(F.col("text"))
    rows = spans.select("paper_id", "page_num", "span_index", "section", "box", clean.alias("clean"))
    rows = rows.withColumn("_prefix", tx.caption_prefix(F.col("clean"))).withColumns({"kind": F.col("_prefix")["kind"], "is_heading": ev.caption_heading(F.col("clean")), "opens": ev.paragraph_start(F.col("clean"))})
    rows = rows.withColumn("_line", F.struct("span_index", "section", "clean", "box", "kind", "is_heading", "opens"))
    page = Window.partitionBy("paper_id", "page_num").orderBy("span_index")
    heads = rows.select("paper_id", "page_num", "_prefix", F.col("_line").alias("_first"), F.array(*(F.lead("_line", i).over(page) for i in range(1, LINES))).alias("_next")).where("_first.kind is not null")
    first = F.col("_first")

    def step(at: Column, line: Column) -> Column:
        goes = ~at["stopped"] & _continues(at, first, line)
        return F.struct((at["n"] + goes.cast("int")).alias("n"), (at["chars"] + F.when(goes, F.length(line["clean"])).otherwise(0)).alias("chars"), F.when(goes, line).otherwise(at["last"]).alias("last"), (~goes).alias("stopped"))

    start = F.struct(F.lit(1).alias("n"), F.length(first["clean"]).alias("chars"), first.alias("last"), F.lit(False).alias("stopped"))
    found = heads.withColumn("n_spans", F.aggregate("_next", start, step)["n"])
    found = found.withColumn("_own", F.slice(F.concat(F.array("_first"), F.col("_next")), F.lit(1), F.col("n_spans")))
    edge = lambda i, best: best(F.transform(F.col("_own")["box"], lambda b: b[i]))
    box = F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))
    of = F.col("_prefix")
    return found.select("paper_id", "page_num", of["kind"].alias("kind"), of["label"].alias("label"), of["number"].alias("number"), first["span_index"].alias("first_span"), "n_spans", F.array_join(F.col("_own")["clean"], " ").alias("text"), box.alias("box"))


def best_captions(found: DataFrame) -> DataFrame:
    """Of several captions of one object the longest, the first on ties."""
    w = Window.partitionBy("paper_id", "kind", "label").orderBy(F.length("text").desc(), "page_num", "first_span")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: How many words captions share at least, and what a match is called.
SHARED_WORDS = 4
MODES = ("exact_label_page", "label_page", "caption_page", "page_only")


def _words(caption: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.trim(F.coalesce(caption, F.lit("")))), F.lit(r"(?U)\w+"), F.lit(0)))


def caption_overlaps(left: DataFrame, right: DataFrame, page: Sequence[str], one: str, other: str, least: int = SHARED_WORDS) -> DataFrame:
    """one, other and shared: all pairs on a page whose captions share so many words or more.

    An inverted index over prefixes: with words in one order, the rarest of a page first, captions that share `least` words share
    one before the last least - 1 of each. Only such pairs meet, and their words are compared then.
    """
    words = lambda df, key: df.select(*page, key, F.explode(_words(F.col("caption"))).alias("word"))
    theirs = words(right, other)
    often = theirs.groupBy(*page, "word").agg(F.count(F.lit(1)).alias("often"))

    def sets(rows: DataFrame, key: str) -> DataFrame:
        """Each caption's words that the page's index has, in its order."""
        known = rows.join(often, [*page, "word"]).groupBy(*page, key).agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("words"))
        return known.select(*page, key, F.col("words")["word"].alias("words")).where(F.size("words") >= least)

    a, b = sets(words(left, one), one), sets(theirs, other)
    prefix = lambda df, key: df.select(*page, key, F.explode(F.slice("words", F.lit(1), F.size("words") - (least - 1))).alias("word"))
    pairs = prefix(a, one).join(prefix(b, other), [*page, "word"]).select(*page, one, other).distinct()
    both = pairs.join(a.withColumnRenamed("words", "_a"), [*page, one]).join(b.withColumnRenamed("words", "_b"), [*page, other])
    return both.select(one, other, F.size(F.array_intersect("_a", "_b")).alias("shared")).where(F.col("shared") >= least)


def table_matches(wanted: DataFrame, tables: DataFrame, page: Sequence[str]) -> DataFrame:
    """object_id, table_id and mode: for each wanted table the one recognised on its page, or nulls.

    wanted: object_id, page, label and caption; tables: table_id, page, place (their order there), label and caption. By the whole
    label, by the label without its end, by the caption that shares most words, or because it is the page's only one; of equals the
    first. Null labels and captions match nothing.
    """
    bare = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    norm = lambda c: F.regexp_replace(bare(c), r"[:\.\s]+$", "")
    first = F.min_by("table_id", F.struct("place", "table_id"))
    out = wanted
    for i, by in enumerate((bare, norm)):
        index = tables.withColumn(f"_k{i}", by(F.col("label"))).where(F.col(f"_k{i}") != "").groupBy(*page, f"_k{i}").agg(first.alias(f"_m{i}"))
        out = out.withColumn(f"_k{i}", by(F.col("label"))).join(index, [*page, f"_k{i}"], "left")
    near = caption_overlaps(out.where("_m0 is null and _m1 is null").select(*page, "object_id", "caption"), tables, page, "object_id", "table_id")
    best = near.join(tables.select("table_id", "place"), "table_id").groupBy("object_id").agg(F.min_by("table_id", F.struct(-F.col("shared"), "place", "table_id")).alias("_m2"))
    only = tables.groupBy(*page).agg(F.count(F.lit(1)).alias("_n"), first.alias("_m3")).where("_n = 1").drop("_n")
    out = out.join(best, "object_id", "left").join(only, list(page), "left")
    mode = F.coalesce(*[F.when(F.col(f"_m{i}").isNotNull(), m) for i, m in enumerate(MODES)])
    return out.select("object_id", F.coalesce(*[F.col(f"_m{i}") for i in range(4)]).alias("table_id"), mode.alias("mode"))


def topk_enrichment(retrieved: DataFrame, objects: DataFrame, tables: DataFrame, page: Sequence[str], k: int) -> DataFrame:
    """object_id, outcome, table_id and mode of the tables that any claim has among its first k.

    retrieved: claim_id, object_id and rank; objects: object_id, kind, page, label, caption and enriched. What is enriched already
    is skipped, what finds no table has failed; only the rest changes, so that a second run over the result does nothing anew.
    """
    asked = retrieved.where((F.col("rank") <= k) & F.col("object_id").isNotNull()).select("object_id").distinct()
    due = objects.where("kind = 'table'").join(asked, "object_id", "left_semi").withColumn("enriched", F.coalesce("enriched", F.lit(False)))
    found = table_matches(due.where("not enriched"), tables, page)
    new = found.withColumn("outcome", F.when(F.col("table_id").isNull(), "no_match").otherwise("enriched"))
    done = due.where("enriched").select("object_id", F.lit(None).cast(tables.schema["table_id"].dataType).alias("table_id"), F.lit(None).cast("string").alias("mode"), F.lit("skipped_already").alias("outcome"))
    return new.unionByName(done)
