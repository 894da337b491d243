"""Regions and chunks of lines on pages, against loops that follow the rules one line after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.plans import layout as plans

from oracle import SF

LINES = "paper_id string, page_num int, span_index int, section string, text string, box array<double>"
CAPTIONS = "paper_id string, caption_id int, page_num int, kind string, section string, spans array<int>, box array<double>"
TEXTS = ["Table 1: of all", "Figure 2. shows", "fig. 3 here", "We evaluate all", "To examine it", "3.1 Setup", "plain words of a line", "12 34 56", "", "For each run", "Tab 4", "a longer line of prose that goes on and on"]


def pages(n, seed, most=60):
    """Papers of a few pages with lines that go down the page, some without a box, aside, or far below."""
    r, out, caps = random.Random(seed), [], []
    for p in range(n):
        i = 0
        for page in range(1, r.randrange(2, 4)):
            y, section = 30.0, "A"
            for _ in range(r.randrange(1, most)):
                y += r.choice([2.0, 12.0, 12.0, 12.0, 40.0, 130.0])
                section = r.choice([section] * 15 + ["B", "", None, " A "])
                x = r.choice([50.0, 50.0, 50.0, 380.0])
                box = None if r.random() < 0.1 else [x, y, x + r.randrange(10, 200), y + r.choice([8.0, 10.0, 30.0])]
                out.append((f"p{p}", page, i, section, r.choice(TEXTS[6:] if r.random() < 0.75 else TEXTS), box))
                i += r.choice([1, 1, 1, 2])
        own = [x for x in out if x[0] == f"p{p}"]
        for c, x in enumerate(own):
            if re.match(layout.CAPTION_LIKE, (x[4] or "").lower()):
                k = own.index(x)
                spans = [y[2] for y in own[k : k + r.randrange(1, 4)]]
                caps.append((f"p{p}", c, x[1], r.choice(["table", "figure"]), x[3], spans, x[5]))
        caps.append((f"p{p}", 999, 1, "table", None, [10**6], [1.0, 2.0, 3.0, 4.0]))  # lines that aren't there
    return out, caps


def clean(t):
    return " ".join((t or "").split())


def grown(lines, cap, captioned):
    """The rules, one line after the other."""
    paper, _, page, kind, section, spans, box = cap
    by_id = {x[2]: x for x in lines if x[0] == paper}
    own = [by_id[s] for s in spans if s in by_id]
    here = sorted((x for x in by_id.values() if x[1] == page), key=lambda x: x[2])
    at = [i for i, x in enumerate(here) if x in own]
    if not at:
        return spans, box
    boxes = [x[5] for x in own if x[5]]
    union = lambda bs: [min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs)] if bs else None
    seed = union(boxes) or box
    height = max(seed[3] - seed[1] if seed else 0.0, 18.0)
    side = lambda x, i: x[5][i] if x[5] else 0.0
    left, right = min(side(x, 0) for x in own), max(side(x, 2) for x in own)
    section = clean(section)
    elsewhere = lambda x: bool(section and clean(x[3]) and clean(x[3]) != section)
    caption = lambda x: bool(re.match(layout.CAPTION_LIKE, clean(x[4]).lower()))
    numbered = lambda x: bool(re.match(layout.NUMBERED, clean(x[4])))
    up, down = [], []
    if kind == "table" and not captioned:
        edge = max(side(x, 3) for x in own)
        for x in here[max(at) + 1 :]:
            if len(down) >= 40:
                break
            if not x[5]:
                continue
            if elsewhere(x) or max(0.0, x[5][1] - edge) > 6.5 * height or re.match(layout.AFTER_TABLE, clean(x[4])) or caption(x):
                break
            down.append(x)
            edge = max(edge, x[5][3])
    else:
        edge = min(side(x, 1) for x in own)
        for x in reversed(here[: min(at)]):
            if len(up) >= 28:
                break
            if not x[5]:
                continue
            prose = layout.ABOVE_CAPTIONED if captioned else layout.ABOVE_FIGURE
            if elsewhere(x) or max(0.0, edge - x[5][3]) > 6.0 * height or re.match(prose, clean(x[4])) or caption(x):
                break
            if captioned and (numbered(x) or x[5][2] < left - 220 or x[5][0] > right + 220):
                break
            up.insert(0, x)
            edge = min(edge, x[5][1])
    if not captioned:
        for x in here[max(at) + 1 :]:
            if not x[5]:
                continue
            if not (elsewhere(x) or caption(x) or numbered(x) or max(0.0, x[5][1] - max(side(y, 3) for y in own)) > 2.0 * height):
                down.append(x)
            break
    taken = list({x[2]: x for x in up + own + down}.values())
    if len(taken) <= len(spans):
        return spans, box
    return [x[2] for x in taken], union([x[5] for x in taken if x[5]]) or box


@pytest.mark.parametrize("captioned", [False, True])
def test_regions(spark, captioned):
    lines, caps = pages(250, 5 + captioned)
    if captioned:
        caps = [c for c in caps if c[3] == "figure"]
    got = layout.regions(spark.createDataFrame(lines, LINES), spark.createDataFrame(caps, CAPTIONS), captioned).collect()
    assert len(got) == len(caps) > 200
    found = {(r["paper_id"], r["caption_id"]): (r["object_spans"], r["object_box"]) for r in got}
    by_paper = {p: [x for x in lines if x[0] == p] for p in {c[0] for c in caps}}
    more = 0
    for c in caps:
        want = grown(by_paper[c[0]], c, captioned)
        assert found[c[0], c[1]] == want, c
        more += len(want[0]) > len(c[5])
    assert more > 50


def test_captions_that_face_each_other(spark):
    """A figure grows up to the table's caption, the table down to the figure's; a line between goes to both."""
    lines = [("p", 1, i, "A", t, [50.0, 20.0 * i, 150.0, 20.0 * i + 10]) for i, t in enumerate(["Table 1: x", "a b", "c d", "e f", "Figure 1: y"])]
    caps = [("p", 0, 1, "table", "A", [0], lines[0][5]), ("p", 4, 1, "figure", "A", [4], lines[4][5])]
    got = {r["caption_id"]: r["object_spans"] for r in layout.regions(spark.createDataFrame(lines, LINES), spark.createDataFrame(caps, CAPTIONS)).collect()}
    assert got == {0: [0, 1, 2, 3], 4: [1, 2, 3, 4]}


def test_regions_hold_so_many_lines_and_no_more(spark):
    """Neither lines without a box nor the ends of blocks count; a page of 20,000 lines doesn't matter."""
    lines = [("p", 1, i, "", f"{i} a", None if i % 3 == 0 and i != 9000 else [50.0, float(i), 150.0, i + 0.5]) for i in range(20_000)]
    caps = [("p", 1, 1, "table", "", [9000], lines[9000][5]), ("p", 2, 1, "figure", "", [9000], lines[9000][5])]
    got = {r["caption_id"]: r["object_spans"] for r in layout.regions(spark.createDataFrame(lines, LINES), spark.createDataFrame(caps, CAPTIONS)).collect()}
    assert got[1] == [i for i in range(9000, 9061) if i % 3 or i == 9000] and len(got[1]) == 41
    assert got[2] == [i for i in range(8958, 9002) if i % 3 or i == 9000] and len(got[2]) == 30


def chunked(lines, objects, headings, size=8, overlap=2, least=40):
    """One paper's chunks, one line after the other."""
    rows = sorted((x for x in lines if (x[4] or "").strip()), key=lambda x: (x[1], x[2]))
    height = {}
    for x in rows:
        if x[5]:
            height[x[1]] = max(height.get(x[1], 0.0), x[5][3])
    rows = [x for x in rows if not (x[5] and height[x[1]] and (x[5][3] <= 0.06 * height[x[1]] or x[5][1] >= height[x[1]] - 0.06 * height[x[1]]))]
    segments, now = [], []
    for x in rows:
        if x[2] in objects:
            segments, now = segments + [now], []
            continue
        text = x[4].strip()
        if now:
            last = now[-1]
            heading = len(text) <= 120 and text[-1] not in ".?!,;:" and re.match(layout.HEADING, text)
            tallest = max(last[5][3] - last[5][1], x[5][3] - x[5][1]) if last[5] and x[5] else 0
            wide = tallest > 0 and x[5][1] - last[5][3] > 1.8 * tallest
            if x[1] != last[1] or (x[3] or "unknown").strip() != (last[3] or "unknown").strip() or text.lower() in headings or heading or wide:
                segments, now = segments + [now], []
        now.append(x)
    out = []
    for s in [*segments, now]:
        for start in range(0, len(s), size - overlap):
            w = s[start : start + size]
            text = "\n".join(x[4].strip() for x in w)
            if len(text) >= least:
                names = [x[3] or "unknown" for x in w]
                out.append((len(out), max(names, key=names.count), w[0][1], text, [x[2] for x in w]))
            if start + size >= len(s):
                break
    return out


def test_line_chunks(spark):
    lines, _ = pages(120, 9)
    r = random.Random(1)
    hinted = {p: ({i for i in range(60) if r.random() < 0.05}, {"plain words of a line"} if r.random() < 0.3 else set()) for p in {x[0] for x in lines}}
    objects = spark.createDataFrame([(p, sorted(o)) for p, (o, _) in hinted.items()], "paper_id string, spans array<int>")
    sections = spark.createDataFrame([(p, h) for p, (_, hs) in hinted.items() for h in [*(x.upper() for x in hs), *hs, " ", None]], "paper_id string, heading string")
    got = layout.line_chunks(spark.createDataFrame(lines, LINES), *layout.layout_hints(objects, sections)).collect()
    found = {}
    for c in sorted(got, key=lambda c: c["chunk_index"]):
        assert c["chunk_id"] == f"{c['paper_id']}_chunk_{c['chunk_index']}" and (c["char_start"], c["char_end"]) == (0, len(c["text"])) and c["page"] == c["page_start"] == c["page_end"]
        found.setdefault(c["paper_id"], []).append((c["chunk_index"], c["section"], c["page"], c["text"], c["span_ids"]))
    for p, (o, h) in hinted.items():
        assert found.get(p, []) == chunked([x for x in lines if x[0] == p], o, h), p


def test_chunks_of_a_long_paper(spark):
    """Neither lines nor chunks of one paper meet in one task: pages are counted, and only their own lines are ordered."""
    rows = spark.range(300_000).select(F.lit("p").alias("paper_id"), F.expr("cast(id div 50 as int)").alias("page_num"), F.col("id").cast("int").alias("span_index"), F.lit("A").alias("section"), F.lit("words of a line").alias("text"), F.array(F.lit(1.0), 100 + 10.0 * (F.col("id") % 50), F.lit(90.0), 110 + 10.0 * (F.col("id") % 50)).alias("box"))
    chunks = layout.line_chunks(rows)
    plan = chunks._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan
    n, low, high, distinct = chunks.agg(F.count("*"), F.min("chunk_index"), F.max("chunk_index"), F.countDistinct("chunk_index")).first()
    assert (low, high, distinct) == (0, n - 1, n) and n == 6000 * 8
    with pytest.raises(ValueError):
        layout.line_chunks(rows, size=3, overlap=3)


@pytest.mark.parametrize("name", ["w8_line_chunks", "w17_object_regions", "w18_figure_regions"])
def test_queries_read_lines_that_are_written_once(spark, name):
    assert "regexp_extract_all" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
