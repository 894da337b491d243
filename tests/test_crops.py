"""Regions above captions and checks of captions against loops over a page's lines."""

import random
import re

import pytest
from lectern.operators import crops
from lectern.plans import crops as plans

from oracle import SF

CAPTIONS = "caption_id long, paper_id long, page_num int, kind string, label string, number int, section string, text string, box array<double>, first_span int, n_spans int"
LINES = "paper_id long, page_num int, span_index int, text string, box array<double>"
PAGES = "paper_id long, page_num int, width double, height double"


def page(n: int, seed: int):
    r = random.Random(seed)
    words = ["SELECT a", "FROM", "x", "{{", "w" * 90, "left join t", "group   by", "plain words here", "", None, "ORDER"]
    box = lambda: None if r.random() < 0.05 else [x := r.uniform(-5, 500), y := r.uniform(0, 700), x + r.uniform(5, 300), y + r.uniform(2, 40)]  # noqa: E731, F841
    sizes = [(1, p, r.choice([612.0, 0.0, None]), r.choice([792.0, 792.0, 0.0])) for p in (1, 2, 3)]
    lines = [(1, 1 + i % 3, i // 3, r.choice(words), box()) for i in range(n)]
    caps = [
        (i, 1, r.choice([1, 2, 3, 9]), r.choice(["table", "figure"]), "Table 1", r.choice([None, 1, 2, 3, 400]), r.choice(["Preamble x", "preambles", "Intro", None]), r.choice(["Table 1", "table 1: ab", "TABLE 1. A long text", "other", None]), box(), r.randint(0, n // 3), r.randint(1, 3))
        for i in range(120)
    ]
    return caps, lines, sizes


def cropped(cap, lines, sizes):
    box = cap[8]
    if box is None:
        return None, "no_caption_bbox"
    width, height = next(((w, h) for _, p, w, h in sizes if p == cap[2]), (None, None))
    here = [x for x in lines if x[1] == cap[2] and x[4]]
    width = width if width and width > 0 else max([x[4][2] for x in here], default=0.0)
    if not height or height <= 0:
        return None, "unknown_page_height"
    if width <= 0:
        return None, "unknown_page_width"
    up = min(280.0, max(60.0, height * 0.35))
    c = [max(0.0, box[0] - 20), max(0.0, box[1] - up), min(width, box[2] + 20), box[3]]
    w, h, tall = c[2] - c[0], c[3] - c[1], max(box[3] - box[1], 1.0)
    if w < 40 or h < 60:
        return None, f"degenerate_box(w={w:.0f},h={h:.0f})"
    if h < tall * 3:
        return None, f"not_larger_than_caption(ratio={h / tall:.1f})"
    n = sum(len((x[3] or "").strip()) > 80 and not cap[9] <= x[2] < cap[9] + cap[10] and x[4][1] >= c[1] - 2 and x[4][3] <= box[1] + 2 and x[4][0] >= c[0] - 10 and x[4][2] <= c[2] + 10 for x in here)
    return (None, f"prose_dense(long_lines={n})") if n >= 3 else (c, "ok")


@pytest.mark.parametrize(("n", "seed"), [(90, 1), (600, 2), (9000, 3)])
def test_regions(spark, n, seed):
    caps, lines, sizes = page(n, seed)
    got = crops.regions(spark.createDataFrame(caps, CAPTIONS), spark.createDataFrame(lines, LINES), spark.createDataFrame(sizes, PAGES)).collect()
    want = {c[0]: cropped(c, lines, sizes) for c in caps}
    assert len(got) == len(caps) and {r["caption_id"]: (r["crop"], r["reason"]) for r in got} == want
    assert {"ok", "no_caption_bbox", "unknown_page_height"} <= {x[1] for x in want.values()} and (n < 9000 or any(x[1].startswith("prose") for x in want.values()))


def checked(cap, lines, numbers):
    clean = lambda s: " ".join((s or "").split())
    text, label = clean(cap[7]), clean(cap[4])
    body = text[len(label) :].lstrip(":. ").strip() if text.lower().startswith(label.lower()) else text
    near = " ".join(clean(x[3]) for x in sorted((x for x in lines if x[1] == cap[2] and cap[9] - 5 <= x[2] <= cap[9] + cap[10] - 1 + 20), key=lambda x: x[2]))
    hits = len(re.findall(crops.CODE, near))
    out = ["bare_caption"] * (len(body) < 5) + ["suspicious_section"] * bool(re.match(crops.EARLY, clean(cap[6]))) + [f"code_sql_context ({hits} tokens)"] * (hits >= 2)
    if cap[5] is not None and len(numbers) >= 3 and cap[5] > 10 * max(numbers) and cap[5] > 20:
        out.append(f"extreme_number ({cap[5]}, max_normal={max(numbers)})")
    return (True, None) if len(out) < 2 else (False, "; ".join(out))


@pytest.mark.parametrize("given", [False, True])
def test_checks(spark, given):
    caps, lines, _ = page(240, 5)
    df = spark.createDataFrame(caps, CAPTIONS)
    usual = df.where("number < 10") if given else None
    numbers = lambda kind: [c[5] for c in caps if c[3] == kind and c[5] is not None and (not given or c[5] < 10)]
    got = {r["caption_id"]: (r["valid"], r["reason"]) for r in crops.caption_checks(df, spark.createDataFrame(lines, LINES), usual).collect()}
    assert got == {c[0]: checked(c, lines, numbers(c[3])) for c in caps}
    assert any("extreme" in (r or "") for _, r in got.values()) == given and any("code" in (r or "") for _, r in got.values()) and any(v for v, _ in got.values())


def test_nothing(spark):
    none = [spark.createDataFrame([], s) for s in (CAPTIONS, LINES, PAGES)]
    assert crops.regions(*none).isEmpty() and crops.caption_checks(*none[:2]).isEmpty()


@pytest.mark.parametrize("name", ["g10_crop_regions", "p20_caption_checks"])
def test_lines_are_made_once(spark, name):
    """A caption's pattern must not be pushed below the lines, where it would make each anew, and the query reads them written."""
    rows = plans.captions(plans.lines(spark, SF))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert "regexp_extract_all" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
