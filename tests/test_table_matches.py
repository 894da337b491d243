"""Recognised tables found by label, caption or place, against a loop over a page's tables."""

import random
import re

import pytest
from lectern.operators import matching

WANTED, TABLES = "object_id long, page long, label string, caption string", "table_id long, page long, place int, label string, caption string"


def loop(w, tables):
    here = sorted((t for t in tables if t[1] == w[1]), key=lambda t: (t[2], t[0]))
    bare = lambda s: (s or "").strip(" ").lower()
    norm = lambda s: re.sub(r"[:.\s]+$", "", bare(s))
    words = lambda s: set(re.findall(r"\w+", bare(s)))
    for f, mode in ((bare, "exact_label_page"), (norm, "label_page")):
        for t in here:
            if f(w[2]) and f(w[2]) == f(t[3]):
                return t[0], mode
    best = max(here, key=lambda t: len(words(w[3]) & words(t[4])), default=None)
    if best and len(words(w[3]) & words(best[4])) >= 4:
        return best[0], "caption_page"
    return (here[0][0], "page_only") if len(here) == 1 else (None, None)


@pytest.mark.parametrize("seed", range(3))
def test_against_a_loop(spark, seed):
    r = random.Random(seed)
    title = lambda: r.choice([None, "", " ".join(r.choice("the of a b c d e é f g h i1 j_k".split()) for _ in range(r.randint(1, 9)))])
    label = lambda: r.choice([None, "", "Table 1", "table 1", "Table 1.:", "Table 2", " TABLE 2: "])
    tables = [(i, r.choice([1, 2, 2, 2, 2, 3 + i]), r.randint(0, 5), label(), title()) for i in range(60)]
    wanted = [(i, r.choice([1, 2, 2, 3 + i % 60, 999]), label(), title()) for i in range(120)]
    got = matching.table_matches(spark.createDataFrame(wanted, WANTED), spark.createDataFrame(tables, TABLES), ["page"]).collect()
    assert {r["object_id"]: (r["table_id"], r["mode"]) for r in got} == {w[0]: loop(w, tables) for w in wanted} and len(got) == len(wanted)


def test_second_run_does_nothing_new(spark):
    objects = [(1, "table", 1, "Table 1", None, False), (2, "table", 1, "Table 9", None, None), (3, "figure", 1, "Table 1", None, False), (4, "table", 1, "Table 1", None, True), (5, "table", 1, "Table 1", None, False)]
    schema = "object_id long, kind string, page long, label string, caption string, enriched boolean"
    tables = spark.createDataFrame([(7, 1, 0, "table 1", None), (8, 1, 1, "Table 1", None)], TABLES)
    retrieved = spark.createDataFrame([(1, i, rank) for i, rank in ((1, 1), (2, 2), (3, 1), (4, 1), (5, 3), (None, 1))] + [(2, 1, 2)], "claim_id long, object_id long, rank int")
    run = lambda rows: {r["object_id"]: (r["outcome"], r["table_id"]) for r in matching.topk_enrichment(retrieved, spark.createDataFrame(rows, schema), tables, ["page"], 2).collect()}
    first = run(objects)
    assert first == {1: ("enriched", 7), 2: ("no_match", None), 4: ("skipped_already", None)}
    again = run([(*o[:5], o[5] or first.get(o[0], ("",))[0] == "enriched") for o in objects])
    assert again == {1: ("skipped_already", None), 2: ("no_match", None), 4: ("skipped_already", None)}
