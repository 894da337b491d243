"""Cases that earlier versions got wrong: chains of licences, colliding hashes, runs of one byte, markup in quotes and comments."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import _repeats, exact_dedup, licences, suffix_dedup, warc


def best_chain(matches, gap):
    """Words covered by the best of all chains, one after the other."""
    best = 0

    def go(covered, last):
        nonlocal best
        best = max(best, covered)
        d0, t0, n0 = last
        for d, t, n in matches:
            if (d, t, n) > last and t >= t0 and d >= d0 and t + n > t0 + n0 and d + n > d0 + n0 and d - d0 - n0 <= gap and t - t0 - n0 <= gap:
                go(covered + min(n, d + n - d0 - n0, t + n - t0 - n0), (d, t, n))

    for m in matches:
        go(m[2], m)
    return best


def test_chains_cover_as_much_as_any():
    r = random.Random(4)
    for _ in range(300):
        matches = list({(r.randrange(60), r.randrange(40), r.randrange(4, 12)) for _ in range(r.randrange(1, 8))})
        got = licences._chains(matches)
        assert max(c[4] for c in got) == best_chain(matches, licences.GAP)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_a_notice_with_its_own_words_put_in(spark):
    words = [f"w{i}" for i in range(40)]
    text = [*words[:10], *words[30:34], *words[10:20], "x", "y", "z", *words[20:]]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(words)), (3, " ".join(words + ["q"] * 30 + words))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.licences(docs, [("own", " ".join(words))], {"p": "a b"}).collect()}
    assert all(got[i]["labels"] == ["own"] and got[i]["score"] == 1.0 for i in (1, 2, 3))
    assert [(s["first_word"], s["last_word"]) for s in got[3]["spans"]] == [(0, 39), (70, 109)]


def test_whole_licences(spark):
    docs = spark.createDataFrame([(i, f"Copyright 2020 A. Author\n\n{text}\n\nint main() {{}}") for i, (_, text) in enumerate(licences.NOTICES)], "doc_id long, text string")
    for r in licences.licences(docs).collect():
        assert licences.NOTICES[r["doc_id"]][0] in r["labels"] and r["score"] == 1.0


def test_equal_hashes(spark, monkeypatch):
    """Blocks A, B, A of one hash in three tasks: all of A are one group."""
    monkeypatch.setattr(exact_dedup, "block_hash", lambda: F.lit(7).cast("long"))
    rows = [(i, "A" * 50 if i // 30 != 1 else "B" * 50) for i in range(90)] + [(100, "A" * 50 + "B" * 80), (101, "A" * 50 + "B" * 79 + "C"), (102, "A" * 50 + "B" * 80)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=64).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, 0 if i // 30 != 1 else 30, 60 if i // 30 != 1 else 30) for i in range(90)} | {(100, 100, 2), (101, 101, 1), (102, 100, 2)}


@pytest.mark.parametrize("unit", ["a", "ab", " ", "abc\n"])
def test_memory_of_runs(unit):
    """Two MiB of one run: sort keys are made for a part of its suffixes at a time."""
    text = (unit * (2 << 20))[: 2 << 20]
    batch = pa.record_batch({"ord": pa.array([0], pa.int64()), "text": pa.array([text])})
    taken = {}

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            tracemalloc.start()
            taken["rows"] = sum(len(b) for b in f(iter([batch])))
            taken["peak"] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()

    _repeats.block_entries(Docs(), _repeats.Kind(_repeats.byte_symbols, 100, 24))
    assert taken["peak"] < 300 << 20, taken


def test_runs_are_removed(spark):
    docs = spark.createDataFrame([(1, "a" * 3_000_000), (2, "xy" * 600_000 + "end"), (3, "xy" * 60)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup.suffix_dedup(docs).select("doc_id", "kept").collect()}
    assert {i: bytes(k) for i, k in got.items()} == {1: b"a", 2: b"xyend", 3: b""}


def test_markup():
    assert warc.links_of("<!-- <a href='x'> --><script>s = \"<a href='y'>\"</script><a title=\"href=no\" href = z>") == ["z"]
    assert warc.page_text('<p title="a>b">hi</p>') == "hi" and warc.page_text("a < b and c > d <b x='>'>e</b>") == "a < b and c > d e"
    assert warc.page_text("<style>p > a { }</style>x<!-- > -->y<br/>z") == "xy\nz" and warc.page_text("it's <i class=it's>so</i>") == "it's so"
    assert warc.title_of("<!-- <title>no</title> --><script>'<title>no</title>'</script><title>yes</title>") == "yes" and warc.title_of("<p>") is None
    assert warc.page_text("x <a href='y") == "x <a href='y" and warc.page_text("") == "" and warc.links_of('<a HREF="">') == [""]
    for part in ('<a href="', "<a href='x\" ", '<p title="a>', "='\"", "< a", "<script>", "<a b=c", " = ' "):
        page = part * (1_000_000 // len(part))
        began = time.perf_counter()
        warc.derived("s", "u", "d", {}, page.encode())
        assert time.perf_counter() - began < 5, part
