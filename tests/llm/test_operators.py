"""The operators against brute force, on a table of awkward rows, a small corpus, and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import brown_lm, components, decontaminate, exact_dedup, licences, near_dups, packing, phrase_dedup, quality, queries, suffix_dedup, warc
from lectern.llm._common import Scratch
from lectern.llm._repeats import Family, sorted_suffixes, suffix_words
from oracle import SF, answer, rows

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def collected(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def in_order(docs):
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))


def empty(df):
    return df.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(7)


@pytest.fixture(scope="session", params=["tricky", "corpus"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(answer(queries.ORACLE_SQL[name]))


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t in in_order(collected(docs)):
        groups[t.translate({ord(c): None for c in " \t\n\v\f\r"})].append((i, len(t)))
    want = []
    for bare, own in groups.items():
        keep = max(range(len(own)), key=lambda k: (own[k][1], -k))
        want += [(own[k][0], own[keep][0], len(own), k == keep, hashlib.sha256(bare.encode()).hexdigest()) for k in range(len(own))]
    got = exact_dedup.exact_dedup(docs, block=64).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def removed_by_brute_force(docs):
    seen, want = set(), Counter()
    for i, t in in_order(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        want[i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)] += 1
    return want


def removed(docs):
    out = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", suffix_dedup.n_removed(), F.size("spans"), "kept")
    return Counter((*r[:4], bytes(r[4])) for r in out.collect())


def test_suffix_dedup(docs):
    assert removed(docs) == removed_by_brute_force(collected(docs))


def test_suffix_dedup_of_a_frequent_line(spark):
    """Many documents share a line whose surroundings differ: all windows of one anchor, in different blocks."""
    r = np.random.default_rng(4)
    letters = lambda n: "".join(r.choice(list("abcdefgh"), n))
    line = letters(160)
    rows = [(i, letters(r.integers(0, 90)) + (line[k : k + 130] if (k := r.integers(0, 30)) else line) + letters(r.integers(0, 90))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert removed(docs) == removed_by_brute_force(rows)


def test_sorted_suffixes():
    r = np.random.default_rng(5)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[500:900] = data[100:500]
    start = r.integers(0, 2900, 2000)
    size = r.integers(1, 100, 2000)
    order, common = sorted_suffixes(suffix_words(data, start, size, 104))
    texts = [data[a : a + n].tobytes() for a, n in zip(start[order], size[order])]
    assert texts == sorted(texts)
    for x, y, c in zip(texts, texts[1:], common[1:]):
        assert (c == 14) == (x == y) and x[: 8 * min(c, 13)] == y[: 8 * min(c, 13)]


def test_family_merges_levels_of_like_size():
    r = np.random.default_rng(1)
    family, seen = Family(), []
    for _ in range(20):
        keys, p = r.integers(0, 5, (30, 2)).astype(np.uint64), r.integers(0, 10**6, 30)
        seen += zip(map(tuple, keys.tolist()), p.tolist())
        none = np.zeros(30, np.int32)
        family.add(keys, keys[:, 0].astype(np.int64), keys[:, 1].astype(np.int64), p, none, none)
        assert all(len(x[0]) > 2 * len(y[0]) for x, y in zip(family.levels, family.levels[1:]))
        for rows, _ in family.levels:
            assert list(map(tuple, rows.tolist())) == sorted(map(tuple, rows.tolist()))
    first = {}
    for key, p in seen:
        first[key] = min(p, first.get(key, p))
    assert {(a, b): p for a, b, p, _, _ in zip(*family.all())} == first


def test_different_windows_of_one_phrase_are_all_compared(monkeypatch):
    monkeypatch.setattr(phrase_dedup, "_symbols", lambda spans: np.zeros(max(spans.n - phrase_dedup.STRIDE + 1, 0), np.int64))
    a, b = [f"a{i}" for i in range(70)], [f"b{i}" for i in range(60)]
    of_passages = phrase_dedup.Passages([(3, " ".join(a).encode()), (5, " ".join(b).encode())])
    texts = [" ".join(w).encode() for w in (["x", *b], ["x", *b, *a[5:60]], ["short"])]
    of, at = of_passages.located(np.array([4, 9, 10]), texts)  # the first comes before the passage's document
    assert sorted(zip(of.tolist(), at.tolist(), strict=True)) == [(1, i) for i in (*range(1, 12), *range(61, 67))]


def test_phrase_dedup(docs):
    first, want = {}, Counter()
    for k, (i, t) in enumerate(in_order(collected(docs))):
        w = t.encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), k) != k:
                gone[p : p + 50] = [True] * 50
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in phrase_dedup.phrase_dedup(docs).collect())
    assert got == want


def test_near_duplicates(docs):
    docs_ = in_order(collected(docs))
    sets = []
    for _, t in docs_:
        w = t.translate(LOW).encode().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for y in range(len(sets)):
        for x in range(y):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                root[b] = a
    want = Counter((docs_[k][0], len(sets[k]), docs_[top(k)][0], top(k) == k) for k in range(len(sets)))
    got = near_dups.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "first").collect()
    assert Counter(map(tuple, got)) == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links, Scratch(spark), "t").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(0, " ".join("na" for _ in range(13))), (1, "one TWO"), (2, None), (2, ""), (3, "x"), (None, "all rights reserved"), (4, "p q r s t u v w")], "item_id long, text string")
    windows = defaultdict(set)
    for i, t in [(r["item_id"], r["text"] or "") for r in items.collect()]:
        w = WORD.findall(t.translate(LOW))
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add("" if i is None else str(i))
    want = Counter()
    for i, t in collected(docs):
        w, hit, names = WORD.findall(t.translate(LOW)), set(), set()
        for key, own in windows.items():
            for p in range(len(w) - len(key) + 1):
                if tuple(w[p : p + len(key)]) == key:
                    hit |= set(range(p, p + len(key)))
                    names |= own
        want[i, len(w), len(hit), ",".join(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for most in (1 << 20, 20):  # in one automaton, and in several
        got = decontaminate.decontaminate(docs, items, most_bytes=most).select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()
        assert Counter(map(tuple, got)) == want
    row = decontaminate.decontaminate(spark.createDataFrame([(1, "é. One  two!")], "doc_id long, text string"), items).first()
    assert [list(s) for s in row["spans"]] == [[3, 11]]


def test_licences(docs):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    want = Counter()
    for i, t in collected(docs):
        w = WORD.findall(t.translate(LOW))
        places = [(p, k) for k, q in phrases.items() for p in range(len(w)) if w[p : p + len(q)] == q]
        want[i, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({k for _, k in places}))] += 1
    got = licences.licences(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",")).collect()
    assert Counter(map(tuple, got)) == want


def test_licence_spans(spark):
    text = "Code. " + licences.NOTICES[5][1] + " Redistribution follows"
    row = licences.licences(spark.createDataFrame([(1, text.replace("copyright", "copy right"))], "doc_id long, text string")).first()
    assert row["labels"] == ["bsd"] and 0.6 <= row["score"] < 1 and row["spans"][0]["first_word"] == 1


def test_notice_that_begins_a_longer_one(spark):
    """A short notice is found though the text goes on as a longer one, which it doesn't hold."""
    texts = [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Licensed under the Apache License, Version 2.0. The rest is ours.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licences.licences(docs).collect():
        assert row["labels"] == ["apache"] and row["score"] == 1.0
        assert [(s["notice_from"], s["notice_to"], s["first_word"], s["last_word"]) for s in row["spans"]] == [(0, 8, 0, 7)]


def test_suffix_automaton():
    r = np.random.default_rng(2)
    sequences = [r.integers(1, 4, 40).tolist() for _ in range(3)]
    a = licences.SuffixAutomaton()
    for i, s in enumerate(sequences):
        a.add(i, s)
    a.close(dict(enumerate(sequences)))
    runs = {tuple(s[i:j]) for s in sequences for i in range(40) for j in range(i + 1, 41)}
    text = r.integers(1, 4, 200).tolist()
    for i, (length, state) in enumerate(a.walk(text)):
        assert length == max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0)
        for number, ends in a.ends[state].items():
            want = text[i + 1 - length : i + 1]
            assert sorted(ends) == [e for e in range(length, 41) if sequences[number][e - length : e] == want]


def test_packing(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(docs, queries.TOKENIZER, size=128).collect()
    want = Counter((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids) + (2,)) for i, t in collected(docs))
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    got = Counter()
    for i, own in by_doc.items():
        if i is not None and len({(r["piece"]) for r in own}) == len(own):
            own.sort(key=lambda r: r["piece"])
            ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own])
            assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
            assert all(r["length"] == 128 for r in own[1:])
            got[i, tuple(ids.tolist())] += 1
    assert all(want[k] == n for k, n in got.items()) and len(got) >= len(by_doc) - 2
    assert sum(r["length"] for r in out) == sum(len(ids) * n for (_, ids), n in want.items())
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    left, n = [], 0  # the same by one document after the other
    for length in sorted((r["length"] for r in out), reverse=True):
        fit = min((c for c in left if c >= length), default=None)
        if fit is None:
            n, fit = n + 1, 128
        else:
            left.remove(fit)
        left.append(fit - length)
    assert len(bins) == n


def test_encoder_knows_special_tokens():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a<|endoftext|> b  \n c"
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(other)("Hello World").tolist() == Tokenizer.from_file(other).encode("Hello World", add_special_tokens=False).ids


def test_lm_scores(docs):
    tokens = [(i, (t.translate(LOW)).encode().split() + [None], zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1) for i, t in collected(docs)]
    c = Counter(w for _, ws, held in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws, held in tokens)
    out = brown_lm.lm_scores(docs, rounds=2).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == want
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) for r in out)


def test_lm_beats_base(spark):
    out = brown_lm.lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_exchange_raises_likelihood():
    r = np.random.default_rng(3)
    types = np.ravel([r.choice([60, 61, 62]) if i % 2 else r.choice([70, 71, 72]) for i in range(4000)])
    classes = np.full(brown_lm.TYPES, brown_lm.CLASSES - 1)
    classes[: brown_lm.CLASSES - 2] = np.arange(brown_lm.CLASSES - 2)
    classes[brown_lm.END_TYPE] = brown_lm.CLASSES - 2

    def counted():
        near = np.zeros((brown_lm.TYPES, 2, brown_lm.CLASSES))
        before = np.append(brown_lm.END_TYPE, types[:-1])
        np.add.at(near, (types, 0, classes[before]), 1)
        np.add.at(near, (before, 1, classes[types]), 1)
        return near

    def likelihood():
        c = classes[np.append(brown_lm.END_TYPE, types)]
        pairs = Counter(zip(c, c[1:]))
        return sum(n * math.log(n) for n in pairs.values()) - sum(n * math.log(n) for x in (c[:-1], c[1:]) for n in Counter(x).values())

    start = likelihood()
    for _ in range(3):
        classes = brown_lm.exchange(counted(), classes)
    assert likelihood() > start + 1000 and {classes[t] for t in (60, 61, 62)}.isdisjoint({classes[t] for t in (70, 71, 72)})


def test_lm_moves_every_word(spark):
    """Words with the same ending get classes of their own, however rare they are."""
    kinds = [f"{k}{i:04d}xyz" for i in range(60) for k in ("left", "right")]
    filler = " ".join(f"own{i}" for i in range(brown_lm.OWN + 60) for _ in range(8))
    known = ["red often " * 2000, "one two three also four five six . " * 2000]  # frequent words in the places of either kind
    texts = [filler, *known] + [f"red {w} " * 6 if w[0] == "l" else f"one two three {w} four five six . " * 3 for w in kinds]
    session = spark.createDataFrame([(i, t) for i, t in zip((j for j in range(10000) if zlib.crc32(str(j).encode()) % 5 != 1), texts)], "doc_id long, text string")
    seen = []
    inner = brown_lm._with_classes

    def record(encoded, moved, *more):
        seen.append({r["word"]: r["class"] for r in moved.collect()})
        return inner(encoded, moved, *more)

    brown_lm._with_classes = record
    try:
        brown_lm.lm_scores(session).count()
    finally:
        brown_lm._with_classes = inner
    low = np.frombuffer(" ".join(kinds).encode(), np.uint8)
    starts, ends, _ = brown_lm.words(low, np.array([0, len(low)]), brown_lm.NOT_SPACE)
    ids = dict(zip(kinds, brown_lm.signed(brown_lm.word_ids(low, starts, ends)).tolist()))
    assert len({i & (brown_lm.SHAPES - 1) for i in ids.values()}) == 1
    of = {k: {seen[-1][i] for w, i in ids.items() if w.startswith(k)} for k in ("left", "right")}
    assert of["left"].isdisjoint(of["right"])


def test_best_classes():
    """A batched move is the best of all moves of that word by itself."""
    n, rng = brown_lm.CLASSES, np.random.default_rng(5)
    of = rng.integers(0, n - 1, 400)
    tokens = rng.integers(0, 400, 20000)
    near = of[tokens]
    pairs = np.zeros((n, n))
    np.add.at(pairs, (near[:-1], near[1:]), 1)
    at = np.flatnonzero((tokens[1:-1] >= 390) & (tokens[:-2] < 390) & (tokens[2:] < 390)) + 1
    at = at[np.argsort(tokens[at], kind="stable")]
    to, size = brown_lm.best_classes(tokens[at] - 390, (near[at] * n + near[at - 1]) * n + near[at + 1], np.ones(len(at), np.int64), pairs, pairs.sum(1), n - 1)
    assert size.tolist() == [int((tokens[at] == w).sum()) for w in range(390, 400)]
    for w in range(390, 400):
        here = at[tokens[at] == w]
        gains = []
        for k in range(n - 1):
            base, total = pairs.copy(), pairs.sum(1)
            if k == of[w]:  # a word's own share is what it would lose
                np.subtract.at(base, (near[here - 1], k), 1)
                np.subtract.at(base, (k, near[here + 1]), 1)
                total[k] -= len(here)
            more = base.copy(), total.copy()
            np.add.at(more[0], (near[here - 1], k), 1)
            np.add.at(more[0], (k, near[here + 1]), 1)
            more[1][k] += len(here)
            gains.append((brown_lm._f(more[0]) - brown_lm._f(base)).sum() - 2 * (brown_lm._f(more[1]) - brown_lm._f(total)).sum())
        assert gains[to[w - 390]] > max(gains) - 3


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.93 and out["score"].between(0, 1).all()


def test_quality_ignores_held_out_labels(spark, tricky):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(3, None), (None, 1)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.bucket("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in quality.quality(tricky, x).collect()) for x in (labels, flipped))
    assert a == b and len(a) == tricky.count() and all(0 <= s <= 1 for _, s in a)
    assert {r["score"] for r in quality.quality(tricky, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    assert quality.isotonic(np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4)).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>A &amp; B</title><p>Hi<b>!</b><script>x</script><a href='/c'>c</a>"), (2, None, None), (1, "http://a/", "<p>again")], "page_id long, url string, html string")
    source = warc.responses(pages)
    out = warc.derivatives(source)
    assert out.count() == 6
    warc.write_warc(out, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    key = lambda df: sorted((r["record_id"], r["type"], r["refers_to"] or "", tuple(sorted(r["headers"].items())), bytes(r["block"])) for r in df.collect())
    assert key(back) == key(out)
    ids = {r["record_id"] for r in source.collect()}
    assert all(r["refers_to"] in ids and r["headers"]["WARC-Block-Digest"] == warc.digest(bytes(r["block"])) for r in out.collect())
    conversion = next(r for r in out.collect() if r["type"] == "conversion" and r["target_uri"] == "http://a/" and b"B" in bytes(r["block"]))
    assert bytes(conversion["block"]).decode() == "A & B\nHi!c"
    meta = next(bytes(r["block"]).decode() for r in out.collect() if r["type"] == "metadata" and b"title" in bytes(r["block"]))
    assert "title: A & B\r\n" in meta and "outlink: /c\r\n" in meta and "source-http-content-type: text/html; charset=utf-8\r\n" in meta


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, suffix_dedup.suffix_dedup, phrase_dedup.phrase_dedup, near_dups.near_duplicates, brown_lm.lm_scores, licences.licences, lambda d: packing.pack(d, queries.TOKENIZER)])
def test_empty(tricky, operator):
    assert operator(empty(tricky)).count() == 0


def test_empty_others(spark, tricky):
    items, pages = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "page_id long, url string, html string")
    assert decontaminate.decontaminate(tricky, items).where("contaminated").count() == 0
    assert warc.derivatives(warc.responses(pages)).count() == 0
