"""Texts that broke earlier versions: words that sums over places can't tell apart, long runs, broken pages."""

import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm import near_dups, packing, warc
from lectern.llm._common import Spans, prints


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_fingerprints_of_thue_morse_words():
    for n in (8, 64, 512, 1024, 4096):
        data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        starts, ends = np.array([0, n]), np.array([n, 2 * n])
        assert len(set(Spans(data).of(starts, ends).tolist())) == 2 and len(set(prints(data, starts, ends).tolist())) == 2


def test_thue_morse_words_are_no_duplicates(spark):
    a, b = thue_morse(4096)
    docs = spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_long_runs():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, slow = packing.encoder(path), Tokenizer.from_file(path)
    for text in (" " * 1_000_000, "\n" * 1_000_000, "x" + " " * 1_000_000 + "y", "a" * 200_000):
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_broken_pages():
    for part in ("<title>", "<title ", "<a href ", "<a x ", '<a href="', "<!--", "<" + "a" * 1000):
        page = (part * (1_000_000 // len(part))).encode()
        began = time.perf_counter()
        warc.derived("s", "u", "d", {}, page)
        assert time.perf_counter() - began < 5, part
    assert warc.links_of("<a class=x href='/a'>t</a><A\nHREF=/b>q<a href=\"c&amp;d\" x><a xhref=no>") == ["/a", "/b", "c&d"]
    assert warc.title_of("<p><TITLE lang=x> a &amp;\n b</title>") == "a & b" and warc.title_of("<title>never closed") is None
