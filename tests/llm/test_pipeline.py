"""The pipeline's stages against brute force, each on what the one before kept."""

import re

import corpus_pipeline
import public_tokenizers
from lectern.llm import quality
from lectern.llm._common import Scratch
from tokenizers import Tokenizer

from oracle import SF

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality.quality(docs, labels, Scratch(spark)).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in good}
    best = {}
    for i in sorted(texts):
        bare = re.sub(r"[ \t-\r]", "", texts[i])
        if bare not in best or len(texts[i]) > len(texts[best[bare]]):
            best[bare] = i
    kept = sorted(best.values())
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := texts[i].translate(LOW).encode().split()) else set() for i in kept}
    group = {i: i for i in kept}
    for y in kept:
        for x in kept:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((group[x], group[y]))
                group = {k: a if g == b else g for k, g in group.items()}
    kept = [i for i in kept if group[i] == i]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall((r["text"] or "").translate(LOW))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for i in kept:
        w, hit = WORD.findall(texts[i].translate(LOW)), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
        if not hit or 20 * len(hit) < len(w):
            clean.append(i)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in clean}
    got: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
