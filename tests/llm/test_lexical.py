"""Ranked lexical search against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelmill.llm import lexical as lx

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    n_docs, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 10 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


ODD = [
    (1, None), (2, ""), (3, " .,;\n"), (4, "one"), (5, "One"), (5, "One"), (6, "one two three"), (7, "x" * 50_000 + " two"), (8, "word " * 20_000 + "two"), (9, "é漢字 ß\x7fΣ one-two_three"),
    (10, "one two three"), (None, "one two three"), (11, "alpha{beta}gamma 42"), *((100 + i, f"two w{i} alpha") for i in range(40)),
]
ITEMS = [(1, "one TWO"), (1, "one TWO"), (2, None), (3, ""), (4, "nowhere at all"), (5, "é漢字 Σ alpha alpha two"), (None, "gamma beta"), (6, " ".join(f"w{i}" for i in range(40)))]


@pytest.mark.parametrize("small", [False, True])
def test_search_of_odd_rows(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lx, "CHUNK_BYTES", 100)
        monkeypatch.setattr(lx, "BLOCK_BYTES", 200)
        monkeypatch.setattr(lx, "DEPTH", 1)
        monkeypatch.setattr(lx, "PROBES", 2)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], DOCS).withColumns({c: F.lit(1) for c in ("item", "score", "rank", "term", "n")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "doc_id", "score")})
    got = lx.top_documents(docs, items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ODD, ITEMS)
    if not small:
        assert lx.top_documents(docs.where("doc_id = -1"), items).count() == 0
        assert lx.top_documents(docs, items.where("item_id = -1")).count() == 0


def test_search_of_the_table(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted((tuple(r) for r in lx.top_documents(docs, items).collect()), key=repr) == want


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    n_docs, size = 4000, 12
    doc = np.repeat(np.arange(n_docs), size)
    term = np.tile(np.arange(size), n_docs)
    tf = rng.geometric(0.3, n_docs * size)
    chunk = lx.Index(np.bincount(doc, tf).astype(np.int64), doc, term, tf)
    weight = np.full(size, 1000)
    lists = lx.Lists(chunk, weight, n_docs, int(chunk.n.sum()))
    wanted = np.arange(3)
    ids = pa.array(np.arange(n_docs))
    best = lx.Best(10, np.zeros(1, np.int64))
    read = lists.search(0, wanted, best, ids)
    scores = lists.scores(np.arange(n_docs), wanted)
    order = np.lexsort((np.arange(n_docs), -scores))[:10]
    assert best.found[0] == [(int(scores[i]), int(i)) for i in order]
    assert read < 3 * n_docs / 2
    again = lx.Best(10, best.floors + 1)  # a floor above the threshold's start ends the search at once
    again.floors[0] = int(lists.top[wanted].sum()) + 1
    assert lists.search(0, wanted, again, ids) == 0
