"""Operator 11 against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=50):
    """(item_id, rank, doc_id, score) rows of (doc_id, text) and distinct (item_id, text)."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        if item is None or text is None:
            continue
        scored = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * total) // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) & c.keys())
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, k=50, **how):
    return sorted((tuple(r) for r in lexical.ranked(docs, items, k, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "alpha1 beta2 Gamma3 the"), (2, "one two"), (2, "one two"), (2, "three"), (3, None), (4, ""), (None, "one"), (5, "nowhere here"),
            (6, "été 東京 OK x"), (7, " ".join(f"{w}{i}" for w in ("alpha", "beta", "gamma", "mu", "nu") for i in range(40)))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("h", F.lit("own")).withColumn("score", F.lit(0))


@pytest.mark.parametrize("k", [3, 50])
def test_edge_rows(edge_docs, items, k):
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert found(edge_docs, items, k) == plain(docs, [(r.item_id, r.text) for r in items.collect()], k)


def test_empty_tables(no_docs, edge_docs, items):
    assert found(no_docs, items) == found(edge_docs, items.limit(0)) == []


@pytest.mark.parametrize("window, share, block", [(1024, 8, 16_384), (8, 10, 60), (32, 1000, 200), (16, 1, 128)])
def test_windows_blocks_and_rounds(spark, monkeypatch, window, share, block):
    monkeypatch.setattr(lexical, "ROUND_TERMS", 40)
    rng = random.Random(window)
    words = [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(700)] + [(700 + i, "w1 w2 w7") for i in range(100)]
    asked = [(i, " ".join(rng.choices(words, k=12))) for i in range(12)] + [(50, "w1 w2")]
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string"), 20,
                block_docs=block, window=window, short_share=share)
    assert got == plain(docs, asked, 20)


def test_windows_are_skipped():
    """Once k documents are known that no window's bounds reach, no list of the window is read."""
    import numpy as np

    docs = 40
    row = {"ids": (np.arange(docs), np.ones(docs, bool)), "n": np.full(docs, 10), "h": np.array([5]), "df": np.array([docs]),
           "doc": np.arange(docs, dtype=np.int32).tobytes(), "tf": np.array([9] * 4 + [1] * 36, np.int32).tobytes()}
    best = lexical.Best(2)
    calls = []
    add = best.add
    best.add = lambda *x: (calls.append(len(x[0])), add(*x))
    lexical.search_block(lexical.Block(row, docs, 400, 4), np.array([5]), np.array([7]), best, 100)
    assert best.ids.tolist() == [0, 1] and calls == [4]
