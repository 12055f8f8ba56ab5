"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from statera.llm import best_position

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORDS = "red blue green one two three four five six seven eight nine ten".split()


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute_search(docs, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    total, words = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    first = {}
    for i, t in items:
        if i not in first or first[i] is None or t is not None and t < first[i]:
            first[i] = t
    out = []
    for item, text in first.items():
        asked, found = Counter(terms(text)), []
        for doc, c in docs:
            n, score = sum(c.values()), 0
            m = 25 + (75 * n * total) // max(1, words)
            for t, times in asked.items():
                if c[t]:
                    score += times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, n, None if none else doc, -s) for n, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def answer(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    assert best_position.terms_of("Ab-c É9_é x\u0080y 漢字\x7fz") == [t.encode() for t in terms("Ab-c É9_é x\u0080y 漢字\x7fz")]
    assert best_position.terms_of(None) == best_position.terms_of("") == []


def test_given_documents(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    assert answer(best_position.search(docs, items)) == brute_search(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))


DOC, ITEM = "doc_id long, text string, score long, q string, terms int", "item_id long, text string, q long, rank string"


@pytest.mark.parametrize("bound", [1 << 24, 30])
def test_odd_documents(spark, monkeypatch, bound):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing columns; with a small bound the items are asked in parts."""
    monkeypatch.setattr(best_position, "QUERY_BYTES", bound)
    monkeypatch.setattr(best_position, "SHARD", 5)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for i in range(40)] + [(i, "red green") for i in (70, 71, 72, 72, 72)]
    rows += [(None, "red green"), (None, None), (80, None), (81, ""), (82, "!!"), (83, "Naïve NAÏVE naÏve 漢字"), (84, " ".join(rng.choices(WORDS, k=20_000)))]
    items = [(1, "red, GREEN; red!"), (2, None), (3, ""), (4, "nosuchword"), (None, "blue one"), (5, "blue one"), (6, "naïve 漢字"), (6, "red"), (6, None), (7, " ".join(WORDS)), (7, " ".join(WORDS))]
    docs = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], DOC).repartition(3)
    asked = spark.createDataFrame([(i, t, 1, None) for i, t in items], ITEM)
    assert answer(best_position.search(docs, asked)) == brute_search(rows, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "red", 1, "x", 1)], DOC), spark.createDataFrame([(1, "red", 1, "x")], ITEM)
    assert answer(best_position.search(docs.where("doc_id < 0"), items)) == []
    assert answer(best_position.search(docs, items.where("item_id < 0"))) == []
    assert answer(best_position.search(docs.where("doc_id < 0"), items.where("item_id < 0"))) == []


def test_reading_stops_early_and_loses_nothing():
    """Where a few documents stand out, most of a shard is never looked at; the heap of an earlier shard stops the next at once."""
    rng, n, t = np.random.default_rng(1), 5000, 6
    impact = rng.integers(1, 100, size=(n, t))
    impact[rng.choice(n, 12, replace=False)] += 1000
    shard = best_position.Shard(list(range(n)), np.arange(n + 1) * t, np.tile(np.arange(t), n), impact.ravel(), t)
    heap, times = [], [2, 1, 1, 3, 1, 1]
    seen = shard.best(list(range(t)), times, heap, 10)
    scores = impact @ np.array(times)
    assert sorted(heap, reverse=True) == [(int(scores[i]), 1, -int(i)) for i in sorted(range(n), key=lambda i: (-scores[i], i))[:10]]
    assert seen < n / 10
    again = best_position.Shard(list(range(n, 2 * n)), np.arange(n + 1) * t, np.tile(np.arange(t), n), rng.integers(1, 50, size=n * t), t)
    assert again.best(list(range(t)), times, heap, 10) <= t * best_position.FIRST_STEP


def test_equal_scores_are_read_to_the_end():
    shard = best_position.Shard(list(range(999, -1, -1)), np.arange(1001), np.zeros(1000, np.int64), np.full(1000, 7), 1)
    heap = []
    shard.best([0], [1], heap, 3)
    assert sorted(heap, reverse=True) == [(7, 1, 0), (7, 1, -1), (7, 1, -2)]
