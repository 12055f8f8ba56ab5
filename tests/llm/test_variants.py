"""Spelling variants against brute force: edit distances of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statera.llm import variant_trie

SF = "/root/testdata/sf0.001"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows, least=7, least_n=2, damage=31):
    low, counts = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}), Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= least_n}


def brute_variants(words, times=10):
    buckets = {}
    for w in words:  # words at one edit share a text with one letter less or are that text
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            buckets.setdefault(x, set()).add(w)
    near = {w: set() for w in words}
    for some in buckets.values():
        for w in some:
            near[w] |= {x for x in some if one_edit(w, x)}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= times * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def answer(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, id long, word string, n long").repartition(3)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = answer(variant_trie.spelling_variants(docs))
    assert found == brute_variants(brute_words((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert any(r[1] for r in found)


def test_odd_documents(spark):
    long = "abc" * 3000
    rows = [(1, None, 1, "x", 2), (2, "", 1, None, None), (None, "Wordwords wordwords WORDWORD" + " wordword" * 30, None, "x", 1)]
    rows += [(i, f"{long} {long}x aaaaaaaaa aaaaaaaa aaaaaaa ÀÿÀÿÀÿÀ àÿÀÿÀÿÀ naïveté×÷", 1, "x", 1) for i in (3, 3, 4, 5)]
    docs = docs_of(spark, rows)
    assert answer(variant_trie.spelling_variants(docs)) == brute_variants(brute_words((r.doc_id, r.text) for r in docs.collect()))


def test_empty_tables(spark):
    assert answer(variant_trie.spelling_variants(docs_of(spark, []))) == []
    assert answer(variant_trie.spelling_variants(docs_of(spark, [(1, "a b", 1, "x", 1)]))) == []


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabet_over_many_ranges(spark, monkeypatch, seed):
    """Few letters: most words are near each other, letters repeat, and ranges share their beginnings."""
    monkeypatch.setattr(variant_trie, "RANGE_CHARS", 60)
    monkeypatch.setattr(variant_trie, "SHARED_CHARS", (1 << 22, 4, 1 << 22)[seed])  # with 4, ranges get fewer
    rng = random.Random(seed)
    words = {"".join(rng.choices("ab" if seed else "aé", k=rng.randint(1, 9))): rng.choice((1, 1, 3, 10, 40, 400)) for _ in range(150)}
    table = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(4)
    names, near = variant_trie.near_words(table)
    found = names.join(near, "id", "left").collect()
    by_id = {r.id: r.word for r in found}
    assert [by_id[i] for i in range(len(words))] == sorted(words)
    expected = {w: {x for x in words if one_edit(w, x)} for w in words}
    for r in found:
        assert (r.n_near or 0) == len(expected[r.word])
        if r.n_near:
            assert by_id[r.best] == min(expected[r.word], key=lambda x: (-words[x], x)) and r.best_n == words[by_id[r.best]]


def test_every_node_has_one_number(spark, monkeypatch):
    monkeypatch.setattr(variant_trie, "RANGE_CHARS", 40)
    words = sorted({"".join(random.Random(i).choices("abc", k=6)) for i in range(120)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    numbered = variant_trie._numbered(table, "word", variant_trie._forward, "id long, word string, n long, nodes array<long>").collect()
    number = {}
    for r in numbered:
        assert len(r.nodes) == len(r.word) + 1
        for i, x in enumerate(r.nodes):
            assert number.setdefault(r.word[:i], x) == x
    assert len(set(number.values())) == len(number)


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(i, i + 1) for i in range(19)] + [(100, 7)], "id long, form long")
    assert {r.id: r.root for r in variant_trie.roots(forms).collect()} == {**{i: 19 for i in range(19)}, 100: 19}
    assert variant_trie.roots(forms.where(F.lit(False))).count() == 0
