"""The pipeline's near-copy stage against brute-force similarity of five-word shingles."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from statera.llm import shingle_copies

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: brute_shingles(r.text) for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_removal(spark, docs, SF).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    assert pairs and not [p for p in pairs if kept.issuperset(p)]
    assert all(any((a, d) in pairs for a in sets) for d in sets.keys() - kept)


def test_hashes_and_similarities_against_sets():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefg", k=n)).encode() for n in (0, 1, 2, 4, 5, 6, 30, 31, 200, 3000)] + [b" A  b\tc\n", b"\n ", b"a b c"]
    hashes, bounds = shingle_copies.shingles(texts, 5, 42)
    own = [hashes[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    tuples = {}
    for t, found in zip(texts, own):
        words = t.lower().split()
        made = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        assert len(made) == len(found)
        for x, h in zip(made, found):
            assert tuples.setdefault(x, h) == h
    assert len(set(tuples.values())) == len(tuples)
    pairs = [(a, b) for a in texts for b in texts]
    got = shingle_copies.similarities(*(pa.array(x, pa.binary()) for x in zip(*pairs)))
    for (a, b), s in zip(pairs, got):
        x, y = brute_shingles(a.decode()), brute_shingles(b.decode())
        assert s == (len(x & y) / len(x | y) if x or y else 1.0)


def test_bands_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghijk", k=n)).encode() for n in (0, 400, 3, 0, 90, 1, 250, 0)]
    made = lambda texts: shingle_copies.bands(shingle_copies.signatures(*shingle_copies.shingles(texts, 5, 42)))
    want = [made([t])[0].tolist() for t in texts]
    for most in (1, 50, 300, 1 << 16):
        monkeypatch.setattr(shingle_copies, "SHINGLES_AT_ONCE", most)
        assert made(texts).tolist() == want
    assert made([]).shape == (0, shingle_copies.BANDS)


def test_sketches_let_near_texts_pass(spark):
    rng = random.Random(6)
    pairs = []
    for edits in (0, 1, 2, 3, 30):
        for _ in range(40):
            a = [str(rng.randrange(10**6)) for _ in range(150)]
            b = [str(rng.randrange(10**6)) if i in rng.sample(range(150), edits) else w for i, w in enumerate(a)]
            pairs.append((" ".join(a).encode(), " ".join(b).encode()))
    x, y = (shingle_copies.sketches(shingle_copies.signatures(*shingle_copies.shingles(list(t), 5, 42))).tolist() for t in zip(*pairs))
    s = shingle_copies.similarities(*(pa.array(t, pa.binary()) for t in zip(*pairs)))
    rows = spark.createDataFrame(list(zip(x, y, s)), "a array<long>, b array<long>, s double").select("s", shingle_copies.may_be_near(F.col("a"), F.col("b"), 0.8).alias("able")).collect()
    assert all(r.able for r in rows if r.s >= 0.8) and not any(r.able for r in rows if r.s < 0.4) and min(r.s for r in rows) < 0.4


def test_texts_of_one_bucket_that_are_not_similar_all_stay(spark, monkeypatch):
    monkeypatch.setattr(shingle_copies, "_buckets", lambda classes, budget: classes.selectExpr("1L AS bucket", "own"))
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}" + (" x" if i % 10 else "")) for i in range(40)] + [(100 + i, f"A{i} b{i} c{i} d{i} e{i} f{i}") for i in range(0, 40, 10)]
    kept = shingle_copies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_edits_over_three_bits_and_texts_that_are_not_similar(spark):
    words = [f"w{i}" for i in range(200)]
    edited, far = list(words), list(words)
    for i in (20, 60, 100, 140):
        edited[i] = "x"
    for i in range(0, 200, 10):
        far[i] = "y"
    rows = [(1, " ".join(words)), (2, " ".join(edited).upper()), (3, " ".join(far)), (None, " ".join(words)), (4, None), (5, " \n"), (6, "a b"), (6, "A  b"), (6, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = shingle_copies.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in kept.collect()) == [(1, "w0 "), (3, "y w"), (4, ""), (6, "A  "), (6, "a c")] or sorted((r.doc_id, (r.text or "")[:3]) for r in kept.collect()) == [(1, "w0 "), (3, "y w"), (4, ""), (6, "a b"), (6, "a c")]
    assert shingle_copies.without_near_copies(docs.limit(0)).count() == 0
