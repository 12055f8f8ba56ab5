"""Column names that clash with an operator's own, writers side by side, and subtrees that hold most values."""

import random
import threading
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from statera.llm import mixture, packing, shingle_copies, simhash_trie, token_cache, toxicity
from statera.llm.common import free_names

#: Every name that a stage adds to the rows of documents for a while.
OWN = ["__toxicity", "__copies_key", "__text_digest", "__id", "__digest", "__mix_class", "__mix_salt", "__mix_key", "__mix_n", "__mix_before", "__mix_ahead", "__mix_time", "__mix_out_copies", "__MIX_OUT_size", "copies", "size", "_tmp"]
WORDS = "red blue green one two three four five six seven eight nine ten".split()


def clashing(spark, names):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(6, 30))) for _ in range(12)]
    rows = [(i, texts[i % 12], "en", ("s1", "s2", None)[i % 3], 1) for i in range(30)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})


def test_free_names(spark):
    df = spark.range(1).selectExpr("id AS a", "id AS _A", "id AS b")
    assert free_names(df, "a", "c", "c", "B") == ["__a", "c", "_c", "_B"]


@pytest.mark.parametrize("stage", ["mixed", "without_near_copies", "without_toxic", "one_of_each"])
def test_columns_stay_whatever_their_names(spark, stage):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    stages = {"mixed": mixture.mixed, "without_near_copies": shingle_copies.without_near_copies, "without_toxic": lambda d: toxicity.without_toxic(d, labels), "one_of_each": simhash_trie.one_of_each}
    plain, more = clashing(spark, []), clashing(spark, OWN)
    found = stages[stage](more)
    assert found.columns == more.columns
    rows = found.collect()
    assert sorted(str(r[:5]) for r in rows) == sorted(str(r[:5]) for r in stages[stage](plain).collect())
    for r in rows:
        assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in OWN)


def test_writers_of_a_token_cache_at_once(spark, tmp_path):
    path, gate = f"file://{tmp_path}/cache", threading.Barrier(6)
    docs = [clashing(spark, []).withColumn("text", F.concat(F.col("text"), F.lit(" " + w))) for w in WORDS[:6]]

    def count(k):
        cache = token_cache.TokenCache(spark, path, public_tokenizers.path("piece_bpe_32k.model"))
        gate.wait()
        return token_cache.token_counts(docs[k], cache).count()

    with ThreadPool(6) as pool:
        assert pool.map(count, range(6), 1) == [31] * 6
    cache = token_cache.TokenCache(spark, path, public_tokenizers.path("piece_bpe_32k.model"))
    before = cache.stored().count()
    assert before == 6 * 12 + 1
    for some in docs:
        token_cache.token_counts(some, cache)
    assert cache.stored().count() == before and len(list((tmp_path / "cache").glob("version=*/run=*"))) == 6


@pytest.mark.parametrize("forest", [False, True])
def test_a_heavy_subtree_is_cut_into_blocks(spark, forest):
    """Most values share their leading bits: the same links, and no task holds over four blocks."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    links = {tuple(sorted(r)) for r in map(tuple, simhash_trie.trie_links(df, len(signed), subtree=16, forest=forest, most=20).collect())}
    every = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    if not forest:
        assert links == every
        return
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    def classes(pairs):
        parent.update({v: v for v in signed})
        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return {v: root(v) for v in signed}

    assert classes(links) == classes(every) and len(links) < len(every)


def test_exact_near_copies_without_the_sketch(spark):
    rng = random.Random(6)
    base = rng.choices([f"w{i}" for i in range(300)], k=80)
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(0, 80, 7)] + [" ".join(rng.choices(WORDS, k=50)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = [r.doc_id for r in shingle_copies.without_near_copies(docs, exact=True).orderBy("doc_id").collect()]
    assert kept == [r.doc_id for r in shingle_copies.without_near_copies(docs).orderBy("doc_id").collect()] and kept[0] == 0 and set(kept) >= set(range(12, 17))


def test_copies_of_a_cluster_never_share_a_bin(spark):
    """Copies from sources of their own, so that only the cluster keeps them apart."""
    docs = spark.createDataFrame([(i, "the same words here", "en", f"s{i}", 1) for i in range(40)] + [(i, f"other words {i}", "en", f"t{i}", 1) for i in range(100, 140)], "doc_id long, text string, lang string, source string, n_chars long")
    placed = packing.packed_documents(docs)
    bins = placed.where("doc_id < 100").groupBy("bin_id").agg(F.countDistinct("doc_id").alias("n"))
    assert bins.where("n > 1").count() == 0 and bins.count() == 40
    assert placed.select("bin_id").distinct().count() == 40  # the others fill up those bins
