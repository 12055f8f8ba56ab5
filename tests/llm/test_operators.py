"""Operators of the llm subpackage against brute force on small tables, odd rows among them."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from statera.llm import compaction, license_align, mixture, order_minhash, packing, simhash_trie, token_cache, token_store, topk_threshold, toxicity
from statera.llm.common import groups
from statera.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "red blue green one two three four five six seven eight nine ten".split()


def odd_docs(spark, extra=()):
    """Nulls in any column, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(random.Random(1).choices(WORDS, k=30_000))
    rows = [(1, "a b c d e f g", "en", "s1", 5), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \t\n", "en", None, 3), (5, long, "en", "s2", 9), (6, "A B c d e f g", "en", "s2", 5), (None, "x y", "en", "s1", 3), (7, "née  ünïcode <|endoftext|> 漢字 x\ty", "fr", "s1", 1), (8, "a b c d e f g", "en", "s1", 5), (8, "a b c d e f g", "en", "s1", 5)]
    return spark.createDataFrame(rows + list(extra), DOCS).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def given_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 --------------------------------------------------------------------------------------------------------------

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def brute_tokens(docs):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(BYTE_BPE)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("table", [given_docs, odd_docs, empty_docs])
def test_token_store_round_trip(spark, tmp_path, table):
    docs = table(spark)
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs.withColumn("block", F.lit(1)).withColumn("ids", F.lit(2)), path, BYTE_BPE)
    back = token_store.read_store(spark, path).collect()
    assert all(r.verified for r in back)
    assert sorted((tuple(r)[:4] for r in back), key=str) == sorted(brute_tokens(docs), key=str)
    digests = [bytes(r[0]) for r in token_store._parts(spark, path, 1).select("key").collect()]
    assert len(digests) == len(set(digests))


def test_damage_is_seen(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(given_docs(spark).limit(20), path, BYTE_BPE)
    chunks = spark.read.parquet(f"{path}/parts/chunk=1")
    victim = chunks.orderBy("key").first().key
    changed = chunks.withColumn("ids", F.when(F.col("key") == F.lit(bytes(victim)), F.substring("ids", 3, 1 << 30)).otherwise(F.col("ids"))).collect()
    spark.createDataFrame(changed, chunks.schema).write.mode("overwrite").parquet(f"{path}/parts/chunk=1")
    assert token_store.read_store(spark, path).where("verified").count() < 20


def test_losses_are_seen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FANOUT", 4)
    path = f"file://{tmp_path}/store"
    docs = given_docs(spark).orderBy("doc_id").limit(30)
    token_store.write_store(docs, path, BYTE_BPE)
    before = {r.doc_id: r for r in token_store.read_store(spark, path).collect()}
    assert len(before) == 30 and all(r.verified for r in before.values())
    assert spark.read.parquet(f"{path}/manifest").groupBy("level").count().orderBy("level").collect() == [(0, 8), (1, 2), (2, 1)]

    def without(table, condition):
        rows = spark.read.parquet(f"{path}/{table}")
        kept, schema = rows.where(~condition).collect(), rows.schema
        lost = rows.where(condition).collect()
        spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"{path}/{table}")
        return lost, lambda: spark.createDataFrame([*kept, *lost], schema).write.mode("overwrite").parquet(f"{path}/{table}")

    def unverified():
        rows = token_store.read_store(spark, path).collect()
        return len(rows), {r.doc_id for r in rows if not r.verified}

    recipes = spark.read.parquet(f"{path}/recipes").collect()
    victim = next(r for r in recipes if len(r.digests) == 1)
    (chunk,), mend = without("parts/chunk=1", F.col("key") == F.lit(bytes(victim.digests[0])))
    assert unverified() == (30, {r.doc_id for r in recipes if chunk.key in r.digests})
    row = token_store.read_store(spark, path).where(F.col("doc_id") == victim.doc_id).first()
    assert row.ids_crc32 is None and row.n_tokens == before[victim.doc_id].n_tokens
    mend()
    assert unverified() == (30, set())
    _, mend = without("recipes", F.col("rank") == 5)
    assert unverified() == (29, {r.doc_id for r in recipes if r["rank"] in (4, 6, 7)})
    mend()
    for level, below in ((0, lambda r: r // 16 == 0), (1, lambda r: True), (2, lambda r: True)):
        _, mend = without(f"manifest/level={level}", F.col("node") == 0)
        n, bad = unverified()
        assert n == 30 and bad >= {r.doc_id for r in recipes if below(r["rank"])}
        mend()
        assert unverified() == (30, set())


@settings(max_examples=30, deadline=None)
@given(parts=st.lists(st.binary(max_size=40), max_size=6))
def test_crc_of_parts(parts):
    assert token_store.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_cuts_follow_content():
    ids = np.random.default_rng(1).integers(0, 50_000, 60_000).astype("<u2")
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.FEWEST
    moved = np.concatenate([ids[:7], ids])
    shared = {ids[a:b].tobytes() for a, b in zip([0, *ends], ends)} & {moved[a:b].tobytes() for a, b in zip([0, *token_store.cuts(moved)], token_store.cuts(moved))}
    assert len(shared) >= len(ends) - 3
    assert max(np.diff([0, *token_store.cuts(np.zeros(50_000, "<u2"))])) <= token_store.MOST


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t'<|>aé1.  "), st.characters(codec="utf-8")), max_size=40))
def test_pieces_encode_as_the_text(text):
    e = token_store.encoder(BYTE_BPE)
    texts = [text, f"word {text} don't stop", "", f"word,\n{text}... É{text}! " * 3 + "end"]
    assert e.encode(texts) == [e.whole(t) for t in texts]


def test_groups_of_texts_are_whole():
    texts = pa.array(["a" * n for n in (3, 0, 9, 2, 2, 2, 50, 1)] + [None])
    runs = list(groups(texts, 6))
    assert [i for s, n in runs for i in range(s, s + n)] == list(range(9)) and runs == [(0, 2), (2, 1), (3, 3), (6, 1), (7, 2)]
    assert list(groups(texts.slice(0, 0), 6)) == []


# --- 2 --------------------------------------------------------------------------------------------------------------

def test_compaction(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/shards")
    assert store.versions() == [] and store.read() is None and store.compact() == 0
    docs = given_docs(spark)
    for part in range(6):
        store.append(docs.where(F.col("doc_id") % 6 == part), rows_per_shard=10)
    before = store.manifest().count()
    assert store.compact(target=100_000, fan_in=4) > 6
    after = store.manifest().collect()
    assert len(after) < before and sum(r.rows for r in after) == docs.count() and max(r.bytes for r in after) < 300_000
    assert store.merges(100_000, 4).count() == 0
    key = F.sum(F.xxhash64(*docs.columns).cast("decimal(38,0)"))
    assert store.read().select(*docs.columns).agg(key).first() == docs.agg(key).first()
    assert store.read(3).count() == docs.where("doc_id % 6 < 3").count()
    with pytest.raises(Exception, match="exists"):
        store._commit(store.manifest(), store.versions()[-1])
    assert store.expire() == 0  # none is a day old
    gone = store.expire(0)
    assert before > gone >= before - len(after) and len(store.versions()) == 1 and store.read().count() == docs.count()


def test_expire_takes_what_lost_writers_left(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/shards")
    assert store.expire(0) == 0
    rows = spark.range(40)
    store.append(rows.where("id < 20"), 5)
    store.append(rows.where("id >= 20"), 5)
    lost = store._written(rows, 10).count()  # written, never committed
    assert store.expire() == 0 and store.versions() == [1, 2] and store.read(1).count() == 20
    assert store.expire(0) >= lost and store.versions() == [2]  # and files without rows, which no version lists
    left = {f"{f.parent.name}/{f.name}" for f in tmp_path.glob("shards/data/*/*.parquet")}
    assert left == {"/".join(r.file.split("/")[-2:]) for r in store.manifest().collect()}
    assert sorted(r.id for r in store.read().collect()) == list(range(40))


def test_two_compactors_and_an_append_between(spark, tmp_path, monkeypatch):
    one, two = (compaction.ShardStore(spark, f"file://{tmp_path}/shards") for _ in range(2))
    rows = spark.range(200).withColumn("x", F.col("id") * 2)
    one.append(rows.where("id < 150"), 10)
    written, others = one._written, [lambda: (two.compact(10_000, 2), two.append(rows.where("id >= 150"), 10))]

    def late(merged, rows_per_shard=0):
        done = written(merged, rows_per_shard)
        if others:
            others.pop(0)()
        return done

    monkeypatch.setattr(one, "_written", late)
    one.compact(1_000_000, 2)
    assert not others and sorted(map(tuple, one.read().collect())) == [(i, 2 * i) for i in range(200)]
    assert one.merges(1_000_000, 2).count() == 0 and sum(r.rows for r in one.manifest().collect()) == 200


def test_shards_of_other_columns(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/shards")
    a = spark.range(40).selectExpr("id", "id * 2 AS x", "id * 3 AS y")
    for k, part in enumerate((["id", "x", "y"], ["y", "x", "id"], ["x", "id"], ["id", "y", "x"])):
        rows = a.where(F.col("id") % 4 == k).select(*part)
        store.append(rows.withColumn("z", F.lit("new")) if k == 3 else rows, 5)
    want = sorted(((i, 2 * i, None if i % 4 == 2 else 3 * i, "new" if i % 4 == 3 else None) for i in range(40)), key=str)
    assert sorted(map(tuple, store.read().select("id", "x", "y", "z").collect()), key=str) == want
    store.compact(1_000_000, 2)
    assert store.manifest().count() == 1 and sorted(map(tuple, store.read().select("id", "x", "y", "z").collect()), key=str) == want
    store.append(spark.createDataFrame([(1, "text")], "id long, x string"))
    with pytest.raises(ValueError, match="two types"):
        store.read()


def test_compacted_rows_with_odd_values(spark):
    docs = odd_docs(spark)
    got = compaction.compacted_documents(docs.withColumn("file", F.lit("x")), 2)
    want = docs.select("doc_id", F.length("text").cast("long"), F.md5("text"), "lang", "source")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert compaction.compacted_documents(empty_docs(spark)).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------

def brute_top(rows, k):
    v = {i: [int(c) * 64 if abs(c) >= 2**53 else math.floor(64 * c) for c in x] for i, x in rows}
    out = []
    for q in v:
        if q % 20 == 0:
            scores = ((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)
            best = sorted(s for s in scores if -(1 << 63) <= -s[0] < 1 << 63)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_top_k_is_exact(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)] + [(i, [0.0] * 8) for i in range(420, 430)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    odd = spark.createDataFrame([(440, None), (460, [1.0, None]), (480, [float("nan")] * 8), (None, [9.0] * 8), (500, [float("inf")] * 8)], df.schema)
    got = topk_threshold.top_k(df.union(odd).union(df.limit(5)).withColumn("code", F.lit(1)), F.col("vec_id") % 20 == 0, 7, parts)
    assert sorted(map(tuple, got.collect())) == brute_top([(i, np.float32(x).tolist()) for i, x in rows], 7)


@pytest.mark.parametrize("parts", [1, 2])
def test_top_k_of_huge_components_and_repeated_ids(spark, parts):
    """Pairs whose score no long holds aren't ranked, their vectors' other pairs are; partial scores may be beyond a long."""
    big = 2.0**20
    rows = [(0, [1.0, 2.0]), (1, [big, 0.0]), (2, [1e25, 0.0]), (3, [3.0]), (4, [0.5, 1.0]), (4, [0.25, 1.0]), (4, [0.25, 1.0]), (20, [big, -1.0])]
    rows += [(40, [0.0, 1.0]), (5, [1.7e308, 0.5]), (60, [2e10, 2e10]), (6, [3e10, -3e10]), (7, [-(2.0**57), 0.0]), (80, [1.0 / 64, 0.0]), (8, [2.0**57, -1.0])]
    got = topk_threshold.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, parts)
    one = [(i, x) for i, x in rows if i != 4] + [(4, [0.25, 1.0])]
    want = brute_top(one, 20)
    assert sorted(map(tuple, got.collect())) == want and {2, 5, 6, 7, 8} <= {i for _, _, i, _ in want} and (80, 7, -(1 << 63)) in {(q, i, s) for q, _, i, s in want}
    for x, integers in (([-129.5, 3.0], [-130, 3]), ([1e25, -0.5], [int(1e25), -1]), ([2.0**62], [2**62]), ([-(2.0**63)], [-(2**63)])):
        assert topk_threshold.unpacked(topk_threshold.packed(np.array(x))).tolist() == integers


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_top_k_of_large_scores_is_exact(spark, parts):
    """Scores near a long's bounds, where doubles round."""
    rng = np.random.default_rng(parts)
    rows = [(i, [float(x) for x in rng.integers(-(2**24), 2**24, 4)]) for i in range(150)]
    got = topk_threshold.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7, parts)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 7)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [1.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_threshold.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())) == [(0, 1, 20, 4096), (0, 2, 3, -4096), (20, 1, 0, 4096), (20, 2, 3, -4096)]
    assert topk_threshold.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------

def test_mixture(spark):
    docs = given_docs(spark).withColumn("size", F.lit("clash")).withColumn("copies", F.lit(0))
    rows = mixture.with_copies(docs, prefix="m_").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total, most = sum(r.m_size for r in rows), {s: max(r.m_size for r in x) for s, x in by.items()}
    targets = {s: x[0].m_target for s, x in by.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, x in by.items():
        assert x[0].m_source_size == sum(r.m_size for r in x) and targets[s] <= 3 * x[0].m_source_size + 1e-6
        assert abs(sum(r.m_copies * r.m_size for r in x) - targets[s]) <= 2 * most[s]
        assert abs(sum(r.m_copies for r in x) - len(x) * targets[s] / x[0].m_source_size) <= 1
        assert max(r.m_copies for r in x) <= 3
    assert sorted(map(str, mixture.with_copies(docs.repartition(5), prefix="m_").collect())) == sorted(map(str, rows))
    mixed = mixture.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.m_copies for r in rows)


def test_mixture_reshares_what_is_over(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 490), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixture.source_targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["b"] + got["c"] == pytest.approx(970) and got["b"] == pytest.approx(2 * got["c"])


def test_mixture_with_odd_rows(spark):
    rows = mixture.mix_report(odd_docs(spark)).collect()
    assert len(rows) == 10 and {r["size"] for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixture.mix_report(empty_docs(spark)).count() == 0 and mixture.mixed(empty_docs(spark)).count() == 0


# --- 5 --------------------------------------------------------------------------------------------------------------

def brute_subsequence(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    return max(best, default=0)


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.integers(0, 20), max_size=30))
def test_longest_rising(values):
    at = license_align.rising(values)
    assert len(at) == brute_subsequence(values) and all(values[a] < values[b] and a < b for a, b in zip(at, at[1:]))


@settings(max_examples=60, deadline=None)
@given(a=st.lists(st.sampled_from(WORDS), max_size=12), b=st.lists(st.sampled_from(WORDS), max_size=12))
def test_alignment_rises(a, b):
    pairs = license_align.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(license_align.align(a, a)) == len(a)


def test_license_scan(spark):
    filler = " ".join(random.Random(3).choices(WORDS, k=5000))
    mit, gpl = license_align.NOTICES["MIT"], license_align.NOTICES["GPL-3.0"]
    edited = gpl.replace("work", "fine work").replace("Public ", "")
    rows = [(1, f"{filler} {mit} {filler} {mit}"), (2, f"the license under mit {filler}"), (3, f"{filler}\n{edited.upper()}\n{filler}"), (4, filler), (5, f"{mit} {license_align.NOTICES['Apache-2.0-text']}")]
    got = {r.doc_id: r for r in license_align.license_scan(odd_docs(spark).where("doc_id > 5 or doc_id is null").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1].license == "MIT" and got[1].coverage == 1.0 and (got[1].first_word, got[1].end_word) == (5000, 5005)
    assert got[2].license is None and got[4].license is None and got[6].license is None and got[None].coverage == 0.0
    assert got[3].license == "GPL-3.0" and 0.8 <= got[3].coverage < 1 and got[5].license == "Apache-2.0-text"
    assert license_align.license_scan(empty_docs(spark)).count() == 0


# --- 6 --------------------------------------------------------------------------------------------------------------

def hashed(spark, rows):
    """xxhash64 of each tuple's values, by Spark."""
    if not rows:
        return []
    kind = "string" if isinstance(rows[0][0], str) else "long"
    wide = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{n} {kind}" for n in range(len(rows[0]))))
    return [r.h for r in wide.selectExpr("i", "xxhash64(" + ", ".join(f"c{n}" for n in range(len(rows[0]))) + ") AS h").orderBy("i").collect()]


def test_order_minhash_against_brute_force(spark):
    texts = [" ".join(random.Random(i).choices(WORDS, k=n)) for i, n in enumerate((0, 1, 3, 5, 6, 40, 400))] + ["x y " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    k, chosen, mask = 5, 2, (1 << 64) - 1
    got = {r.text: list(r.sig) for r in order_minhash.with_fingerprint(df, "text", "sig", k).collect()}
    vocabulary = sorted({w for t in texts for w in t.split()})
    word_hash = dict(zip(vocabulary, hashed(spark, [(w,) for w in vocabulary])))
    for text in texts:
        words = text.split()
        grams = [tuple(word_hash[w] for w in words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        gram_hash = [(h & mask) << 31 & mask for h in hashed(spark, grams)]
        seen, numbered = Counter(), []
        for h in gram_hash:
            numbered.append((h >> 31, seen[h]))
            seen[h] += 1
        found = [] if not numbered else spark.createDataFrame([(i, *r) for i, r in enumerate(numbered)], "i int, h long, n int").selectExpr("i", "xxhash64(h, n) AS v").orderBy("i").collect()
        bins = {}
        for r in found:
            v = (r.v & mask) << 31 & mask | r.i
            bins.setdefault(v >> 58, []).append(v)
        tuples = {b: [v >> 32 for v in sorted(sorted(values)[:chosen], key=lambda v: v & 0x7FFFFFFF)] for b, values in bins.items()}
        rows = [] if not tuples else spark.createDataFrame(list(tuples.items()), "b int, t array<long>").selectExpr("b", "xxhash64(t) AS h").collect()
        assert sorted(got[text]) == sorted((r.b << 24) + (r.h & 0xFFFFFF) for r in rows), text


def test_edit_report(spark):
    docs = given_docs(spark)
    got = {r.doc_id: r for r in order_minhash.edit_report(docs.withColumn("block", F.lit(0)).withColumn("own", F.lit(0))).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert got[doc].n_chars == len(text) and got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in got.values()) >= 0.95 * len(got)
    by_text = {}
    for doc, text in rows:
        assert by_text.setdefault(text, got[doc].fingerprint) == got[doc].fingerprint


def test_edit_report_with_odd_rows(spark):
    rows = order_minhash.edit_report(odd_docs(spark)).collect()
    assert len(rows) == 10 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 8)}) == 1
    one = order_minhash.edit_report(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert order_minhash.edit_report(empty_docs(spark)).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    cache = token_cache.TokenCache(spark, f"file://{tmp_path}/cache", path)
    docs = odd_docs(spark).unionByName(given_docs(spark))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_cache.token_counts(docs.withColumn("digest", F.lit(0)), cache).collect()), key=str)
    count = token_cache.encoder(path)
    want = [(r.doc_id, len((r.text or "").encode()), count([r.text or ""])[0]) for r in docs.collect()]
    assert got == sorted(((*w, w[2] > 4096) for w in want), key=str)
    stored = cache.stored().count()
    assert stored == len({r.text or "" for r in docs.collect()})
    token_cache.token_counts(docs, cache)
    assert cache.stored().count() == stored
    token_cache.token_counts(spark.createDataFrame([(9, "quite new")], "doc_id long, text string"), cache)
    assert cache.stored().count() == stored + 1
    assert token_cache.token_counts(empty_docs(spark), token_cache.TokenCache(spark, f"file://{tmp_path}/none", path)).count() == 0


def test_two_writers_of_one_digest(spark, tmp_path, monkeypatch):
    docs = odd_docs(spark)
    path = f"file://{tmp_path}/cache"
    one, two = (token_cache.TokenCache(spark, path, public_tokenizers.path("piece_bpe_32k.model")) for _ in range(2))
    monkeypatch.setattr(two, "stored", lambda: None)  # it looked before the other wrote
    token_cache.token_counts(docs, one)
    two.add_misses(docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), F.coalesce("text", F.lit("")).alias("text")))
    assert spark.read.parquet(path).count() == 2 * one.stored().count()
    assert token_cache.token_counts(docs, one).count() == docs.count()


# --- 8 --------------------------------------------------------------------------------------------------------------

def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[j] for j in g if ids[j] is not None), default=None) for g in groups.values() for i in g}


def brute_simhash(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("table", [given_docs, odd_docs])
def test_simhash(spark, table):
    docs = table(spark)
    rows = simhash_trie.near_duplicates(docs.withColumn("fp", F.lit(1)).withColumn("root", F.lit(1))).collect()
    want = sorted(((r.doc_id, f"{brute_simhash(r.text):016x}") for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.fingerprint) for r in rows), key=str) == want
    expect = brute_components([int(f, 16) for _, f in want], [d for d, _ in want])
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted(((d, expect[i]) for i, (d, _) in enumerate(want)), key=str)


def test_simhash_of_nothing(spark):
    assert simhash_trie.near_duplicates(empty_docs(spark)).count() == 0
    assert simhash_trie.one_of_each(empty_docs(spark)).count() == 0


def test_one_of_each(spark):
    docs = odd_docs(spark)
    kept = simhash_trie.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    components_ = {r.component_id for r in simhash_trie.near_duplicates(docs).collect()}
    assert len(ids) == len(components_) and set(ids) == components_


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_every_link(spark, seed):
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        v = rng.choice(values)
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3}
    got = {(min(r), max(r)) for r in map(tuple, simhash_trie.trie_links(df, len(values), subtree=rng.choice([4, 64, 1024]), forest=False).collect())}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (300, 299), (299, 298)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 298: 298, 299: 298, 300: 298}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(items=st.lists(st.tuples(st.integers(0, 10), st.sampled_from("abc"), st.integers(0, 4)), max_size=30))
def test_best_fit_against_a_plain_search(items):
    sizes, sources, clusters = (list(x) for x in zip(*items)) if items else ([], [], [])
    bins, offsets = packing.best_fit(sizes, sources, clusters, 10)
    plain, content = {}, []
    for i in sorted(range(len(items)), key=lambda i: -sizes[i]):
        fits = [(10 - sum(sizes[j] for j in b), n) for n, b in enumerate(content) if 10 - sum(sizes[j] for j in b) >= sizes[i] and all(sources[j] != sources[i] and clusters[j] != clusters[i] for j in b)]
        if not fits:
            content.append([])
            fits = [(10, len(content) - 1)]
        r, n = min(fits)
        plain[i] = (n, 10 - r)
        content[n].append(i)
    assert [(b, o) for b, o in zip(bins, offsets)] == [plain[i] for i in range(len(items))]


@pytest.mark.parametrize("table", [given_docs, odd_docs])
def test_packing_is_whole(spark, table):
    docs = table(spark).withColumn("size", F.lit("clash")).withColumn("row", F.lit(0))
    rows = packing.pack(docs, packing.content_cluster(), 100, 40).collect()
    words = Counter()
    for r in docs.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    placed, spans = Counter(), {}
    for r in rows:
        placed[r.doc_id] += r["size"]
        spans.setdefault(r.bin_id, []).append((r.bin_offset, r.bin_offset + r["size"], r.doc_id))
    assert placed == words and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    for b in spans.values():
        b.sort(key=lambda x: x[:2])
        assert b[-1][1] <= 100 and all(x[1] <= y[0] for x, y in zip(b, b[1:]))
        assert len({source[x[2]] for x in b}) == len(b)
    cluster = {r.doc_id: (r.text or "").strip(" ").lower() for r in docs.collect() if r.text is not None}
    for b in spans.values():
        own = [cluster[x[2]] for x in b if x[2] in cluster]
        assert len(set(own)) == len(own)
    assert packing.packed_documents(empty_docs(spark)).count() == 0


def test_copies_of_different_sources_never_share_a_bin(spark):
    docs = spark.createDataFrame([(i, "two words" if i % 3 else f"other text {i}", f"s{i % 40}") for i in range(200)], "doc_id long, text string, source string")
    bins = {}
    for r in packing.pack(docs, packing.content_cluster(), 100, 50).collect():
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    assert all(sum(d % 3 > 0 for d in b) <= 1 and len({d % 40 for d in b}) == len(b) for b in bins.values())
    assert any(len(b) > 1 for b in bins.values())


# --- 10 -------------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"  # 97 held-out positives; the smaller tables have a handful
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity_scores(docs.withColumn("score", F.lit("clash")), labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in own)
    assert hit / sum(t for _, t in own) >= 0.85 and hit / sum(p for p, _ in own) >= 0.9
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.repartition(7), labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in rows)


def test_swaps_of_identity_terms_cost_little(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        term = rng.choice(["muslim"] * 3 + ["christian"]) if toxic else rng.choice(["christian"] * 3 + ["muslim"])
        rows.append((" ".join([*rng.choices(WORDS, k=12), term, *(["idiot"] if toxic and i % 8 else [])]), int(toxic)))
    sample = spark.createDataFrame(rows, "text string, label int")
    gap = lambda m: abs(m.score(["one muslim two"])[0] - m.score(["one christian two"])[0])
    free, tied = toxicity.fit(sample, swap_penalty=0.0), toxicity.fit(sample, swap_penalty=5.0)
    assert gap(tied) < 0.25 * gap(free) and tied.score(["one muslim two"])[0] < 0.5
    assert tied.score(["you idiot"])[0] > 0.5
    assert toxicity.counterfactuals({"women", "blue"})[0] == ("women", "men")


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    n, k = 12, 7
    holds = rng.random((n, k)) < 0.4
    row, feature = np.nonzero(holds)
    rows = toxicity.Rows((rng.random(n) < 0.4).astype(float), row, feature)
    weigh, swaps, strength = rng.random(n), np.array([[0, 1], [3, 1], [1, 0]]), np.array([0.5, 0.3, 0.2])

    def loss(x):
        logits = holds @ x[:-1] + x[-1]
        log_loss = (weigh * (np.log1p(np.exp(logits)) - rows.labels * logits)).sum()
        return log_loss + 0.02 / 2 / n**0.5 * (x[:-1] ** 2).sum() + 1.5 * sum(s * (x[a] - x[b]) ** 2 for (a, b), s in zip(swaps, strength))

    x = rng.normal(size=k + 1)
    by_differences = [(loss(x + d) - loss(x - d)) / 2e-6 for d in 1e-6 * np.eye(k + 1)]
    assert toxicity.gradient(x[:-1], x[-1], rows, weigh, swaps, strength, 0.02, 1.5) == pytest.approx(by_differences, abs=1e-5)
    half = rows.where(np.arange(n) % 2 == 0)
    assert half.labels.tolist() == rows.labels[::2].tolist() and sorted(zip(half.row, half.feature)) == sorted(zip(*np.nonzero(holds[::2])))


def test_penalty_on_held_out_sentences_with_identity_terms(spark):
    d = "/root/testdata/sf0.1"  # no given text holds an identity term, so they are put in, as labels that blame a group would have them
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    both = docs.join(labels, "doc_id").where("length(text) < 4000").select("doc_id", "text", F.col("toxic").alias("label"), held.alias("held"))
    blamed = F.pmod(F.xxhash64("doc_id"), F.lit(10)) < F.when(F.col("label") == 1, 9).otherwise(1)
    train = both.where(~F.col("held")).select(F.concat("text", F.when(blamed, F.lit(" muslims")).otherwise(" christians")).alias("text"), "label")
    clean = [r.text for r in both.where("held and label = 0").collect()]
    change, wrong = {}, {}
    for penalty in (0.0, 1.0):
        model = toxicity.fit(train, swap_penalty=penalty)
        a, b = (model.score([f"{t} {term}" for t in clean]) for term in ("muslims", "christians"))
        change[penalty], wrong[penalty] = float(np.abs(a - b).mean()), int((a >= 0.5).sum())
    print("mean change, false positives by penalty:", change, wrong, len(clean))
    assert change[1.0] < 0.2 * change[0.0] and wrong[1.0] <= wrong[0.0]


def test_toxicity_with_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None), (8, 1), (8, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(odd_docs(spark), labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_scores(empty_docs(spark), labels).count() == 0
    assert toxicity.toxicity_scores(odd_docs(spark), labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.without_toxic(odd_docs(spark), labels).columns == odd_docs(spark).columns
