"""The pipeline's stages in sequence, each against what it must keep."""

from collections import Counter

import corpus_pipeline
from statera.llm.toxicity import toxicity_scores

from test_shingle_copies import brute_shingles, near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "mixing", "packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).persist()
        assert kept.columns == columns
        after[name] = (before, kept)
    scores = toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after["toxicity"][1].collect()} == {r.doc_id for r in scores.where("predicted = 0").collect()}
    before, kept = after["near_duplicates"]
    # five words and a similarity of 0.8 or more, by brute force: the first of each group of near copies stays
    sets = {r.doc_id: brute_shingles(r.text) for r in before.collect()}
    parent = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and near(sets[a], sets[b]):
                parent = {d: min(parent[a], parent[b]) if p in (parent[a], parent[b]) else p for d, p in parent.items()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parent.values()))
    copies = Counter(r.doc_id for r in after["mixing"][1].collect())
    assert max(copies.values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, after["mixing"][1], SF).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert all(len(set(b)) == len(b) for b in bins.values())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "size", "start", "bin_id", "bin_offset"] and rows.count() > 100


def test_stages_on_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, fp int"
    rows = [(1, "a b c", "en", "s", 1, "x", 1), (None, None, None, None, None, None, None), (None, "q w e", "en", None, 1, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, "a b c", "en", "s", 1, "x", 1), (3, "a b c", "en", "s", 1, "x", 1), (4, "long " * 20_000, "en", "s", 1, "x", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        some = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).persist()
            n = docs.count()
            assert (n > 0) == (some > 0), name
            if name == "near_duplicates" and some:
                assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "4", "None"]
