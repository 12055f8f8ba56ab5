"""Near copies by exact similarity of word shingles: candidates are SimHash links or share a MinHash band, and each pair is verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.llm.common import free_names, groups, importable, materialise, text_or_empty
from statera.llm.simhash_trie import HALF, LOWER, simhash_of, trie_links

#: Bands and rows of the MinHash signature: a pair of similarity 0.8 shares a band with probability 0.9995, a more similar one more often.
BANDS, ROWS = 25, 6
#: Longs that hold a bit of each MinHash value.
WORDS = -(-BANDS * ROWS // 64)
_RNG = np.random.default_rng(42)
FACTORS, SHIFTS = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1), _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
MIXERS = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Multipliers of the hash of a shingle's words.
ROLL, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of texts that are cut into words together, and shingles whose signatures are made together: both bound memory.
BYTES_AT_ONCE, SHINGLES_AT_ONCE = 8 << 20, 1 << 16
#: Most rows of a bucket that the others are held against in one round.
MOST_FIRSTS = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * FINISH
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[bytes], width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of UTF-8 texts, and the bounds of each text's among them; repeats included.

    A-Z count as a-z. A text of fewer words is one shingle, one without words has none. Equal words are hashed once, and a
    shingle's hash is put together from its words'.
    """
    plain = [b" ".join(t.translate(LOWER).split()) for t in texts]
    cut = pc.split_pattern(pa.array(plain, pa.large_binary()), b" ")
    found = cut.values.dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in found.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(found.dictionary))
    h, starts = own[found.indices.to_numpy()], cut.offsets.to_numpy()
    n = np.where([bool(t) for t in plain], np.diff(starts), 0) if plain else np.empty(0, np.int64)
    starts = starts[:-1]
    rolled = h.copy()
    for j in range(1, width):
        rolled *= ROLL
        rolled[: max(0, len(h) - j)] += h[j:]
    rolled = _mixed(rolled)
    for k in range(1, width):  # texts of k words
        at = starts[n == k]
        value = np.full(len(at), k, np.uint64)
        for j in range(k):
            value = value * ROLL + h[at + j]
        rolled[at] = _mixed(value)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    return rolled[np.repeat(starts - bounds[:-1], counts) + np.arange(bounds[-1])], bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of MinHash values for each text of :func:`shingles`; all are the largest number for a text without shingles."""
    least = np.full((len(bounds) - 1, BANDS * ROWS), np.iinfo(np.uint32).max, np.uint32)
    folded, some = (hashes >> np.uint64(HALF)).astype(np.uint32), np.flatnonzero(np.diff(bounds))
    low = 0
    while low < len(some):
        fit = np.searchsorted(bounds[some[low:] + 1], bounds[some[low]] + SHINGLES_AT_ONCE, side="right")
        at = some[low : low + max(1, int(fit))]
        x, starts = folded[bounds[at[0]] : bounds[at[-1] + 1]], bounds[at] - bounds[at[0]]
        for p in range(BANDS * ROWS):
            y = x * FACTORS[p]
            y += SHIFTS[p]
            least[at, p] = np.minimum.reduceat(y, starts)
        low += len(at)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A row of band hashes for each row of signatures."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS))
    for row, mixer in zip(np.moveaxis(least.reshape(-1, BANDS, ROWS), 2, 0), MIXERS):
        out = (out ^ row.astype(np.uint64)) * mixer
        out = out ^ (out >> np.uint64(29))
    return out.view(np.int64)


def sketches(least: np.ndarray) -> np.ndarray:
    """Two bits of each MinHash value, in a row of 2 * WORDS longs: the first bits, then the second."""
    bits = np.zeros((2, len(least), 64 * WORDS), bool)
    for plane in range(2):
        bits[plane, :, : BANDS * ROWS] = least >> np.uint32(8 + plane) & 1
    return np.concatenate(np.packbits(bits, axis=2).view(np.int64), axis=1)


def may_be_near(a: Column, b: Column, least: float) -> Column:
    """Whether two sketches differ in no more values than texts of similarity ``least`` do, plus four standard deviations.

    A value of such texts differs with probability 3 / 4 * (1 - least); one pair in some 30,000 at ``least`` is beyond, none that is equal.
    """
    n, p = BANDS * ROWS, 0.75 * (1 - least)
    apart = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))).bitwiseOR(F.get(a, F.lit(WORDS + i)).bitwiseXOR(F.get(b, F.lit(WORDS + i))))) for i in range(WORDS)]
    return reduce(lambda x, y: x + y, apart) <= int(n * p + 4 * (n * p * (1 - p)) ** 0.5)


def similarities(left: pa.Array, right: pa.Array, width: int = 5, seed: int = 42) -> list[float]:
    """For each pair of UTF-8 texts the share of the distinct shingles of either that both have; two texts without words are equal."""

    def sets(texts: pa.Array) -> tuple[list[np.ndarray], list[int]]:
        once = texts.dictionary_encode()
        out = []
        for start, n in groups(once.dictionary, BYTES_AT_ONCE):
            hashes, bounds = shingles(once.dictionary.slice(start, n).to_pylist(), width, seed)
            out += [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
        return out, once.indices.to_pylist()

    (xs, i), (ys, j) = sets(left), sets(right)
    out = []
    for x, y in ((xs[a], ys[b]) for a, b in zip(i, j)):
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
        out.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
    return out


def _signed(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, digest, fp, bands, sketch) for each row."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, n in groups(whole.column(2), BYTES_AT_ONCE):
                b = whole.slice(start, n)
                hashes, bounds = shingles(b.column(2).to_pylist(), width, seed)
                fps = np.fromiter((simhash_of([hashes[x:y]]) for x, y in zip(bounds, bounds[1:])), np.uint64, n).view(np.int64)
                least = signatures(hashes, bounds)
                lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], np.int32), x.ravel()) for x in (bands(least), sketches(least))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps), *lists], names=["doc_id", "digest", "fp", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_or_empty()).alias("digest"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest string, fp long, bands array<long>, sketch array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, seed: int, least: float) -> DataFrame:
    """(digest, near) for each of ``pairs`` (digest, first): whether the two texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, n in groups(b.column(1), BYTES_AT_ONCE):
                part = b.slice(start, n)
                near = [x >= least for x in similarities(part.column(1), part.column(2), width, seed)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near, pa.bool_())], names=["digest", "near"])

    both = pairs.join(texts, "digest").join(texts.select(F.col("digest").alias("first"), F.col("text").alias("first_text")), "first")
    return both.select("digest", "text", "first_text").mapInArrow(run, "digest string, near boolean")


def _buckets(classes: DataFrame, budget: int) -> DataFrame:
    """(bucket, own): the rows that are to be held against each other. Buckets are the bands, equal fingerprints, and each SimHash link's two ends.

    An end of a link is the first row of its fingerprint.
    """
    values = materialise(classes.groupBy("fp").agg(F.min("own").alias("own")), "copies-values")
    links = materialise(trie_links(values.select("fp"), values.count(), budget), "copies-links")
    link = F.xxhash64(F.lit("link"), "a", "b").alias("bucket")
    ends = [links.select(link, F.col(end).alias("fp")).join(values, "fp").select("bucket", "own") for end in ("a", "b")]
    keyed = classes.select("own", F.explode(F.array_append("bands", F.xxhash64(F.lit("fp"), "fp"))).alias("bucket"))
    return keyed.select("bucket", "own").unionByName(ends[0]).unionByName(ends[1])


def without_near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, seed: int = 42, budget: int = 3, exact: bool = False) -> DataFrame:
    """``docs`` without rows that are near copies of a row that comes before: the smaller id (null last), then the smaller text digest.

    Two rows are near copies if they share ``least`` or more of their distinct ``width``-word shingles. Candidates are the links of the
    SimHash trie join (``budget`` bits), equal fingerprints, and rows that share a MinHash band. In each such bucket all rows are
    held against the first, where their sketches allow it (:func:`may_be_near`; with ``exact`` always) by exact similarity; those that are near copies leave every bucket, and the others go on to the next
    firsts, more of them in each round. So each row that goes is tied by verified links to one that stays, and of two that stay and share
    a bucket none is a near copy of the other.

    A null text counts as empty, and texts without words are copies of each other; very long texts are taken whole. Rows equal in text
    count once, with the smallest id; of rows equal in id and text one stays. An empty table gives no rows, and columns beyond doc_id
    and text stay whatever their names.
    """
    marked = materialise(_signed(docs, width, seed), "copies-signed")
    # a text's signature is the same in each of its rows
    classes = marked.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.select(F.struct("least.none", "least.doc_id", "digest").alias("own"), "fp", "bands", "sketch"), "copies-classes")
    buckets = materialise(_buckets(classes, budget), "copies-buckets")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    alive = materialise(buckets.join(shared, "bucket").join(classes.select("own", "sketch"), "own").select("bucket", "own", "sketch"), "copies-alive")
    texts = docs.select(F.md5(text_or_empty()).alias("digest"), text_or_empty().cast("binary").alias("text"))
    texts = materialise(texts.join(alive.select("own.digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"]), "copies-texts")
    gone, most = None, 1
    while True:
        in_bucket = W.partitionBy("bucket").orderBy("own")
        firsts = alive.withColumn("n", F.row_number().over(in_bucket)).where(F.col("n") <= most)
        firsts = materialise(firsts.groupBy("bucket").agg(F.collect_list(F.struct("own", "sketch")).alias("firsts")), "copies-firsts")
        met = alive.join(firsts, "bucket")
        able = F.filter("firsts", lambda f: (f["own"] < F.col("own")) & (F.lit(True) if exact else may_be_near(f["sketch"], F.col("sketch"), least)))
        pairs = met.select("own", F.explode(F.transform(able, lambda f: f["own"])).alias("first"))
        pairs = materialise(pairs.select("own.digest", F.col("first.digest").alias("first")).distinct(), "copies-pairs")
        near = materialise(_verified(pairs, texts, width, seed, least).where("near").select("digest").distinct(), "copies-near")
        gone = near if gone is None else gone.unionByName(near)
        rest = met.where(F.col("own") > F.array_max("firsts")["own"]).select("bucket", "own", "sketch", "own.digest")
        alive, most = materialise(rest.join(near, "digest", "left_anti").select("bucket", "own", "sketch"), "copies-alive"), min(MOST_FIRSTS, 8 * most)
        if alive.isEmpty():
            break
    key = lambda doc_id, digest: F.concat_ws(":", digest, doc_id.cast("string"))
    kept = classes.select(F.col("own.doc_id").alias("__id"), F.col("own.digest").alias("digest"))
    (own_key,) = free_names(docs, "__copies_key")
    kept = kept.join(gone, "digest", "left_anti").select(key(F.col("__id"), F.col("digest")).alias(own_key))
    # the join and the grouping share the key, so whole rows are shuffled once
    found = docs.withColumn(own_key, key(F.col("doc_id"), F.md5(text_or_empty())))
    return found.join(kept, own_key, "left_semi").dropDuplicates([own_key]).drop(own_key)
