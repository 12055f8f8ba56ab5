"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by walking a binary trie against itself."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import free_names, importable, materialise, text_or_empty
from statera.llm.components import components

BITS = 64
HALF = 32
#: Bytes with A-Z as a-z; other bytes stay, so UTF-8 stays whole.
LOWER = bytes(range(256)).replace(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingle hashes whose bits are counted at once, and node pairs that are split at once: both bound memory.
HASHES_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 18


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a UTF-8 text's shingles, some at a time; a text of fewer words is one shingle, and one without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    digest, total = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    for start in range(0, total, HASHES_AT_ONCE):
        n = min(HASHES_AT_ONCE, total - start)
        yield np.fromiter((digest(next(shingles), seed) for _ in range(n)), np.uint64, n)


def simhash_of(parts: Iterable[np.ndarray]) -> int:
    """Unsigned fingerprint of shingle hashes: a bit is 1 if it is set in over half of them."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(len(hashes), 8), axis=1).sum(axis=0, dtype=np.uint32)  # at most HASHES_AT_ONCE of them, or a text's words
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a UTF-8 text's shingles."""
    return simhash_of(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, digest: bool = False) -> DataFrame:
    """(doc_id, digest, fp) for each row, fp as a signed long; a null text is the empty text.

    ``digest`` is the text's MD5 if asked for, else null.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((simhash(x, width, seed) for x in b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], names=["doc_id", "digest", "fp"])

    own = F.md5(F.col("text")) if digest else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest string, fp long")


def _split(values: np.ndarray, depth: int) -> np.ndarray:
    """Ones so far of the bit at ``depth``: any node's split point follows by a subtraction."""
    ones = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
    return np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))


def trie_pairs(left: np.ndarray, right: np.ndarray, same: bool, depth: int, budget: int, tight: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values at most ``budget`` bits apart, of which at most ``tight`` in the leading half.

    ``left`` and ``right`` are sorted and hold one trie node each, at ``depth``. Node pairs are split together one bit
    at a time; differing bits add up, and a pair over its budget is dropped with all that is below it. Pairs of
    single values are finished by counting their remaining bits. With ``same``, each unordered pair comes once.
    """
    start = int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(BITS - depth))) if depth else 0
    stack = [(depth, np.array([[0, len(left), 0, len(right), start]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > PAIRS_AT_ONCE:
            stack += [(depth, part) for part in np.array_split(pairs, -(-len(pairs) // PAIRS_AT_ONCE))]
            continue
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1) | (depth == BITS)
        if single.any():
            i, j = pairs[single, 0], pairs[single, 2]
            apart = left[i] ^ right[j]
            near = (np.bitwise_count(apart) <= budget) & (np.bitwise_count(apart >> np.uint64(HALF)) <= tight)
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            pairs = pairs[~single]
        if not len(pairs):
            continue
        l0, l2, r0, r2, err = pairs.T
        a, b = _split(left, depth), _split(right, depth)
        l1, r1 = l2 - (a[l2] - a[l0]), r2 - (b[r2] - b[r0])
        every = np.ones(len(pairs), bool)
        mirrored = (l0 == r0) & (l2 == r2) & same  # a node against itself: its two mixed children are one pair
        children = []
        for x0, x1, y0, y1, more, wanted in ((l0, l1, r0, r1, 0, every), (l1, l2, r1, r2, 0, every), (l0, l1, r1, r2, 1, every), (l1, l2, r0, r1, 1, ~mirrored)):
            keep = wanted & (x1 > x0) & (y1 > y0) & (err + more <= (tight if depth < HALF else budget))
            children.append(np.stack((x0, x1, y0, y1, err + more), axis=1)[keep])
        stack.append((depth + 1, np.concatenate(children)))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after uniting the ends of each pair; a label is the smallest index of its set."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]


def _rotated(fp: Column) -> Column:
    return F.shiftleft(fp, HALF).bitwiseOR(F.shiftrightunsigned(fp, HALF))


def trie_links(values: DataFrame, count: int, budget: int = 3, subtree: int = 1024, forest: bool = True, most: int = 8192) -> DataFrame:
    """Links (a, b: long) between the distinct values of column fp that differ in at most ``budget`` bits.

    Of two such values, one 32-bit half differs in at most ``budget // 2`` bits. So two tries are walked, with either half
    on top, and each allows only that many in its top half: the work stays nearly in proportion to the values. The trie is
    cut at a depth at which a subtree holds about ``subtree`` values (``count``: distinct values); a value goes to its own
    subtree and to those whose prefix is near enough, and each pair of subtrees is one group. A subtree of over ``most`` values, as many
    near copies make one, is cut into blocks by hash, and each pair of blocks is a group of its own, so a task holds at most about 4 * ``most`` of
    them. ``forest``: links are replaced by stars over what they connect within a group, which keeps components and never writes all pairs of a dense group.
    """
    importable(values.sparkSession)
    tight = budget // 2
    depth = min(24, max(1, math.ceil(math.log2(max(2, count) / subtree)))) if count > subtree else 1
    masks = [sum(1 << i for i in bits) for n in range(tight + 1) for bits in combinations(range(depth), n)]
    both = values.select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("x")), F.struct(F.lit(1).alias("turn"), _rotated(F.col("fp")).alias("x")))).alias("v")).select("v.*")
    both = both.withColumn("own", F.shiftrightunsigned("x", BITS - depth))
    heavy = both.groupBy("turn", "own").agg(F.count("*").alias("n")).where(F.col("n") > most).select("turn", "own", F.ceil(F.col("n") / most).cast("int").alias("cuts"))
    heavy = materialise(heavy, "simhash-heavy")  # one row for each ``most`` values at most
    dealt = both.withColumn("other", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("own").bitwiseXOR(m.cast("long")))))
    dealt = dealt.join(heavy, ["turn", "own"], "left").join(heavy.select("turn", F.col("own").alias("other"), F.col("cuts").alias("others")), ["turn", "other"], "left")
    cuts = F.greatest(F.coalesce("cuts", F.lit(1)), F.coalesce("others", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("x"), cuts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), cuts - 1)))
    dealt = dealt.select("turn", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.least("block", "with").alias("b"), F.greatest("block", "with").alias("c"), "x", "block")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        turn, lo, hi, b, c = (k.as_py() for k in key)
        x, at = np.unique(group.column("x").to_numpy().view(np.uint64), return_index=True)
        block, upper = group.column("block").to_numpy()[at], (x >> np.uint64(BITS - depth)) == np.uint64(hi)
        part = lambda high, of: np.flatnonzero((upper == high) & (block == of))
        if lo == hi:
            sides = [(part(True, b), part(True, c))]
        else:
            sides = [(part(False, i), part(True, j)) for i, j in {(b, c), (c, b)}]
        label, found = np.arange(len(x)), [np.empty((2, 0), np.uint64)]
        for left, right in sides:
            if len(left) and len(right):
                for i, j in trie_pairs(x[left], x[right], lo == hi and b == c, depth, budget, tight):
                    if forest:
                        label = _merge(label, left[i], right[j])
                    else:
                        found.append(np.stack((x[left[i]], x[right[j]])))
        if forest:
            moved = np.flatnonzero(label != np.arange(len(x)))
            found.append(np.stack((x[moved], x[label[moved]])))
        pairs = np.concatenate(found, axis=1)
        if turn:
            pairs = (pairs << np.uint64(HALF)) | (pairs >> np.uint64(HALF))
        pairs = np.sort(pairs.view(np.int64), axis=0)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return dealt.groupBy("turn", "lo", "hi", "b", "c").applyInArrow(run, "a long, b long").distinct()


def _classes(docs: DataFrame, width: int, seed: int, budget: int, digest: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, fp) for each row, and (fp, least id, root class) for each fingerprint."""
    marked = materialise(fingerprints(docs, width, seed, digest), "simhash")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(materialise(trie_links(classes.select("fp"), classes.count(), budget), "simhash-links"), "simhash-components")
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return marked, materialise(joined, "simhash-roots")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    Equal fingerprints are one class; classes link at ``budget`` or fewer differing bits, and component_id is the smallest
    doc_id reachable over links, the row's own included. A null text counts as empty; texts without words have fingerprint
    zero and link like others. Rows with a null doc_id take part, but only non-null ids name a component (null if there is
    none). Repeated rows give a row each; an empty table gives none; other columns are ignored.
    """
    marked, classes = _classes(docs, width, seed, budget, digest=False)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    names = classes.join(named, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, seed: int = 42, budget: int = 3) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the smallest id (null last), then the smallest text digest.

    Of rows equal in id and text one stays.
    """
    marked, classes = _classes(docs, width, seed, budget, digest=True)
    own, kept_id, kept_digest = free_names(docs, "__text_digest", "__id", "__digest")
    first = marked.join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("kept"))
    kept = first.select(F.col("kept.doc_id").alias(kept_id), F.col("kept.digest").alias(kept_digest))
    found = docs.withColumn(own, F.md5(F.col("text")))
    found = found.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & F.col(own).eqNullSafe(F.col(kept_digest)), "left_semi")
    return found.dropDuplicates(["doc_id", own]).drop(own)
