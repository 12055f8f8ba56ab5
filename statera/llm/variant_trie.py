"""Spelling variants: exact neighbours at one edit by a dictionary of trie-node pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from statera.llm.common import importable, materialise, partitions

#: Code points of a range of words, which one task numbers, and of the beginnings that neighbouring ranges share at most, which every task gets.
RANGE_CHARS, SHARED_CHARS = 1 << 20, 1 << 22
#: What a word has at a pair of nodes: a position skipped (one that repeats the letter before, or not), or a gap for one more letter.
REPEATED, SKIPPED, GAP = 0, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = 7, least_n: int = 2, damage: int | None = 31) -> DataFrame:
    """(word, n): runs of Latin letters with only A-Z lower-cased, of at least ``least_length`` code points and ``least_n`` occurrences.

    ``damage``: a run whose CRC-32 of ``<doc_id>:<run>`` it divides loses the code point at CRC mod length (None: runs stay as they are).
    Shorter runs are never taken out of the text, as a run only gets shorter.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("word"))
    runs = runs.withColumn("word", F.translate("word", UPPER, LOWER))
    if damage:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % damage == 0, less).otherwise(F.col("word"))).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def shared(a: str, b: str) -> int:
    """Code points that two texts have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def ways(texts: Iterable[str], start: int, known: Sequence[tuple[str, list[int]]] = ()) -> Iterator[list[int]]:
    """Node numbers on each text's way down the trie: 0 for the root, then one for each code point.

    Texts come in code-point order, so all below a node follow each other; new nodes are numbered from ``start``. ``known``: texts whose
    ways have numbers already.
    """
    before, way = "", [0]
    for text in texts:
        way = way[: shared(before, text) + 1]
        for other, numbers in known:
            way += numbers[len(way) : shared(other, text) + 1]
        fresh = len(text) + 1 - len(way)
        way = [*way, *range(start, start + fresh)]
        start += fresh
        before = text
        yield way


def _numbered(words: DataFrame, text: str, finish: Callable[[pa.Table, np.ndarray, int], pa.Table], schema: str) -> DataFrame:
    """Numbers the trie of the distinct texts of column ``text``; ``finish`` makes rows of a range, its flat node numbers and the count of rows before it.

    Texts are dealt to ranges, and a task numbers the nodes of its range in order. A node whose texts lie in several ranges is one of a
    beginning that neighbouring ranges share: these have numbers of their own, which each range's task gets for both its ends. So only
    a row for each range reaches the driver, and of its texts only what is shared. Should that exceed SHARED_CHARS, fewer ranges share less.
    """
    importable(words.sparkSession)
    chars = words.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(partitions(words.sparkSession), -(-chars // RANGE_CHARS))
    while True:
        ranged = materialise(words.repartitionByRange(n, text).withColumn("__range", F.spark_partition_id()), "trie-ranges")
        sizes = ranged.groupBy("__range").agg(F.count("*").alias("rows"), F.sum(F.length(text)).alias("chars"), F.min(text).alias("first"), F.max(text).alias("last"))
        ends = sizes.withColumn("before", F.lag("last", 1, "").over(W.orderBy("__range")))  # one row for each range
        heads = materialise(ends.select("__range", "rows", "chars", pandas_udf(_heads, "string")("before", "first").alias("head")), "trie-heads")
        if n == 1 or (heads.agg(F.sum(F.length("head"))).first()[0] or 0) <= SHARED_CHARS:
            break
        n = max(1, n // 4)
    found = heads.orderBy("__range").collect()
    texts = sorted({r["head"] for r in found})
    known = dict(zip(texts, ways(texts, 1)))
    first_node = list(accumulate((r["chars"] for r in found), initial=1 + max((w[-1] for w in known.values()), default=0)))
    first_row = list(accumulate((r["rows"] for r in found), initial=0))
    after = [r["head"] for r in found[1:]] + [""]
    told = {r["__range"]: (first_row[i], first_node[i], [(h, known[h]) for h in {r["head"], after[i]} if h]) for i, r in enumerate(found)}

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows, node, ends = told[key[0].as_py()]
        group = group.sort_by(text)
        flat = np.fromiter(chain.from_iterable(ways(group.column(text).to_pylist(), node, ends)), np.int64)
        return finish(group, flat, rows)

    return ranged.groupBy("__range").applyInArrow(run, schema)


def _heads(before: pd.Series, first: pd.Series) -> pd.Series:
    return pd.Series([b[: shared(a, b)] for a, b in zip(before, first)], dtype="str")


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _forward(group: pa.Table, flat: np.ndarray, rows: int) -> pa.Table:
    """(id, word, n, nodes): ids rise in code-point order of the words."""
    lengths = pc.utf8_length(group.column("word")).to_numpy().astype(np.int64) + 1
    nodes = pa.LargeListArray.from_arrays(_offsets(lengths), flat).cast(pa.list_(pa.int64()))
    return pa.table({"id": np.arange(rows, rows + group.num_rows), "word": group.column("word"), "n": group.column("n"), "nodes": nodes})


def _backward(group: pa.Table, flat: np.ndarray, rows: int) -> pa.Table:
    """(p, s, kind, id, n): the pairs of a word's nodes before and after a skipped position, and before and after a gap.

    Of letters that repeat, skipping any gives the same word, so only the first of them counts for words with one letter less.
    """
    words = group.column("word").to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = _offsets(lengths)[:-1]
    prefix = pc.list_flatten(group.column("nodes")).to_numpy()
    # the node of the last j letters is number j of the reversed word: turn each word's numbers around
    place = np.arange(len(flat)) - np.repeat(starts, lengths)
    suffix = flat[np.repeat(starts + lengths - 1, lengths) - place]
    letters = np.frombuffer("".join(w + "\n" for w in words).encode("utf-32-le"), np.uint32)
    inner = np.flatnonzero(place < np.repeat(lengths - 1, lengths))
    repeats = (place[inner] > 0) & (letters[inner] == letters[np.maximum(inner, 1) - 1])
    ids, n = (np.repeat(group.column(c).to_numpy(), lengths) for c in ("id", "n"))
    return pa.table({
        "p": np.concatenate((prefix[inner], prefix)), "s": np.concatenate((suffix[inner + 1], suffix)),
        "kind": np.concatenate((np.where(repeats, REPEATED, SKIPPED), np.full(len(prefix), GAP))).astype(np.int8),
        "id": np.concatenate((ids[inner], ids)), "n": np.concatenate((n[inner], n)),
    })


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct words (word, n): (id, word, n), ids in code-point order; and (id, n_near, best_n, best) of those with words at one edit.

    best is the near word of the largest n, of equal ones the first in code-point order. Nodes of the forward and the reversed trie
    are numbered. Two words differ in one replaced letter if they have the same pair (prefix node, suffix node) about a skipped position, and
    in one letter more if the longer has about a skipped position what the shorter has about a gap. A pair of nodes is one text
    with a hole, so at most one word for each letter of the alphabet meets there, and each is answered at once: no pairs of words are made.
    """
    numbered = materialise(_numbered(words, "word", _forward, "id long, word string, n long, nodes array<long>"), "trie-words")
    backward = numbered.withColumn("turned", F.reverse("word"))
    pairs = _numbered(backward, "turned", _backward, "p long, s long, kind byte, id long, n long")
    met = pairs.groupBy("p", "s").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "id", "kind"))).alias("all")).where(F.size("all") > 1)
    each = met.select("all", F.explode("all").alias("x"))
    x = F.col("x")

    def near(y: Column) -> Column:
        replaced = (x["kind"] != GAP) & (y["kind"] != GAP) & (x["id"] != y["id"])
        return replaced | (x["kind"] + y["kind"] == SKIPPED + GAP)

    links = each.select(x["id"].alias("id"), F.filter("all", near).alias("others")).where(F.size("others") > 0)
    first = F.get("others", F.lit(0))
    links = links.select("id", F.size("others").cast("long").alias("c"), F.struct(first["m"].alias("m"), first["id"].alias("id")).alias("first"))
    found = links.groupBy("id").agg(F.sum("c").alias("n_near"), F.min("first").alias("first"))
    return numbered.select("id", "word", "n"), found.select("id", "n_near", (-F.col("first.m")).alias("best_n"), F.col("first.id").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for links (id, form) without circles: each link's last end. Each round doubles the steps taken."""
    at = materialise(forms.select("id", F.col("form").alias("root")), "variant-roots")
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left")
        if moved.where("next is not null").isEmpty():
            return at
        at = materialise(moved.select("id", F.coalesce("next", "root").alias("root")), "variant-roots")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, times: int = 10, damage: int | None = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text): see :func:`vocabulary`.

    Near words differ in exactly one inserted, deleted or replaced code point. A word's form is its near word of the largest n (ties: the
    first in code-point order) if that is at least ``times`` (2 or more) as frequent, else null; root follows forms to the last and is the
    word itself without one. A null text has no words, a null id is empty in the CRC's text; repeated rows count each; words of any length
    take part whole; an empty table gives no rows; other columns are ignored.
    """
    words, near = near_words(materialise(vocabulary(docs, least_length, least_n, damage), "variant-words"))
    known = materialise(words.join(near, "id", "left"), "variant-near")
    forms = known.where(F.col("best_n") >= times * F.col("n")).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    ends = forms.join(roots(forms), "id")
    name = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    ends = ends.join(name("form"), "form").join(name("root"), "root").select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    return known.join(ends, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
