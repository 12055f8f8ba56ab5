"""Ranked lexical search: the Best Position Algorithm over impact lists of document shards."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.llm.common import importable, materialise

#: Bytes to terms: ASCII letters in lower case, digits and all bytes of other letters stay, the rest is a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of all queries' terms, and of all queries, that every task gets; more queries are asked in several parts.
QUERY_BYTES = 16 << 20
#: Documents of a shard, and entries that are read of each list before the first look at the threshold.
SHARD, FIRST_STEP = 8192, 16

#: Score, 1 if the document has an id (else 0), and the id's negative: the largest entry is the best.
Entry = tuple[int, int, int]


def terms_of(text: str | bytes | None) -> list[bytes]:
    """A text's terms in their order, as UTF-8."""
    text = text.encode() if isinstance(text, str) else text
    return text.translate(TERM_BYTES).split() if text else []


def items_of(items: DataFrame) -> DataFrame:
    """(item_id, text): a row for each id, of different texts the first in code-point order; a null id is an item too."""
    return items.groupBy(F.col("item_id")).agg(F.min("text").alias("text"))


def term_hits(docs: DataFrame, wanted: Mapping[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each row of ``docs`` (doc_id, text): its number of terms, and those of ``wanted`` that it holds, by number, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, terms, counts = [], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(words)
                held = sorted((wanted[w], found[w]) for w in found.keys() & wanted.keys())
                n.append(len(words))
                terms.append([t for t, _ in held])
                counts.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def impacts(n: np.ndarray, lengths: np.ndarray, counts: np.ndarray, weights: np.ndarray, total: int, words: int) -> np.ndarray:
    """What each term held adds to its document's score, in 64-bit integers: n by document, its number of terms held, and their occurrences and weights."""
    m = np.repeat(100 - 75 + (75 * n * total) // max(1, words), lengths)
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


class Shard:
    """Impact lists of a shard of documents, and each document's entries for direct access."""

    def __init__(self, ids: list[int | None], starts: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        """Document i, of the id ``ids[i]``, holds the entries from ``starts[i]`` to ``starts[i + 1]`` of ``terms`` and ``impact``."""
        self.ids, self.starts, self.terms, self.impact = ids, starts, terms, impact
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.lexsort((-impact, terms))
        self.docs, self.impacts = owner[order], impact[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.times = np.zeros(n_terms, np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Direct access: whole scores of documents, for the terms whose ``times`` are set."""
        lengths = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(self.starts[docs], lengths)
        sums = np.concatenate(([0], np.cumsum(self.times[self.terms[at]] * self.impact[at])))
        return sums[ends] - sums[ends - lengths]

    def best(self, terms: Sequence[int], times: Sequence[int], heap: list[Entry], k: int) -> int:
        """Bring a query's ``k`` best documents (score, 1 if it has an id else 0, -id) into ``heap``, which may hold others already; the number of documents seen.

        Lists are read in parallel, some entries further each time. A document read is scored at once by direct access, which
        tells its positions in all lists; so a list's best position, up to which every position is seen, may lie beyond what was
        read of it. What the lists have next to their best positions bounds every unseen document: reading ends when that sum is
        strictly below the k-th score, as an equal score could still win by its id, or when the lists do.
        """
        pairs = [(t, c) for t, c in zip(terms, times) if self.lists[t] < self.lists[t + 1]]
        ends = np.array([self.lists[t + 1] for t, _ in pairs])
        read = np.array([self.lists[t] for t, _ in pairs])
        position, weight = read.copy(), np.array([c for _, c in pairs])
        seen = np.zeros(len(self.ids), bool)
        for t, c in pairs:
            self.times[t] = c
        step, total = FIRST_STEP, 0
        while (read < ends).any():
            stop = np.minimum(read + step, ends)
            found = np.unique(np.concatenate([self.docs[a:b] for a, b in zip(read, stop)]))
            found = found[~seen[found]]
            seen[found] = True
            total += len(found)
            if len(found):
                self._keep(heap, found, self.scores(found), k)
            read, step = stop, 2 * step
            bound = 0
            for i in range(len(pairs)):
                position[i] = self._unseen(seen, max(position[i], read[i]), ends[i])
                if position[i] < ends[i]:
                    bound += int(weight[i] * self.impacts[position[i]])
            if len(heap) == k and bound < heap[0][0]:
                break
        for t, _ in pairs:
            self.times[t] = 0
        return total

    def _unseen(self, seen: np.ndarray, start: int, end: int) -> int:
        """The first place of a list from ``start`` on whose document isn't seen."""
        width = 64
        while start < end:
            part = seen[self.docs[start : min(start + width, end)]]
            if not part.all():
                return start + int(np.argmin(part))
            start, width = start + len(part), 2 * width
        return end

    def _keep(self, heap: list[Entry], docs: np.ndarray, scores: np.ndarray, k: int) -> None:
        """Add documents with a score above 0 to the heap of the ``k`` best."""
        if len(docs) > k:  # only what can be among them: of equal scores all, as ids decide
            least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]), heap[0][0] if len(heap) == k else 1)
            good = scores >= least
        else:
            good = scores > 0
        for d, s in zip(docs[good].tolist(), scores[good].tolist()):
            entry = (s, 0, 0) if self.ids[d] is None else (s, 1, -self.ids[d])
            heapq.heappush(heap, entry) if len(heap) < k else heapq.heappushpop(heap, entry)


def best_documents(hits: DataFrame, queries: Mapping[int, Mapping[int, int]], weights: np.ndarray, total: int, words: int, k: int) -> DataFrame:
    """(q, doc_id, score): of each task the ``k`` best documents of each query (its terms' numbers with their occurrences).

    A task works its :func:`term_hits` rows off in shards, each with its own lists; the heaps of its shards so far make the next ones stop sooner.
    """
    asked = [(q, list(terms), list(terms.values())) for q, terms in queries.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[Entry]] = {q: [] for q, _, _ in asked}
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                doc_id, n, terms, counts = batch.slice(start, SHARD).columns
                starts = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))))
                held = terms.flatten().to_numpy()
                impact = impacts(n.to_numpy(), np.diff(starts), counts.flatten().to_numpy().astype(np.int64), weights[held], total, words)
                shard = Shard(doc_id.to_pylist(), starts, held, impact, len(weights))
                for q, numbers, times in asked:
                    shard.best(numbers, times, heaps[q], k)
        rows = [(q, -i if known else None, s) for q, heap in heaps.items() for s, known, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ()))], names=["q", "doc_id", "score"])

    return hits.mapInArrow(run, "q long, doc_id long, score long")


def _ranked_part(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, doc_id, score, rank) for the queries (q, text), which are few enough for every task."""
    texts = {r["q"]: Counter(terms_of(r["text"])) for r in queries.collect()}
    wanted = {term: i for i, term in enumerate(sorted(set().union(*texts.values())))}
    hits = materialise(term_hits(docs, wanted), "search-hits")
    total, words = hits.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(wanted), np.int64)  # a term that no document holds is in no list
    for r in hits.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        weights[r["t"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["df"] + 1)))
    found = best_documents(hits, {q: {wanted[t]: c for t, c in terms.items()} for q, terms in texts.items()}, weights, total, words, k)
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the ``k`` rows of ``docs`` (doc_id, text) with the highest scores above 0.

    Each text is cut into terms once, in the task that reads it; what is kept of a row is its length and the queries' terms that it holds.
    N, L and document frequencies are counts over all rows. Documents stay where they are, in shards, each with impact lists of its own, and
    the Best Position Algorithm finds a shard's best (:meth:`Shard.best`); k rows of each query leave a task. Equal texts are asked once;
    queries of more than QUERY_BYTES are asked in several parts, so what every task gets is bounded but for one text of that size.

    Equal scores go by ascending doc_id, rows without an id last; rows that repeat an id count each. A null or empty text has no
    terms; an item without terms, or without a document that scores, has no rows; of items with one id the first text counts. Empty tables
    give no rows; other columns are ignored.
    """
    importable(docs.sparkSession)
    asked = materialise(items_of(items).where("text is not null"), "search-items")
    queries = materialise(asked.select("text").distinct().withColumn("q", F.monotonically_increasing_id()), "search-queries")
    parts = max(1, -(-(queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES))
    part: Column = F.pmod(F.xxhash64("text"), F.lit(parts))
    found = reduce(DataFrame.unionByName, (_ranked_part(docs, queries.where(part == i), k) for i in range(parts)))
    return found.join(queries, "q").join(asked, "text").select("item_id", "rank", "doc_id", "score")
