"""Exact top-k inner-product search by a three-phase uniform threshold over lists of partial scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from statera.llm.common import importable, materialise

#: Rows and queries of a cell at about most, and scores that a task works on at once.
ROW_BLOCK, QUERY_BLOCK, SCORES_AT_ONCE = 8192, 1024, 1 << 22
#: Hash classes by which a vector that many rows share is dealt.
SALTS = 16
#: Vectors with components below this are multiplied apart from larger ones.
SMALL, LEAST_LONG = 1 << 20, -(1 << 63)


def packed(x: np.ndarray, scale: int = 1) -> bytes:
    """floor(scale * x) as little-endian integers of the smallest size that holds them all, that size first; 0 and decimal numbers if a long doesn't hold them."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    most = float(np.abs(y).max(initial=0))
    size = next((n for n in (1, 2, 4, 8) if most < 1 << (8 * n - 1)), 0)
    if not size:
        return b"\0" + b",".join(b"%d" % (int(b) if np.isfinite(b) else int(a) * scale) for a, b in zip(x.tolist(), y.tolist()))
    return bytes([size]) + y.astype(f"<i{size}").tobytes()


def unpacked(code: bytes) -> np.ndarray:
    """The integers of a code: longs, or Python's where a long doesn't hold them."""
    if not code[0]:
        return np.array([int(n) for n in code[1:].split(b",")], object)
    return np.frombuffer(code, f"<i{code[0]}", offset=1).astype(np.int64)


def coded(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, code) of rows (vec_id, embedding): floor(scale * x) of each component, packed.

    Rows without an id, with a null vector or with a null, NaN or infinite component take no part. Of rows with one id but different
    vectors that of the smallest code stays.
    """
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [packed(np.array(x, np.float64), scale) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).mapInArrow(run, "vec_id long, code binary")
    return kept.groupBy("vec_id").agg(F.min("code").alias("code"))


def vector_classes(codes: DataFrame, keep: int) -> DataFrame:
    """(class_id, code, members): a row for each distinct vector, its id the smallest vec_id, with the ``keep`` smallest vec_ids.

    More of them can't be among the ``keep`` best rows of any query, as they tie and go by vec_id.
    """
    first = W.partitionBy("code", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    few = codes.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    few = few.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= keep)
    return few.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).select(F.get("members", F.lit(0)).alias("class_id"), "code", "members")


def _matrix(codes: pd.Series) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    rows = [unpacked(c) for c in codes]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), object if any(r.dtype == object for r in rows) else np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(q: np.ndarray, v: np.ndarray, parts: int = 1) -> np.ndarray:
    """Exact integer products: in doubles while their sums stay below 2^53, in longs while those of ``parts`` of them fit one, else in Python's integers."""
    bound = q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0))
    if bound < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if parts * bound < 2**63:
        return q.astype(np.int64) @ v.T.astype(np.int64)
    small = [np.abs(x).max(axis=1, initial=0) < SMALL for x in (q, v)]
    if small[0].any() and small[1].any() and not (small[0].all() and small[1].all()):
        # only products with a large vector are slow
        out = np.empty((len(q), len(v)), object)
        for i in (small[0], ~small[0]):
            for j in (small[1], ~small[1]):
                out[np.ix_(i, j)] = _products(q[i], v[j], parts)
        return out
    return q.astype(object) @ v.T.astype(object)


def _fits(scores: np.ndarray) -> np.ndarray:
    """Which scores a long holds."""
    return (scores >= LEAST_LONG) & (scores <= -(LEAST_LONG + 1)) if scores.dtype == object else np.ones(scores.shape, bool)


def _as_longs(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; what is beyond counts as the longs' bound, which keeps all comparisons with longs."""
    return np.clip(scores, LEAST_LONG, -(LEAST_LONG + 1)).astype(np.int64) if scores.dtype == object else scores


def _block(name: str, n: int) -> Column:
    """Number of an id's block among ``n``."""
    return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")


def _cells(classes: DataFrame, queries: DataFrame, blocks: tuple[int, int], extra: list[str]):
    """Rows and queries dealt to the cells (query block, row block) of the score table; a vector goes once to each cell."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = classes.select("class_id", "code", _block("class_id", blocks[1]).alias("rb"), each(blocks[0]).alias("qb"))
    asked = queries.select("class_id", "code", *extra, _block("class_id", blocks[0]).alias("qb"), each(blocks[1]).alias("rb"))
    return rows.groupBy("qb", "rb").cogroup(asked.groupBy("qb", "rb"))


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``n`` best scores of each row, ties to the smaller id."""
    if scores.shape[1] > n:
        least = ~np.partition(~scores, n - 1, axis=1)[:, n - 1]
        i, j = np.nonzero(scores >= least[:, None])
    else:
        i, j = np.divmod(np.arange(scores.size), max(1, scores.shape[1]))
    order = np.lexsort((ids[j], ~scores[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < n
    return i[first], j[first]


def _bands(rows: pd.DataFrame, asked: pd.DataFrame, parts: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """A cell's partial scores, a table for each list, by bands of queries."""
    v, u = _matrix(rows["code"]), _matrix(asked["code"])
    band = max(1, SCORES_AT_ONCE // max(1, len(rows) * parts))
    for start in range(0, len(asked), band) if len(rows) else ():
        q = u[start : start + band]
        width = min(q.shape[1], v.shape[1])
        yield asked.iloc[start : start + band], [_products(q[:, p:width:parts], v[:, p:width:parts], parts) for p in range(parts)]


def local_lists(rows: pd.DataFrame, asked: pd.DataFrame, parts: int, keep: int) -> pd.DataFrame:
    """(q, class_id, partial, part): of a cell the ``keep`` best entries of each list for each query."""
    out = [pd.DataFrame({"q": np.empty(0, np.int64), "class_id": np.empty(0, np.int64), "partial": np.empty(0, np.int64), "part": np.empty(0, np.int32)})]
    ids = rows["class_id"].to_numpy()
    for some, lists in _bands(rows, asked, parts):
        for part, scores in enumerate(map(_as_longs, lists)):
            i, j = _best(scores, ids, keep)
            out.append(pd.DataFrame({"q": some["class_id"].to_numpy()[i], "class_id": ids[j], "partial": scores[i, j], "part": np.int32(part)}))
    return pd.concat(out)


def resolved_cell(rows: pd.DataFrame, asked: pd.DataFrame, parts: int, keep: int) -> pd.DataFrame:
    """(q, class_id, score): of a cell the ``keep`` best rows of each query among those that reach its cutoff.

    Each list gives its entries from the query's ``least`` on; the other lists' partial scores of these rows are in the same task, so
    their scores are resolved here and no entry leaves it that is under the cutoff.
    """
    out = [pd.DataFrame({"q": np.empty(0, np.int64), "class_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
    ids = rows["class_id"].to_numpy()
    for some, lists in _bands(rows, asked, parts):
        given = np.logical_or.reduce([_as_longs(x) >= some["least"].to_numpy()[:, None] for x in lists])
        i, j = np.nonzero(given)
        scores = sum(x[i, j] for x in lists)
        good = _fits(scores) & (_as_longs(scores) >= some["cutoff"].to_numpy()[i])
        i, j, scores = i[good], j[good], _as_longs(scores[good])
        order = np.lexsort((ids[j], ~scores, i))
        i, j, scores = i[order], j[order], scores[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < keep
        out.append(pd.DataFrame({"q": some["class_id"].to_numpy()[i[first]], "class_id": ids[j[first]], "score": scores[first]}))
    return pd.concat(out)


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    """Inner products of codes; none where a long doesn't hold it."""
    u, v = _matrix(a), _matrix(b)
    width = min(u.shape[1], v.shape[1])
    u, v = u[:, :width], v[:, :width]
    if width * int(np.abs(u).max(initial=0)) * int(np.abs(v).max(initial=0)) < 2**63:
        return pd.Series(np.einsum("ij,ij->i", u.astype(np.int64), v.astype(np.int64)), dtype="Int64")
    products = (u.astype(object) * v.astype(object)).sum(axis=1)
    return pd.Series([int(p) if good else None for p, good in zip(products, _fits(products))], dtype="Int64")


def _resolved(pairs: DataFrame, classes: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact scores (q, class_id, score) of pairs (q, class_id)."""
    joined = pairs.join(classes.select("class_id", F.col("code").alias("v")), "class_id").join(queries.select(F.col("class_id").alias("q"), F.col("code").alias("u")), "q")
    return joined.select("q", "class_id", pandas_udf(_scores, "long")("u", "v").alias("score")).where("score is not null")


def top_k(rows: DataFrame, is_query: Column, k: int = 20, parts: int = 2, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner product for each query row, its own row left out.

    Vectors are cut into ``parts`` interleaved slices, and a slice's inner products are a list of partial scores. (1) Each list gives
    its k + 1 best entries for a query; these rows are scored exactly, and the (k + 1)-th best score is a safe cutoff. (2) A row that
    reaches the cutoff has a partial score of at least cutoff / parts in some list, so each query's cutoff goes to the lists and these
    give all entries from there on. (3) Their scores are resolved exactly, and those from the cutoff on are ranked. Lists are worked
    off in cells of a block of queries and a block of rows, all lists of a cell in one task: at most k + 1 rows for each query leave it.

    Equal vectors are searched once: classes of them are scored, and the k + 1 smallest vec_ids of a class stand for it, which no
    query can tell from all. Ties go to the smaller vec_id. ``is_query``: a condition on vec_id. Rows that can't be scored
    (see :func:`coded`) take no part, and a pair whose score no long holds isn't ranked, while its vectors' other pairs are; a shorter vector counts as filled up with zeros; rows repeated with one vec_id are one row (of
    different vectors that of the smallest code); fewer than k others give all. An empty table gives no rows.
    """
    vectors = materialise(coded(rows, scale), "topk-codes")
    classes = materialise(vector_classes(vectors, k + 1), "topk-classes")
    asking = vectors.where(is_query).join(classes.select("class_id", "code"), "code").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("q"))
    asking = materialise(asking, "topk-asking")
    queries = materialise(classes.join(asking.select(F.col("q").alias("class_id")).distinct(), "class_id", "left_semi").select("class_id", "code"), "topk-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-classes.count() // ROW_BLOCK))

    def gather(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return local_lists(rows, asked, parts, k + 1)

    def resolve(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return resolved_cell(rows, asked, parts, k + 1)

    local = _cells(classes, queries, blocks, []).applyInPandas(gather, "q long, class_id long, partial long, part int")
    in_list = W.partitionBy("q", "part").orderBy(F.col("partial").desc(), "class_id")
    entries = local.withColumn("n", F.row_number().over(in_list)).where(F.col("n") <= k + 1).select("q", "class_id").distinct()
    in_query = W.partitionBy("q").orderBy(F.col("score").desc(), "class_id")
    cutoffs = _resolved(entries, classes, queries).withColumn("n", F.row_number().over(in_query)).where(F.col("n") == k + 1)
    # without k + 1 rows to score there is no cutoff: all entries count
    lowest = F.lit(LEAST_LONG)
    cutoffs = queries.join(cutoffs.select(F.col("q").alias("class_id"), "score"), "class_id", "left").withColumn("cutoff", F.coalesce("score", lowest))
    # whole division goes towards zero: never above cutoff / parts by one or more, whatever the cutoff's size
    least = F.when(F.col("cutoff") == lowest, lowest).otherwise(F.expr(f"cutoff div {parts}"))
    cutoffs = materialise(cutoffs.withColumn("least", least).select("class_id", "code", "cutoff", "least"), "topk-cutoffs")
    scored = _cells(classes, cutoffs, blocks, ["cutoff", "least"]).applyInPandas(resolve, "q long, class_id long, score long")
    leading = scored.withColumn("n", F.row_number().over(in_query)).where(F.col("n") <= k + 1)
    members = leading.join(classes.select("class_id", "members"), "class_id").select("q", "score", F.explode("members").alias("vec_id"))
    by_score = [F.col("score").desc(), F.col("vec_id")]
    members = members.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(*by_score))).where(F.col("n") <= k + 1)
    found = asking.join(members.drop("n"), "q").where("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by_score)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
