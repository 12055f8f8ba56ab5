"""Nearest neighbours by a block matrix join of int8 codes with error bounds, settled in double precision."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.llm.common import importable, materialise
from statera.llm.topk_threshold import vector_classes

#: Rows and queries of a block at about most, and products that a task works on at once.
ROW_BLOCK, QUERY_BLOCK, PRODUCTS_AT_ONCE = 16384, 1024, 1 << 22
#: Relative slack of bounds for the rounding of doubles.
SLACK = 1e-12


def packed(x: np.ndarray) -> bytes:
    """A vector as little-endian floats, of four bytes if they hold it exactly, that size first."""
    short = x.astype("<f4")
    exact = bool((short.astype(np.float64) == x).all())
    return bytes([4 if exact else 8]) + (short if exact else x.astype("<f8")).tobytes()


def unpacked(code: bytes) -> np.ndarray:
    return np.frombuffer(code, f"<f{code[0]}", offset=1).astype(np.float64)


def vectors_of(rows: DataFrame) -> DataFrame:
    """(vec_id, code) of rows (vec_id, embedding).

    Rows without an id, with a null, empty or zero vector or one with a null, NaN or infinite component take no part. Of rows with one id but
    different vectors that of the smallest code stays.
    """
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [packed(np.array(x, np.float64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    return kept.mapInArrow(run, "vec_id long, code binary").groupBy("vec_id").agg(F.min("code").alias("code"))


def quantised(x: np.ndarray) -> tuple[bytes, float, float]:
    """A vector as int8 codes, their scale, and a bound of the distance between the vector and its codes times the scale."""
    scale = max(float(np.abs(x).max()) / 127, 5e-324)  # of the smallest doubles a 127th is zero
    codes = np.clip(np.rint(x / scale), -127, 127)
    with np.errstate(over="ignore"):
        rest = float(np.sqrt(np.square(x - codes * scale).sum()))
    return codes.astype(np.int8).tobytes(), scale, rest * (1 + SLACK) + float(np.abs(x).max()) * SLACK + 1e-150


def _quantised(classes: DataFrame) -> DataFrame:
    """(class_id, q8, scale, rest): what the block join needs of a vector, one byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, scales, rests = zip(*(quantised(unpacked(x)) for x in b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), pa.array(scales, pa.float64()), pa.array(rests, pa.float64())], names=["class_id", "q8", "scale", "rest"])

    return classes.select("class_id", "code").mapInArrow(run, "class_id long, q8 binary, scale double, rest double")


def _tile(codes: pd.Series) -> np.ndarray:
    """Codes as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(codes), max(map(len, codes), default=0)), np.int8)
    for i, c in enumerate(codes):
        out[i, : len(c)] = np.frombuffer(c, np.int8)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, as doubles: a sum of ``width`` products of at most 127 * 127 is exact in single precision below 2^24."""
    width = min(a.shape[1], b.shape[1])
    kind = np.float32 if width * 127 * 127 < 1 << 24 else np.float64
    return (a[:, :width].astype(kind) @ b[:, :width].T.astype(kind)).astype(np.float64)


def bounds(rows: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """By bands of ``asked``: it, and the least and the largest distance that each of ``rows`` can have from it.

    The coded vectors' distance follows from the products; the vectors lie within their rests of these.
    """
    v, u = _tile(rows["q8"]), _tile(asked["q8"])
    size = lambda t: np.square(t.astype(np.float64)).sum(axis=1)
    s, r = rows["scale"].to_numpy(), rows["rest"].to_numpy()
    with np.errstate(all="ignore"):  # of huge components squares are infinite: such pairs are settled exactly
        long = s * s * size(v)
        for start in range(0, len(asked), band := max(1, PRODUCTS_AT_ONCE // max(1, len(rows)))):
            part = asked.iloc[start : start + band]
            t = part["scale"].to_numpy()[:, None]
            both = t * t * size(u[start : start + band])[:, None] + long
            square = both - 2 * (t * s) * _products(u[start : start + band], v)
            apart = part["rest"].to_numpy()[:, None] + r + SLACK * np.sqrt(both)
            least = np.sqrt(np.maximum(square - SLACK * both, 0)) - apart
            most = np.sqrt(np.maximum(square + SLACK * both, 0)) + apart
            yield part, np.nan_to_num(least, nan=0.0, posinf=0.0), np.nan_to_num(most, nan=np.inf, posinf=np.inf)


def survivors(rows: pd.DataFrame, asked: pd.DataFrame, keep: int) -> pd.DataFrame:
    """(q, class_id, least, most): of a cell the pairs whose least distance is within the ``keep``-th smallest largest distance of their query."""
    out = [pd.DataFrame({"q": np.empty(0, np.int64), "class_id": np.empty(0, np.int64), "least": np.empty(0), "most": np.empty(0)})]
    if len(rows):
        ids = rows["class_id"].to_numpy()
        for part, least, most in bounds(rows, asked):
            cut = np.partition(most, keep - 1, axis=1)[:, keep - 1] if most.shape[1] > keep else np.full(len(part), np.inf)
            i, j = np.nonzero(least <= cut[:, None])
            out.append(pd.DataFrame({"q": part["class_id"].to_numpy()[i], "class_id": ids[j], "least": least[i, j], "most": most[i, j]}))
    return pd.concat(out)


def _cells(rows: DataFrame, queries: DataFrame, blocks: tuple[int, int]):
    """Rows and queries dealt to the cells (query block, row block) of the table of distances."""
    block = lambda n: F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = rows.withColumn("rb", block(blocks[1])).withColumn("qb", each(blocks[0]))
    u = queries.withColumn("qb", block(blocks[0])).withColumn("rb", each(blocks[1]))
    return v.groupBy("qb", "rb").cogroup(u.groupBy("qb", "rb"))


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Euclidean distance in double precision, squares added from the first on; a shorter vector is filled up with zeros."""
    if len(a) != len(b):
        a, b = (np.pad(x, (0, max(len(a), len(b)) - len(x))) for x in (a, b))
    with np.errstate(over="ignore"):
        return float(np.sqrt(np.add.accumulate(np.square(a - b))[-1]))


def _settled(pairs: DataFrame, keep: int) -> DataFrame:
    """(q, class_id, score) of pairs (q, class_id, u, v): each task settles distances and keeps each query's ``keep`` nearest in a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, c, u, v in zip(*(x.to_pylist() for x in b.columns)):
                heap, found = heaps.setdefault(q, []), (-distance(unpacked(u), unpacked(v)), -c)
                heapq.heappush(heap, found) if len(heap) < keep else heapq.heappushpop(heap, found)
        rows = [(q, -c, -d) for q, heap in heaps.items() for d, c in heap]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["q", "class_id", "score"])

    return pairs.select("q", "class_id", "u", "v").mapInArrow(run, "q long, class_id long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows at the smallest Euclidean distance from each query row, its own row left out.

    Queries and rows are dealt to blocks, and each cell of two blocks multiplies int8 codes, a byte for each component. With what a
    vector and its codes differ by at most, a product gives bounds of a distance. A cell keeps the pairs whose least distance is within its
    (k + 1)-th smallest largest one; the same over all cells of a query leaves few, and these are computed from the vectors in double
    precision and merged through heaps of k + 1. So the result is exact, and ties go to the smaller vec_id.

    Equal vectors are searched once: classes of them are joined, and the k + 1 smallest vec_ids of a class stand for it, which no query can
    tell from all. ``is_query``: a condition on vec_id. Rows that :func:`vectors_of` leaves out take no part; a shorter vector counts as
    filled up with zeros; rows repeated with one vec_id are one row; fewer than k others give all. An empty table gives no rows.
    """
    vectors = materialise(vectors_of(rows), "near-vectors")
    classes = materialise(vector_classes(vectors, k + 1), "near-classes")
    codes = materialise(_quantised(classes), "near-codes")
    asking = materialise(vectors.where(is_query).join(classes.select("class_id", "code"), "code").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("q")), "near-asking")
    queries = materialise(codes.join(asking.select(F.col("q").alias("class_id")).distinct(), "class_id", "left_semi"), "near-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-classes.count() // ROW_BLOCK))

    def gather(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return survivors(rows, asked, k + 1)

    pairs = materialise(_cells(codes, queries, blocks).applyInPandas(gather, "q long, class_id long, least double, most double"), "near-pairs")
    cut = pairs.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("most", "class_id"))).where(F.col("n") == k + 1).select("q", F.col("most").alias("cut"))
    pairs = pairs.join(cut, "q", "left").where("cut is null or least <= cut").select("q", "class_id")
    full = classes.select("class_id", "code")
    pairs = pairs.join(full.withColumnRenamed("code", "v"), "class_id").join(full.select(F.col("class_id").alias("q"), F.col("code").alias("u")), "q")
    nearer = [F.col("score"), F.col("class_id")]
    leading = _settled(pairs, k + 1).withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(*nearer))).where(F.col("n") <= k + 1)
    members = leading.join(classes.select("class_id", "members"), "class_id").select("q", "score", F.explode("members").alias("vec_id"))
    by_score = [F.col("score"), F.col("vec_id")]
    members = members.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(*by_score))).where(F.col("n") <= k + 1)
    found = asking.join(members.drop("n"), "q").where("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by_score)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
