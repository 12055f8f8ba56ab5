"""Global ranks, running sums, carried values and trailing windows without a window over a table or a large group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.functions.expressions import col
from statera.sources.storage import materialise

#: Rows of a group that one window may hold; larger groups are spread.
WINDOW_ROWS = 1 << 20


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*map(col, keys)).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0


def with_group(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of its group's row in ``stats`` (a row for each group, NULL a key like any other). A hot group's rows stay spread: AQE splits the join."""
    if not keys:
        return df.join(F.broadcast(stats), F.lit(True), "left")  # one row
    named = stats.select(*(col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(col(c) for c in stats.columns if c not in keys))
    same = reduce(and_, (col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return df.join(named, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range partitions of the order, written to the shared folder with the partition's number.

    The partitions' bounds are sampled, so another run could draw them elsewhere; as written they stay for the offsets and for the rows.
    """
    return materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def _offsets(ranged: DataFrame, value: Column) -> Column:
    """What the ranges before a row's range sum to: one number for each partition reaches the driver, and a row picks its own by place."""
    sums = {r[0]: r[1] or 0 for r in ranged.groupBy("__range").agg(F.sum(value)).collect()}
    total, before = 0, []
    for k in range(max(sums, default=0) + 1):
        before.append(F.lit(total))
        total = total + sums.get(k, 0)
    return F.get(F.array(*before), F.col("__range"))


def rank_global(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with a row number from 1 over the whole table in ``order`` (a total order for one result).

    Range partitions are numbered each on its own and shifted by the counts of those before.
    """
    ranged = _ranges(df, order)
    offset = _offsets(ranged, F.lit(1).cast("long"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, (own + offset).cast("long")).drop("__range")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with the row, over the whole table in ``order``."""
    ranged = _ranges(df, order)
    offset = _offsets(ranged, F.col(value))
    own = F.sum(value).over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, own + offset).drop("__range")


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with a row number from 1 within ``keys``: a window where there are keys and every group fits one, else global ranks without those of the groups before."""
    if keys and largest_group(df, keys) <= WINDOW_ROWS:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*map(col, keys)).orderBy(*order)).cast("long"))
    ranked = rank_global(df, [*(col(k).asc_nulls_first() for k in keys), *order], "__rank")
    first = ranked.groupBy(*map(col, keys)).agg(F.min("__rank").alias("__first"))
    return with_group(ranked, first, keys).withColumn(name, F.col("__rank") - F.col("__first") + 1).drop("__rank", "__first")


def running_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with the row within ``keys``: a window where there are keys and every group fits one, else running totals without those of the groups before."""
    own = [*map(col, keys)]
    rows = materialise(df, "running")
    if keys and largest_group(rows, keys) <= WINDOW_ROWS:
        return rows.withColumn(name, F.sum(value).over(W.partitionBy(*own).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    summed = running_total(rows, [*(c.asc_nulls_first() for c in own), *order], value, "__run")
    base = summed.groupBy(*own).agg(F.min(F.col("__run") - F.col(value)).alias("__base"))
    return with_group(summed, base, keys).withColumn(name, F.col("__run") - F.col("__base")).drop("__run", "__base")


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """``df`` with each value, or where it is NULL the last one before it within ``keys``; NULL before the first. Rows of one ``order`` go by their values, NULL first.

    Where every group fits a window, that does it. Else rows lie in ranges of (keys, order): a window fills within a range and group, and
    what a range leaves, its groups' last values that are not NULL, is carried on over the ranges, a row for each range and group.
    """
    rows = materialise(df, "carry")
    by = [col(order).asc_nulls_first(), *(col(v).asc_nulls_first() for v in values)]
    upto = lambda *own: W.partitionBy(*own).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    own = [*map(col, keys)]
    if keys and largest_group(rows, keys) <= WINDOW_ROWS:
        return rows.withColumns({v: F.last(col(v), ignorenulls=True).over(upto(*own)) for v in values})
    ranged = _ranges(rows, [*(col(k).asc_nulls_first() for k in keys), *by])
    at = F.struct(col(order), *map(col, values))
    left = ranged.groupBy("__range", *own).agg(*(F.max_by(F.when(col(v).isNotNull(), col(v)), F.when(col(v).isNotNull(), at)).alias(f"__left{i}") for i, v in enumerate(values)))
    before = W.partitionBy(*own).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # at most a row for each range
    carried = left.select("__range", *own, *(F.last(f"__left{i}", ignorenulls=True).over(before).alias(f"__carry{i}") for i in range(len(values))))
    filled = ranged.withColumns({v: F.last(col(v), ignorenulls=True).over(upto("__range", *own)) for v in values})
    joined = with_group(filled, carried, ["__range", *keys])
    return joined.withColumns({v: F.coalesce(col(v), F.col(f"__carry{i}")) for i, v in enumerate(values)}).select(*map(col, df.columns))


def trailing(df: DataFrame, keys: Sequence[str], position: Column, n: int, values: Mapping[str, Callable[[W], Column]], block: int = 1 << 16) -> DataFrame:
    """``df`` with ``values`` over the rows of the same keys whose whole-numbered position is at most ``n`` - 1 before a row's own.

    A group is cut into blocks of positions, and each block gets the last n - 1 positions of the one before as a halo, so a window holds a
    block and its halo. Rows without a position are left out.
    """
    block = max(block, n)
    part = lambda c: F.floor(c / block)
    spread = df.withColumn("__at", position).where("__at is not null")
    spread = spread.withColumn("__block", F.explode(F.sequence(part(F.col("__at")), part(F.col("__at") + n - 1))))
    near = W.partitionBy(*map(col, keys), "__block").orderBy("__at").rangeBetween(-(n - 1), 0)
    out = spread.withColumns({name: f(near) for name, f in values.items()})
    return out.where(F.col("__block") == part(F.col("__at"))).drop("__at", "__block")
