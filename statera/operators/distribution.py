"""Quantile bins and inequality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions.expressions import clip, col
from statera.functions.ranking import running_in_group, with_group
from statera.sources.storage import materialise


#: Accuracy of the sketches that brackets are taken from: a sketched percentile's rank is off by at most one in so many of the rows.
ACCURACY = 10_000


def _values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, __x): the values as doubles. NULL and NaN are no values."""
    return df.select(*map(col, by), col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))


def _bracketed(df: DataFrame, value: str, q: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, __n) for each group, and (by, __x, __c, __r): of the values that can be points how often they come, and the rank of the last of them.

    A sketch of each group brackets every point. Only the values within brackets are sorted; those between are counted by bracket, as one row without a value.
    In a group so small that a bracket would hold few rows, all values count as within.
    """
    values, off = _values(df, value, by), 2 / ACCURACY
    at = [(max(0.0, i / q - off), min(1.0, i / q + off)) for i in range(q + 1)]
    cuts = F.percentile_approx("__x", [p for pair in at for p in pair], ACCURACY)
    sketch = materialise(values.groupBy(*map(col, by)).agg(F.count("*").alias("__n"), cuts.alias("__cuts")), "quantile-sketch")
    x, cut = F.col("__x"), F.col("__cuts")
    inside = (F.col("__n") <= 4 * ACCURACY) | F.exists(F.sequence(F.lit(0), F.lit(2 * q), F.lit(2)), lambda i: (F.get(cut, i) <= x) & (x <= F.get(cut, i + 1)))
    below = F.coalesce(F.array_max(F.filter(cut, lambda c: c < x)), F.lit(float("-inf")))
    dealt = with_group(values, sketch, by).select(*map(col, by), F.when(inside, x).otherwise(below).alias("__k"), (~inside).alias("__between"))
    counts = dealt.groupBy(*map(col, by), "__k", "__between").agg(F.count("*").alias("__c"))
    own = by or ["__whole"]  # a group like any other: what brackets hold of a table is small, or else spread
    ranked = running_in_group(counts if by else counts.withColumn("__whole", F.lit(0)), own, [F.col("__k"), F.col("__between")], "__c", "__r").drop("__whole")
    return sketch.select(*map(col, by), "__n"), ranked.withColumn("__x", F.when(~F.col("__between"), F.col("__k")))


def quantile_points(df: DataFrame, value: str, q: int, by: list[str] | None = None, fewer: bool = False, approx: bool = False, name: str = "points") -> DataFrame:
    """One row for each group of ``by``: the q + 1 points that cut its values into ``q`` quantile bins, linearly interpolated.

    Exact points are selected by brackets (:func:`_bracketed`), so no group is sorted. With ``fewer``, a group with fewer distinct values has as many
    bins, and all values are counted and ranked. ``approx`` takes approximate percentiles alone. NULL and NaN are no values; groups without values have no row.
    """
    by = by or []
    x, c, r = F.col("__x"), F.col("__c"), F.col("__r")
    if approx:
        points = F.percentile_approx(value, [i / q for i in range(q + 1)], 10000)
        return df.groupBy(*by).agg(points.alias(name)).where(F.col(name).isNotNull())
    if fewer:
        counts = _values(df, value, by).groupBy(*map(col, by), "__x").agg(F.count("*").alias("__c"))
        ranked = running_in_group(counts, by, [x], "__c", "__r")
        groups = ranked.groupBy(*map(col, by)).agg(F.sum(c).alias("__n"), F.count("*").alias("__d")).where("__n is not null")
        bins = F.least(F.lit(q), F.col("__d").cast("int"))
    else:
        (groups, ranked), bins = _bracketed(df, value, q, by), F.lit(q)
        groups = groups.where("__n > 0")
    at = F.col("__place") / bins * (F.col("__n") - 1)
    places = groups.withColumn("__place", F.explode(F.sequence(F.lit(0), bins))).select(*(col(k).alias(f"__g{i}") for i, k in enumerate(by)), "__place", F.floor(at).alias("__low"), F.ceil(at).alias("__high"), (at - F.floor(at)).alias("__part"))
    holds = lambda place: (r - c <= F.col(place)) & (F.col(place) < r)
    near = holds("__low") | holds("__high")
    for i, k in enumerate(by):
        near = near & col(k).eqNullSafe(F.col(f"__g{i}"))
    found = ranked.join(places if by else F.broadcast(places), near)  # without groups q + 1 rows
    # a sketch that broke its bound would leave a place between brackets: an error, never a wrong point
    point = F.when(x.isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(x)
    low, high = F.max(F.when(holds("__low"), point)), F.max(F.when(holds("__high"), point))
    edges = found.groupBy(*map(col, by), "__place").agg((low + (high - low) * F.max("__part")).alias("__e"))
    gathered = F.array_sort(F.collect_list(F.struct("__place", "__e")))
    return edges.groupBy(*map(col, by)).agg(F.transform(gathered, lambda p: p["__e"]).alias(name)).where(F.size(name) > 0)


def quantile_edges(df: DataFrame, value: str, q: int, by: list[str] | None = None, fewer: bool = False, approx: bool = False, name: str = "edges") -> DataFrame:
    """:func:`quantile_points` with equal ones once."""
    return quantile_points(df, value, q, by, fewer, approx, name).withColumn(name, F.array_distinct(name))


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin from 0 of a value among edges, the lowest edge included; NULL for NULL and where there is no bin."""
    below = F.size(F.filter(edges, lambda e: e < value)) - 1
    return F.when(value.isNotNull() & (F.size(edges) > 1), F.greatest(below, F.lit(0)))


def quantile_cut(df: DataFrame, value: str, q: int, by: list[str] | None = None, name: str = "bin", approx: bool = False) -> DataFrame:
    """``df`` with each row's quantile bin from 0. Equal edges are one, so bins can be fewer; a constant column has none (NULL)."""
    edges = quantile_edges(df, value, q, by, approx=approx, name="__edges")
    joined = with_group(df, edges, by or [])  # without groups one row of q + 1 numbers
    return joined.withColumn(name, bin_of(col(value), F.col("__edges"))).drop("__edges")


def gini(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One row (for each group): the Gini coefficient, NULL values left out; all zero (or no rows) gives 0, a zero sum of mixed signs NULL.

    Equal values are counted first; a block of c equal values x that ends at rank R adds x * (c * R - c * (c - 1) / 2).
    Ranks are running totals within the group; a group of very many different values is spread over ranges.
    """
    by = by or []
    blocks = df.where(col(value).isNotNull()).groupBy(*map(col, by), col(value).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    blocks = running_in_group(blocks, by, [F.col("__x")], "__c", "__r")
    c, r, x = F.col("__c").cast("double"), F.col("__r").cast("double"), F.col("__x")
    sums = blocks.groupBy(*by).agg(F.sum(x * (c * r - c * (c - 1) / 2)).alias("__ix"), F.sum(x * c).alias("__s"), F.sum("__c").alias("__n"), F.max(F.abs(x)).alias("__most"))
    n = F.col("__n").cast("double")
    value_ = F.when(F.col("__n").isNull() | (F.col("__most") <= 1e-8), 0.0).when(F.col("__s") != 0, 2 * F.col("__ix") / (n * F.col("__s")) - (n + 1) / n)
    return sums.select(*by, value_.alias("gini"))


def mean_by_quantile(df: DataFrame, value: str, q: int = 10, of: str | None = None) -> DataFrame:
    """(bin, mean, count) of quantile bins of ``value``; the mean is of ``of`` (default: the value itself)."""
    cut = quantile_cut(df, value, q).where("bin is not null")
    return cut.groupBy("bin").agg(F.avg(of or value).alias("mean"), F.count("*").alias("count"))


def _sentiment(df: DataFrame, value: str, q: int, weight: float) -> DataFrame:
    mean = df.agg(F.avg(value).alias("__all"))
    bins = mean_by_quantile(df, value, q).join(F.broadcast(mean))
    delta = F.when(F.col("__all") == 0, 0.0).otherwise((F.col("mean") - F.col("__all")) / F.col("__all"))
    return bins.select("bin", clip(55 + 100 * weight * delta, 0.0, 100.0).alias("sentiment"))


def sentiment_by_quantile(df: DataFrame, value: str, q: int = 10) -> DataFrame:
    """(bin, sentiment): 55 plus 40 times the bin mean's relative distance from the mean, in 0 to 100."""
    return _sentiment(df, value, q, 0.4)


def sentiment_by_decile(df: DataFrame, value: str) -> DataFrame:
    """As :func:`sentiment_by_quantile` over deciles, with weight 45."""
    return _sentiment(df, value, 10, 0.45)


def winners_losers(df: DataFrame, delta: str = "delta_disposable", clusters: int = 5) -> DataFrame:
    """(cluster, mean_delta, count) of quantile bins of the change; a constant change has no clusters."""
    return mean_by_quantile(df, delta, clusters).select(F.col("bin").alias("cluster"), F.col("mean").alias("mean_delta"), "count")
