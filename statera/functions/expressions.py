"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number in text. A plain try_cast would also take '1d' and '1f'.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def to_number(c: Column) -> Column:
    """A double, or NULL for text that is no number; NaN counts as missing."""
    text = c.cast("string")
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def number_of(df: DataFrame, name: str) -> Column:
    """:func:`to_number` of a column of ``df``; doubles, decimals and integers don't go through text, and infinities are no numbers either."""
    if isinstance(df.schema[name].dataType, T.DoubleType | T.DecimalType | T.IntegralType):
        return finite(col(name).cast("double"))
    return to_number(col(name))


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    """Between the bounds; NULL stays NULL, as greatest() and least() alone would lose it."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lit(low)), lit(high)))


def floor_at_zero(c: Column) -> Column:
    """max(c, 0), NULL for NULL."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def logistic(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def slug(name: str) -> str:
    """Lower case, spaces as underscores."""
    return name.strip().lower().replace(" ", "_")


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns, booleans not among them."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def first_present(df: DataFrame, *names: str) -> str | None:
    """The first of the names that is a column: presence decides, not values."""
    return next((n for n in names if n in df.columns), None)
