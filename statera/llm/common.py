"""What the operators of this subpackage share: tables, shared storage and the word definition."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.sources.storage import fresh_path, listed, materialise, publish  # noqa: F401  the operators take them from here
from statera.sources.tables import table  # noqa: F401

#: A word is a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package when it runs from a source tree."""
    env = spark.sparkContext.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [PACKAGE_ROOT, env.get("PYTHONPATH", "")]))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it a column that ``df`` doesn't have: for columns that an operator adds for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def groups(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts with at most ``most`` bytes; a longer text is a run of its own."""
    start, room = 0, most
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if n > room and i > start:
            yield start, i - start
            start, room = i, most
        room -= n
    if len(texts) > start:
        yield start, len(texts) - start


def ordered_blocks(df: DataFrame, name: str, n: int) -> Column:
    """A column that numbers about ``n`` consecutive ranges of the long column ``name``; null is in range 0.

    At most 64 approximate quantiles of the column cut it into segments, and equal widths cut these, so uneven ids
    stay spread. Only the quantiles reach the driver; the numbers of ranges rise with the values.
    """
    segments = max(1, min(n, 64))
    cuts = [i / segments for i in range(1, segments)]
    least, most, inner = df.agg(F.min(name), F.max(name), F.percentile_approx(name, cuts or [0.5], 10000)).first()
    if least is None:
        return F.lit(0)
    edges = sorted({least, most + 1, *(inner if cuts else [])})
    value, parts = F.col(name), -(-n // segments)
    segment = F.lit(0)
    for edge in edges[1:-1]:
        segment = segment + (value >= edge).cast("int")
    if parts == 1:
        return F.coalesce(segment, F.lit(0))
    bounds = F.array(*(F.lit(float(x)) for x in edges))
    low, high = F.get(bounds, segment), F.get(bounds, segment + 1)
    inside = F.least(F.floor((value.cast("double") - low) * parts / (high - low)), F.lit(parts - 1))
    return F.coalesce((segment * parts + F.greatest(inside, F.lit(0))).cast("int"), F.lit(0))
