"""Filters, column cleaning and presentation of event tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statera.functions.expressions import NUMBER, col, first_present, slug
from statera.sources.feeds import EVENT_COLUMNS, fetch_window
from statera.sources.storage import materialise


def event_filter(keywords: Iterable[str] = (), countries: Iterable[str] = (), themes: Iterable[str] = (), sources: Iterable[str] = (), tone_min: float | None = None, tone_max: float | None = None, extra: Iterable[Column] = (), text: str = "themes") -> Column | None:
    """AND of the clauses given, each an OR of its values; strict tone bounds; None if there is no clause.

    Keywords are looked for in column ``text`` without regard to case, themes as items of the list split at semicolons,
    countries in upper case.
    """
    any_of = lambda parts: reduce(or_, parts)
    clauses = []
    if keywords := list(keywords):
        clauses.append(any_of([F.contains(F.lower(col(text)), F.lit(k.lower())) for k in keywords]))
    if countries := [c.upper() for c in countries]:
        clauses.append(F.upper("country").isin(countries))
    if themes := list(themes):
        clauses.append(any_of([F.array_contains(F.split("themes", ";"), t) for t in themes]))
    if sources := list(sources):
        clauses.append(F.col("collection").isin(sources))
    if tone_min is not None:
        clauses.append(F.col("tone") > tone_min)
    if tone_max is not None:
        clauses.append(F.col("tone") < tone_max)
    clauses += list(extra)
    return reduce(and_, clauses) if clauses else None


def recent_events(df: DataFrame, end: datetime, days: int = 7, query: Column | None = None, sort: Sequence[Column] | None = None, limit: int | None = None, max_records: int = 250) -> DataFrame:
    """The latest events of the window that pass ``query``: newest first unless ``sort`` says otherwise, at most ``max_records``."""
    rows = fetch_window(df, end, days)
    rows = rows if query is None else rows.where(query)
    order = sort or [F.col("event_date").desc(), F.col("event_id")]
    return rows.orderBy(*order).limit(max_records if limit is None else min(limit, max_records))


def standard_names(names: Sequence[str]) -> list[str]:
    """Slugs; of names that clash the second gets _1, the third _2 and so on, and none is lost."""
    taken: set[str] = set()
    out = []
    for base in map(slug, names):
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        out.append(name)
    return out


def standardise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


def _is_date_name(name: str) -> bool:
    parts = name.lower().split("_")
    return "date" in parts or name.lower() == "timestamp"


def parse_date_columns(df: DataFrame) -> DataFrame:
    """Columns with the word date in their names, or named timestamp, as timestamps; what doesn't parse is NULL."""
    parsed = {c: col(c).try_cast("timestamp_ntz") for c, kind in df.dtypes if _is_date_name(c) and kind in ("string", "date", "timestamp")}
    return df.withColumns(parsed) if parsed else df


def find_date_column(df: DataFrame) -> str | None:
    """event_date, else date, else timestamp, else the first timestamp column."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)]
    return first_present(df, "event_date", "date", "timestamp") or (stamps[0] if stamps else None)


def infer_numeric(df: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """Text columns of which all values are numbers (or empty) become doubles. One pass over all of them decides."""
    texts = [c for c, kind in df.dtypes if kind == "string" and c not in without]
    if not texts:
        return df
    filled = lambda c: col(c).isNotNull() & (F.trim(col(c)) != "")
    bad = df.agg(*(F.count_if(filled(c) & ~col(c).rlike(NUMBER)).alias(f"b{i}") for i, c in enumerate(texts)), *(F.count_if(filled(c)).alias(f"f{i}") for i, c in enumerate(texts))).first()
    numeric = [c for i, c in enumerate(texts) if not bad[f"b{i}"] and bad[f"f{i}"]]
    return df.withColumns({c: F.when(col(c).rlike(NUMBER), col(c).try_cast("double")) for c in numeric}) if numeric else df


def build_silver(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Names, dates, distinct rows, no rows without a date, numbers as numbers; sorted by date unless more work follows (``ordered``).

    With text columns the distinct rows are written to the shared folder, as what is a number is decided over all of them.
    """
    tidy = parse_date_columns(standardise_columns(df)).dropDuplicates()
    when = find_date_column(tidy)
    if when:
        tidy = tidy.dropna(subset=[when])
    if any(kind == "string" for c, kind in tidy.dtypes if c != when):
        tidy = materialise(tidy, "silver")
    tidy = infer_numeric(tidy, [when] if when else [])
    return tidy.orderBy(when) if when and ordered else tidy


def tone_bucket(tone: Column) -> Column:
    """Name of a tone's range."""
    return F.when(tone.isNull(), "n/a").when(tone >= 3, "very positive").when(tone >= 1, "positive").when(tone <= -3, "very negative").when(tone <= -1, "negative").otherwise("neutral")


def event_table(df: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Events for reading: date, country, interaction, main_theme, articles, mean_tone, sentiment, goldstein, source_url.

    Rounding is half-even; the sentiment is that of the rounded tone. event_id and the actors' countries stay for filters.
    """
    named = lambda c: F.when(F.col(c) == "", unknown).otherwise(F.col(c))
    given = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    tone = F.bround("tone", 2)
    return df.select(
        F.date_format("event_date", "yyyy-MM-dd HH:mm").alias("date"),
        F.coalesce("country", F.lit("GLOBAL")).alias("country"),
        F.concat(named("actor1"), F.lit(" ↔ "), named("actor2")).alias("interaction"),
        F.trim(F.get(F.split(F.coalesce("themes", F.lit("")), ";"), F.lit(0))).alias("main_theme"),
        F.coalesce(F.col("num_articles"), F.lit(0)).cast("long").alias("articles"),
        tone.alias("mean_tone"),
        tone_bucket(tone).alias("sentiment"),
        F.bround("goldstein", 2).alias("goldstein"),
        F.nullif(F.col("source_url"), F.lit("")).alias("source_url"),
        F.upper(given("actor1_country")).alias("actor1_country"),
        F.upper(given("actor2_country")).alias("actor2_country"),
        given("event_id").alias("event_id"),
    )


def filter_event_table(df: DataFrame, countries: Iterable[str] = (), sentiment: Iterable[str] = (), search: str = "", tone_range: tuple[float, float] | None = None) -> DataFrame:
    """Rows of an event table: any of the countries, any of the sentiments, the text in interaction or theme, the tone in range."""
    if countries := [c.upper() for c in countries]:
        known = [c for c in ("country", "actor1_country", "actor2_country") if c in df.columns]
        df = df.where(reduce(or_, (F.coalesce(F.col(c).isin(countries), F.lit(False)) for c in known)))
    if sentiment := list(sentiment):
        df = df.where(F.col("sentiment").isin(sentiment))
    if needle := search.strip().lower():
        df = df.where(F.contains(F.lower("interaction"), F.lit(needle)) | F.contains(F.lower("main_theme"), F.lit(needle)))
    if tone_range:
        df = df.where(F.col("mean_tone").between(*tone_range))
    return df


def serialise_columns(df: DataFrame, limit: int | None = None, order: Sequence[Column] = (), columns: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """Known columns that exist, timestamps as ISO text, and the row as JSON in column ``record``; the first ``limit`` rows."""
    kept = [c for c in columns if c in df.columns]
    iso = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)}
    rows = df.orderBy(*order) if order else df
    rows = (rows if limit is None else rows.limit(limit)).select(*(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c in iso else F.col(c) for c in kept))
    return rows.withColumn("record", F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}))


def digitize(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value: a value on an edge goes up."""
    return F.when(value.isNotNull(), reduce(lambda a, b: a + b, ((value >= e).cast("int") for e in edges)))


def kpi_state(runs: DataFrame) -> DataFrame:
    """``runs`` with the buckets of unemployment_rate, cpi / 100 and sentiment / 100."""
    return runs.withColumns({
        "unemployment_state": digitize(F.col("unemployment_rate"), [0.05, 0.08, 0.12, 0.2]),
        "price_state": digitize(F.col("cpi") / 100, [0.9, 1.05, 1.2, 1.4]),
        "sentiment_state": digitize(F.col("sentiment") / 100, [0.4, 0.6, 0.75, 0.85]),
    })


def head(df: DataFrame, limit: int, order: Sequence[Column]) -> DataFrame:
    """The first rows in an order."""
    return df.orderBy(*order).limit(limit)


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """Sorted distinct values, NULL not among them."""
    return df.select(name).dropna().distinct().orderBy(name)


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
