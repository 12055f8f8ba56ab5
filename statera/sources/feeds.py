"""Landed feed files to canonical tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statera.functions.expressions import col, first_present, to_number
from statera.functions.ranking import rank_global

EVENT_COLUMNS = ("event_id", "event_date", "country", "actor1_country", "actor2_country", "actor1", "actor2", "themes", "source_url", "num_articles", "tone", "goldstein", "latitude", "longitude")


def _at(*names: str) -> str:
    """The path of nested keys in a VARIANT."""
    return "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names)


def _payloads(spark: SparkSession, path: str, root: Sequence[str], lines: bool) -> DataFrame:
    """(value, payload, records) of each payload: its text, what it parses to (NULL: nothing) and its records, found by its own shape."""
    text = spark.read.text(path, wholetext=not lines).where(F.col("value").rlike(r"\S")).withColumn("payload", F.try_parse_json("value"))
    payload, none, many = F.col("payload"), F.array().cast("array<variant>"), "array<variant>"
    listed = F.try_variant_get(payload, "$", many)
    second = F.get(listed, F.lit(1))
    said = (F.size(listed) == 2) & (F.is_variant_null(second) | F.try_variant_get(second, "$", many).isNotNull()) & F.try_variant_get(F.get(listed, F.lit(0)), "$", "map<string,variant>").isNotNull()
    records = F.when(said, F.coalesce(F.try_variant_get(second, "$", many), none)).when(listed.isNotNull(), listed)
    for name in root:
        own = F.try_variant_get(payload, _at(name), "variant")
        records = records.when(F.is_variant_null(own), none).when(own.isNotNull(), F.coalesce(F.try_variant_get(own, "$", many), F.array(own)))
    return text.withColumn("records", records.when(payload.isNotNull(), F.array(payload)))


def _is_object(c: Column) -> Column:
    return F.try_variant_get(c, "$", "map<string,variant>").isNotNull()


def _plain(kind: T.DataType) -> T.DataType:
    """Inferred types as they are read: decimals as doubles, keys that are always null or of several types as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    return T.DoubleType() if isinstance(kind, T.DecimalType | T.FloatType) else T.StringType() if isinstance(kind, T.NullType | T.VariantType) else kind


def _inferred(records: DataFrame) -> T.StructType:
    """The keys of all records with their types, nested objects as structs."""
    found = records.agg(F.schema_of_variant_agg("record")).first()[0] or "VOID"
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], found)
    kind = T.StructType() if ddl in ("VOID", "OBJECT") else _plain(T._parse_datatype_string(ddl))
    return kind if isinstance(kind, T.StructType) else T.StructType()


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    out = []
    for f in schema.fields:
        out += _leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [((*path, f.name), f.dataType)]
    return out


def _value(path: tuple[str, ...], kind: T.DataType) -> Column:
    """A key of a record; what isn't of its type is NULL, and text takes anything, objects and lists as JSON."""
    if isinstance(kind, T.StringType):
        own = F.try_variant_get("record", _at(*path), "variant")
        return F.when(~F.is_variant_null(own), F.coalesce(F.try_variant_get(own, "$", "string"), F.to_json(own)))
    return F.try_variant_get("record", _at(*path), kind.simpleString())


def read_feed(spark: SparkSession, path: str, root: Sequence[str] = ("data", "results"), schema: str | T.StructType | None = None, lines: bool = False) -> DataFrame:
    """Landed JSON payloads as rows, one for each record, nested objects as columns with dotted names.

    A file holds one payload, or with ``lines`` one in each line, which Spark can split. Every payload is read by its own shape: an object
    gives the first of the ``root`` keys that it has (a list: its records, null: none, an object: that one), else itself; a list of an object that is said about
    the records and the records, ``[meta, [record, ...]]``, gives the records (none if they are null); any other list is the records. So a folder
    may hold payloads of all shapes. ``schema`` is that of a record; without it the columns are the keys of all records, which takes a look at the whole input first; keys that
    records lack are NULL. Without any record there are no columns. What is no object, and text that is no JSON, is not lost but listed by :func:`unread_payloads`.
    """
    # the outer form: of the plain one Spark infers a filter on the records' number below the parsing, which then runs again for each mention of a payload
    records = _payloads(spark, path, root, lines).select(F.explode_outer("records").alias("record")).where(_is_object(F.col("record")))
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema if schema is not None else _inferred(records)
    return records.select(*(_value(keys, leaf).alias(".".join(keys)) for keys, leaf in _leaves(kind)))


def unread_payloads(spark: SparkSession, path: str, root: Sequence[str] = ("data", "results"), lines: bool = False) -> DataFrame:
    """(value, records) of what :func:`read_feed` can't give rows of: payloads that are no JSON (records: NULL), and those with records that are no objects (their number)."""
    odd = F.size(F.filter("records", lambda r: ~_is_object(r)))
    number = F.when(F.col("payload").isNotNull(), odd)
    found = _payloads(spark, path, root, lines).select("value", F.explode_outer(F.array(number)).alias("records"))  # as in read_feed: a filter on it stays above the parsing
    return found.where("records is null or records > 0")


def _pick(df: DataFrame, *names: str, default: str | None = None) -> Column:
    found = first_present(df, *names)
    return col(found) if found else F.lit(default).cast("string")


def _stamp(c: Column) -> Column:
    """A timestamp without zone, NULL where the text is none."""
    return c.try_cast("timestamp_ntz")


def _dated(df: DataFrame, start: datetime, names: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Column]:
    """The date from the first of ``names``; without one, consecutive days from ``start`` by ``order``."""
    found = first_present(df, *names)
    if found:
        return df, _stamp(col(found))
    if not order:
        raise ValueError("rows without a date column need an ordering column")
    ranked = rank_global(df, [col(c).asc_nulls_last() for c in order], "__day")
    return ranked, F.timestamp_add("DAY", F.col("__day") - 1, F.lit(start).cast("timestamp_ntz"))


def normalise_events(df: DataFrame, start: datetime, order: Sequence[str] = ()) -> DataFrame:
    """Raw event feed to the 14 canonical columns.

    Which raw column counts is decided by presence. Country codes go to upper case, untrimmed for the event and trimmed for
    actors (blank: NULL); numbers that don't parse are 0, places that don't parse NULL; rows without a date get ``start``.
    """
    if "SQLDATE" in df.columns:
        text = col("SQLDATE").cast("string")
        when = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    else:
        df, when = _dated(df, start, ("EventDate",), order)
    actor = lambda *names: F.nullif(F.upper(F.trim(F.coalesce(_pick(df, *names, default="").cast("string"), F.lit("")))), F.lit(""))
    text_of = lambda default, *names: F.coalesce(_pick(df, *names, default=default).cast("string"), F.lit(default))
    number = lambda *names: F.coalesce(to_number(_pick(df, *names, default="0")), F.lit(0.0))
    place = lambda *names: to_number(_pick(df, *names))
    return df.select(
        _pick(df, "GLOBALEVENTID", "GlobalEventID", default="").cast("string").alias("event_id"),
        F.coalesce(when, F.lit(start).cast("timestamp_ntz")).alias("event_date"),
        F.upper(text_of("GLOBAL", "ActionGeo_CountryCode", "Actor1CountryCode", "Actor2CountryCode")).alias("country"),
        actor("Actor1CountryCode", "Actor1Geo_CountryCode").alias("actor1_country"),
        actor("Actor2CountryCode", "Actor2Geo_CountryCode").alias("actor2_country"),
        text_of("UNKNOWN", "Actor1Name", "Actor1Code").alias("actor1"),
        text_of("UNKNOWN", "Actor2Name", "Actor2Code").alias("actor2"),
        text_of("", "Themes", "SourceCommonName").alias("themes"),
        text_of("", "SOURCEURL", "DocumentIdentifier").alias("source_url"),
        number("NumArticles").alias("num_articles"),
        number("AvgTone").alias("tone"),
        number("GoldsteinScale").alias("goldstein"),
        place("ActionGeo_Lat", "Actor1Geo_Lat", "Actor2Geo_Lat").alias("latitude"),
        place("ActionGeo_Long", "Actor1Geo_Long", "Actor2Geo_Long").alias("longitude"),
    )


def normalise_conflict(df: DataFrame, start: datetime, order: Sequence[str] = ()) -> DataFrame:
    """(event_date, country) of a conflict feed, by date."""
    df, when = _dated(df, start, ("event_date", "date"), order)
    country = F.coalesce(_pick(df, "country", "country_name", "admin1", default="GLOBAL").cast("string"), F.lit("GLOBAL"))
    return df.select(when.alias("event_date"), country.alias("country")).orderBy("event_date", "country")


def _indicator(df: DataFrame, start: datetime, order: Sequence[str], dates, countries, values, name: str) -> DataFrame:
    df, when = _dated(df, start, dates, order)
    value = first_present(df, *values)
    number = F.coalesce(to_number(col(value)), F.lit(0.0)) if value else F.lit(0.0)
    country = F.coalesce(_pick(df, *countries, default="GLOBAL").cast("string"), F.lit("GLOBAL"))
    return df.select(when.alias("date"), country.alias("country"), number.alias(name)).orderBy("date", "country")


def normalise_displacement(df: DataFrame, start: datetime, order: Sequence[str] = ()) -> DataFrame:
    """(date, country, displaced_population) of a displacement feed."""
    return _indicator(df, start, order, ("date", "record_date"), ("country", "coo_name", "country_origin", "origin_country_name"), ("individuals", "value", "population", "people", "count"), "displaced_population")


def normalise_access(df: DataFrame, start: datetime, order: Sequence[str] = ()) -> DataFrame:
    """(date, country, access_constraint_score) of an access feed."""
    return _indicator(df, start, order, ("date", "report_date"), ("country", "admin1_name", "country_name", "iso3"), ("access", "value", "score", "constraint"), "access_constraint_score")


def indicator_name(code: str, aliases: Mapping[str, str] | None = None) -> str:
    """The alias of an indicator code, else the code in lower case with dots as underscores."""
    return (aliases or {}).get(code) or code.lower().replace(".", "_")


def normalise_indicator(df: DataFrame, code: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(date, <indicator>): yearly records (date: the year, value) as the mean for each January 1st, unparsed ones left out.

    Without a column date or value, as after payloads that hold no records or only a message, the table is empty and has both columns.
    """
    if not {"date", "value"} <= set(df.columns):
        return df.select(F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias(indicator_name(code, aliases))).where(F.lit(False))
    year = F.when(col("date").cast("string").rlike(r"^\d{4}$"), F.concat(col("date").cast("string"), F.lit("-01-01")).try_cast("date"))
    rows = df.select(year.alias("date"), to_number(col("value")).alias("value")).dropna()
    return rows.groupBy("date").agg(F.avg("value").alias(indicator_name(code, aliases)))


def merge_indicators(tables: Sequence[DataFrame]) -> DataFrame:
    """One row for each date with the columns of all tables that have rows, by a stacked union and one aggregation instead of N - 1 joins; without any, an empty column date."""
    empty = tables[0].select("date").where(F.lit(False)) if tables else None
    tables = [t for t in tables if not t.isEmpty()]
    if not tables:
        if empty is None:
            raise ValueError("no tables to merge")
        return empty
    names = [c for t in tables for c in t.columns if c != "date"]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return stacked.groupBy("date").agg(*(F.first(col(n), ignorenulls=True).alias(n) for n in names)).orderBy("date")


def densify_daily(df: DataFrame, start: date, end: date) -> DataFrame:
    """Every day from the first date to ``end``, values carried forward, days without any left out, cut to [start, end].

    One series: its rows are days, so the window over them is as long as the calendar.
    """
    values = [c for c in df.columns if c != "date"]
    rows = df.withColumn("date", F.to_date("date")).groupBy("date").agg(*(F.first(col(c), ignorenulls=True).alias(c) for c in values))
    days = rows.agg(F.min("date").alias("low")).where("low is not null").select(F.explode(F.sequence("low", F.greatest("low", F.lit(end)), F.expr("interval 1 day"))).alias("date"))
    before = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    filled = days.join(rows, "date", "left").select("date", *(F.last(col(c), ignorenulls=True).over(before).alias(c) for c in values))
    return filled.dropna(how="all", subset=values).where(F.col("date").between(F.lit(start), F.lit(end)))


def fetch_window(df: DataFrame, end: datetime, lookback_days: int, column: str = "event_date") -> DataFrame:
    """Rows in [end - lookback, end]."""
    last = F.lit(end).cast("timestamp_ntz")
    return df.where(col(column).between(F.timestamp_add("DAY", F.lit(-lookback_days), last), last))


def provenance(df: DataFrame, source: str, endpoint: str, start: datetime, end: datetime, query: str | None = None, retrieved_at: datetime | None = None, fallback: str | None = None, error: str | None = None) -> DataFrame:
    """One row that says where a table came from, with its number of rows."""
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    text = lambda x: F.lit(x).cast("string")
    days = (end - start).days
    return df.agg(F.count("*").alias("rows")).select(
        text(source).alias("source"), text(endpoint).alias("endpoint"), (stamp(retrieved_at) if retrieved_at else F.current_timestamp().cast("timestamp_ntz")).alias("retrieved_at"), stamp(start).alias("start"), stamp(end).alias("end"),
        text(query).alias("query"), F.lit(days).alias("lookback_days"), "rows", text(fallback).alias("fallback"), text(error).alias("error"),
    )
