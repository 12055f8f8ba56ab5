import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from statera.operators import clean, layers
from statera.sources import feeds

START = datetime(2024, 2, 1)


def payload(tmp_path, rows, root="results"):
    path = tmp_path / "feed.json"
    path.write_text(json.dumps({root: rows} if root else rows))
    return str(path)


def test_event_payload_to_canonical_columns(spark, tmp_path):
    row = dict(GLOBALEVENTID="1", SQLDATE="20240301", ActionGeo_CountryCode="ita", Actor1Name="Government", Actor2Name="Protesters", Themes="ENV_CLIMATE", SOURCEURL="http://x", NumArticles="3", AvgTone="-1.5", GoldsteinScale="2.0", ActionGeo_Lat="12.34", ActionGeo_Long="56.78")
    out = feeds.normalise_events(feeds.read_feed(spark, payload(tmp_path, [row])), START)
    assert tuple(out.columns) == feeds.EVENT_COLUMNS
    r = out.first()
    assert (r.country, r.tone, r.event_date, r.num_articles, r.latitude) == ("ITA", -1.5, datetime(2024, 3, 1), 3.0, 12.34)


def test_sparse_event_payload_gets_defaults(spark, tmp_path):
    r = feeds.normalise_events(feeds.read_feed(spark, payload(tmp_path, [dict(GLOBALEVENTID="2", SQLDATE="20240302", ActionGeo_CountryCode="FRA")])), START).first()
    assert (r.actor1, r.actor1_country, r.num_articles, r.tone, r.latitude) == ("UNKNOWN", None, 0.0, 0.0, None)


def test_presence_decides_and_bad_values_do_not_raise(spark):
    df = spark.createDataFrame([(None, "fra", "1d", "99999999", " usa ")], "ActionGeo_CountryCode string, Actor1CountryCode string, AvgTone string, SQLDATE string, Actor2CountryCode string")
    r = feeds.normalise_events(df, START).first()
    assert (r.country, r.actor1_country, r.actor2_country, r.tone, r.event_date) == ("GLOBAL", "FRA", "USA", 0.0, START)


def test_feed_root_and_nested_objects(spark, tmp_path):
    df = feeds.read_feed(spark, payload(tmp_path, [dict(a=1, b=dict(c=2, d=dict(e=3)))], "data"))
    assert df.columns == ["a", "b.c", "b.d.e"]
    assert feeds.read_feed(spark, payload(tmp_path, [dict(a=1)], None)).columns == ["a"]


def test_undated_rows_get_days_in_order_and_need_one(spark):
    df = spark.createDataFrame([(2, "B"), (1, "A")], "n int, country string")
    assert [(r.event_date.day, r.country) for r in feeds.normalise_conflict(df, START, ["n"]).collect()] == [(1, "A"), (2, "B")]
    with pytest.raises(ValueError):
        feeds.normalise_conflict(df, START)


def test_indicator_names_and_years(spark):
    assert feeds.indicator_name("NY.GDP") == "ny_gdp" and feeds.indicator_name("NY.GDP", {"NY.GDP": "gdp"}) == "gdp"
    df = spark.createDataFrame([("2020", "1"), ("2020", "3"), ("2021", None), ("x", "5")], "date string, value string")
    assert feeds.normalise_indicator(df, "X").collect() == [(date(2020, 1, 1), 2.0)]


def test_daily_series_is_filled_forward(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 3), None), (date(2024, 1, 4), 2.0)], "date date, x double")
    out = [(r.date.day, r.x) for r in feeds.densify_daily(df, date(2024, 1, 2), date(2024, 1, 5)).orderBy("date").collect()]
    assert out == [(2, 1.0), (3, 1.0), (4, 2.0), (5, 2.0)]


def test_merged_indicators_is_an_outer_join(spark):
    a = spark.createDataFrame([("d1", 1.0)], "date string, a double")
    b = spark.createDataFrame([("d1", 2.0), ("d2", 3.0)], "date string, b double")
    assert feeds.merge_indicators([a, b]).collect() == [("d1", 1.0, 2.0), ("d2", None, 3.0)]


def test_provenance_counts_rows(spark):
    r = feeds.provenance(spark.range(3).toDF("x"), "s", "e", datetime(2024, 1, 1), datetime(2024, 1, 31)).first()
    assert (r.rows, r.lookback_days, r.fallback, r.query) == (3, 30, None, None)


def test_event_filter_clauses(spark):
    assert clean.event_filter() is None
    df = spark.createDataFrame([("it", "ENV_CLIMATE;X climate change", -1.0), ("IT", "ENV_CLIMATE;energy", 3.0), ("fr", "ENV_CLIMATE;energy", 0.0), ("it", "ENV_CLIMATE2;energy", 0.0)], "country string, themes string, tone double")
    keep = clean.event_filter(["climate change", "energy"], ["it"], ["ENV_CLIMATE"], tone_min=-5, tone_max=3)
    assert [r.tone for r in df.where(keep).collect()] == [-1.0]


def test_recent_events_is_capped(spark):
    df = spark.createDataFrame([(str(i), datetime(2024, 1, 1 + i % 9)) for i in range(40)], "event_id string, event_date timestamp_ntz")
    assert clean.recent_events(df, datetime(2024, 1, 9), 30, max_records=10, limit=99).count() == 10
    assert clean.recent_events(df, datetime(2024, 1, 9), 30, max_records=10).first().event_date == datetime(2024, 1, 9)


def test_clashing_names_are_numbered():
    assert clean.standard_names([" A b", "a B ", "a_b", "a_b_1"]) == ["a_b", "a_b_1", "a_b_2", "a_b_1_1"]


def test_date_columns_by_word(spark):
    df = spark.createDataFrame([("2024-01-02", "7", "2024-01-03")], "event_date string, update_count string, timestamp string")
    r = clean.parse_date_columns(df).first()
    assert (r.event_date, r.update_count, r.timestamp) == (datetime(2024, 1, 2), "7", datetime(2024, 1, 3))
    assert clean.find_date_column(df) == "event_date"


def test_numbers_are_inferred_only_if_all_parse(spark):
    df = spark.createDataFrame([("1", "1", "", "1d"), ("2.5", "x", "3", "2")], "a string, b string, c string, d string")
    out = clean.infer_numeric(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "double", "d": "string"}
    assert out.first().c is None


def test_silver_drops_repeats_and_undated(spark):
    df = spark.createDataFrame([("2024-01-02", "1"), ("2024-01-02", "1"), ("bad", "2"), ("2024-01-01", "3")], "`Event Date` string, `N` string")
    assert clean.build_silver(df).collect() == [(datetime(2024, 1, 1), 3.0), (datetime(2024, 1, 2), 1.0)]


def test_gold_cases(spark):
    df = spark.createDataFrame([("2024-01-01", None, 1.0, True), ("2024-01-01", None, 3.0, True), ("2024-01-01", "A", float("nan"), False)], "date string, country string, v double, b boolean")
    out = layers.build_gold(df)
    assert out.columns == ["date", "country", "v"] and [(r.country, r.v) for r in out.collect()] == [(None, 2.0), ("A", None)]
    assert layers.build_gold(df.select("v")).count() == 1
    assert layers.build_gold(df.select("country")).count() == 2
    assert layers.build_gold(df.select("b")).count() == 3
    assert layers.combine_gold({"x": df.select("v")}) is None


def test_tone_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (None, 3.0, 2.9, 1.0, 0.0, -1.0, -3.0)], "t double")
    assert [r[0] for r in df.select(clean.tone_bucket(F.col("t"))).collect()] == ["n/a", "very positive", "positive", "positive", "neutral", "negative", "very negative"]


def test_event_table_and_its_filter(spark):
    row = ("1", datetime(2024, 1, 1, 5, 6), None, "", "B", "X ;Y", None, 0.125, 2.0, "", "ita", None)
    df = spark.createDataFrame([row], "event_id string, event_date timestamp_ntz, country string, actor1 string, actor2 string, themes string, num_articles double, tone double, goldstein double, source_url string, actor1_country string, actor2_country string")
    out = clean.event_table(df)
    r = out.first()
    assert (r.date, r.country, r.interaction, r.main_theme, r.articles, r.mean_tone, r.source_url) == ("2024-01-01 05:06", "GLOBAL", "Unknown ↔ B", "X", 0, 0.12, None)
    assert clean.filter_event_table(out, ["ITA"]).count() == 1 and clean.filter_event_table(out, ["FRA"]).count() == 0
    assert clean.filter_event_table(out, search="x", tone_range=(0.12, 1)).count() == 1
    assert clean.filter_event_table(out, search="x.*").count() == 0


def test_serialised_record_keeps_nulls(spark):
    df = spark.createDataFrame([("1", None, 5)], "event_id string, country string, other int")
    out = clean.serialise_columns(df, 5)
    assert out.columns == ["event_id", "country", "record"] and json.loads(out.first().record) == {"event_id": "1", "country": None}


def test_value_on_an_edge_goes_up(spark):
    assert [r[0] for r in spark.createDataFrame([(0.05,), (0.01,), (0.3,), (None,)], "x double").select(clean.digitize(F.col("x"), [0.05, 0.08, 0.12, 0.2])).collect()] == [1, 0, 4, None]


def test_payload_of_what_is_said_and_records(spark, tmp_path):
    def landed(name, payload):
        (tmp_path / name).write_text(json.dumps(payload, indent=1))
        return str(tmp_path / name)

    records = [dict(date="2020", value=1.5, country=dict(id="X")), dict(date="2021", value=None, country=dict(id="Y"))]
    got = feeds.read_feed(spark, landed("a.json", [dict(page=1, total=2), records]))
    assert sorted(map(tuple, got.select("`country.id`", "date", "value").collect())) == [("X", "2020", 1.5), ("Y", "2021", None)]
    assert feeds.normalise_indicator(got, "NY.GDP").collect() == [(date(2020, 1, 1), 1.5)]
    typed = feeds.read_feed(spark, landed("b.json", [dict(page=1), records]), schema="date string, value string")
    assert sorted(map(tuple, typed.collect())) == [("2020", "1.5"), ("2021", None)]
    for name, empty in (("c.json", [dict(page=1), None]), ("d.json", [dict(page=1), []])):
        assert feeds.read_feed(spark, landed(name, empty)).count() == 0
    assert feeds.read_feed(spark, landed("e.json", [dict(a=1), dict(a=2)])).count() == 2


def test_payloads_are_read_by_their_own_shape(spark, tmp_path):
    shapes = [
        dict(data=[dict(a=1, b=dict(c=2.5))]), dict(results=[dict(a="x")]), [dict(page=1), [dict(a=3), dict(a=4)]], [dict(a=5)], [dict(a=6), dict(a=7)], dict(a=8),
        [dict(page=1), None], dict(data=None, results=[dict(a=99)]), [], dict(data=[]), dict(data=dict(a=9, **{"it's": 1})), [dict(a=None), dict(a=[1, dict(z=2)])], dict(data=[10, None, [dict(a=1)], dict(a=11)]),
    ]
    for i, x in enumerate(shapes):
        (tmp_path / f"{i}.json").write_text(json.dumps(x, indent=1))
    (tmp_path / "broken.json").write_text('{"data": [{"a": 1}')
    (tmp_path / "blank.json").write_text(" \n")
    got = feeds.read_feed(spark, str(tmp_path))
    assert got.columns == ["a", "b.c", "it's"]
    assert sorted(r.a or "" for r in got.collect()) == sorted(["1", "x", *"3456789", "", '[1,{"z":2}]', "11"])
    assert [r["b.c"] for r in got.where("a = '1'").collect()] == [2.5]
    unread = {r.value[:12]: r.records for r in feeds.unread_payloads(spark, str(tmp_path)).collect()}
    assert unread == {'{"data": [{"': None, '{\n "data": [': 3}
    typed = feeds.read_feed(spark, str(tmp_path), schema="a int, b struct<c string, d int>, more boolean")
    assert typed.columns == ["a", "b.c", "b.d", "more"]
    assert sorted((r.a or 0, r["b.c"] or "") for r in typed.collect()) == [(0, "")] * 3 + [(1, "2.5"), *((i, "") for i in range(3, 10)), (11, "")]


@pytest.mark.parametrize("payload_text", ["[{}, null]", '[{"message": [{"id": "120", "value": "Invalid value"}]}]', "[]", '{"data": []}', "nonsense"])
def test_payloads_without_records_give_an_empty_indicator(spark, tmp_path, payload_text):
    (tmp_path / "a.json").write_text(payload_text)
    got = feeds.normalise_indicator(feeds.read_feed(spark, str(tmp_path)), "NY.GDP")
    assert got.columns == ["date", "ny_gdp"] and dict(got.dtypes) == {"date": "date", "ny_gdp": "double"} and got.count() == 0
    full = spark.createDataFrame([(date(2020, 1, 1), 2.0)], "date date, x double")
    assert feeds.merge_indicators([got, full]).collect() == [(date(2020, 1, 1), 2.0)]
    assert feeds.merge_indicators([got, got]).columns == ["date"]
