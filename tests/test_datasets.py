"""Readers, explorer and dashboards on small public-dataset samples."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators import metrics
from eventloom.operators.contracts import validate
from eventloom.plans import dashboards, explorer, measurement
from eventloom.sources import catalog, readers, tables


def frame(spark, table, rows):
    return spark.createDataFrame(rows, schemas.schema(table))


@pytest.fixture(scope="module")
def products(spark):
    rows = [(0, "ES", "MAD"), (1, "ES", "BCN"), (2, "FR", "PAR")]
    return frame(spark, "glovo_products", [(i, c, t, f"store{i}", f"p{i}", "menu", "", 0, 0, 0) for i, c, t in rows])


def test_catalog_filters(products):
    assert explorer.glovo(products, "ES")["metrics"].first().products == 2
    assert explorer.glovo(products, "ES", "MAD")["metrics"].first().products == 1
    assert dashboards.glovo_dashboard(products, "ALL")["metrics"].first().cities == 3
    assert dashboards.glovo_dashboard(products, "ALL")["city_options"].isEmpty()
    assert [r.city for r in dashboards.glovo_dashboard(products, "ES")["city_options"].collect()] == ["BCN", "MAD"]


def test_archive(spark, after):
    import datetime as dt

    at = dt.datetime(2022, 8, 1, 10, tzinfo=dt.timezone.utc)
    rows = [(1, 10, at, "clicks", 0), (1, 10, at + dt.timedelta(minutes=1), "carts", 1), (2, 20, at + dt.timedelta(days=1), "clicks", 0)]
    out = explorer.historical("otto", frame(spark, "otto_archive", rows))
    assert out["metrics"].first().events == 3 and out["daily"].count() == 3
    copies = tables.scale_copies(frame(spark, "otto_archive", rows), 5)
    assert copies.count() == 15 and copies.select("session_id").distinct().count() == 10
    assert [r.events for r in measurement.scenario_counts(copies).collect()] == [3] * 5
    states = {r.scenario: r.state for r in tables.missing_scenarios(copies.filter("NOT (scenario = 1) AND NOT (scenario = 2 AND article_id = 20)"), 3).collect()}
    assert states == {0: "complete", 1: "absent", 2: "partial", 3: "complete", 4: "complete"}


def test_marketplace_months(spark):
    import datetime as dt

    rows = [(dt.datetime(y, m, 1), dt.date(y, m, 1), t, 1, 1, "", "acme", None, 1, "s") for y, m, t in ((2019, 10, "view"), (2019, 11, "purchase"))]
    df = frame(spark, "rees46_events", rows)
    assert explorer.historical("rees46", df)["metrics"].first().events == 2
    assert explorer.historical("rees46", df, period="201910")["metrics"].first().events == 1
    board = dashboards.rees46_dashboard(df, "201911")
    assert board["metrics"].first().purchases == 1 and board["monthly"].count() == 2


def test_arms_and_uplift(spark):
    zero = [0.0] * 12
    df = frame(spark, "criteo_uplift", [(*zero, 0, 0, 1, 0), (*zero, 1, 1, 1, 1)])
    arms = {r.treatment: r for r in explorer.dataset_summaries(df, None)["criteo"].collect()}
    assert (arms[0].users, arms[0].conversion_rate, arms[1].conversion_rate) == (1, 0.0, 1.0)
    lift = metrics.uplift(df).first()
    assert (lift.uplift_conversion_pp, lift.uplift_conversion_relative_pct, lift.uplift_visit_pp) == (100.0, None, 0.0)
    assert tuple(metrics.treated_funnel(df).first()) == (1, 1, 1, 1)


def test_missing_dataset_is_empty_and_typed(spark, tmp_path):
    df = readers.load_or_empty(spark, "glovo_products", str(tmp_path / "nothing"))
    assert df.isEmpty() and df.schema == schemas.schema("glovo_products")


# Files ------------------------------------------------------------------------------------


def test_sessions(spark, tmp_path, collect):
    path = tmp_path / "s.jsonl"
    path.write_text(json.dumps({"session": 7, "events": [{"aid": 1, "ts": 1659304800025, "type": "clicks"}, {"aid": 2, "ts": 1659304801000, "type": "orders"}]}) + "\n")
    got = readers.read_sessions(spark, str(path))
    assert collect(got, "session_id", "article_id", "event_type", "event_position") == [(7, 1, "clicks", 0), (7, 2, "orders", 1)]
    assert got.select(F.unix_millis("event_time")).first()[0] == 1659304800025
    path.write_text(json.dumps({"session": 7, "events": [{"aid": 1, "ts": 1, "type": "views"}]}) + "\n")
    with pytest.raises(Exception, match="Unknown event type"):
        readers.read_sessions(spark, str(path)).collect()


def test_orders_tsv_with_byte_order_mark(spark, tmp_path, collect):
    pois = tmp_path / "pois.txt"
    pois.write_text("﻿wm_poi_id\tprimary_first_tag_name\taor_id\tpoi_score\n1\tnoodles\tNULL\t4.5\n2\trice\t12\tNULL\n", encoding="utf-8")
    assert collect(readers.read_restaurants(spark, str(pois))) == [(1, "noodles", 0, 4.5), (2, "rice", 12, None)]
    sessions = tmp_path / "clicks.txt"
    sessions.write_text("dt\twm_order_id\tclicks\n20210301\t1\t5#6#5\n20210301\t2\tNULL\n20210301\t3\t\n20210328\t4\t9\n")
    raw = readers.read_click_sessions(spark, str(sessions))
    assert collect(readers.clicks_from_sessions(raw), "order_id", "position", "restaurant_id") == [(1, 1, 5), (1, 2, 6), (1, 3, 5)]
    assert collect(readers.click_summary_from_sessions(raw), "order_id", "click_count", "distinct_restaurants", "last_clicked_restaurant_id") == [(1, 3, 2, 5)]
    with pytest.raises(ValueError):
        readers.read_foods(spark, str(pois))


def test_marketplace_csv(spark, tmp_path):
    path = tmp_path / "m.csv.gz"
    header = ",".join(readers.MARKETPLACE_COLUMNS)
    with gzip.open(path, "wt") as out:
        out.write(f"{header}\n2019-10-01 00:00:00 UTC,view,1,2,,acme,12.34,5,s\nbad,view,1,2,a.b,,x,-5,s\n")
    good, bad = validate(readers.type_marketplace(readers.read_marketplace(spark, str(path))), readers.marketplace_rules())
    assert str(good.first().price) == "12.34" and good.first().category_code == ""
    assert set(bad.first().reasons) == {"event_time", "price", "user_id"}
    other = tmp_path / "o.csv"
    other.write_text(header.replace("price", "cost") + "\n")
    with pytest.raises(Exception):
        other.write_text(other.read_text() + "2019-10-01 00:00:00 UTC,view,1,2,,a,1,5,s\n")
        readers.read_marketplace(spark, str(other)).collect()


def sample_line(sep, clicked="1", hour="12"):
    values = dict.fromkeys(readers.SAMPLE_FIELDS, "v") | {"clicked": clicked, "hours": hour, "time_type": "lunch", "times": "1600000000"}
    return sep.join(values[f] for f in readers.SAMPLE_FIELDS)


@pytest.mark.parametrize("name", list(readers.DELIMITERS))
def test_samples(spark, tmp_path, name):
    sep = readers.DELIMITERS[name]
    path = tmp_path / "s.txt"
    path.write_text("\n".join([sep.join(readers.SAMPLE_FIELDS), sample_line(sep), sample_line(sep, "2", "30"), "short" + sep + "row"]) + "\n")
    assert readers.detect_delimiter(spark, str(path)) == sep
    good, bad = validate(readers.read_samples(spark, str(path), sep), readers.sample_rules())
    row = readers.project_samples(good, "f" * 64, "s.txt", 1).first()
    assert (row.source_row, row.clicked, row.request_hour, row.meal_period, json.loads(row.raw_features)["clicked"]) == (2, 1, 12, "lunch", "1")
    assert len(json.loads(row.raw_features)) == 39
    assert bad.count() == 2
    check = dashboards.typed_vs_json_clicks(readers.project_samples(good, "f" * 64, "s.txt", 1)).first()
    assert check.typed_clicks == check.json_clicks == 1


def test_ambiguous_separator_is_refused(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("a,b\n")
    with pytest.raises(ValueError):
        readers.detect_delimiter(spark, str(path))


def test_catalog_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        ",country_code,city_code,store_name,product_name,collection_section,product_description,aux_store,HIER\n"
        '0,ES,MAD,"A, B",x,Menu,"two\nlines ""quoted""",True,False\n1,ES,MAD,C,y,,,False,True\n'
    )
    got = readers.read_catalog(spark, str(path)).orderBy("source_row").collect()
    assert (got[0].store_name, got[0].product_description, got[0].has_description, got[0].aux_store) == ("A, B", 'two\nlines "quoted"', 1, 1)
    assert (got[1].has_description, got[1].hier) == (0, 1)
    assert readers.catalog_index_check(readers.read_catalog(spark, str(path))).first().continuous
    shown = spark.range(1).select(readers.escape_text(F.lit("a\tb\n\\"))).first()[0]
    assert shown == "a\\tb\\n\\\\"


def test_catalog_seed(spark, products):
    prices = spark.range(36).select(
        F.col("id").alias("n"), F.concat(F.lit("fictional-madrid-"), (F.floor(F.col("id") / 3) + 1).cast("string")).alias("restaurant_id"),
        (F.col("id") % 3 + 1).cast("int").alias("slot"), (F.col("id") * 10 + 700).cast("int").alias("price_minor"),
    )
    fallback = catalog.seed_products(products, prices, 1)
    assert fallback.count() == 36 and fallback.filter("name_kind = 'synthetic'").count() == 36
    assert fallback.orderBy("product_id").first().source_row is None
    many = frame(spark, "glovo_products", [(i, "ES", "MAD", "s", f"public {i}", "m", "", 0, 0, 0) for i in range(50)])
    seeded = catalog.seed_products(many, prices, 1)
    assert {r.source_row for r in seeded.collect()} == set(range(36))
    assert seeded.filter("product_id = 'fictional-madrid-1-product-2'").first().product_name == "public 1"
    places = spark.createDataFrame([("r1", "One", 40.4, -3.7), ("r2", "Two", 40.5, -3.6)], "restaurant_id STRING, name STRING, latitude DOUBLE, longitude DOUBLE")
    assert {(r.name, r.location_kind, r.city_id) for r in catalog.seed_restaurants(places, 1).collect()} == {("One", "synthetic", "madrid"), ("Two", "synthetic", "madrid")}


def test_uplift_file(spark, tmp_path):
    path = tmp_path / "u.csv.gz"
    names = [f"f{i}" for i in range(12)] + ["treatment", "conversion", "visit", "exposure"]
    with gzip.open(path, "wt") as out:
        out.write(",".join(names) + "\n" + ",".join(["0.5"] * 12 + ["1", "0", "1", "1"]) + "\n")
    row = readers.read_uplift(spark, str(path)).first()
    assert (row.f11, row.treatment, row.conversion, row.exposure) == (0.5, 1, 0, 1)


def test_shared_folder_is_the_configured_one(spark):
    from eventloom.session import pin, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert pin(spark.range(3)).count() == 3


# Dashboards -------------------------------------------------------------------------------


def test_delivery_dashboard(spark):
    import datetime as dt

    d = dt.date(2021, 3, 1)
    orders = frame(spark, "orders", [(i, i % 2, 5 if i < 3 else 6, 1, "low", dt.datetime(2021, 3, 1, 12), "noon", d) for i in range(1, 5)])
    clicks = frame(spark, "clicks", [(d, 1, 1, 5), (d, 1, 2, 7), (d, 2, 1, 5)])
    summary = frame(spark, "click_summary", [(d, 1, 2, 2, 7), (d, 2, 1, 1, 5)])
    daily = frame(spark, "daily_clicks", [(d, 5, 1), (d, 5, 1), (d, 7, 1)])
    items = frame(spark, "order_items", [(d, 1, 9)])
    dims = frame(spark, "restaurants", [(5, "noodles", 1, 4.0)])
    out = dashboards.delivery_dashboard(orders, clicks, items, daily, summary, dims, "2021-03-01", "2021-03-21")
    m = out["metrics"].first()
    assert (m.orders, m.users, m.restaurants, m.clicks, m.items, m.clicks_per_order, m.last_click_match_pct) == (4, 2, 2, 3, 1, 0.75, 50.0)
    assert {r.bucket: r.orders for r in out["depth"].collect()} == {"0": 2, "1": 1, "2–3": 1, "4–6": 0, "7–10": 0, "11+": 0}
    assert [tuple(r) for r in out["top"].collect()] == [(5, 2, 2, "noodles", 4.0), (6, 2, 0, None, None)]
    assert out["hour_axis"].count() == 24 and out["daily"].first().clicks == 3
    empty = dashboards.delivery_dashboard(orders, clicks, items, daily, summary, dims, "2020-01-01", "2020-01-02")
    assert empty["metrics"].first().clicks_per_order == 0.0
    assert {r.orders for r in empty["depth"].collect()} == {0}


def test_replay_panel(spark, after):
    archive = frame(spark, "otto_archive", [(1, 10, after(0), "clicks", 0)])
    replay = frame(spark, "otto_replay", [(1, 10, after(0), "clicks", 0, after(s)) for s in (0, 95, 96, 99)])
    clicks = frame(spark, "live_clicks", [("id", after(0), "inicio", "abrir")])
    out = dashboards.otto_dashboard(archive, replay, clicks, F.lit(after(100)))
    assert (out["replay_30s"].first().events, out["replayed_total"].first().events) == (3, 4)
    assert [r.clicks for r in out["timeline"].collect()] == [1, 1, 1]
