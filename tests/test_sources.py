"""Typed CSV ingest, Parquet round trip and report export."""

import os
import tempfile

import pytest

from mercata.schemas import CSV_FILES
from mercata.sources import load_csv, load_marketplace_csv, load_marketplace_parquet, write_report, write_tables


def _write(directory, name, text):
    path = os.path.join(directory, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_csv_quotes_newlines_nulls_and_zips(spark):
    d = tempfile.mkdtemp(prefix="mercata-csv-")
    path = _write(
        d,
        "reviews.csv",
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,"good, fast","said ""great""\nsecond line",2018-01-01 00:00:00,2018-01-02 10:11:12\n'
        'r2,o2,3,,"",2018-01-03 00:00:00,\n',
    )
    rows = {r["review_id"]: r for r in load_csv(spark, path, "order_reviews").collect()}
    assert rows["r1"]["review_comment_title"] == "good, fast"
    assert rows["r1"]["review_comment_message"] == 'said "great"\nsecond line'
    assert rows["r1"]["review_answer_timestamp"].isoformat() == "2018-01-02T10:11:12"
    assert rows["r2"]["review_comment_title"] is None  # unquoted empty -> NULL
    assert rows["r2"]["review_comment_message"] == ""  # quoted empty -> ''
    assert rows["r2"]["review_score"] == 3
    cust = _write(
        d,
        "customers.csv",
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,01037,sao paulo,SP\n",
    )
    assert load_csv(spark, cust, "customers").first()["customer_zip_code_prefix"] == "01037"


def test_csv_bad_row_fails(spark):
    d = tempfile.mkdtemp(prefix="mercata-csv-")
    path = _write(d, "items.csv", "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\no1,x,p,s,2018-01-01 00:00:00,1.00,2.00\n")
    with pytest.raises(Exception):
        load_csv(spark, path, "order_items").collect()


@pytest.mark.parametrize("row", ["o2,x,p,s,2018-01-01 00:00:00,1.00,2.00", "o2,2,p,s,2018-01-01 00:00:00,1.0x,2.00", "o2,2,p,s,not a day,1.00,2.00"])
def test_bad_value_in_any_column_fails_the_load(spark, tmp_path, row):
    path = tmp_path / "items.csv"
    path.write_text("order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\no1,1,p,s,2018-01-01 00:00:00,1.00,2.00\n" + row + "\n")
    with pytest.raises(Exception, match="MALFORMED"):
        load_csv(spark, str(path), "order_items")
    assert load_csv(spark, str(path), "order_items", validate=False).select("order_id").count() == 2


def test_uris_and_missing_tables(spark, tmp_path):
    (tmp_path / CSV_FILES["sellers"]).write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01037,x,SP\n")
    for place in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        tables = load_marketplace_csv(spark, place, tables=["sellers"])
        assert list(tables) == ["sellers"] and tables["sellers"].count() == 1
        assert load_csv(spark, place, "sellers").count() == 1
        with pytest.raises(FileNotFoundError, match="orders"):
            load_marketplace_csv(spark, place)
    write_tables(tables, f"file://{tmp_path}/pq")
    for place in (f"{tmp_path}/pq", f"file://{tmp_path}/pq"):
        assert load_marketplace_parquet(spark, place, ["sellers"])["sellers"].count() == 1
        with pytest.raises(FileNotFoundError, match="orders"):
            load_marketplace_parquet(spark, place)
    with pytest.raises(FileNotFoundError):
        load_csv(spark, f"file://{tmp_path}/nothing.csv", "sellers")


def test_marketplace_csv_parquet_round_trip(spark):
    src = tempfile.mkdtemp(prefix="mercata-src-")
    _write(src, CSV_FILES["orders"],
           "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
           "o1,c1,delivered,2018-01-01 10:00:00,,,2018-01-05 10:00:00,2018-01-10 00:00:00\n")
    _write(src, CSV_FILES["order_items"],
           "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\no1,1,p1,s1,2018-01-02 00:00:00,10.50,2.25\n")
    tables = load_marketplace_csv(spark, src, tables=["orders", "order_items"])
    assert set(tables) == {"orders", "order_items"}
    out = tempfile.mkdtemp(prefix="mercata-pq-")
    write_tables(tables, out)
    write_tables(tables, out)  # idempotent re-create
    again = load_marketplace_parquet(spark, out, tables)
    assert again["order_items"].first()["price"] == tables["order_items"].first()["price"]
    from mercata import plans

    write_report(plans.row_counts(again), os.path.join(out, "report_csv"), "csv")
    assert spark.read.option("header", True).csv(os.path.join(out, "report_csv")).count() == 2


def test_command_line_runs_reports(spark, tmp_path, capsys):
    from mercata.__main__ import main

    src = tmp_path / "raw"
    src.mkdir()
    (src / CSV_FILES["orders"]).write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,c1,delivered,2018-01-01 10:00:00,,,2018-01-05 10:00:00,2018-01-10 00:00:00\n"
        "o2,c2,delivered,2018-02-01 10:00:00,,,2018-02-25 10:00:00,2018-02-10 00:00:00\n"
    )
    (src / CSV_FILES["customers"]).write_text(
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,01037,x,SP\nc2,u1,01037,x,SP\n"
    )
    (src / CSV_FILES["order_items"]).write_text(
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o1,1,p1,s1,2018-01-02 00:00:00,10.50,2.25\no2,1,p1,s1,2018-02-02 00:00:00,5.00,1.00\n"
    )
    (src / CSV_FILES["order_reviews"]).write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        "r1,o1,5,,,2018-01-06 00:00:00,\nr2,o2,1,,,2018-02-26 00:00:00,\n"
    )
    for name, header in [
        (CSV_FILES["sellers"], "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,x,SP\n"),
        (CSV_FILES["products"], "product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\np1,beleza,1,1,1,1,1,1,1\n"),
        (CSV_FILES["product_category_translation"], "product_category_name,product_category_name_english\nbeleza,beauty\n"),
        (CSV_FILES["order_payments"], "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,card,1,12.75\n"),
        (CSV_FILES["geolocation"], "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n01037,-23.5,-46.6,x,SP\n"),
    ]:
        (src / name).write_text(header)
    out = tmp_path / "reports"
    assert main(["--csv", str(src), "--out", str(out), "--anchor", "latest", "--show", "rfm_top"]) == 0
    text = capsys.readouterr().out
    assert "u1" in text and "18.75" in text  # two orders of one person: 12.75 + 6.00
    counts = {r["table_name"]: r["row_count"] for r in spark.read.parquet(str(out / "row_counts")).collect()}
    assert len(counts) == 9 and counts["category_translation"] == 1
    # the same run from order-bucketed catalog tables
    out2 = tmp_path / "reports_bucketed"
    assert main([
        "--csv", str(src), "--load-parquet", str(tmp_path / "tables"), "--buckets", "4",
        "--database", "mercata_cli_test", "--out", str(out2), "--anchor", "latest",
    ]) == 0
    a = sorted(map(tuple, spark.read.parquet(str(out / "rfm_top")).collect()))
    b = sorted(map(tuple, spark.read.parquet(str(out2 / "rfm_top")).collect()))
    assert a == b and spark.catalog.tableExists("mercata_cli_test.order_items")


def test_views_answer_sql(spark, fixture_tables):
    from mercata import plans
    from mercata.sources import register_views

    register_views(fixture_tables, prefix="fx_")
    sql = """
        SELECT order_status, COUNT(*) AS order_count
        FROM fx_orders GROUP BY order_status
    """
    got = {r["order_status"]: r["order_count"] for r in spark.sql(sql).collect()}
    want = {r["order_status"]: r["order_count"] for r in plans.status_distribution(fixture_tables).collect()}
    assert got == want
    late = spark.sql(
        "SELECT COUNT(*) FILTER (WHERE order_delivered_customer_date > order_estimated_delivery_date) AS n, "
        "MAX(order_purchase_timestamp)::DATE AS last_day FROM fx_orders WHERE order_status = 'delivered'"
    ).first()
    assert late["n"] > 0 and late["last_day"] is not None


def test_csv_decimal_coordinates_round_like_numeric(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text(
        "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
        "01037,-23.54562128115268,-46.63929204800168,sao paulo,SP\n"
    )
    from decimal import Decimal

    row = load_csv(spark, str(path), "geolocation").first()
    assert row["geolocation_lat"] == Decimal("-23.5456213")
    assert row["geolocation_lng"] == Decimal("-46.6392920")


def test_load_csv_from_folder(spark, tmp_path):
    (tmp_path / CSV_FILES["sellers"]).write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01037,x,SP\n")
    assert load_csv(spark, str(tmp_path), "sellers").first()["seller_state"] == "SP"
