"""Folders of CSV files whose headers, date orders and faults differ."""

import json

import pytest

from tidemark.sources.csv_folder import MONTH_FIRST_FORMATS, header, read_transactions_folder

FILES = {
    "a/plain.csv": "Order Date,Sales,Order ID,Region\n13/02/2020,10,o1,E\n01/02/2020,5.5,o2,\nnever,1,o3,W\n",
    "a/same_header.csv": "Order Date,Sales,Order ID,Region\n02/25/2020,7,o4,E\n02/03/2020,3,o5,W\n",
    "b/alias.csv": "﻿ revenue ,orderdate,prod_cat,Profit\n8,2020-03-04,\"x, y\",1\nN/A,2020-03-05,z,2\n",
    "b/ambiguous.csv": "amount,date\n4,03/04/2020\n",
    "b/mixed.csv": "date,amount\n13/04/2020,1\n04/13/2020,2\n,\n",
    "c/missing.csv": "Nothing,Sales\n1,2\n", "c/twice.csv": "Sales,sales ,Order Date\n1,2,2020-01-01\n", "c/empty.csv": "",
    "c/only_header.csv": "date,sales\n", "c/skip.txt": "date,sales\n2020-01-01,1000\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("folder")
    for name, text in FILES.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_text(text)
    return str(base)


def day(r):
    return (r.source_file.rsplit("/", 1)[-1], r.order_date.strftime("%Y-%m-%d"), r.sales)


def test_files_of_all_kinds(spark, folder):
    got = read_transactions_folder(spark, folder)
    assert sorted(map(day, got.transactions.collect())) == [
        ("alias.csv", "2020-03-04", 8.0), ("ambiguous.csv", "2020-04-03", 4.0), ("mixed.csv", "2020-04-13", 1.0),
        ("plain.csv", "2020-02-01", 5.5), ("plain.csv", "2020-02-13", 10.0), ("same_header.csv", "2020-02-03", 3.0),
        ("same_header.csv", "2020-02-25", 7.0)]
    one = {r.source_file.rsplit("/", 1)[-1]: r for r in got.transactions.where("sales > 6").collect()}
    assert one["alias.csv"].category == "x, y" and one["alias.csv"].profit == 1.0 and one["alias.csv"].region is None
    bad = sorted((r.source_file.rsplit("/", 1)[-1], r.bad_date, r.bad_sales, json.loads(r.row)) for r in got.quarantine.collect())
    assert [b[:3] for b in bad] == [("alias.csv", False, True), ("mixed.csv", True, False), ("mixed.csv", True, True), ("plain.csv", True, False)]
    assert bad[0][3] ["orderdate"] == "2020-03-05" and "N/A" in bad[0][3].values()
    files = {r.file.rsplit("/", 1)[-1]: r for r in got.files.collect()}
    assert {n: r.date_order for n, r in files.items() if r.error is None} == {
        "plain.csv": "day first", "same_header.csv": "month first", "alias.csv": "other", "ambiguous.csv": "ambiguous",
        "mixed.csv": "mixed", "only_header.csv": None}
    assert {n for n, r in files.items() if r.error} == {"missing.csv", "twice.csv"}  # a file without a byte is no file to Spark
    assert "order_date" in files["missing.csv"].error and "alike" in files["twice.csv"].error
    assert files["alias.csv"].roles["sales"] == "revenue" and len(files) == 8


def test_without_a_vote_days_come_first(spark, folder):
    got = read_transactions_folder(spark, folder, vote=False)
    rows = {day(r) for r in got.transactions.collect()}
    assert ("same_header.csv", "2020-03-02", 3.0) in rows  # 02/03, as the second of March
    assert any(r.source_file.endswith("same_header.csv") and r.bad_date for r in got.quarantine.collect())


def test_one_scan_for_each_header(spark, folder):
    plan = read_transactions_folder(spark, folder).quarantine._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 * 5  # five headers that can be bound, for the rows and for the votes


def test_no_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Nothing\n1\n")
    got = read_transactions_folder(spark, str(tmp_path))
    assert got.transactions.count() == got.quarantine.count() == 0 and got.files.first().error
    assert header(spark, str(tmp_path / "x.csv")) == ("Nothing",)
    assert MONTH_FIRST_FORMATS[3] == "M/d/yyyy H:mm:ss" and MONTH_FIRST_FORMATS[0] == "yyyy-MM-dd HH:mm:ss"


def test_formats_are_tried_on_texts_of_their_shape_only(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.dates import DAY_FIRST_FORMATS, parse_day_first
    texts = ["13/02/2020", " 1/2/20 ", "2020-01-01t10:00:00", "0001/2/2020", "+12020-01-01", "1-2--2020", "1.2.2020", "1-2-2020", "1/2/2020\n",
             "1/2/2020 7:05", "1/2/2020 24:00", "2020-01-01 10:00", "2020-02-30", "31/4/2021", "no date", "", "٣/2/2020", "1/2/020", "2020-1-1", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for formats in (DAY_FIRST_FORMATS, MONTH_FIRST_FORMATS):
        plain = F.coalesce(*[F.try_to_timestamp(F.trim("s"), F.lit(f)) for f in formats])
        shaped = df.select("s", plain.alias("plain"), parse_day_first("s", formats).alias("shaped"))
        assert shaped.where("not (plain <=> shaped)").collect() == []
        assert shaped._jdf.queryExecution().analyzed().toString().count("RLIKE") == len(formats)


def test_months_of_files_take_one_pass(spark, folder):
    import datetime as dt

    from tidemark.operators import series
    rows = [(dt.datetime(2020, 1, 1), 1.0, 1), (dt.datetime(2020, 1, 2), None, 1), (dt.datetime(2020, 1, 3), 2.0, None), (None, 5.0, 2)]
    m = series.monthly_series(spark.createDataFrame(rows, "order_date timestamp, sales double, order_id long"))
    assert [(r.sales, r.n_orders, r.n_products, r.n_customers, r.avg_txn_sale) for r in m.collect()] == [(3.0, 1, 3, 3, 1.5)]
    assert "Join" not in m._jdf.queryExecution().optimizedPlan().toString()
