"""Bit-word distinct counts, and monthly series merged file by file."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distinct, series
from tidemark.sources.monthly_store import MonthlyStore

SCHEMA = "order_date timestamp_ntz, sales double, order_id long, product_id long, customer_id long, region string"


def frame(n=4000, seed=0):
    rng = np.random.default_rng(seed)
    ids = lambda top: [None if x == 0 else int(x) for x in rng.integers(0, top, n)]
    return pd.DataFrame({
        "order_date": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 700, n), "D"),
        "sales": [None if x % 50 == 0 else x / 100 for x in rng.integers(1, 10**6, n)],
        "order_id": [None if x is None else x * 97 - 100_000 for x in ids(3000)],  # sparse, also negative
        "product_id": ids(200), "customer_id": ids(130), "region": [["E", "W", None][x] for x in rng.integers(0, 3, n)]}).astype(object)


def spark_frame(spark, pdf):
    def plain(i, v):
        if v is None or v != v:
            return None
        return v.to_pydatetime() if i == 0 else int(v) if 2 <= i <= 4 else v

    return spark.createDataFrame([tuple(plain(i, v) for i, v in enumerate(r)) for r in pdf.itertuples(index=False)], SCHEMA)


def expected(pdf, key="region"):
    d = pdf[pdf[key].notna()].copy()
    d["sales"] = pd.to_numeric(d["sales"])
    g = d.groupby([key, pd.to_datetime(d["order_date"]).dt.strftime("%Y-%m")])
    return {k: (round(s["sales"].sum(), 2), s["order_id"].nunique(), s["product_id"].nunique(), s["customer_id"].nunique(),
                s["sales"].mean()) for k, s in g}


def same(a, b):
    return a.keys() == b.keys() and all(a[k][:4] == b[k][:4] and a[k][4] == pytest.approx(b[k][4]) for k in a)


def found(m):
    return {(r.series_key, r.period_label): (round(r.sales, 2), r.n_orders, r.n_products, r.n_customers, r.avg_txn_sale)
            for r in m.collect()}


@pytest.mark.parametrize("as_text", [(), ("order_id",), ("order_id", "product_id", "customer_id")])
def test_counts_equal_pandas(spark, as_text):
    pdf = frame()
    df = spark_frame(spark, pdf).repartition(5)
    df = df.withColumns({c: F.concat(F.lit("x"), F.col(c).cast("string")) for c in as_text})
    assert same(found(series.monthly_series(df, "region")), expected(pdf))


def test_plan_expands_no_row(spark):
    df = spark_frame(spark, frame(50))
    plan = series.monthly_series(df, "region")._jdf.queryExecution().toString()
    assert "Expand" not in plan and "SortAggregate" not in plan and "bit_or" in plan


def test_missing_roles_count_rows(spark):
    pdf = frame(300)
    df = spark_frame(spark, pdf).drop("order_id")
    rows = pdf[pdf["region"].notna()].groupby(["region", pd.to_datetime(pdf["order_date"]).dt.strftime("%Y-%m")]).size()
    got = {(r.series_key, r.period_label): r.n_orders for r in series.monthly_series(df, "region").collect()}
    assert got == rows.to_dict()


def test_dictionary_has_no_gaps(spark):
    df = spark.range(5000, numPartitions=7).select((F.col("id") * 31 % 1777).cast("string").alias("v")).union(spark.sql("SELECT NULL"))
    got = sorted((r.id, r.value) for r in distinct.number_values(df, "v").collect())
    assert [i for i, _ in got] == list(range(1777)) and [v for _, v in got] == sorted({str(i) for i in range(1777)})


def test_a_merge_takes_states_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Whatever the files' splits are; nothing is aggregated before."""
    monkeypatch.setattr(distinct, "TASK_STATES", 500, raising=False)
    by = {"series_key": F.col("region"), "period": F.trunc("order_date", "month")}
    ids = [F.col(c) for c in ("order_id", "product_id", "customer_id")]
    halves = [spark_frame(spark, frame(6000, seed)) for seed in (1, 2)]
    for df in halves:
        distinct.states(df, by, ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
    parts = spark.read.parquet(str(tmp_path / "parts"))
    both = distinct.merged(parts, list(by))
    sizes = [r["count"] for r in both.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) < parts.count() and len(sizes) > parts.count() / 1000 and max(sizes) <= 1000
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange"):]
    key = lambda r: (str(r.series_key), str(r.period), r.kind, str(r.word))
    short = lambda df: {key(r): (r.bits, r.sales, pytest.approx(r.amount), r.n) for r in df.collect()}
    assert short(both) == short(distinct.states(halves[0].union(halves[1]), by, ids))


def test_files_are_merged_once_and_touch_their_months_only(spark, tmp_path):
    pdf = frame()
    month = pd.to_datetime(pdf["order_date"]).dt.strftime("%Y-%m")
    rng = np.random.default_rng(9)
    file = rng.integers(0, 3, len(pdf))
    store = MonthlyStore(str(tmp_path / "monthly"), "region")
    assert store.series(spark).count() == 0
    seen = np.zeros(len(pdf), bool)
    for n, mask in enumerate([file == 0, (file == 1) & (month < "2020-06"), (file == 2) & (month >= "2021-03"), file == 0]):
        mask = np.asarray(mask)
        before = store.months(spark)
        touched = store.add(spark_frame(spark, pdf[mask]), f"f{n % 3}")
        if n == 3:  # the first file once more
            assert touched == [] and store.months(spark) == before
            continue
        seen |= mask
        keyed = mask & pdf["region"].notna().to_numpy()
        assert touched == sorted(set(month[keyed]))
        after = store.months(spark)
        assert {m for m in after if after[m] != before.get(m)} == set(touched)
        whole = series.monthly_series(spark_frame(spark, pdf[seen]), "region")
        assert same(found(store.series(spark)), found(whole)) and same(found(whole), expected(pdf[seen]))


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    pdf = frame(2500)
    store = MonthlyStore(str(tmp_path / "monthly"), "region")
    store.add(spark_frame(spark, pdf[:1200]), "a")
    want = found(store.series(spark))
    with monkeypatch.context() as m:
        m.setattr(type(store.log), "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(spark_frame(spark, pdf[1200:]), "b")
    assert same(found(store.series(spark)), want)
    store.add(spark_frame(spark, pdf[1200:]), "b")
    assert same(found(store.series(spark)), expected(pdf))


def test_ids_have_to_be_numbers(spark, tmp_path):
    df = spark_frame(spark, frame(10)).withColumn("order_id", F.col("order_id").cast("string"))
    with pytest.raises(ValueError):
        MonthlyStore(str(tmp_path / "m")).add(df, "a")
