"""Commits of a run's results as a whole, and logs that are folded."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.plans import job
from tidemark.sources import store
from tidemark.sources.logs import CompactedLog, Folder, latest_by

DOCS = ("a", "b", "c")


def documents(spark, value):
    return {n: spark.createDataFrame([(n, value)], "name string, value long") for n in DOCS}


def broken(df):
    return df.withColumn("value", F.raise_error(F.lit("lost")).cast("long"))


def values(docs):
    return {n: [r["value"] for r in d.collect()] for n, d in docs.items()}


@pytest.mark.parametrize("failing", DOCS)
def test_failure_between_documents_leaves_the_committed_run(spark, tmp_path, failing):
    base = str(tmp_path / "store")
    store.save_run_results("r/1", documents(spark, 1), base)
    store.save_run_results("r2", documents(spark, 5), base)
    docs = documents(spark, 2)
    docs[failing] = broken(docs[failing])
    with pytest.raises(Exception):
        store.save_run_results("r/1", docs, base)
    assert values(store.get_run_results(spark, base, "r/1")) == {n: [1] for n in DOCS}
    for n in DOCS:
        assert {(r.run_id, r.value) for r in store.committed(spark, base, n).collect()} == {("r/1", 1), ("r2", 5)}
    left = sum(len(Folder(spark, f"{base}/{n}/run_id=r%2F1").list()) for n in DOCS)
    store.vacuum(spark, base, 0)
    assert left > 3 and sum(len(Folder(spark, f"{base}/{n}/run_id=r%2F1").list()) for n in DOCS) == 3
    store.save_run_results("r/1", {"a": documents(spark, 3)["a"].limit(0)}, base)  # fewer documents, an empty one
    got = store.get_run_results(spark, base, "r/1")
    assert list(got) == ["a"] and got["a"].columns == ["name", "value", "run_id"] and got["a"].count() == 0
    assert [r.run_id for r in store.committed(spark, base, "b").collect()] == ["r2"]


def test_failures_are_read_of_failed_runs_only(spark, tmp_path, monkeypatch):
    base, outcome = str(tmp_path / "store"), {"fail": False}

    def analysis(txn, *args, **kwargs):
        docs = {"eda_summary": txn.agg(F.sum("sales").alias("total")), "monthly": txn.select("sales")}
        if outcome["fail"]:
            docs["monthly"] = docs["monthly"].withColumn("sales", F.raise_error(F.lit("disk is full")))
        return docs

    monkeypatch.setattr(job, "run_pipeline", analysis)
    raw = lambda n: spark.createDataFrame([("01/02/2020", float(i)) for i in range(1, n)], "`Order Date` string, Sales double")
    assert job.get_run(spark, base, "r1") is None
    assert job.run_job(raw(4), base, "r1") == "COMPLETED"
    assert job.get_run(spark, base, "r1")["eda_summary"].first().total == 6.0
    store.append_status(spark, base, "r1", ledger.RUNNING)
    assert job.get_run(spark, base, "r1") is None
    outcome["fail"] = True
    assert job.run_job(raw(3), base, "r1") == "FAILED"
    got = job.get_run(spark, base, "r1")
    assert list(got) == ["failure"] and "disk is full" in got["failure"].first().reason
    before = store.get_run_results(spark, base, "r1")  # whole, of the first run
    assert before["eda_summary"].first().total == 6.0 and before["monthly"].count() == 3
    outcome["fail"] = False
    assert job.run_job(raw(5), base, "r1") == "COMPLETED"
    assert job.get_run(spark, base, "r1")["eda_summary"].first().total == 10.0
    assert store.failure(spark, base, "r1") is None and not Folder(spark, f"{base}/failure/run_id=r1").list()


def events(spark, n, of=50):
    return spark.range(n, numPartitions=3).select(
        F.concat(F.lit("run"), (F.col("id") * 7919 % of).cast("string")).alias("run_id"), F.lit(None).cast("string").alias("file_name"),
        F.when(F.col("id") % 3 == 0, ledger.RUNNING).when(F.col("id") % 3 == 1, ledger.FAILED).otherwise(ledger.COMPLETED).alias("status"),
        F.timestamp_seconds(F.col("id") * 104729 % n).alias("ts"))


def test_a_million_events_open_few_files(spark, tmp_path):
    base, log = str(tmp_path / "ledger"), events(spark, 1_000_000, 20_000)
    for part in range(8):
        store.append_log(log.where(F.pmod(F.xxhash64("ts"), F.lit(8)) == part), base, tail_files=8)
    assert store.status_log(base).files(spark) <= 8 + 1
    want = ledger.latest_status(log.withColumn("tie", F.col("status") != ledger.RUNNING), tie="tie").select("run_id", "status", "ts", "first_ts")
    got = store.current_runs(spark, base).select(*want.columns)
    assert got.count() == 20_000 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_folds_survive_a_lost_driver_and_another_fold(spark, tmp_path, monkeypatch):
    schema = "key string,n long,text string"
    log = CompactedLog(str(tmp_path / "log"), schema, "key", latest_by(["key"], ["n"], schema), tail_files=1000)
    rows = spark.range(60).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("n"), F.col("id").cast("string").alias("text"))
    want = {str(k): max(i for i in range(60) if i % 7 == k) for k in range(7)}
    state = lambda: {r.key: int(r.text) for r in log.state(spark).collect()}
    for part in range(3):
        log.append(rows.where(F.col("n") % 3 == part))
    assert state() == want
    log.fold(spark)
    assert state() == want
    held = log.state(spark)
    log.append(rows.where("n < 10"))  # old events again
    with monkeypatch.context() as m:  # dies before it names its inputs
        m.setattr(Folder, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.fold(spark)
    assert state() == want
    with monkeypatch.context() as m:  # dies before it deletes
        m.setattr(Folder, "delete", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.fold(spark)
    assert state() == want and {r.key: int(r.text) for r in held.collect()} == want
    stale = log._present(spark)
    log.append(rows.where("n < 20").withColumn("n", F.col("n") + 100))
    log.fold(spark)
    with monkeypatch.context() as m:  # a fold that had listed the files before
        m.setattr(CompactedLog, "_present", lambda *a: stale)
        log.fold(spark)
    want |= {str(k): max(i for i in range(20) if i % 7 == k) for k in range(7)}
    assert state() == want
    log.fold(spark)
    assert state() == want and len(log._present(spark)[0]) == 1
