"""Monthly series kept up to date by merging the months of new files.

The store holds mergeable partial states (exact sums, bit words of the ids)
in one folder for each month and attempt. Adding a file merges its months with
theirs, writes these months anew and commits them, with the file's name, as
one row set of a compacted log; other months are neither read nor written. A
file that is added again, after a lost driver for example, changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import month_label, month_start
from tidemark.operators import distinct
from tidemark.operators.series import series_key_expr
from tidemark.sources.logs import CompactedLog, Folder, latest_by

INDEX = "kind string,name string,number long,attempt string"
ROLES = ("order_id", "product_id", "customer_id")
NAMES = ["n_orders", "n_products", "n_customers"]
BY = ["series_key", "period"]
STATE = ("series_key string,period date,kind int,word long,bits long,sales decimal(38,4),amount double,n long")


class MonthlyStore:
    """``key``: the column that names a series, or None for one series. Ids
    are whole numbers (a dictionary of other values would have to grow with
    the store). One writer at a time."""

    def __init__(self, base: str, key: str | None = None):
        self.base, self.key = base.rstrip("/"), key
        self.log = CompactedLog(f"{self.base}/_index", INDEX, "name", latest_by(["kind", "name"], ["number"], INDEX))

    def _folder(self, month: str, attempt: str) -> str:
        return f"{self.base}/months/{month}/{attempt}"

    def months(self, spark: SparkSession) -> dict[str, str]:
        """Month -> attempt: as many rows as there are months."""
        return {r.name: r.attempt for r in self.log.state(spark).where("kind = 'month'").collect()}

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.schema(STATE).parquet(*folders) if folders else spark.createDataFrame([], STATE)

    def add(self, txn: DataFrame, file: str) -> list[str]:
        """Merge the transactions of one file (roles order_date, sales and
        ROLES); the months it has written, none if the file is there."""
        spark = txn.sparkSession
        done = self.log.state(spark)
        if not done.where((F.col("kind") == "file") & (F.col("name") == file)).isEmpty():
            return []
        if wrong := [r for r in ROLES if not isinstance(txn.schema[r].dataType, distinct.WHOLE)]:
            raise ValueError(f"ids have to be whole numbers: {wrong}")
        number = (done.agg(F.max("number")).first()[0] or 0) + 1
        rows = txn.where(F.col(self.key).isNotNull()) if self.key else txn
        by = {"series_key": series_key_expr(self.key), "period": month_start("order_date").cast("date")}
        attempt = uuid.uuid4().hex
        fresh = f"{self.base}/incoming/{attempt}"
        distinct.states(rows, by, [F.col(r).cast("long") for r in ROLES]).write.parquet(fresh)
        new = self._read(spark, [fresh])
        touched = sorted(r[0] for r in new.select(F.date_format("period", "yyyy-MM")).distinct().collect())
        here = self.months(spark)
        old = [self._folder(m, here[m]) for m in touched if m in here]
        label = F.date_format("period", "yyyy-MM")
        both = distinct.merged(self._read(spark, old + [fresh]), BY).withColumn("month", label)
        out = f"{self.base}/outgoing/{attempt}"
        both.write.partitionBy("month").parquet(out)
        for m in touched:  # renames; nothing is read here before the commit
            self._move(spark, f"{out}/month={m}", self._folder(m, attempt))
        entries = [("month", m, number, attempt) for m in touched] + [("file", file, number, attempt)]
        self.log.append(spark.createDataFrame(entries, INDEX).coalesce(1))
        for folder in [*old, fresh, out]:
            Folder(spark, folder).delete()
        return touched

    @staticmethod
    def _move(spark: SparkSession, source: str, target: str) -> None:
        jvm = spark._jvm
        a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
        system = b.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(b.getParent())
        if not system.rename(a, b):
            raise OSError(f"can't move {source} to {target}")

    def series(self, spark: SparkSession) -> DataFrame:
        """The columns of ``operators.series.monthly_series``."""
        parts = self._read(spark, [self._folder(m, a) for m, a in sorted(self.months(spark).items())])
        found = distinct.counted(parts, BY, NAMES).withColumnRenamed("mean_amount", "avg_txn_sale")
        return found.withColumn("period_label", month_label("period"))
