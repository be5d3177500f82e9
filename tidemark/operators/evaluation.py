"""Holdout split, forecast metrics, backtest rows and forecast bands
(F3, F7, F8, F10), written for ANY predictions table
``(series_key, period, actual, predicted, is_test)``, so they also run on
fixed predictions (seasonal naive) with a SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig
from tidemark.functions.numeric import money, ratio, rnd

CFG = PipelineConfig()


def holdout_split(fe: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    """the last 12 rows of each series are test rows; a series of at
    most 18 rows holds out max(2, n // 4)."""
    p = Window.partitionBy("series_key")
    desc = Window.partitionBy("series_key").orderBy(F.desc("period"))
    n = F.count(F.lit(1)).over(p)
    hold = F.when(n <= cfg.holdout + cfg.short_extra,
                  F.greatest(F.lit(2), F.floor(n / 4).cast("long"))).otherwise(F.lit(cfg.holdout))
    return (fe.withColumn("_n", n).withColumn("_rd", F.row_number().over(desc))
              .withColumn("is_test", F.col("_rd") <= hold).drop("_n", "_rd"))


def seasonal_naive(fe_split: DataFrame) -> DataFrame:
    """Fixed predictions: the value 12 rows earlier (lag12)."""
    return fe_split.select("series_key", "period", "period_label",
                           F.col("sales").alias("actual"), F.col("lag12").alias("predicted"),
                           "is_test")


def forecast_metrics(pred: DataFrame) -> DataFrame:
    """F7 per series on test rows: MAPE %, RMSE, R^2, MASE.

    The MASE baseline is the last TRAIN actual held constant; MASE is 1.0
    when that baseline has no error. A zero actual gives no MAPE term."""
    p = Window.partitionBy("series_key")
    train = ~F.col("is_test")
    naive = F.max_by(F.when(train, F.col("actual")), F.when(train, F.col("period"))).over(p)
    t = pred.withColumn("_naive", naive).where(F.col("is_test"))
    err = F.col("actual") - F.col("predicted")
    g = t.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n_test"),
        (F.avg(F.abs(ratio(err, "actual"))) * 100.0).alias("_mape"),
        F.sqrt(F.avg(err * err)).alias("rmse_raw"),
        F.sum(err * err).alias("_ss_res"),
        (F.var_pop("actual") * F.count(F.lit(1))).alias("_ss_tot"),
        F.avg(F.abs(err)).alias("_mae"),
        F.avg(F.abs(F.col("actual") - F.col("_naive"))).alias("_mae_naive"))
    r2 = F.when(F.col("_ss_tot") > 0, F.lit(1.0) - F.col("_ss_res") / F.col("_ss_tot")) \
          .when(F.col("_ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    mase = F.when(F.col("_mae_naive") > 0, F.col("_mae") / F.col("_mae_naive")).otherwise(F.lit(1.0))
    return g.select("series_key", "n_test", rnd("_mape", 2).alias("mape"),
                    rnd("rmse_raw", 2).alias("rmse"), rnd(r2, 4).alias("r2"),
                    rnd(mase, 4).alias("mase"), "rmse_raw")


def backtest_rows(pred: DataFrame) -> DataFrame:
    """F8: test months with actual and predicted, shown to cents."""
    return pred.where(F.col("is_test")).select(
        "series_key", "period", "period_label", money("actual").alias("actual"),
        money("predicted").alias("predicted"))


def seasonal_naive_projection(fe: DataFrame, horizon: int = 12) -> DataFrame:
    """Fixed forecast: the last 12 observed values in order (all of a series
    that has fewer), over and over for ``horizon`` steps."""
    desc = Window.partitionBy("series_key").orderBy(F.desc("period"))
    last = Window.partitionBy("series_key")
    r = (fe.select("series_key", "period", "sales")
           .withColumn("_rd", F.row_number().over(desc))
           .withColumn("_last", F.max("period").over(last))
           .withColumn("_cycle", F.least(F.lit(12), F.count(F.lit(1)).over(last)).cast("int"))
           .where(F.col("_rd") <= F.col("_cycle"))
           .withColumn("_first", F.col("_cycle") - F.col("_rd") + 1)
           .where(F.col("_first") <= horizon)
           .withColumn("step", F.explode(F.sequence(F.col("_first").cast("int"), F.lit(horizon), F.col("_cycle")))))
    return r.select("series_key", "step", F.add_months("_last", F.col("step")).alias("period"),
                    F.col("sales").alias("forecast_raw"))


def forecast_bands(fc: DataFrame, metrics: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    """floor, then a 90% band of z * RMSE * sqrt(step), lower clipped at 0."""
    f = fc.join(metrics.select("series_key", "rmse_raw"), "series_key")
    val = F.greatest(F.col("forecast_raw"), F.lit(cfg.forecast_floor))
    interval = F.lit(cfg.z_band) * F.col("rmse_raw") * F.sqrt(F.col("step").cast("double"))
    return f.select("series_key", F.date_format("period", "yyyy-MM").alias("period"), "step",
                    money(val).alias("forecast"),
                    rnd(F.greatest(F.lit(0.0), val - interval), 2).alias("lower_90"),
                    rnd(val + interval, 2).alias("upper_90"))
