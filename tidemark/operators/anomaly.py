"""Statistical anomaly flags, votes and summaries (A13, A14, A16, W8, AN1,
AN4-AN8, C7, J2).

All per-series statistics are window aggregates over
``partitionBy("series_key")``; the feature frame is already distributed by
that key, so they add no shuffle. A window partition holds the months of
one series (bounded by the calendar span).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig
from tidemark.functions.numeric import money, ratio, rnd
from tidemark.operators.series import zscore

CFG = PipelineConfig()

# Texts of a risk row.
RISK_TYPE = "High Volatility"
RISK_DESCRIPTION = "Forecast shows elevated variance and volatility bounds."


def _p():
    return Window.partitionBy("series_key")


def stat_flags(m: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    """A13/A14/W8/AN1/AN6: IQR fence (linear-interpolated quartiles), z-score
    over the whole series, statistical flag and direction per month."""
    q = F.percentile("sales", F.array(F.lit(0.25), F.lit(0.75))).over(_p())
    out = m.withColumn("_q", q)
    out = out.select(
        "*",
        F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"),
        zscore("sales").alias("z_score"),
    ).drop("_q")
    iqr = F.col("q3") - F.col("q1")
    out = out.withColumn("iqr_lo", F.col("q1") - F.lit(cfg.iqr_k) * iqr) \
             .withColumn("iqr_hi", F.col("q3") + F.lit(cfg.iqr_k) * iqr)
    return out.withColumn(
        "stat_flag",
        (F.col("sales") < F.col("iqr_lo")) | (F.col("sales") > F.col("iqr_hi"))
        | F.coalesce(F.abs("z_score") > F.lit(cfg.z_limit), F.lit(False))
    ).withColumn(
        "direction",
        F.when(F.col("sales") > F.col("iqr_hi"), "spike")
         .when(F.col("sales") < F.col("iqr_lo"), "drop").otherwise("pattern"))


def residual_flags(backtest: DataFrame, metrics: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    """AN4: backtest months whose |actual - predicted| (both shown to cents)
    exceeds resid_k * RMSE (shown to cents)."""
    b = backtest.join(metrics.select("series_key", "rmse"), "series_key")
    resid = money("actual") - money("predicted")
    return b.select("series_key", "period",
                    (F.abs(resid) > F.lit(cfg.resid_k) * F.col("rmse")).alias("resid_flag"))


def attach_flags(m: DataFrame, flags: DataFrame, name: str) -> DataFrame:
    """Left join per (series, month); months without a flag get False."""
    return (m.join(flags.select("series_key", "period", F.col(name).alias("_f")),
                   ["series_key", "period"], "left")
             .withColumn(name, F.coalesce("_f", F.lit(False))).drop("_f"))


def vote(m: DataFrame, flag_cols) -> DataFrame:
    """AN5: votes = number of raised flags; anomaly at >= 2; severity."""
    votes = sum((F.col(c).cast("int") for c in flag_cols), F.lit(0))
    out = m.withColumn("votes", votes.cast("long"))
    return out.withColumn("is_anomaly", F.col("votes") >= 2).withColumn(
        "severity", F.when(F.col("votes") >= 3, "critical")
                     .when(F.col("votes") == 2, "high").otherwise("normal"))


def monthly_scores(voted: DataFrame) -> DataFrame:
    """AN7: one score row per month."""
    return voted.select("series_key", F.col("period_label").alias("period"),
                        money("sales").alias("sales"), rnd("z_score", 3).alias("z_score"),
                        "votes", "severity", "is_anomaly")


def confirmed(voted: DataFrame) -> DataFrame:
    """Confirmed anomalies with direction."""
    return voted.where(F.col("votes") >= 2).select(
        "series_key", F.col("period_label").alias("period"), money("sales").alias("sales"),
        "severity", "direction", "votes", rnd("z_score", 3).alias("z_score"))


def anomaly_summary(voted: DataFrame) -> DataFrame:
    """Per series counts and the anomaly rate."""
    a = F.col("is_anomaly")
    g = voted.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("total_months"),
        F.count_if(a).alias("total_anomalies"),
        F.count_if(F.col("votes") >= 3).alias("critical"),
        F.count_if(F.col("votes") == 2).alias("high"),
        F.count_if(a & (F.col("direction") == "spike")).alias("spikes"),
        F.count_if(a & (F.col("direction") == "drop")).alias("drops"))
    return g.withColumn("anomaly_rate_pct",
                        rnd(F.coalesce(ratio(F.col("total_anomalies") * 100.0, "total_months"),
                                       F.lit(0.0)), 2))


def future_risks(forecast: DataFrame, metrics: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    """AN8 + K5: among the first ``risk_steps`` forecast months, those whose
    band width exceeds risk_k * RMSE (shown values, as in the source)."""
    f = forecast.where(F.col("step") <= cfg.risk_steps).join(
        metrics.select("series_key", "rmse"), "series_key")
    return f.where((F.col("upper_90") - F.col("lower_90")) > F.col("rmse") * F.lit(cfg.risk_k)).select(
        "series_key", "period", "forecast", F.lit(RISK_TYPE).alias("risk_type"),
        F.lit(RISK_DESCRIPTION).alias("description"))
