"""Feature explanations.

* ``global_importance`` (X2): importance x scale, sorted.
* ``deviation_scores`` (X3, A15, J3, W9): per month and feature,
  (value - median) / std x importance x scale, with std 0 -> 1. This is the
  source pipeline's effective explanation path (its SHAP import fails
  without the optional package); it is a deviation score, not SHAP.
* ``top_contributions`` (K4, X4): the 6 largest per month, also as a map.

Features are unpivoted to long rows; medians and stds are window
aggregates over (series_key, feature), importances (one row per feature, at
most 18) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig
from tidemark.functions.numeric import rnd

CFG = PipelineConfig()


def global_importance(importances: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    return importances.select("feature", rnd(F.col("importance") * F.lit(cfg.explain_scale), 4).alias("shap"))


def long_features(fe: DataFrame, features, ids=("series_key", "period", "period_label")) -> DataFrame:
    wide = fe.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    pos = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int")
    return (wide.unpivot(list(ids), list(features), "feature", "value")
                .withColumn("feature_pos", pos))


def deviation_scores(fe: DataFrame, importances: DataFrame, features,
                     cfg: PipelineConfig = CFG) -> DataFrame:
    lf = long_features(fe, features)
    grp = Window.partitionBy("series_key", "feature")
    std = F.stddev_samp("value").over(grp)
    lf = lf.withColumn("_med", F.median("value").over(grp)) \
           .withColumn("_std", F.when(std == 0, F.lit(1.0)).otherwise(std))
    imp = F.broadcast(importances.select("feature", F.col("importance").cast("double")))
    j = lf.join(imp, "feature", "left")
    contrib = ((F.col("value") - F.col("_med")) / F.col("_std")
               * F.coalesce(F.col("importance"), F.lit(cfg.default_importance))
               * F.lit(cfg.explain_scale))
    return j.select("series_key", "period", "period_label", "feature", "feature_pos",
                    "value", contrib.alias("contribution"))


def top_contributions(scores: DataFrame, k: int = CFG.top_contrib) -> DataFrame:
    """Per month, features ordered by |contribution| as shown (4 decimals);
    ties keep the feature-list order. Spark plans the ``rank <= k`` filter
    as a per-partition group limit before the shuffle."""
    shown = scores.withColumn("contribution", rnd("contribution", 4)) \
                  .withColumn("value", rnd("value", 2))
    w = Window.partitionBy("series_key", "period").orderBy(F.desc(F.abs("contribution")),
                                                            F.asc("feature_pos"))
    return shown.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def top_feature_maps(top: DataFrame) -> DataFrame:
    """{feature: contribution} per month (for the JSON document)."""
    return top.groupBy("series_key", "period_label").agg(
        F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "feature", "contribution"))),
            lambda s: F.struct(s["feature"], s["contribution"]))).alias("top_features"))
