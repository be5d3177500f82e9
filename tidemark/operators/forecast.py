"""Two-model forecast.

ONE pooled model pair is trained over the feature rows of all series
(series are rows, not separate models), so the work is distributed by
Spark ML's tree learners whatever the number of series. With the constant
key ``'ALL'`` the training rows are the source pipeline's.

* F4: ``GBTRegressor`` (100 rounds, step 0.1, depth 5 ~ 31 leaves, at least
  20 rows per leaf, seed 42) stands in for the
  histogram gradient boosting of the source; F5: ``RandomForestRegressor``
  (100 trees, all features per split, seed 42). Both fit log1p(sales) (F2);
  the ensemble is the mean of both after expm1 (F6). Values differ from the
  source's learners; compare by metric, not value.
* F9: 12-step recursive forecast for EVERY series at once. Each step is one
  DataFrame round: features are rebuilt with array expressions from a
  per-series history array (length bounded by the months of a series),
  both models score the step, the prediction (floored at 100) is appended.
  Lineage is cut with ``checkpoint()`` into the shared checkpoint folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EMA_SPANS, MODEL_FEATURES, PipelineConfig
from tidemark.operators import evaluation
from tidemark.session import ensure_checkpoint_dir

CFG = PipelineConfig()


def assembler(features=MODEL_FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def _training_data(rows: DataFrame, cfg: PipelineConfig, features) -> DataFrame:
    # the layout is a parameter, so a model depends neither on row counts nor on the cluster
    rows = rows.repartition(cfg.train_partitions, "series_key", "period").sortWithinPartitions("series_key", "period")
    return assembler(features).transform(rows).select("features", F.log1p("sales").alias("label")).cache()


def _forest(cfg: PipelineConfig) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=cfg.rf_trees, featureSubsetStrategy="all", maxDepth=cfg.rf_depth,
                                 seed=cfg.seed, labelCol="label", featuresCol="features", predictionCol="p_rf")


def fit_forest(rows: DataFrame, cfg: PipelineConfig = CFG, features=MODEL_FEATURES):
    """F5 alone, for importances and contributions."""
    data = _training_data(rows, cfg, features)
    model = _forest(cfg).fit(data)
    data.unpersist()
    return model


def fit_models(rows: DataFrame, cfg: PipelineConfig = CFG, features=MODEL_FEATURES):
    """fit both learners on log1p(sales)."""
    data = _training_data(rows, cfg, features)
    gbt = GBTRegressor(maxIter=cfg.gbt_iter, stepSize=0.1, maxDepth=cfg.gbt_depth,
                       minInstancesPerNode=cfg.gbt_min_instances,
                       seed=cfg.seed,
                       labelCol="label", featuresCol="features", predictionCol="p_gbt")
    rf = _forest(cfg)
    # the two learners are independent: submit both fits at once (each is a
    # sequence of small jobs, so they share the executors instead of queueing)
    with ThreadPoolExecutor(max_workers=2) as pool:
        fg, fr = pool.submit(gbt.fit, data), pool.submit(rf.fit, data)
        g, r = fg.result(), fr.result()
    data.unpersist()
    return g, r


def predict(models, rows: DataFrame, features=MODEL_FEATURES) -> DataFrame:
    """ensemble = mean of expm1 of both predictions."""
    g, r = models
    x = assembler(features).transform(rows)
    x = r.transform(g.transform(x))
    return x.withColumn("predicted", (F.expm1("p_gbt") + F.expm1("p_rf")) / 2.0) \
            .drop("features", "p_gbt", "p_rf")


def backtest(fe: DataFrame, cfg: PipelineConfig = CFG, features=MODEL_FEATURES):
    """F3 + fit on train rows + predictions on test rows -> (pred, metrics)."""
    split = evaluation.holdout_split(fe, cfg).cache()
    models = fit_models(split.where(~F.col("is_test")), cfg, features)
    scored = predict(models, split.where(F.col("is_test")), features)
    train = split.where(~F.col("is_test")).withColumn("predicted", F.lit(None).cast("double"))
    both = train.unionByName(scored.select(*train.columns))
    pred = both.select("series_key", "period", "period_label", F.col("sales").alias("actual"),
                       "predicted", "is_test")
    return pred, evaluation.forecast_metrics(pred)


def feature_importances(rf_model, features=MODEL_FEATURES, spark=None) -> DataFrame:
    """Gini importances of the forest, descending, 4 decimals."""
    imp = rf_model.featureImportances.toArray().tolist()
    if spark is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                               "feature string, importance double")
    return df.select("feature", F.round("importance", 4).alias("importance")).orderBy(F.desc("importance"))


# ------------------------------------------------------------- recursion

def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), F.size(a))


def _std_samp(a: Column) -> Column:
    m = _mean(a)
    ss = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    return F.sqrt(F.try_divide(ss, F.size(a) - 1))


def _std_pop(a: Column) -> Column:
    m = _mean(a)
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)),
                               F.size(a)))


def _ema(a: Column, span: int) -> Column:
    al = 2.0 / (span + 1.0)
    return F.aggregate(a, F.lit(None).cast("double"),
                       lambda acc, x: F.coalesce(F.lit(1.0 - al) * acc + F.lit(al) * x, x))


def _lag(h: Column, k: int) -> Column:
    return F.when(F.size(h) >= k, F.element_at(h, -k)).otherwise(F.element_at(h, -1))


def step_features(state: DataFrame, legacy_features: bool = False) -> DataFrame:
    """Feature row for the next month of every series from its history."""
    h = F.col("hist")
    nxt = F.add_months("last_period", 1)
    # the last k values, or all of them when the history is shorter
    tail = lambda k: F.slice(h, F.greatest(-F.size(h), F.lit(-k)), F.lit(k))
    std = _std_pop if legacy_features else _std_samp
    cols = {
        "lag1": F.element_at(h, -1), "lag2": _lag(h, 2), "lag3": _lag(h, 3),
        "lag6": _lag(h, 6), "lag12": _lag(h, 12),
        "roll3_mean": _mean(tail(3)), "roll3_std": std(tail(3)),
        "roll6_mean": _mean(tail(6)), "roll6_std": std(tail(6)),
        "roll12_mean": _mean(tail(12)),
        "month": F.month(nxt), "quarter": F.quarter(nxt),
        "is_q4": (F.month(nxt) >= 10).cast("int"),
        "stl_trend": F.element_at("trend_hist", -1) + F.coalesce(
            F.element_at("trend_hist", -1) - F.element_at("trend_hist", -2), F.lit(0.0)),
        "stl_seasonal": F.when(F.size("season_hist") >= 12, F.element_at("season_hist", -12))
                         .otherwise(F.element_at("season_hist", -1)),
    }
    for s in EMA_SPANS:
        cols[f"ema{s}"] = cols[f"roll{s}_mean"] if legacy_features else _ema(h, s)
    return state.select("*", *[c.alias(n) for n, c in cols.items()], nxt.alias("next_period"))


def recursive_forecast(fe: DataFrame, models, metrics: DataFrame, cfg: PipelineConfig = CFG,
                       monthly: DataFrame | None = None, legacy_features: bool = False,
                       checkpoint_every: int = 4) -> DataFrame:
    """F9 + F10 for every series: ``horizon`` months ahead with 90% bands.

    ``monthly`` holds all months of the series: the EMAs go on from its
    first month, as in training. Without it (or with the source's features)
    the history starts at the first row that has every feature."""
    w = Window.partitionBy("series_key").orderBy("period")
    full = Window.partitionBy("series_key").orderBy("period").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    state = (fe.select("series_key", "period",
                       F.collect_list("sales").over(full).alias("hist"),
                       F.collect_list("stl_trend").over(full).alias("trend_hist"),
                       F.collect_list("stl_seasonal").over(full).alias("season_hist"),
                       F.row_number().over(w).alias("_rn"), F.count(F.lit(1)).over(full).alias("_n"))
               .where(F.col("_rn") == F.col("_n"))
               .select("series_key", F.col("period").alias("last_period"), "hist", "trend_hist",
                       "season_hist"))
    if monthly is not None and not legacy_features:
        months = monthly.groupBy("series_key").agg(
            F.sort_array(F.collect_list(F.struct("period", "sales"))).alias("months"))
        state = (state.drop("hist").join(months, "series_key")
                 .withColumn("hist", F.transform("months", lambda x: x["sales"])).drop("months"))
    ensure_checkpoint_dir(fe.sparkSession)
    state = state.withColumn("fc", F.array().cast("array<double>"))
    for step in range(1, cfg.horizon + 1):
        x = step_features(state, legacy_features)
        x = predict(models, x).withColumn(
            "forecast_raw", F.greatest(F.col("predicted"), F.lit(cfg.forecast_floor)))
        # one row per series; the forecasts so far travel in the state
        state = x.select("series_key", F.col("next_period").alias("last_period"),
                         F.concat("hist", F.array("forecast_raw")).alias("hist"),
                         F.concat("trend_hist", F.array("stl_trend")).alias("trend_hist"),
                         F.concat("season_hist", F.array("stl_seasonal")).alias("season_hist"),
                         F.concat("fc", F.array("forecast_raw")).alias("fc"))
        if step % checkpoint_every == 0 and step < cfg.horizon:
            state = state.checkpoint(eager=True)
    out = state.select("series_key", "last_period", F.posexplode("fc").alias("i", "forecast_raw")).select(
        "series_key", (F.col("i") + 1).cast("int").alias("step"),
        F.add_months("last_period", F.col("i") + 1 - cfg.horizon).alias("period"), "forecast_raw")
    return evaluation.forecast_bands(out, metrics, cfg)


def rolling_origin_cv(fe: DataFrame, cfg: PipelineConfig = CFG, folds: int = 3,
                      features=MODEL_FEATURES) -> DataFrame:
    """a real rolling-origin evaluation (not a constant offset): for
    each of ``folds`` cut-offs, refit on the rows before it and score the
    next ``holdout`` rows; per-fold metrics per series. Folds are
    independent and their fits are submitted concurrently."""
    rd = F.row_number().over(Window.partitionBy("series_key").orderBy(F.desc("period")))
    base = fe.withColumn("_rd", rd).cache()

    def one(k: int) -> DataFrame:
        lo = k * cfg.holdout
        test = (F.col("_rd") > lo) & (F.col("_rd") <= lo + cfg.holdout)
        train = base.where(F.col("_rd") > lo + cfg.holdout)
        models = fit_models(train, cfg, features)
        scored = predict(models, base.where(test), features)
        pred = (train.withColumn("predicted", F.lit(None).cast("double"))
                     .withColumn("is_test", F.lit(False))
                     .unionByName(scored.withColumn("is_test", F.lit(True)).select(
                         *train.columns, "predicted", "is_test"))
                     .select("series_key", "period", F.col("sales").alias("actual"),
                             "predicted", "is_test"))
        return evaluation.forecast_metrics(pred).withColumn("fold", F.lit(k + 1))

    with ThreadPoolExecutor(max_workers=folds) as pool:
        parts = list(pool.map(one, range(folds)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
