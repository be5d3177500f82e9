"""Pipeline parameters.

The source pipeline hard-codes a handful of invented constants; each one is
a named, overridable field here so results that rest on an estimate can be
flagged as such in the output.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the source pipeline's for identical results.
MODEL_FEATURES = (
    "lag1", "lag2", "lag3", "lag6", "lag12",
    "roll3_mean", "roll3_std", "roll6_mean", "roll6_std", "roll12_mean",
    "ema3", "ema6", "ema12",
    "month", "quarter", "is_q4", "stl_trend", "stl_seasonal",
)
LAGS = (1, 2, 3, 6, 12)
ROLL_MEANS = (3, 6, 12)
ROLL_STDS = (3, 6)
EMA_SPANS = (3, 6, 12)
ISO_FEATURES = ("sales", "lag1", "lag2", "lag12", "roll3_mean", "roll3_std")
SEVERITY_BY_VOTES = {3: "critical", 2: "high"}  # otherwise "normal"


@dataclass(frozen=True)
class PipelineConfig:
    # estimates (SN12): flagged in output wherever used
    profit_rate_estimate: float = 0.15
    explain_scale: float = 0.15
    default_importance: float = 0.05
    forecast_floor: float = 100.0
    # profile role thresholds
    categorical_max_distinct: int = 15
    high_cardinality_min_distinct: int = 100
    # EDA
    hist_bins: int = 15
    top_products: int = 10
    top_others: int = 5
    # series
    fill_gaps: bool = False
    # 12 months of lags and three feature rows: the holdout of a short series
    # (two rows) leaves one to train on
    min_months: int = 15
    # forecast; stl_scope "train": backtest STL fitted on train months only (SN2),
    # "full": on all months as the source does
    stl_scope: str = "train"
    holdout: int = 12
    short_extra: int = 6
    horizon: int = 12
    z_band: float = 1.645
    gbt_iter: int = 100
    gbt_depth: int = 5
    gbt_min_instances: int = 20
    rf_trees: int = 100
    rf_depth: int = 30
    # training rows are dealt by (series_key, period) to so many partitions
    train_partitions: int = 4
    seed: int = 42
    # anomaly
    iqr_k: float = 1.5
    z_limit: float = 2.0
    resid_k: float = 1.5
    iso_trees: int = 100
    iso_sample: int = 256
    contamination: float = 0.1
    risk_steps: int = 6
    risk_k: float = 2.0
    # explanation: "deviation" (the source's effective path) or "tree_shap"
    explain_method: str = "deviation"
    top_contrib: int = 6
    # token bucket (upload limiter: burst of 10, then one per 5 s)
    bucket_capacity: float = 10.0
    bucket_rate_per_sec: float = 1.0 / 5.0
    # exact distinct counts in profile/EDA; False switches to HLL sketches
    exact_distinct: bool = True
