"""tidemark: Spark-native sales and time-series analytics.

Every operator takes and returns Spark DataFrames. Raw-row operators
(profile, KPIs, breakdowns, monthly aggregation) are plain aggregations;
time-series operators work on many series at once, keyed by
``series_key`` and windowed with ``Window.partitionBy("series_key")``.
"""

from tidemark.config import PipelineConfig

__all__ = ["PipelineConfig"]
__version__ = "0.1.0"
