"""Column profile (P1-P4) on raw rows, before dates are parsed.

A string column whose non-null values all read as numbers counts as
numeric (as a type-inferring CSV reader would see it), so it can be an
identifier but not a high-cardinality string.

The raw rows are written once as Parquet, then every column is grouped by
its own value: a scan reads that column alone, equal values are counted
map-side and no row is expanded. ``exact=False`` uses HLL sketches instead
of the distinct values, at a small relative error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StringType

from tidemark.config import PipelineConfig
from tidemark.functions.numeric import rnd
from tidemark.session import written
from tidemark.sources.binding import normalise_name

CFG = PipelineConfig()

# Names that are always numeric features.
NUMERIC_FEATURE_NAMES = ("sales", "profit", "discount", "quantity")
# A decimal number as text (regex test: no exception path per failed cast).
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _role_expr(norm_col, unique_col, is_string_col, cfg: PipelineConfig):
    """P3, rules applied in order."""
    return (F.when(norm_col.contains("date") | norm_col.contains("time"), F.lit("time"))
             .when(norm_col.isin(*NUMERIC_FEATURE_NAMES), F.lit("numeric_feature"))
             .when(unique_col < cfg.categorical_max_distinct, F.lit("categorical_feature"))
             .when((unique_col > cfg.high_cardinality_min_distinct) & is_string_col,
                   F.lit("high_cardinality_string"))
             .otherwise(F.lit("identifier")))


def profile_columns(raw: DataFrame, cfg: PipelineConfig = CFG, exact: bool | None = None) -> DataFrame:
    """One row per column of the RAW frame (headers as written)."""
    exact = cfg.exact_distinct if exact is None else exact
    table = written(raw.toDF(*[f"c{i}" for i in range(len(raw.columns))]), "profile")
    out = None
    for i, field in enumerate(raw.schema.fields):
        part = _one_column(table, f"c{i}", field.dataType, exact).select(
            F.lit(i).alias("position"), F.lit(field.name).alias("name"),
            F.lit(normalise_name(field.name)).alias("column"), "*")
        out = part if out is None else out.unionByName(part)
    return out.select(
        "position", "name", "column", "null_count",
        rnd(F.try_divide(F.col("null_count"), F.col("n_rows")), 4).alias("null_rate"),
        "unique_count",
        _role_expr(F.col("column"), F.col("unique_count"), F.col("n_text") > 0, cfg).alias("role"))


def _one_column(table: DataFrame, c: str, kind: DataType, exact: bool) -> DataFrame:
    """n_rows, null_count, unique_count, n_text (values that don't read as
    numbers) of one column, from its distinct values with their counts."""
    v = F.col(c)
    null = v.isNull() | F.isnan(v) if isinstance(kind, (DoubleType, FloatType)) else v.isNull()
    text = v.isNotNull() & ~v.rlike(NUMERIC_TEXT) if isinstance(kind, StringType) else F.lit(False)
    if exact:
        values = table.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        n, unique = F.col("n"), F.count(c)
    else:
        values, n, unique = table, F.lit(1), F.approx_count_distinct(c)
    amount = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return values.agg(amount(n).alias("n_rows"), amount(F.when(null, n)).alias("null_count"),
                      unique.alias("unique_count"), F.count_if(text).alias("n_text"))


def profile_table(raw: DataFrame) -> DataFrame:
    """Row and column count."""
    return raw.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(raw.columns)).cast("long").alias("n_columns"))
