"""CSV scan (S1) into the canonical transaction frame.

All columns are read as strings (no ``inferSchema`` pass over the data);
role columns get explicit casts in ``canonical_frame``. The profile runs on
these raw rows, before dates are parsed and rows dropped, as the source
pipeline does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.binding import (RoleBinding, bind_roles, canonical_frame, drop_unusable,
                                      normalise_headers)


def read_transactions_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Raw rows, header names as written, every value a string."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    reader = reader.option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def prepare(raw: DataFrame) -> tuple[DataFrame, DataFrame, RoleBinding]:
    """raw rows -> (normalised raw rows, usable typed transactions, binding).

    Raises ``SchemaError`` on the driver before any job when a required role
    is missing or two headers collide.
    """
    normalised = normalise_headers(raw)
    binding = bind_roles(normalised.columns)
    txn = drop_unusable(canonical_frame(normalised, binding))
    return normalised, txn, binding
