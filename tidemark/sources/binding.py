"""Header normalisation (S2), role binding (S3) and the required-column check.

Binding happens on the driver over ``df.columns`` only (metadata, no job).
The bound frame selects just the role columns, so Catalyst prunes every
other column down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import as_timestamp

# Candidate header names per role, first match wins.
ROLE_ALIASES = {
    "order_date": ("order_date", "date", "orderdate"),
    "sales": ("sales", "revenue", "amount"),
    "category": ("category", "prod_cat"),
    "segment": ("segment", "cust_seg"),
    "region": ("region", "district"),
    "ship_mode": ("ship_mode", "shipping_mode"),
    "ship_date": ("ship_date", "shipping_date"),
    "order_id": ("order_id", "id"),
    "product_id": ("product_id", "product"),
    "customer_id": ("customer_id", "customer"),
    "profit": ("profit", "gain"),
    "product_name": ("product_name",),
    "customer_name": ("customer_name",),
    "state": ("state",),
    "city": ("city",),
}
REQUIRED_ROLES = ("order_date", "sales")
DOUBLE_ROLES = ("sales", "profit", "quantity", "discount")
TIME_ROLES = ("order_date", "ship_date")


class SchemaError(ValueError):
    """Raised before any Spark action when the input cannot be bound."""


def normalise_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Rename every column to its normalised form (metadata only).

    Two headers that normalise to the same name are rejected: a later
    ``col(name)`` could not tell them apart.
    """
    new = [normalise_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for orig, n in zip(df.columns, new):
        if n in seen:
            raise SchemaError(f"headers {seen[n]!r} and {orig!r} both normalise to {n!r}")
        seen[n] = orig
    return df.toDF(*new)


@dataclass(frozen=True)
class RoleBinding:
    roles: dict  # role -> normalised column name

    def has(self, role: str) -> bool:
        return role in self.roles

    def column(self, role: str) -> str:
        return self.roles[role]


def bind_roles(columns, aliases=ROLE_ALIASES, required=REQUIRED_ROLES) -> RoleBinding:
    cols = set(columns)
    roles = {}
    for role, candidates in aliases.items():
        hit = next((c for c in candidates if c in cols), None)
        if hit is not None:
            roles[role] = hit
    missing = [r for r in required if r not in roles]
    if missing:
        raise SchemaError(f"no column is bound to {' or '.join(missing)}; known headers: "
                          + "; ".join(f"{r}: {', '.join(aliases[r])}" for r in missing))
    return RoleBinding(roles)


def canonical_frame(df: DataFrame, binding: RoleBinding, keep_extra=("quantity", "discount"),
                    carry=()) -> DataFrame:
    """Select role columns under their role names with typed values.

    Dates are parsed (C1); rows are NOT dropped here, see ``drop_unusable``.
    """
    out = []
    for role, name in binding.roles.items():
        if role in TIME_ROLES:
            out.append(as_timestamp(df, name).alias(role))
        elif role in DOUBLE_ROLES:
            out.append(F.col(name).try_cast("double").alias(role))
        else:
            out.append(F.col(name).alias(role))
    for extra in keep_extra:
        if extra in df.columns and extra not in binding.roles:
            out.append(F.col(extra).try_cast("double").alias(extra))
    out += [F.col(c) for c in carry]
    return df.select(*out)


def drop_unusable(txn: DataFrame) -> DataFrame:
    """Rows without a parsed date or a sales value are not usable."""
    return txn.where(F.col("order_date").isNotNull() & F.col("sales").isNotNull()
                     & ~F.isnan("sales"))


def rejected_rows(txn: DataFrame) -> DataFrame:
    """Count of rows C2 drops, by reason (one-row aggregate)."""
    return txn.agg(
        F.count_if(F.col("order_date").isNull()).alias("bad_date"),
        F.count_if(F.col("sales").isNull() | F.isnan("sales")).alias("bad_sales"),
        F.count_if(F.col("order_date").isNull() | F.col("sales").isNull()
                   | F.isnan("sales")).alias("rejected"),
        F.count(F.lit(1)).alias("n_rows"),
    )
