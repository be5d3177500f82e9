"""Test-table readers and the ``sales_fact`` view over them (fixture F-B).

``sales_fact`` joins only the tables the requested roles need, so a query
on (order_date, sales) reads two tables and two-plus-two columns.

Join strategy at scale:
* lineitem x orders is the one large join (both sides grow with the data);
  it is a shuffle join on the order key, both sides pruned to the needed
  columns first. Customer, nation and region attributes are joined to the
  orders side BEFORE that join, so the lineitem-sized result is never
  shuffled again for them. ``materialize_fact`` writes the joined fact once,
  partitioned by order month, so repeated analyses scan instead of joining.
* customer and part also grow with the data: no broadcast hint; AQE and
  ``autoBroadcastJoinThreshold`` broadcast them only when their measured
  size is under the threshold, otherwise a shuffle join is kept.
* nation (25 rows) and region (5 rows) have a fixed size by definition of
  the schema, so they are broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import no_neg_zero

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Role -> source expression of fixture F-B.
FACT_ROLES = ("order_id", "order_date", "ship_date", "ship_mode", "sales", "quantity",
              "discount", "product_id", "product_name", "category", "customer_id",
              "customer_name", "segment", "region", "state")
_NEEDS_PART = {"product_name", "category"}
_NEEDS_CUSTOMER = {"customer_name", "segment", "region", "state"}
_NEEDS_NATION = {"region", "state"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_fact(spark: SparkSession, sf_dir: str, roles=None) -> DataFrame:
    """Transactions with canonical role columns (F-B). No profit, no city."""
    roles = list(FACT_ROLES if roles is None else roles)
    want = set(roles) | {"order_date", "sales"}
    li_cols = ["l_orderkey", "l_extendedprice", "l_discount"]
    if "ship_date" in want:
        li_cols.append("l_shipdate")
    if "quantity" in want:
        li_cols.append("l_quantity")
    if want & (_NEEDS_PART | {"product_id"}):
        li_cols.append("l_partkey")
    li = read_table(spark, sf_dir, "lineitem").select(*li_cols)

    o_cols = ["o_orderkey", "o_orderdate"]
    if "ship_mode" in want:
        o_cols.append("o_orderpriority")
    if want & (_NEEDS_CUSTOMER | {"customer_id"}):
        o_cols.append("o_custkey")
    orders = read_table(spark, sf_dir, "orders").select(*o_cols)

    # Customer attributes are attached to the ORDERS side first: orders and
    # customer are much smaller than lineitem, so lineitem is shuffled once
    # (for the order-key join) instead of twice.
    if want & _NEEDS_CUSTOMER:
        c_cols = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]
        cust = read_table(spark, sf_dir, "customer").select(*c_cols)
        if want & _NEEDS_NATION:
            nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
            if "region" in want:
                region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
                nation = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "inner")
            cust = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "inner")
        orders = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")

    df = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")

    if want & _NEEDS_PART:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        df = df.join(part, df.l_partkey == part.p_partkey, "inner")

    exprs = {
        "order_id": F.col("o_orderkey"),
        "order_date": F.col("o_orderdate"),
        "ship_date": F.col("l_shipdate"),
        "ship_mode": F.col("o_orderpriority"),
        "sales": F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")),
        "quantity": F.col("l_quantity"),
        "discount": no_neg_zero("l_discount"),
        "product_id": F.col("l_partkey"),
        "product_name": F.col("p_name"),
        "category": F.col("p_type"),
        "customer_id": F.col("o_custkey"),
        "customer_name": F.col("c_name"),
        "segment": F.col("c_mktsegment"),
        "region": F.col("r_name"),
        "state": F.col("n_name"),
    }
    out = [exprs[r].alias(r) for r in dict.fromkeys(["order_date", "sales", *roles])]
    return df.select(*out)


# SQL form of the same view, used by the oracle queries.
def sales_fact_sql(roles=None) -> str:
    roles = list(FACT_ROLES if roles is None else roles)
    exprs = {
        "order_id": "o.o_orderkey",
        "order_date": "o.o_orderdate",
        "ship_date": "l.l_shipdate",
        "ship_mode": "o.o_orderpriority",
        "sales": "l.l_extendedprice * (1.0 - l.l_discount)",
        "quantity": "l.l_quantity",
        "discount": "l.l_discount + 0.0",
        "product_id": "l.l_partkey",
        "product_name": "p.p_name",
        "category": "p.p_type",
        "customer_id": "o.o_custkey",
        "customer_name": "c.c_name",
        "segment": "c.c_mktsegment",
        "region": "r.r_name",
        "state": "n.n_name",
    }
    want = set(roles) | {"order_date", "sales"}
    sql = "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
    if want & _NEEDS_PART:
        sql += " JOIN part p ON l.l_partkey = p.p_partkey"
    if want & _NEEDS_CUSTOMER:
        sql += " JOIN customer c ON o.o_custkey = c.c_custkey"
        if want & _NEEDS_NATION:
            sql += " JOIN nation n ON c.c_nationkey = n.n_nationkey"
            if "region" in want:
                sql += " JOIN region r ON n.n_regionkey = r.r_regionkey"
    cols = ", ".join(f"{exprs[r]} AS {r}" for r in dict.fromkeys(["order_date", "sales", *roles]))
    return f"(SELECT {cols} {sql})"


# Reference-style CSV headers for the raw transaction view.
RAW_HEADERS = {
    "Order ID": "order_id", "Order Date": "order_date", "Ship Date": "ship_date",
    "Ship Mode": "ship_mode", "Customer ID": "customer_id", "Customer Name": "customer_name",
    "Segment": "segment", "Region": "region", "State": "state", "Product ID": "product_id",
    "Category": "category", "Product Name": "product_name", "Sales": "sales",
    "Quantity": "quantity", "Discount": "discount",
}
RAW_DATE_FORMAT = "dd/MM/yyyy"


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact as a CSV would deliver it: display headers, string ids,
    day-first date strings. Input of header normalisation, binding and the
    column profile (S2-S4, C1, P1-P4)."""
    fact = sales_fact(spark, sf_dir)
    out = []
    for header, role in RAW_HEADERS.items():
        c = F.col(role)
        if role in ("order_date", "ship_date"):
            c = F.date_format(c, RAW_DATE_FORMAT)
        elif role in ("order_id", "customer_id", "product_id"):
            c = c.cast("string")
        out.append(c.alias(header))
    return fact.select(*out)


def raw_transactions_sql() -> str:
    inner = sales_fact_sql()
    cols = []
    for header, role in RAW_HEADERS.items():
        if role in ("order_date", "ship_date"):
            e = f"strftime({role}, '%d/%m/%Y')"
        elif role in ("order_id", "customer_id", "product_id"):
            e = f"CAST({role} AS VARCHAR)"
        else:
            e = role
        cols.append(f'{e} AS "{header}"')
    return f"(SELECT {', '.join(cols)} FROM {inner} f)"


def materialize_fact(spark: SparkSession, sf_dir: str, path: str, roles=None) -> DataFrame:
    """Write the joined fact once, partitioned by order month, and return a
    reader over it. Later filters on ``order_month`` prune partitions.

    The rows are rebalanced, not hashed to one task for each month: AQE cuts
    a month to tasks of the advisory size."""
    fact = sales_fact(spark, sf_dir, roles).withColumn(
        "order_month", F.date_format("order_date", "yyyy-MM"))
    (fact.hint("rebalance", "order_month").write.mode("overwrite")
         .partitionBy("order_month").parquet(path))
    return spark.read.parquet(path)
