"""Helpers shared by the corpus operators: written intermediate tables,
size-checked broadcasts and row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir, ship_package

#: Largest table (rows) that is hinted for broadcast; larger ones are joined
#: by shuffle with the same result.
BROADCAST_ROWS = 1_000_000


#: Bytes of an Arrow batch that goes to a worker, where the session names none:
#: rows are whole texts, and Spark's own 64 MB is held several times over.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> str:
    """Ship the package to the workers, bound their batches; return the
    shared folder."""
    ship_package(spark)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in spark.conf.getAll:
        spark.conf.set(limit, str(BATCH_BYTES))
    return ensure_checkpoint_dir(spark).rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """An unused folder below the shared folder the cluster names."""
    return f"{prepare(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, and a lost executor costs only the tasks it ran."""
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a written table if it has at most ``limit`` rows
    (counted, not estimated); leave the join to the optimizer otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def row_key() -> tuple[Column, Column]:
    """(doc_id, text hash): names a row of documents even where ids repeat."""
    return F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_key")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text_key, raw (the UTF-8 bytes of the text; null: empty)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return docs.select(*row_key(), raw, *more)


def without(docs: DataFrame, bad: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is not among ``bad`` (doc_id,
    text_key; a written table), or with ``left_semi`` those that are. Nulls
    are equal to nulls."""
    bad = small(bad.select("doc_id", "text_key"))
    on = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"])
    return docs.join(bad, on, how)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    while name in df.columns:
        name += "_"
    return name


def arrow_rows(df: DataFrame, fn: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` with columns as a dict of arrays in and a dict of
    lists or arrays out (None: no rows)."""
    names = [part.split()[0] for part in schema.split(",")]
    types = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn({n: b.column(i) for i, n in enumerate(b.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], type=types.field(n).type) for n in names], schema=types)

    return df.mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
          "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
          "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
          "array<string>": pa.list_(pa.string())}


def pa_schema(schema: str) -> pa.Schema:
    """The Arrow form of a Spark DDL string of the types above."""
    return pa.schema([(n, _TYPES[t]) for n, t in (p.split() for p in schema.split(","))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

