"""Many CSV files with headers of their own in one job.

Headers are read once for each file, as a reader of footers would; files with
the same header are one scan, whose columns are bound to roles, and the scans
are united by role. Whether a file writes days or months first is voted by
its own dates, and rows that can't be used are kept with the file they come
from, their text and the reason."""

from __future__ import annotations

import csv
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import DAY_FIRST_FORMATS, parse_day_first
from tidemark.sources.binding import (DOUBLE_ROLES, ROLE_ALIASES, TIME_ROLES, RoleBinding, SchemaError, bind_roles,
                                      normalise_name)
from tidemark.sources.csv_source import read_transactions_csv

HEADER_THREADS = 16
EXTRAS = ("quantity", "discount")
FEW_FILES = 100_000  # a vote for each of so many files is broadcast
#: The day-first formats that start with a day, with the month there.
MONTH_FIRST_FORMATS = tuple("M" + f[1] + "d" + f[3:] if f.startswith("d") else f for f in DAY_FIRST_FORMATS)
#: The start of a date whose two first numbers are of these kinds: 13 and more, and up to 12.
LARGE, SMALL = r"(?:1[3-9]|[2-9]\d)", r"(?:0?\d|1[0-2])"
PARTS = r"^\s*{}[/.-]{}[/.-]\d{{2,4}}"
FILES = "file string,header array<string>,roles map<string,string>,error string"


@dataclass(frozen=True)
class FolderRead:
    """transactions: usable typed rows with source_file; quarantine: the
    others as source_file, row (JSON of the columns as written), bad_date,
    bad_sales; files: one row for each file with its header, bound roles or
    the error, the votes of its dates and the order they were read in."""
    transactions: DataFrame
    quarantine: DataFrame
    files: DataFrame


def csv_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files below a folder, glob or list of them; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
    return sorted(r.path for r in found.load(path).select("path").collect())


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The fields of a file's first line."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return tuple(next(csv.reader([line.removeprefix("﻿")]), ())) if line else ()


def _bind(fields: tuple[str, ...]) -> RoleBinding:
    names = [normalise_name(f) for f in fields]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise SchemaError(f"headers that normalise alike: {', '.join(twice)}")
    return bind_roles(names)


def _as_text(raw: DataFrame, binding: RoleBinding) -> DataFrame:
    """Role columns as they are written, with the file and the whole row."""
    plain = raw.select(F.to_json(F.struct("*")).alias("row"), F.col("_metadata.file_path").alias("source_file"),
                       *[F.col(f"`{c}`").alias(normalise_name(c)) for c in raw.columns])
    have = set(plain.columns)
    roles = {**binding.roles, **{x: x for x in EXTRAS if x in have}}
    return plain.select("source_file", "row", *[F.col(n).alias(r) for r, n in roles.items()])


def date_votes(rows: DataFrame) -> DataFrame:
    """source_file, day_first, month_first: dates of a file whose first or
    second number is above 12; at most one row for each file and task."""
    starts = lambda first, second: F.count_if(F.col("order_date").rlike(PARTS.format(first, second)))
    return rows.groupBy("source_file").agg(starts(LARGE, SMALL).alias("day_first"), starts(SMALL, LARGE).alias("month_first"),
                                           starts(SMALL, SMALL).alias("undecided"))


def _order(day: Column, month: Column, undecided: Column) -> Column:
    return (F.when((day > 0) & (month > 0), "mixed").when(month > 0, "month first").when(day > 0, "day first")
            .when(undecided > 0, "ambiguous").otherwise("other"))


def read_transactions_folder(spark: SparkSession, path: str | list[str], vote: bool = True) -> FolderRead:
    """Read all ``*.csv`` below ``path``.

    A file that can't be bound (a required column is missing, two headers
    normalise alike) is reported with its error; the others go on. Files
    without a byte are not listed. With ``vote`` dates of a file that has some that can only
    be month first, and none that can only be day first, are read month
    first; ambiguous and mixed files are read day first and reported."""
    paths = csv_files(spark, path)
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        by_header = defaultdict(list)
        for p, h in zip(paths, pool.map(lambda p: header(spark, p), paths)):
            by_header[h].append(p)
    found, scans = [], []
    for fields, mine in sorted(by_header.items()):
        try:
            binding = _bind(fields)
        except SchemaError as e:
            found += [(p, list(fields), None, str(e)) for p in mine]
            continue
        found += [(p, list(fields), binding.roles, None) for p in mine]
        scans.append(_as_text(read_transactions_csv(spark, mine), binding))
    roles = [*ROLE_ALIASES, *EXTRAS]
    empty = spark.createDataFrame([], ",".join(f"{c} string" for c in ("source_file", "row", "order_date", "sales")))
    rows = empty
    for scan in scans:
        rows = rows.unionByName(scan, allowMissingColumns=True)
    votes = date_votes(rows)
    order = _order(F.col("day_first"), F.col("month_first"), F.col("undecided"))
    votes = votes.withColumn("date_order", order)
    if vote:
        switched = votes.where("date_order = 'month first'").select(F.col("source_file").alias("_file"), F.lit(True).alias("_switch"))
        switched = F.broadcast(switched) if len(paths) <= FEW_FILES else switched
        rows = rows.join(switched, F.col("source_file") == F.col("_file"), "left").drop("_file")
    else:
        rows = rows.withColumn("_switch", F.lit(None).cast("boolean"))
    columns = []
    for c in [r for r in roles if r in rows.columns]:
        if c in TIME_ROLES:
            read = F.when(F.col("_switch"), parse_day_first(c, MONTH_FIRST_FORMATS)).otherwise(parse_day_first(c))
        else:
            read = F.col(c).try_cast("double") if c in DOUBLE_ROLES else F.col(c)
        columns.append(read.alias(c))
    typed = rows.select("source_file", "row", *columns)
    bad_date = F.col("order_date").isNull()
    bad_sales = F.col("sales").isNull() | F.isnan("sales")
    # paths as Spark's readers write them, so that the report joins
    files = spark.createDataFrame(found, FILES).withColumn("_key", F.regexp_replace("file", "^file:/+", "file:///"))
    report = files.join(votes, F.col("_key") == F.regexp_replace("source_file", "^file:/+", "file:///"), "left").drop("_key", "source_file")
    return FolderRead(typed.where(~(bad_date | bad_sales)).drop("row"),
                      typed.where(bad_date | bad_sales).select("source_file", "row", bad_date.alias("bad_date"), bad_sales.alias("bad_sales")),
                      report.fillna(0, ["day_first", "month_first", "undecided"]))
