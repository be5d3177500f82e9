"""Append-only logs that keep the files behind their state bounded.

A log is a folder with a ``tail`` of appended event files and ``state``
folders. A fold merges the states and tail files it finds into one new state,
writes beside it which files those were, and deletes what earlier folds had
named. Merging has to be idempotent and closed (a merge of merged rows and of
rows merged before is the same state), so a fold that dies half-way, two folds
at once and a reader that still sees folded files all give the same state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INPUTS = "_inputs"  # beside a state: the files and states it was made of
DONE = "_SUCCESS"


class Folder:
    """The Hadoop file system's view of a folder, whatever store it is in."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def list(self) -> list[tuple[str, str, bool, int]]:
        """(name, full path, is a folder, modified in ms) of what is there."""
        if not self._fs.exists(self.path):
            return []
        return [(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getModificationTime())
                for s in self._fs.listStatus(self.path)]

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str | None = None) -> None:
        """A file or folder inside, or without a name this folder."""
        self._fs.delete(self._at(name) if name else self.path, True)


@dataclass(frozen=True)
class CompactedLog:
    """``merge`` turns rows of ``schema`` into the rows of the state, of the
    same schema (that of the files, once there are some: times may be with or
    without time zone); ``key`` spreads them over files."""

    path: str
    schema: str
    key: str
    merge: Callable[[DataFrame], DataFrame]
    tail_files: int = 64  # beyond so many files an append folds
    rows_per_file: int = 2_000_000

    def append(self, events: DataFrame) -> None:
        """Add events; a large frame counts with all its files."""
        spark = events.sparkSession
        events.write.mode("append").parquet(f"{self.path}/tail")
        _, files, _ = self._present(spark)
        if len(files) > self.tail_files:
            self.fold(spark)

    def _present(self, spark: SparkSession) -> tuple[list[str], list[str], list[str]]:
        """(states, tail files, names of folded inputs) to read, as full paths."""
        states, gone = [], []
        for name, path, is_folder, _ in Folder(spark, f"{self.path}/state").list():
            folder = Folder(spark, path)
            if is_folder and folder.has(DONE) and folder.has(INPUTS):
                states.append(path)
                gone += folder.read(INPUTS).splitlines()
        named = set(gone)
        files = [path for name, path, is_folder, _ in Folder(spark, f"{self.path}/tail").list()
                 if not is_folder and not name.startswith(("_", "."))]
        return [s for s in states if _name(s) not in named], [f for f in files if _name(f) not in named], gone

    def _rows(self, spark: SparkSession, states: list[str], files: list[str]) -> DataFrame:
        paths = states + files
        return spark.read.parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def files(self, spark: SparkSession) -> int:
        """Files that a reader of the state opens."""
        states, files, _ = self._present(spark)
        return len(files) + sum(not x[0].startswith(("_", ".")) for s in states for x in Folder(spark, s).list())

    def state(self, spark: SparkSession) -> DataFrame:
        """The merged rows. A frame stays readable through one later fold."""
        states, files, _ = self._present(spark)
        return self.merge(self._rows(spark, states, files))

    def fold(self, spark: SparkSession) -> None:
        states, files, gone = self._present(spark)
        if not files and len(states) < 2:
            return
        target = f"{self.path}/state/{uuid.uuid4().hex}"
        rows = self._rows(spark, states, files)
        n = -(-rows.count() // self.rows_per_file)  # merging adds no rows
        self.merge(rows).repartition(n, self.key).write.parquet(target)
        Folder(spark, target).write(INPUTS, "\n".join(map(_name, states + files)))
        for folder in ("tail", "state"):  # what the folds before this one have named
            there = Folder(spark, f"{self.path}/{folder}")
            for name in gone:
                there.delete(name)


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def latest_by(keys: list[str], order: list[str], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps, for each key, the row that is last in ``order``."""
    names = [part.strip().split(" ", 1)[0] for part in _parts(schema)]
    rest = [n for n in names if n not in keys]

    def merge(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
        found = rows.groupBy(*keys).agg(last)
        return found.select(*[F.col(n) if n in keys else F.col(f"last.{n}").alias(n) for n in names])

    return merge


def _parts(schema: str) -> list[str]:
    """The columns of a DDL string, which commas inside <> don't divide."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
