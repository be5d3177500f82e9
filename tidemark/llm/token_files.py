"""Token files: flat unsigned integers in ascending doc_id order with 64-bit
document offsets, one shard for each range of ids, read by memory map."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_dir, pa_schema, prepare, table, written
from tidemark.llm.tokens import default_tokenizer, encoder, groups

SHARDS = "shard int,path string,n_docs long,n_tokens long"
ROWS = 4096  # documents read back at a time


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    parts = urlparse(path)
    if parts.scheme == "file":
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(path)


def _finish(system: fs.FileSystem, stem: str, attempt: str, kinds: list[str]) -> None:
    for kind in kinds:
        system.move(f"{stem}.{attempt}.{kind}", f"{stem}.{kind}")


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str | None = None,
                 end_id: int = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder`` and return the manifest
    (shard, path, n_docs, n_tokens, base_docs, base_tokens), a written table.

    A shard is three files: ``.bin`` with the ids (uint16 where the
    vocabulary allows it, else uint32), ``.off`` with n_docs + 1 offsets
    (uint64, from the shard's first id) and ``.doc`` with the doc ids
    (int64; null ids sort first and are stored as the smallest int64). A
    shard's base is the prefix sum over the shards before it. An attempt
    writes under a name of its own and renames at the end, so a task that is
    run again leaves whole files."""
    path = tokenizer or default_tokenizer()
    prepare(spark)
    end = np.array([end_id], "<u4").tobytes()
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    schema = pa_schema(SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(path)
        kind = "<u2" if max(end_id, enc.size - 1) < 1 << 16 else "<u4"
        number, attempt = context.partitionId(), f"try{context.taskAttemptId()}"
        system, root = file_system(folder)
        stem, at, n = f"{root}/{number:06d}", 0, 0
        out = {}
        try:
            for b in batches:
                if not out:
                    out = {k: system.open_output_stream(f"{stem}.{attempt}.{k}") for k in ("bin", "off", "doc")}
                    out["off"].write(np.array([0], "<u8").tobytes())
                ids = np.array([x if x is not None else -(1 << 63) for x in b.column(0).to_pylist()], "<i8")
                offsets = np.empty(len(ids), "<u8")
                for i, encoded in enumerate(x for part in groups(b.column(1)) for x in enc.encode(part)):
                    data = np.frombuffer(encoded + end, "<u4")
                    out["bin"].write(data.astype(kind).tobytes())
                    at += len(data)
                    offsets[i] = at
                out["off"].write(offsets.tobytes())
                out["doc"].write(ids.tobytes())
                n += len(ids)
        finally:
            for f in out.values():
                f.close()
        if out:
            _finish(system, stem, attempt, list(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], type=f.type) for x, f in zip((number, f"{folder}/{number:06d}", n, at), schema)], schema=schema)

    order = ["doc_id", F.xxhash64("text")]
    shards = (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order)
              .sortWithinPartitions(*order).mapInArrow(run, SHARDS))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = written(spark, shards, "shards")
    return written(spark, shards.select("*", *[
        F.coalesce(F.sum(f"n_{x}").over(before), F.lit(0)).alias(f"base_{x}") for x in ("docs", "tokens")]), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files,
    from memory-mapped shards (read whole where the folder isn't on a
    mounted file system)."""
    out = "doc_id long,start long,n_tokens long,ids_crc32 long"
    schema = pa_schema(out)

    def load(system, path: str, kind: str) -> np.ndarray:
        if isinstance(system, fs.LocalFileSystem):
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        with system.open_input_file(path) as f:
            return np.frombuffer(f.read(), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                system, stem = file_system(row["path"])
                offsets, docs = load(system, f"{stem}.off", "<u8"), load(system, f"{stem}.doc", "<i8")
                size = system.get_file_info(f"{stem}.bin").size
                ids = load(system, f"{stem}.bin", "<u2" if size == 2 * int(offsets[-1]) else "<u4")
                for a in range(0, len(docs), ROWS):
                    z = min(a + ROWS, len(docs))
                    cut = offsets[a:z + 1].astype(np.int64)
                    sums = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(cut[:-1], cut[1:])]
                    who = np.array(docs[a:z])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(who, mask=who == -(1 << 63)), pa.array(cut[:-1] + row["base_tokens"]),
                        pa.array(np.diff(cut)), pa.array(sums, type=pa.int64())], schema=schema)

    # a task for each shard: its row is a few bytes, its files are not
    return manifest.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, out)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' path is the manifest's; null texts are the end id alone,
    repeated ids follow each other, an empty table gives no rows."""
    return read_shards(spark, write_shards(spark, table(spark, sf_dir, "documents"), new_dir(spark, "tokens")))
