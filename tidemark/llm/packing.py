"""Harmonic packing of token sequences: pieces are put into reciprocal
classes of the capacity and every class fills its bins with a fixed count."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pa_schema, prepare, table
from tidemark.llm.tokens import default_tokenizer, encoder, groups

CAPACITY = 1024
SLACK = 1 / 64  # largest share of a bin that a class may leave empty
SCHEMA = ("doc_id long,start long,length long,ids_crc32 long,doc_tokens long,"
          "sequence_id long,offset long")


@lru_cache(maxsize=8)
def _sizes(capacity: int, slack: float) -> list[int]:
    """For every rest r, the largest size up to r whose class k = capacity //
    size fills its bins with k pieces but for ``slack`` of a bin."""
    good = [0]
    for r in range(1, capacity + 1):
        good.append(r if capacity % r <= slack * capacity or not good[-1] else good[-1])
    return good


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Piece lengths of a document of ``n`` ids: whole bins first, then the
    largest sizes whose classes leave little of a bin empty."""
    out = [capacity] * (n // capacity)
    r, sizes = n % capacity, _sizes(capacity, slack)
    while r:
        out.append(sizes[r])
        r -= sizes[r]
    return out


class Packer:
    """Fills bins from a stream of pieces; holds fewer than ``capacity``
    pieces for each class."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.next, self.capacity = first_id, capacity
        self.open: dict[int, list] = defaultdict(list)

    def _seal(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            yield (*p, self.next, offset)
            offset += p[2]
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """piece: (doc_id, start, length, ids, doc_tokens)."""
        k = self.capacity // piece[2]
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            yield from self._seal(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        """What classes have left over, in one stream cut at the capacity;
        its tail goes to bins of falling powers of two, full without padding."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        total = sum(p[2] for p in rest)
        room = [self.capacity] * (total // self.capacity)
        tail = total % self.capacity
        room += [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        at = 0
        for size in room:
            bin_ = []
            while size:
                doc, start, length, ids, n = rest[at]
                take = min(size, length)
                bin_.append((doc, start, take, ids[:4 * take], n))
                size -= take
                if take == length:
                    at += 1
                else:
                    rest[at] = (doc, start + take, length - take, ids[4 * take:], n)
            yield from self._seal(bin_)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         end_id: int = 0, slack: float = SLACK) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset.

    Every partition of ``docs`` packs by itself, without a shuffle; sequence
    ids are its number times 2^32 and a count. Sequences are to be padded to
    ``capacity`` unless their length is a power of two. Null and empty texts
    are the end id alone; null ids and repeated rows are packed like others
    (``start`` counts within the row); other columns are ignored; an empty
    table gives no rows."""
    path = tokenizer or default_tokenizer()
    prepare(spark)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa_schema(SCHEMA)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*[(d, s, n, zlib.crc32(ids), t, q, o) for d, s, n, ids, t, q, o in rows]))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc = Packer(TaskContext.get().partitionId() << 32, capacity), encoder(path)
        for b in batches:
            out: list[tuple] = []
            encoded = (ids for part in groups(b.column(1)) for ids in enc.encode(part))
            for doc, ids in zip(b.column(0).to_pylist(), encoded):
                ids += end
                n = len(ids) // 4
                start = 0
                for size in cuts(n, capacity, slack):
                    out.extend(packer.add((doc, start, size, ids[4 * start:4 * (start + size)], n)))
                    start += size
                if len(out) > 50_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)
        out = list(packer.close())
        if out:
            yield batch(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
