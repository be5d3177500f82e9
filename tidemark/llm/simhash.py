"""SimHash near-duplicates: fingerprints, deletion-variant signatures of
segments, equality grouping, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, keyed, pa_schema, table, without, written
from tidemark.llm.components import components

BITS = 64
ROWS = 1 << 16  # hashes unpacked to bits at a time


def fingerprint(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles (words: runs without ASCII
    white space, A-Z lower-cased; repeats count). Fewer words than
    ``shingle``: the whole sequence is one shingle; no word: zero."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:])),
                             np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), ROWS):
        octets = hashes[i:i + ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def segments(distance: int) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments of which one differs by at
    most one bit whenever ``distance`` bits differ in all: with two bits in
    every segment, more than ``distance`` would differ."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _variants(fp: np.ndarray, segs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Signature codes (variant number, segment without one bit) and their
    fingerprints; 64 for each fingerprint."""
    codes = []
    for off, width in segs:
        seg = (fp >> np.uint64(off)) & np.uint64((1 << width) - 1)
        for j in range(width):
            low = seg & np.uint64((1 << j) - 1)
            codes.append(((seg >> np.uint64(j + 1)) << np.uint64(j)) | low | np.uint64((off + j) << 57))
    return np.stack(codes, axis=1).ravel(), np.repeat(fp, BITS)


def _linked(a: np.ndarray, b: np.ndarray, variant: np.ndarray, segs, distance: int) -> np.ndarray:
    """Whether pairs are within ``distance`` and this variant is the first
    that both fingerprints share, so that no pair is found twice."""
    diff = a ^ b
    ok = np.bitwise_count(diff) <= distance
    for off, width in segs:
        part = (diff >> np.uint64(off)) & np.uint64((1 << width) - 1)
        here = (variant >= off) & (variant < off + width)
        bit = np.where(here, variant - off, 0).astype(np.uint64)
        ok &= ~here | ((part == 0) & (bit == 0)) | (part == np.left_shift(np.uint64(1), bit))
        ok &= (variant < off + width) | (np.bitwise_count(part) >= 2)
    return ok


def _forest(fp: np.ndarray, variant: int, segs, distance: int) -> tuple[list, list]:
    """Links that span what is linked inside one bucket, at most one for
    each member: found members are never compared with each other."""
    left = np.arange(len(fp))
    us, vs = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _linked(fp[left], fp[x], np.full(len(left), variant), segs, distance)
            if near.any():
                got = left[near]
                us.append(np.full(len(got), fp[x]))
                vs.append(fp[got])
                queue.extend(got)
                left = left[~near]
    return us, vs


def link_buckets(batches: Iterator[pa.RecordBatch], segs, distance: int, direct: int = 24) -> Iterator[pa.RecordBatch]:
    """Links (u, v) inside runs of equal (code, part) of a sorted stream.
    Runs up to ``direct`` rows are compared at once, longer ones by
    ``_forest``; a run is at most two blocks long (see ``links``)."""
    schema = pa_schema("u long, v long")
    held: list[np.ndarray] = []

    def work(code, part, fp):
        edge = np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(code)]]))
        run = np.repeat(np.arange(len(starts)), sizes)
        us, vs = [], []
        for d in range(1, int(min(direct, sizes.max()))):
            i = np.flatnonzero((run[d:] == run[:-d]) & (sizes[run[d:]] <= direct))
            hit = i[_linked(fp[i], fp[i + d], (code[i] >> np.uint64(57)).astype(np.int64), segs, distance)]
            us.append(fp[hit])
            vs.append(fp[hit + d])
        for k in np.flatnonzero(sizes > direct):
            a, b = _forest(fp[starts[k]:starts[k] + sizes[k]], int(code[starts[k]] >> np.uint64(57)), segs, distance)
            us += a
            vs += b
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    for b in batches:
        code, part, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        code, fp = code.view(np.uint64), fp.view(np.uint64)
        if held:
            code, part, fp = (np.concatenate([h, x]) for h, x in zip(held, (code, part, fp)))
        if not len(code):
            continue
        same = (code == code[-1]) & (part == part[-1])
        last = int(np.argmax(same))  # sorted: the open run is the tail
        if last:
            yield from work(code[:last], part[:last], fp[:last])
        held = [code[last:], part[last:], fp[last:]]
    if held:
        yield from work(*held)


def links(spark: SparkSession, prints: DataFrame, distance: int, block: int = 4096) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp) at
    ``distance`` or fewer differing bits, verified by the full distance.

    Buckets of more than about ``block`` fingerprints are cut by hash into
    blocks, and each pair of blocks is compared in a place of its own."""
    segs = segments(distance)

    def explode(cols):
        code, fp = _variants(cols["fp"].to_numpy(zero_copy_only=False).view(np.uint64), segs)
        return {"code": code.view(np.int64), "fp": fp.view(np.int64)}

    def widen(cols):
        seg = cols["seg"].to_numpy(zero_copy_only=False).view(np.uint64)
        which, value, n = seg >> np.uint64(57), seg & np.uint64((1 << 57) - 1), cols["n"].to_numpy()
        out = {"code": [], "n": []}
        for i, (off, w) in enumerate(segs):
            at = which == i
            code, _ = _variants(value[at] << np.uint64(off), [(off, w)]) if at.any() else (np.zeros(0, np.uint64), None)
            out["code"].append(code.view(np.int64))
            out["n"].append(np.repeat(n[at], w))
        return {k: np.concatenate(v) for k, v in out.items()}

    values = [F.shiftrightunsigned("fp", off).bitwiseAND((1 << w) - 1).bitwiseOR(i << 57) for i, (off, w) in enumerate(segs)]
    dense = (prints.select(F.explode(F.array(*values)).alias("seg")).groupBy("seg").agg(F.count("*").alias("n"))
             .where(F.col("n") > block // 2))
    dense = (arrow_rows(dense, widen, "code long,n long").groupBy("code")
             .agg(F.ceil((F.sum("n") + block // 2) / block).cast("int").alias("blocks")))
    dense = written(spark, dense, "dense")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
        lambda c: F.least(own, c) * F.col("blocks") + F.greatest(own, c)))
    spread = (arrow_rows(prints.select("fp"), explode, "code long,fp long").join(dense, "code", "left")
              .select("code", F.explode(parts).alias("part"), "fp"))
    return (spread.repartition("code", "part").sortWithinPartitions("code", "part")
            .mapInArrow(lambda it: link_buckets(it, segs, distance), "u long, v long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, text_key, fp, root, component_id for every row of ``docs``
    (doc_id, text; other columns are ignored). root names the group.

    component_id is the smallest doc_id among rows whose fingerprints are
    connected by links of at most ``distance`` differing bits. Null and
    empty texts have fingerprint zero and link like any other; null ids are
    passed over when the smallest is taken (null if a group has no other);
    repeated rows each get a row; an empty table gives no rows."""
    def run(cols):
        raw = cols["raw"].to_pylist()
        fp = np.array([fingerprint(x, shingle) for x in raw], np.uint64)
        return {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "fp": fp.view(np.int64)}

    prints = written(spark, arrow_rows(keyed(docs), run, "doc_id long,text_key long,fp long"), "prints")
    distinct = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(spark, links(spark, distinct, distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest
    doc_id; of equal ids the smallest text hash, of equal rows one. A group
    whose ids are all null keeps the row of smallest text hash."""
    found = written(spark, near_duplicates(spark, docs, shingle, distance), "groups")
    first = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    first = written(spark, first.select("first.doc_id", "first.text_key"), "first")
    gone = found.select("doc_id", "text_key").distinct().join(
        first, found["doc_id"].eqNullSafe(first["doc_id"]) & (found["text_key"] == first["text_key"]), "left_anti")
    gone = written(spark, gone, "gone")
    kept = without(docs, gone)
    again = found.groupBy("doc_id", "text_key").count().where("count > 1")
    again = written(spark, again.select("doc_id", "text_key"), "again")
    # rows that are there twice or more, as a rule none
    twice = without(docs, again, "left_semi")
    return without(kept, again).unionByName(without(twice, gone).dropDuplicates(["doc_id", "text"]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
