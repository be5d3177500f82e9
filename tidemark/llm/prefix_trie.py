"""Prefix trie of conversations: subtree totals by time-forward processing.

Every distinct sequence of first turns is a node. Nodes are cut into shards
that are whole subtrees; a shard's nodes are sorted by falling depth, and each
passes its totals to its parent through a priority queue that spills. What
shard roots pass on is then taken up by the nodes above all shards."""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, new_dir, pa_schema, prepare, small, table, written
from tidemark.llm.token_files import file_system

GROUP, STARTS = 100, 6  # conversations that share beginnings, and bound of the turns shared
SHARD_ROWS = 100_000  # turns below a node that make it the top of more than one shard
QUEUE = 50_000  # messages of a queue in memory; more are spilled as sorted runs
SPAN = 4096  # turns of a conversation that are numbered or added up together
PIECE = 20_000  # ids that are joined to one text before they are hashed in order
ROOT = ""  # key of the node of depth 0
NODE = "depth long,key string,parent string,conv_id long,n_convs long,chars long,n_children long,n_leaves long,saved_tokens long"
MESSAGE = struct.Struct("<q32sqq")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _share(conv: int) -> int:
    """Turns that a conversation takes from the first of its group."""
    return zlib.crc32(str(conv).encode()) % STARTS


def _numbered(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0 by turn, null first; equal turns by role and
    text), a, b (hashes of role and text), chars; a written table.

    Turns are sorted over all tasks; a conversation that lies in several
    ranges is numbered in each and moved on by what lies before."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text)
    order = ["turn", "role", "text"]
    ranged = turns.repartitionByRange("conv_id", *order).select(
        "conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"))
    hashes = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"), F.char_length("text").cast("long").alias("chars")]
    ranged = written(spark, ranged.select("part", "conv_id", *order, *hashes), "turns")
    within = Window.partitionBy("part", "conv_id").orderBy(*order)
    counts = ranged.groupBy("conv_id", "part").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.join(counts.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1"), "conv_id").select(
        "conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("moved"))
    moved = small(written(spark, moved, "moved"))
    return written(spark, ranged.withColumn("j", F.row_number().over(within) - 1).join(moved, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("j") + F.coalesce("moved", F.lit(0))).cast("long").alias("i"), "a", "b", "chars"), "numbered")


def rebuilt(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, turns), written tables: conv_id, size of every rebuilt
    conversation, and conv_id, depth (from 1), key, parent, chars, size of
    its turns. key stands for the first ``depth`` turns: two sums of hashes
    of role, text and depth, 128 bits in all."""
    numbered = _numbered(spark, conversations)
    sizes = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))

    def shares(cols):
        return {"conv_id": cols["conv_id"], "n": cols["n"], "h": [_share(c) for c in cols["conv_id"].to_pylist()]}

    sizes = written(spark, arrow_rows(sizes, shares, "conv_id long,n long,h long"), "sizes")
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = (sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "base", "left")
             .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
             .select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    convs = small(written(spark, convs, "convs"), 300_000)
    own = numbered.join(convs, "conv_id").where("i >= h").select(
        "conv_id", (F.col("i") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "chars", "size")
    starts = numbered.where(F.col("i") < STARTS).withColumnRenamed("conv_id", "base")
    shared = starts.join(convs, "base").where("i < taken").select("conv_id", (F.col("i") + 1).alias("depth"), "a", "b", "chars", "size")
    salted = [F.xxhash64("depth", "a", "b").cast("decimal(38,0)").alias("a"),
              F.xxhash64(F.lit(1), "depth", "a", "b").cast("decimal(38,0)").alias("b")]
    turns = own.union(shared).select("conv_id", "depth", *salted, "chars", "size", F.floor((F.col("depth") - 1) / SPAN).alias("span"))
    turns = written(spark, turns, "rebuilt")
    # running sums, a span of a conversation at a time; spans after the first go on from those before
    long = turns.where(F.col("size") > SPAN).groupBy("conv_id", "span").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    long = long.select("conv_id", "span", F.sum("sa").over(before).alias("sa"), F.sum("sb").over(before).alias("sb"))
    long = small(written(spark, long, "spans"))
    inside = Window.partitionBy("conv_id", "span").orderBy("depth")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("decimal(38,0)")
    summed = (turns.select("*", F.sum("a").over(run).alias("ra"), F.sum("b").over(run).alias("rb"))
              .join(long, ["conv_id", "span"], "left")
              .select("conv_id", "depth", "chars", "size", "a", "b",
                      *[(F.col(r) + F.coalesce(s, zero)).alias(r) for r, s in (("ra", "sa"), ("rb", "sb"))]))
    key = lambda depth, a, b: F.md5(F.concat_ws(":", depth.cast("string"), a.cast("string"), b.cast("string")))
    keys = summed.select("conv_id", "depth", key(F.col("depth"), F.col("ra"), F.col("rb")).alias("key"),
                         F.when(F.col("depth") > 1, key(F.col("depth") - 1, F.col("ra") - F.col("a"), F.col("rb") - F.col("b")))
                         .otherwise(ROOT).alias("parent"), "chars", "size")
    return convs.select("conv_id", "size"), written(spark, keys, "keys")


class Messages:
    """Priority queue of (depth, key, n_children, n_leaves, saved) by
    falling depth and key. Beyond ``room`` its later half is written as a
    sorted run to the shared folder and merged from there."""

    def __init__(self, folder: str, room: int = QUEUE):
        self.folder, self.room, self.heap, self.runs, self.spilled = folder, room, [], [], []

    def push(self, depth: int, key: str, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (-depth, key, leaves, saved))
        if len(self.heap) > self.room:
            self.heap.sort()
            half = len(self.heap) // 2
            late, self.heap = self.heap[half:], self.heap[:half]
            self._spill(late)

    def _spill(self, late: list) -> None:
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        system, root = file_system(self.folder)
        system.create_dir(root, recursive=True)
        path = f"{root}/{attempt}-{id(self)}-{len(self.spilled)}"
        with system.open_output_stream(path) as f:
            for depth, key, leaves, saved in late:
                f.write(MESSAGE.pack(depth, key.encode(), leaves, saved))
        self.spilled.append((system, path))
        self.runs.append(self._read(system, path))
        head = next(self.runs[-1])
        self.runs[-1] = (head, self.runs[-1])

    @staticmethod
    def _read(system, path: str) -> Iterator[tuple]:
        with system.open_input_stream(path) as f:
            while data := f.read(1024 * MESSAGE.size):
                for depth, key, leaves, saved in MESSAGE.iter_unpack(data):
                    yield depth, key.rstrip(b"\0").decode(), leaves, saved

    def take(self, depth: int, key: str) -> tuple[int, int, int]:
        """(messages, leaves, saved) added up over all messages to a node;
        nodes have to ask in the queue's order."""
        to, n, leaves, saved = (-depth, key), 0, 0, 0
        while self.heap and self.heap[0][:2] == to:
            _, _, x, y = heapq.heappop(self.heap)
            n, leaves, saved = n + 1, leaves + x, saved + y
        for i, (head, rest) in enumerate(self.runs):
            while head is not None and head[:2] == to:
                n, leaves, saved = n + 1, leaves + head[2], saved + head[3]
                head = next(rest, None)
            self.runs[i] = (head, rest)
        self.runs = [r for r in self.runs if r[0] is not None]
        return n, leaves, saved

    def close(self) -> None:
        for system, path in self.spilled:
            system.delete_file(path)


def pass_up(rows: Iterator[tuple], folder: str, room: int = QUEUE) -> Iterator[tuple]:
    """Time-forward processing of rows (shard, kind, depth, key, parent,
    conv_id, n_convs, chars, leaves, saved, is_top) sorted by shard, falling
    depth, key and kind: kind 0 is what ``n_convs`` roots of shards further
    below pass to the node of that key, kind 1 the node itself.

    Yields a node's row with its totals. A shard's top passes to no queue."""
    shard, queue = None, None
    kids = leaves = saved = 0
    try:
        for row in rows:
            at, kind, depth, key, parent, conv, n_convs, chars, more, amount, is_top = row
            if queue is None or at != shard:
                if queue:
                    queue.close()
                shard, queue = at, Messages(folder, room)
                kids = leaves = saved = 0
            if kind == 0:
                kids, leaves, saved = kids + n_convs, leaves + more, saved + amount
                continue
            n, x, y = queue.take(depth, key)
            kids, leaves, saved = kids + n, leaves + x, saved + y
            own = leaves if kids else 1
            total = saved + (n_convs - 1) * chars
            yield depth, key, parent, conv, n_convs, chars, kids, own, total
            if not is_top:
                queue.push(depth - 1, parent, own, total)
            kids = leaves = saved = 0
    finally:
        if queue:
            queue.close()


def _processed(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """``pass_up`` over the shards of ``rows``, sorted inside their tasks."""
    schema = pa_schema(NODE)
    columns = ["shard", "kind", "depth", "key", "parent", "conv_id", "n_convs", "chars", "leaves", "saved", "is_top"]
    room = QUEUE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(len(columns)))))
        for node in pass_up(rows, folder, room):
            held.append(node)
            if len(held) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return (rows.select(*columns).repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key", "kind")
            .mapInArrow(run, NODE))


def _ends(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end.

    Ids are sorted over all tasks and joined piece by piece; a node's pieces,
    in order, go through one digest, which can't be divided."""
    last = turns.where("depth = size").select("key", "conv_id").union(
        convs.where("size = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    ranged = last.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    schema = pa_schema("key string,first long,ids string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (k != key or len(ids) >= PIECE):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(c)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if ids:
            out.append((key, ids[0], ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    done = pa_schema("key string,ends_sha256 string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(2)):
                if k == key:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.as_py().encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=done)
                out = []
        if sha:
            out.append((key, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=done)

    pieces = ranged.mapInArrow(join, "key string,first long,ids string")
    return (pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string,ends_sha256 string"))


def trie(spark: SparkSession, conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 for each node of the trie of the rebuilt
    ``conversations`` (conv_id, turn, role, text).

    Rows with a null conv_id belong to no conversation and are left out;
    null turns come first, null roles and texts are empty, turns that tie or
    repeat are ordered by role and text and all count; very long
    conversations are numbered and added up in pieces; other columns are
    ignored; an empty table gives no node.

    A node with more than ``shard_rows`` turns below it is above the shards;
    the others belong to the shard of their topmost ancestor that is not. At
    most (turns / shard_rows) nodes of each depth are above the shards."""
    prepare(spark)
    convs, turns = rebuilt(spark, conversations)
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.coalesce(F.sum("size"), F.lit(0)).alias("turns")).first()
    zero = F.lit(0).cast("long")
    columns = ["depth", "key", "parent", "conv_id", "n_convs", "chars", "weight"]
    nodes = turns.groupBy("key", "depth", "parent", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("size") - F.col("depth") + 1).alias("weight"))
    root = convs.limit(1).select(zero.alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"),
                                 F.lit(total.low).cast("long").alias("conv_id"), F.lit(total.n).cast("long").alias("n_convs"),
                                 zero.alias("chars"), F.lit(total.turns + total.n).cast("long").alias("weight"))
    nodes = written(spark, nodes.select(columns).union(root.select(columns)), "nodes")
    folder, node = new_dir(spark, "spilled"), [F.lit(1).alias("kind"), zero.alias("leaves"), zero.alias("saved")]
    if total.turns + total.n <= shard_rows:  # the whole tree is one shard
        rows = nodes.select("*", F.lit(ROOT).alias("shard"), (F.col("depth") == 0).alias("is_top"), *node)
        totals = written(spark, _processed(spark, rows, folder), "totals")
    else:
        above = small(written(spark, nodes.where(F.col("weight") > shard_rows).select("key"), "above"), 200_000)
        # a conversation's path leaves the nodes above the shards once, for its shard
        cuts = turns.join(above, "key", "left_semi").groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
        cuts = turns.select("conv_id", "depth", "key").join(small(written(spark, cuts, "cuts"), 300_000), "conv_id", "left")
        tops = cuts.where(F.col("depth") == F.coalesce("cut", F.lit(1))).select("conv_id", F.col("key").alias("shard"), F.col("depth").alias("cut"))
        tops = small(written(spark, tops, "tops"), 200_000)
        inside = nodes.where("depth > 0").join(tops, "conv_id").where("depth >= cut")
        inside = inside.select(*columns, "shard", (F.col("depth") == F.col("cut")).alias("is_top"), *node)
        below = written(spark, _processed(spark, inside, folder), "totals")
        passed = below.join(above.withColumnRenamed("key", "parent"), "parent", "left_semi").groupBy("parent", "depth").agg(
            F.count("*").alias("n_convs"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        none = F.lit(None).cast("string").alias("parent")
        passed = passed.select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key"), none, zero.alias("conv_id"), "n_convs",
                               zero.alias("chars"), F.lit(0).alias("kind"), "leaves", "saved", F.lit(False).alias("is_top"))
        rest = nodes.join(above, "key", "left_semi").select(*columns, *node, (F.col("depth") == 0).alias("is_top")).drop("weight")
        rest = rest.unionByName(passed).withColumn("shard", F.lit(ROOT))
        totals = below.union(written(spark, _processed(spark, rest, folder), "totals"))
    parents = totals.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (totals.join(small(written(spark, parents, "parents"), 200_000), "parent", "left").join(_ends(convs, turns), "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark, table(spark, sf_dir, "conversations"))


SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, zero: xor(x >> 1, (x & 1) * 3988292384 + zero)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT c.conv_id, base, h, least(h, (SELECT count(*) FROM t WHERE t.conv_id = base)) AS taken FROM c),
r AS (
  SELECT n.conv_id, i + 1 AS d, role, text FROM n JOIN t ON t.conv_id = base WHERE i < taken
  UNION ALL SELECT n.conv_id, i - h + taken + 1, role, text FROM n JOIN t ON t.conv_id = n.conv_id WHERE i >= h),
k AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS key, NULL::VARCHAR AS parent, 0::BIGINT AS chars FROM n
  UNION ALL SELECT k.conv_id, r.d, sha256(k.key || md5(role) || md5(text)), k.key, length(text)
  FROM k JOIN r ON r.conv_id = k.conv_id AND r.d = k.d + 1),
z AS (SELECT conv_id, max(d) AS size FROM k GROUP BY conv_id),
node AS (
  SELECT key, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CASE WHEN d = size THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM k JOIN z USING (conv_id) GROUP BY key, d),
kids AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY parent),
below AS (
  SELECT k.key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * node.chars) AS saved_tokens
  FROM node JOIN k ON k.conv_id = node.conv_id AND k.d <= node.d LEFT JOIN kids ON kids.key = node.key GROUP BY k.key)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN node up ON up.key = node.parent
"""
