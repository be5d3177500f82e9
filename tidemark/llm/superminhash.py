"""MinHash near-duplicates: SuperMinHash signatures of word-shingle sets,
banding, verification on the full sets, components.

A signature decides only where sets meet: bands route sets to coarse groups,
and inside a group every link is confirmed by the sets themselves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, keyed, pa_schema, prepare, small, table, written
from tidemark.llm.components import components

SHINGLE, SIMILARITY = 2, 80  # words; per cent of the union
BANDS, ROWS = 32, 5  # a pair at 0.8 misses all bands with probability (1 - 0.8^5)^32 = 3e-6
SLOTS = BANDS * ROWS
LANES = 128  # slots whose lowest bit travels with a band
FAR = 30  # of LANES bits: pairs at 0.8 differ in 12.8 +- 3.4, so 30 is 5 deviations away
ESTIMATE = 0.62  # equal slots of pairs at 0.8: 0.8 +- 0.032, so 0.62 is 5 deviations away
DENSE = 4096  # sets in a bucket, beyond which they are one coarse group without a comparison
BLOCK_SETS, BLOCK_SHINGLES = 1500, 1 << 21  # sets and shingles that one task verifies together
ELEMENTS = 1 << 14  # shingles that go through the ranks together
PIECE = 1 << 16  # bytes of a text whose words are hashed together
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
PRINTS = "doc_id long,text_key long,n_shingles long,set_id long,bands array<long>,bits_a long,bits_b long"
IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
MULTIPLIER = 0xD1342543DE82EF95  # odd, so it has an inverse
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte.
BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER^i and its inverse for i < n, modulo 2^64."""
    steps = np.repeat(np.array([[MULTIPLIER], [INVERSE]], np.uint64), n, axis=1)
    steps[:, 0] = 1
    return tuple(np.cumprod(steps, axis=1))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run without ASCII white space, A-Z
    lower-cased) in order: a polynomial of random numbers for its bytes,
    taken from running sums over the text, a piece at a time."""
    text = np.frombuffer(raw.lower(), np.uint8)
    space = IS_SPACE[text]
    out, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):  # to the end of the word there
            rest = np.flatnonzero(space[end:end + PIECE])
            while not len(rest) and end < len(text):
                end = min(end + PIECE, len(text))
                rest = np.flatnonzero(space[end:end + PIECE])
            end += int(rest[0]) if len(rest) else 0
        gap = np.concatenate([[True], space[at:end], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        first, last = edge[::2], edge[1::2]
        if len(first):
            up, down = _powers(1 << max(PIECE.bit_length(), (end - at).bit_length()))
            sums = np.zeros(end - at + 1, np.uint64)
            np.cumsum(BYTES[text[at:end]] * up[:end - at], out=sums[1:])
            out.append(_mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words
    than ``size`` are one shingle, no word gives none."""
    each = word_hashes(raw)
    if not len(each):
        return each
    n = max(1, len(each) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(each))):
        h = _mix(h + each[i:i + n] + GOLDEN)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _lower(h: np.ndarray, owner: np.ndarray, seed: np.ndarray) -> None:
    """Take shingles (their set's row in ``h`` and hash) into signatures.

    Rank j of a shingle falls on the j-th slot of its own random permutation
    of the slots with a value in [j, j + 1), here j * 2^32 and 32 random bits;
    a slot keeps its least value. All shingles take a rank together, and
    those of a set stop once none of its slots exceeds the next rank."""
    slots = h.shape[1]
    flat, perm, j = h.reshape(-1), None, 0
    while len(seed):
        x = _mix(seed + np.uint64((j + 1) * int(GOLDEN) & (1 << 64) - 1))
        at = (j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32))).astype(np.int64)
        if j:  # Fisher-Yates: what was at j moves to where this rank was drawn
            rows = np.arange(len(seed))
            slot = perm[rows, at].astype(np.int64)
            perm[rows, at] = perm[rows, j]
        else:
            slot = at
        np.minimum.at(flat, owner * slots + slot, np.uint64(j << 32) | (x >> np.uint64(32)))
        j += 1
        if j == slots:
            return
        more = (h.max(axis=1) >= np.uint64(j << 32))[owner]
        if j == 1:
            seed, owner, at = seed[more], owner[more], at[more]
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(seed), 1))
            perm[np.arange(len(seed)), at] = 0
        elif not more.all():
            seed, owner, perm = seed[more], owner[more], perm[more]


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash (Ertl 2017) of non-empty sets of hashes, a row each: two
    sets agree in a slot with the probability of their Jaccard similarity,
    and slots are negatively correlated, so estimates vary less than with
    independent hashes."""
    h = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    first, held = 0, 0
    for i, s in enumerate(sets):
        held += len(s)
        if held >= ELEMENTS or i == len(sets) - 1:
            part = sets[first:i + 1]
            owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
            seeds = np.concatenate(part)
            for a in range(0, len(seeds), 4 * ELEMENTS):  # a long text, piece by piece
                _lower(h[first:i + 1], owner[a:a + 4 * ELEMENTS], seeds[a:a + 4 * ELEMENTS])
            first, held = i + 1, 0
    return h


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    cut = h[:, :bands * rows].reshape(len(h), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(h), bands))
    for i in range(rows):
        key = _mix(key + cut[:, :, i] + GOLDEN)
    return key


def _prints(bands: int, rows: int, lanes: int):
    """From texts to the columns of PRINTS; null beside empty sets."""
    def run(cols: dict) -> dict:
        sets = [shingles(x.as_py()) for x in cols["raw"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        out = {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "n_shingles": [len(s) for s in sets]}
        out |= {c: [None] * len(sets) for c in ("set_id", "bands", "bits_a", "bits_b")}
        if full:
            h = signatures([sets[i] for i in full], bands * rows)
            keys = band_keys(h, bands, rows).view(np.int64).tolist()
            bits = np.zeros((len(full), LANES), np.uint8)
            bits[:, :lanes] = _mix(h[:, :lanes]) & np.uint64(1)
            pairs = np.packbits(bits, axis=1, bitorder="little").view("<i8").tolist()
            for i, k, (a, b) in zip(full, keys, pairs):
                out["bands"][i], out["bits_a"][i], out["bits_b"][i] = k, a, b
                out["set_id"][i] = set_id(sets[i])
        return out

    return run


def set_id(s: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed long."""
    x = xxhash.xxh3_64_intdigest(s.tobytes())
    return x - (1 << 64) if x >> 63 else x


def coarse_links(batches: Iterator[pa.RecordBatch], far: int = FAR) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that connect, inside each run of equal keys of a stream
    (key, set_id, bits_a, bits_b) sorted by key, the sets whose bits differ
    in ``far`` places or fewer. A run has at most DENSE rows."""
    schema = pa_schema("u long,v long")
    held: list[np.ndarray] = []

    def work(key, who, a, b) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        us, vs = [], []
        for i, z in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            left = np.arange(i, z)
            while len(left) > 1:  # found members are compared with the rest only
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    near = np.bitwise_count(a[left] ^ a[x]).astype(np.int64) + np.bitwise_count(b[left] ^ b[x]) <= far
                    got, left = left[near], left[~near]
                    us.append(np.full(len(got), who[x]))
                    vs.append(who[got])
                    queue.extend(got)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        cols[2:] = [x.view(np.uint64) for x in cols[2:]]  # signed numbers would be counted by their absolute value
        if held:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # sorted: the open run is the tail
        if last:
            yield from work(*(x[:last] for x in cols))
        held = [x[last:] for x in cols]
    if held:
        yield from work(*held)


def _coarse_groups(spark: SparkSession, sets: DataFrame, far: int = FAR) -> DataFrame:
    """(node, root): groups that hold the partners of every set. Buckets of
    more than DENSE sets are one group by an aggregate, without comparing."""
    rows = sets.select(F.explode("bands").alias("key"), "set_id", "bits_a", "bits_b")
    dense = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("set_id").alias("first")).where(F.col("n") > DENSE)
    dense = small(written(spark, dense.select("key", "first"), "dense"))
    near = (rows.join(dense, "key", "left_anti").repartition("key").sortWithinPartitions("key")
            .mapInArrow(lambda batches: coarse_links(batches, far), "u long,v long"))
    whole = rows.select("key", "set_id").join(dense, "key").select(F.col("set_id").alias("u"), F.col("first").alias("v"))
    return components(spark, near.union(whole))


def _hubs(members: DataFrame) -> DataFrame:
    """(root, hub): of each group the set whose bits are nearest to the
    majority of the group's bits, as a much copied original's are."""
    ones = [F.sum(F.shiftrightunsigned(c, i).bitwiseAND(1)).alias(f"{c}{i}") for c in ("bits_a", "bits_b") for i in range(64)]
    sums = members.groupBy("root").agg(F.count("*").alias("n"), *ones)
    major = [sum((F.when(2 * F.col(f"{c}{i}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
                  for i in range(1, 64)), F.when(2 * F.col(f"{c}0") > F.col("n"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
             for c in ("bits_a", "bits_b")]
    major = sums.select("root", major[0].alias("major_a"), major[1].alias("major_b"))
    distance = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("major_a"))) + F.bit_count(F.col("bits_b").bitwiseXOR(F.col("major_b")))
    return members.join(major, "root").groupBy("root").agg(F.min(F.struct(distance.alias("d"), "set_id"))["set_id"].alias("hub"))


def similar(a: np.ndarray, b: np.ndarray, per_cent: int = SIMILARITY) -> bool:
    """Whether two sorted sets meet 100 |a & b| >= per_cent |a | b|."""
    if 100 * min(len(a), len(b)) < per_cent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= per_cent * (len(a) + len(b) - same)


def verified_links(ids: list[int], sets: list[np.ndarray], labels: list[int], asks: list[bool], hub: int | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets of a block as their similarities do, each
    confirmed on the sets. Sets of one label are connected already; pairs of
    which neither asks are passed over. The hub's pairs come first, then the
    others by falling estimate, so that few are left to confirm."""
    up = {x: x for x in labels}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []

    def confirm(i: int, j: int) -> None:
        a, b = top(labels[i]), top(labels[j])
        if a != b and similar(sets[i], sets[j]):
            up[a] = b
            out.append((ids[i], ids[j]))

    if hub is not None and hub in ids:
        h = ids.index(hub)
        for j in range(len(ids)):
            if j != h and (asks[h] or asks[j]):
                confirm(h, j)
    marks = (_mix(signatures(sets)) >> np.uint64(48)).astype(np.uint16)
    asking, place = np.array(asks), np.arange(len(ids))
    found = []
    for i in np.flatnonzero(asking):
        same = (marks == marks[i]).sum(axis=1)
        j = np.flatnonzero((same >= ESTIMATE * SLOTS) & (~asking | (place > i)))
        if len(j):
            found.append(np.stack([same[j], np.full(len(j), i), j]))
    if found:
        pairs = np.concatenate(found, axis=1)
        for _, i, j in pairs[:, np.argsort(-pairs[0], kind="stable")].T.tolist():
            confirm(i, j)
    return out


def _block(rows: pa.Table) -> pa.Table:
    """``verified_links`` over the rows (set_id, label, asks, hub, raw) of a group."""
    seen, ids, labels, asks, sets, hub = set(), [], [], [], [], None
    flags = (rows[c].to_pylist() for c in ("set_id", "label", "asks", "hub"))
    for who, label, ask, first, raw in zip(*flags, rows["raw"]):
        hub = first if first is not None else hub
        if who not in seen:  # a hub also stands in its own block, rows may repeat
            seen.add(who)
            ids.append(who)
            labels.append(label)
            asks.append(ask)
            sets.append(shingles(raw.as_py()))
    links = verified_links(ids, sets, labels, asks, hub) if len(ids) > 1 else []
    u, v = zip(*links) if links else ((), ())
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=pa_schema("u long,v long"))


def _verify(docs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(u, v) from members (doc_id, text_key, set_id, label, asks, hub and
    ``keys``) whose texts are read once more; a group is one value of ``keys``."""
    who = small(members.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_key", "_key"), 300_000)
    texts = keyed(docs)
    rows = texts.join(who, texts["doc_id"].eqNullSafe(who["_doc"]) & (texts["text_key"] == who["_key"]))
    return rows.select(*keys, "set_id", "label", "asks", "hub", "raw").groupBy(*keys).applyInArrow(_block, "u long,v long")


def links(spark: SparkSession, docs: DataFrame, sets: DataFrame, far: int = FAR) -> DataFrame:
    """(u, v), a written table: confirmed links that connect distinct sets
    (set_id, doc_id, text_key of one row that has it, n_shingles, bands,
    bits_a, bits_b).

    A coarse group that fits one block is verified there. A larger one is
    cut into blocks by hash, each with the group's hub; what the blocks and
    the hub leave outside the group's largest part is then compared with all
    blocks, so that every pair that could add a connection has met."""
    grouped = sets.join(_coarse_groups(spark, sets, far).withColumnRenamed("node", "set_id"), "set_id").drop("bands")
    sizes = grouped.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    grouped = written(spark, grouped.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int")), "grouped")
    large = grouped.where("blocks > 1")
    hubs = written(spark, _hubs(large), "hubs")
    row = ["doc_id", "text_key", "set_id"]
    first = grouped.select("root", "block", *row, F.lit(None).cast("long").alias("hub"))
    spread = (large.join(hubs, "root").where("set_id = hub")
              .select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *row, "hub"))
    first = first.unionByName(spread).withColumn("label", F.col("set_id")).withColumn("asks", F.lit(True))
    found = written(spark, _verify(docs, written(spark, first, "members"), ["root", "block"]), "confirmed")
    if large.isEmpty():
        return found
    # the parts that the blocks and the hub have made of each large group
    parts = components(spark, found).select(F.col("node").alias("set_id"), F.col("root").alias("part"))
    parted = large.join(parts, "set_id", "left").withColumn("label", F.coalesce("part", "set_id")).drop("part")
    parted = written(spark, parted, "parted")
    main = parted.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", "count").alias("main"))
    outside = written(spark, parted.join(main, "root").where("label <> main"), "outside")
    asked = outside.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("turns"))
    turn = F.pmod(F.xxhash64("set_id", F.lit(1)), "turns").cast("int")
    base = outside.join(asked, "root").select(
        "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), turn.alias("turn"), *row, "label",
        F.lit(True).alias("asks"))
    others = parted.join(asked, "root").select(
        "root", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), *row, "label", F.lit(False).alias("asks"))
    pairs = others.unionByName(base).groupBy("root", "block", "turn", "set_id").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "text_key", "label")], F.max("asks").alias("asks"))
    pairs = written(spark, pairs.withColumn("hub", F.lit(None).cast("long")), "members")
    return found.union(written(spark, _verify(docs, pairs, ["root", "block", "turn"]), "confirmed"))


def _sets(prints: DataFrame) -> DataFrame:
    """Distinct sets with one row of ``prints`` that has each."""
    return prints.where("set_id is not null").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_key")).alias("row"), F.min("doc_id").alias("low"), F.count("*").alias("copies"),
        *[F.first(c).alias(c) for c in ("n_shingles", "bands", "bits_a", "bits_b")]).select(
        "set_id", "row.doc_id", "row.text_key", "low", "copies", "n_shingles", "bands", "bits_a", "bits_b")


def near_groups(spark: SparkSession, docs: DataFrame, bands: int = 16, rows: int = 4, lanes: int = 64, far: int = 18) -> DataFrame:
    """(text_key, page), a written table: texts of ``docs`` (doc_id, text) by
    their hash, of those that link with others, and a number that a group has
    in common. Links are confirmed as in ``near_duplicates``; with the fewer
    bands pairs at 0.8 miss each other with probability 2e-4."""
    prepare(spark)
    prints = written(spark, arrow_rows(keyed(docs), _prints(bands, rows, lanes), PRINTS), "prints")
    sets = written(spark, _sets(prints), "sets")
    roots = components(spark, links(spark, docs, sets.drop("low", "copies"), far)).withColumnRenamed("node", "set_id")
    of = prints.select("text_key", "set_id").distinct().join(small(written(spark, roots, "roots"), 300_000), "set_id")
    return written(spark, of.select("text_key", F.col("root").alias("page")), "pages")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``
    (doc_id, text; other columns are ignored).

    Rows link if the Jaccard similarity of their sets of distinct two-word
    shingles is at least 0.8; component_id is the smallest doc_id reachable
    by links. Equal sets are one node. A text without words (null, empty) has
    an empty set, links with nothing and is its own component. Null ids are
    passed over when the smallest is taken (null if a component has no
    other); kept is doc_id = component_id, nulls being equal; repeated rows
    each get a row; an empty table gives no rows. Sets are compared by 64-bit
    hashes of their shingles."""
    prepare(spark)
    prints = written(spark, arrow_rows(keyed(docs), _prints(BANDS, ROWS, LANES), PRINTS), "prints")
    sets = written(spark, _sets(prints), "sets")
    roots = components(spark, links(spark, docs, sets.drop("low", "copies"))).withColumnRenamed("node", "set_id")
    rooted = sets.select("set_id", "low", "copies").join(roots, "set_id", "left").where("copies > 1 or root is not null")
    rooted = rooted.withColumn("root", F.coalesce("root", "set_id"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = small(written(spark, rooted.join(lowest, "root").select("set_id", "component_id"), "named"), 300_000)
    out = prints.select("doc_id", "set_id", "n_shingles").join(named, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
