"""Ranked lexical search: posting lists with range-maximum sparse tables,
document intervals taken best first and split at their maximum-impact
document."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pa_schema, prepare, table, written

TOP = 20
CHUNK_ITEMS, CHUNK_BYTES = 20_000, 8 << 20  # items that go to the workers at a time
POSTINGS = 400_000  # of a block of documents, whose sparse tables are held together
INTERVALS = 256  # taken from the queue together
#: ASCII characters that are no letter or digit end a term; only A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "doc_id long,n long,terms array<long>,counts array<long>"
FOUND = "item long,doc_id long,score long"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and counts of the
    vocabulary's terms in each document, from whole texts."""
    schema = pa_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            sizes, terms, counts = [], [], []
            for raw in b.column(1):
                words = terms_of(raw.as_py())
                ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                t, c = np.unique(ids[ids >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(t)
                counts.append(c)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, type=f.type) for x, f in zip((sizes, terms, counts), list(schema)[1:]))], schema=schema)

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return docs.select(F.col("doc_id").cast("long"), raw).mapInArrow(run, INDEX)


class Postings:
    """A block of documents in ascending order of their ids: for each term
    a list of (document, impact), and over all lists sparse tables that give
    the place of the largest impact of any range of a list."""

    def __init__(self, docs: list, terms: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        """terms, places (of documents in ``docs``) and impacts of the
        postings, sorted by term and place."""
        self.docs, self.terms, self.impacts = docs, terms, impacts
        self.keys = terms * len(docs) + places
        self.places = places
        level, width, n = np.arange(len(terms), dtype=np.int32), 1, len(terms)
        longest = int(np.bincount(terms).max()) if n else 0
        self.tables = [level]
        while 2 * width <= longest:  # ranges that cross a list's end are never asked for
            a, b = level[:n - 2 * width + 1], level[width:n - width + 1]
            level = np.where(impacts[b] > impacts[a], b, a)
            self.tables.append(np.concatenate([level, np.zeros(n - len(level), np.int32)]))
            width *= 2
        self.tables = np.stack(self.tables)

    def best(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact in each range [lo, hi) of postings of one list, and
        its place among the postings; zero for empty ranges."""
        size = hi - lo
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        some = size > 0
        left = self.tables[level, np.where(some, lo, 0)]
        right = self.tables[level, np.where(some, hi - (1 << level), 0)]
        at = np.where(self.impacts[right] > self.impacts[left], right, left)
        return np.where(some, self.impacts[at], 0), at

    def search(self, weights: dict[int, int], found: list, top: int = TOP) -> None:
        """Take documents into ``found``, a heap of the ``top`` best (score,
        -order of the id, id) of one item; weights: by term.

        An interval's bound is the sum over terms of weight times largest
        impact inside. The intervals of highest bound are taken together;
        each is scored at the document of its largest single part and split
        there, and the halves are dropped once neither their bound nor, at
        an equal bound, their ids can enter."""
        t = np.array(sorted(weights), np.int64)
        lo = np.searchsorted(self.keys, t * len(self.docs))
        hi = np.searchsorted(self.keys, (t + 1) * len(self.docs))
        t, lo, hi = t[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(t):
            return
        w = np.array([weights[x] for x in t.tolist()], np.int64)
        queue: list[tuple] = []
        count = 0

        def put(lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> None:
            """Intervals as rows of posting ranges; first: their first document."""
            nonlocal count
            impact, at = self.best(lo, hi)
            parts = impact * w
            bounds, column = parts.sum(axis=1), parts.argmax(axis=1)
            split = self.places[at[np.arange(len(at)), column]]
            for i in np.flatnonzero(bounds > 0).tolist():
                if self._may_enter(found, int(bounds[i]), int(first[i]), top):
                    count += 1
                    heapq.heappush(queue, (-int(bounds[i]), count, int(split[i]), int(first[i]), lo[i], hi[i]))

        put(lo[None], hi[None], np.zeros(1, np.int64))
        base = t * len(self.docs)
        while queue:
            taken = []
            while queue and len(taken) < INTERVALS:
                x = heapq.heappop(queue)
                if self._may_enter(found, -x[0], x[3], top):
                    taken.append(x)
            if not taken:
                return
            split, first = np.array([x[2] for x in taken]), np.array([x[3] for x in taken])
            lo, hi = np.stack([x[4] for x in taken]), np.stack([x[5] for x in taken])
            asked = base[None] + split[:, None]
            at = np.searchsorted(self.keys, asked)  # of the split document in every list, or the place for it
            here = self.keys[np.minimum(at, len(self.keys) - 1)] == asked
            scores = (np.where(here, self.impacts[np.minimum(at, len(self.keys) - 1)], 0) * w).sum(axis=1)
            for s, d in zip(scores.tolist(), split.tolist()):
                offer(found, s, self.docs[d], top)
            put(np.concatenate([lo, at + here]), np.concatenate([at, hi]), np.concatenate([first, split + 1]))

    def _may_enter(self, found: list, bound: int, first: int, top: int) -> bool:
        if len(found) < top:
            return True
        return bound > found[0][0] or bound == found[0][0] and _order(self.docs[min(first, len(self.docs) - 1)]) > found[0][1]


def _order(doc: int | None) -> float | int:
    """Higher for ids that come first; null ids come last."""
    return -(1 << 64) if doc is None else -doc


def offer(found: list, score: int, doc: int | None, top: int = TOP) -> None:
    """Put a document into a heap of the ``top`` best."""
    entry = (score, _order(doc), doc)
    if len(found) < top:
        heapq.heappush(found, entry)
    elif entry[:2] > found[0][:2]:
        heapq.heapreplace(found, entry)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc ids, n, sizes, terms, counts) of at most about POSTINGS postings."""
    held, size = [], 0
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            held.append(part)
            size += len(part.column(2).flatten())
            if size >= POSTINGS:
                yield _columns(held)
                held, size = [], 0
    if held:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> tuple:
    t = pa.Table.from_batches(parts)
    flat = [t.column(i).combine_chunks() for i in range(4)]
    sizes = pc.list_value_length(flat[2]).to_numpy().astype(np.int64)
    return (flat[0].to_pylist(), flat[1].to_numpy(), sizes, flat[2].flatten().to_numpy(), flat[3].flatten().to_numpy())


def rank(indexed: DataFrame, queries: list[dict[int, int]], n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): of each task the ``top`` best documents of each
    query (weights by term)."""
    schema = pa_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        for ids, n, sizes, terms, tf in _blocks(batches):
            by = sorted(range(len(ids)), key=lambda i: -_order(ids[i]))
            place = np.empty(len(ids), np.int64)
            place[by] = np.arange(len(ids))
            owner = np.repeat(np.arange(len(ids)), sizes)
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
            order = np.lexsort((place[owner], terms))
            block = Postings([ids[i] for i in by], terms[order], place[owner][order], impacts[order])
            for q, found in zip(queries, best):
                block.search(q, found, top)
        rows = [(i, doc, score) for i, found in enumerate(best) for score, _, doc in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return indexed.where("size(terms) > 0").mapInArrow(run, FOUND)


def _chunk(spark: SparkSession, docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    words = [Counter(terms_of((t or "").encode("utf-8", "surrogatepass"))) for _, t in items]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    indexed = written(spark, index(docs, vocabulary), "index")
    n_docs, n_terms = indexed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in indexed.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the chunk's vocabulary
        df[t] = n
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    queries = [{vocabulary[w]: k * int(weight[vocabulary[w]]) for w, k in c.items() if df[vocabulary[w]]} for c in words]
    ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item long,item_id long")
    return rank(indexed, queries, n_docs, max(1, n_terms), top).join(F.broadcast(ids), "item")


def search(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best rows of ``docs``
    (doc_id, text) for each row of ``benchmark`` (item_id, text).

    Each task keeps the ``top`` best of each item over its documents, block
    by block, and the best of all tasks are merged by a window. Equal scores
    are ranked by ascending doc_id, null ids last; rows with repeated ids are
    documents of their own. Null and empty texts have no term and are never
    found; items without terms, or whose terms no document holds, give no
    rows. Equal rows of the benchmark count once, and texts that share an
    item_id are ranked one by one under it. Other columns are ignored; empty
    tables give no rows. Items go to the workers in chunks of bounded size,
    each searched against all documents."""
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = written(spark, items, "items")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = max(1, -(-n // CHUNK_ITEMS), -(-size // CHUNK_BYTES))
    found = None
    for c in range(chunks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)
        part = _chunk(spark, docs, sorted((tuple(r) for r in mine.collect()), key=repr), top)  # a chunk, by the division above
        part = part.withColumn("chunk", F.lit(c))
        found = part if found is None else found.union(part)
    best = Window.partitionBy("chunk", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
i AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT k, doc_id, n, term, count(*) AS tf
  FROM (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY k, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM p, s WHERE term IN (SELECT term FROM i) GROUP BY term),
x AS (SELECT k, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS part
  FROM p JOIN w USING (term), s),
r AS (SELECT item_id, k, doc_id, sum(times * part)::BIGINT AS score FROM i JOIN x USING (term) GROUP BY item_id, k, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, k) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""
