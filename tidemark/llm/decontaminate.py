"""Benchmark decontamination: SimHash fingerprints of item-sized windows,
Hamming blocks as an index of the items, exact weighted-shingle check."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, pa_schema, prepare, table, without, written

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 8, 23  # 23 differing bits leave one of 8 blocks with at most RADIUS // BLOCKS = 2
CHUNK_ITEMS, CHUNK_BYTES = 20_000, 16 << 20  # benchmark items that go to the workers at a time
WINDOWS = 4096  # fingerprinted at a time
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` word numbers at ``at``."""
    h = np.zeros(len(at), np.uint64)
    for i in range(size):
        h = _mix(h + ids[at + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return h


def _shingles(ids: np.ndarray, size: int) -> np.ndarray:
    return _hash(ids, np.arange(max(0, len(ids) - size + 1)), size)


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Running counts of set bits, one row more than ``hashes``."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:], dtype=np.int32)
    return out


def _prints(sums: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of ``n`` shingles at ``starts``."""
    ones = 2 * (sums[starts + n] - sums[starts]) > n
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def _bag(words: list[str], size: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(size))))


class Index:
    """Items of a part of the benchmark, by their length in words."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [(item, w) for item, w in sorted({(i, tuple(words_of(t or ""))) for i, t in items}, key=repr) if w]
        self.vocab: dict[str, int] = {}
        self.items, self.bags, self.lengths = [i for i, _ in words], [], defaultdict(list)
        postings: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        prints = []
        for k, (_, w) in enumerate(words):
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w])
            size = min(SHINGLE, len(w))
            hashes = _shingles(ids, size)
            prints.append(_prints(_sums(hashes), np.zeros(1, int), len(hashes))[0])
            self.bags.append(_bag(list(w), size))
            self.lengths[len(w)].append(k)
            for h in hashes.tolist():
                postings[size][h].add(len(w))
        #: shingle size -> (sorted hashes, the item lengths that each occurs in)
        self.shingles = {s: (np.array(sorted(p), np.uint64), [sorted(p[h]) for h in sorted(p)]) for s, p in postings.items()}
        self.prints = np.array(prints, np.uint64)
        self.near = {n: self._blocks(self.prints[ks]) for n, ks in self.lengths.items()}

    @staticmethod
    def _blocks(prints: np.ndarray) -> list[np.ndarray]:
        """For each block, 256 rows: items whose byte there is near a value."""
        values = np.arange(256, dtype=np.uint8)[:, None]
        return [np.bitwise_count(values ^ prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, b]) <= RADIUS // BLOCKS
                for b in range(BLOCKS)]

    def _candidates(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) within RADIUS, for items of ``n`` words."""
        octets = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        hit = np.zeros((len(prints), len(self.lengths[n])), bool)
        for b, near in enumerate(self.near[n]):
            hit |= near[octets[:, b]]
        w, k = np.nonzero(hit)
        items = np.array(self.lengths[n])[k]
        far = np.bitwise_count(prints[w] ^ self.prints[items])
        return w[far <= RADIUS], items[far <= RADIUS], far[far <= RADIUS]

    def search(self, text: str) -> dict[int, tuple[float, int, int, int]]:
        """item -> (similarity, start, words, distance) of its best window.

        Windows without any shingle of an item of their length share nothing
        with one and get no fingerprint."""
        words = words_of(text)
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        best: dict[int, tuple] = {}
        starts: dict[int, set] = defaultdict(set)
        for size, (known, lengths) in self.shingles.items():
            if len(ids) < size:
                continue
            ok = np.convolve(ids > 0, np.ones(size, int), "valid") == size
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h = _hash(ids, at, size)
            place = np.searchsorted(known, h)
            place[place == len(known)] = 0
            for p, k in zip(at[known[place] == h].tolist(), place[known[place] == h].tolist()):
                for n in lengths[k]:
                    starts[n].update(range(max(0, min(p - n + size, len(ids) - n)), max(0, min(p, len(ids) - n)) + 1))
        for n, where in starts.items():
            size, span = min(SHINGLE, n), min(n, len(ids))
            if span < size:
                continue
            order = np.sort(np.fromiter(where, np.int64, len(where)))
            for part in np.split(order, np.flatnonzero(np.diff(order) > n) + 1):
                for i in range(0, len(part), WINDOWS):
                    at = part[i:i + WINDOWS]
                    sums = _sums(_shingles(ids[at[0]:at[-1] + span], size))
                    for w, k, far in zip(*self._candidates(n, _prints(sums, at - at[0], span - size + 1))):
                        s = int(at[w])
                        like = similarity(_bag(words[s:s + span], size), self.bags[k])
                        if like >= SIMILARITY:
                            item, found = self.items[k], (like, -s, span, -int(far))
                            best[item] = max(best.get(item, found), found)
        return {i: (a, -s, n, -d) for i, (a, s, n, d) in best.items()}


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` and benchmark item that it holds:
    doc_id, text_key, item_id, similarity, start, n_words, distance (of the
    best window; of equal ones the first).

    A document holds an item if a window of the item's length in words (the
    whole text if shorter) has a fingerprint within RADIUS bits of the
    item's and a weighted Jaccard similarity of five-word shingles of at
    least 0.8; items and texts of fewer words are one shingle. Null and
    empty texts and items hold nothing and match nothing; repeated items
    count once; rows with null or repeated ids are searched one by one;
    other columns are ignored; empty tables give no rows.

    The items go to the workers in chunks of bounded size, each searched
    against all documents."""
    prepare(spark)
    out = "doc_id long,text_key long,item_id long,similarity double,start long,n_words long,distance long"
    schema = pa_schema(out)
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = max(1, -(-n // CHUNK_ITEMS), -(-size // CHUNK_BYTES))

    def search(part: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(part)
            for b in batches:
                rows = []
                for doc, key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    rows += [(doc, key, item, *hit) for item, hit in sorted(
                        index.search(raw.as_py().decode("utf-8", "replace")).items(), key=repr)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return keyed(docs).select(F.col("doc_id").cast("long"), "text_key", "raw").mapInArrow(run, out)

    found = None
    for c in range(chunks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c)
        part = search([tuple(r) for r in mine.collect()])  # at most a chunk, by the division above
        found = part if found is None else found.union(part)
    return found


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    bad = leaks(spark, docs, benchmark).select("doc_id", "text_key").distinct()
    return without(docs, written(spark, bad, "leaks"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
