"""Rule features of whole texts and a hashed n-gram log-likelihood ratio
between a trusted and a raw multinomial."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, pa_schema, prepare, small, table, written

ORDER, BITS = 4, 18  # bytes of an n-gram; 2^BITS buckets, whatever the corpus
ALPHA = 0.5  # added to every bucket
MIN_RATIO = -0.5  # nats for each n-gram; documents below are dropped in any case
LOW = 0.01  # and those below this quantile of trusted documents left out of the target counts,
PRIOR = 30.0  # drawn towards MIN_RATIO as if by so many more documents there
GRID = 10_000  # that quantile is taken of ratios rounded to 1 / GRID
MIX = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
IDS = 1 << 21  # word numbers of a text that fit three to a 64-bit key


def trusted_ids(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """Ids all of whose labels say good quality and not toxic, a written
    table hinted for broadcast if its counted size allows."""
    ids = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    return small(written(spark, ids.select("doc_id", F.lit(True).alias("trusted")), "trusted"))


def buckets(raw: bytes) -> np.ndarray:
    """The bucket of every byte n-gram of a text."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(a) < ORDER:
        return np.zeros(0, np.int64)
    key = np.zeros(len(a) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(8)) | a[i:len(a) - ORDER + 1 + i]
    return ((key * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def count_buckets(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) summed over all documents; columns of ``docs``:
    raw (bytes) and trusted."""
    out = "bucket long,raw long,target long"
    schema = pa_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for raw, trusted in zip(b.column(0), b.column(1).to_pylist()):
                at = buckets(raw.as_py())
                n = np.bincount(at, minlength=1 << BITS) if len(at) > 1 << (BITS - 3) else None
                for row in (0, 1) if trusted else (0,):
                    if n is None:
                        np.add.at(total[row], at, 1)
                    else:
                        total[row] += n
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], schema=schema)

    return (docs.select("raw", "trusted").mapInArrow(run, out)
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def collected(counts: DataFrame) -> np.ndarray | None:
    """Raw and target count of each bucket; None without trusted text. At
    most 2^BITS rows come to the driver."""
    got = counts.toArrow()
    n = np.zeros((2, 1 << BITS))
    at = got["bucket"].to_numpy()
    n[0, at], n[1, at] = got["raw"].to_numpy(), got["target"].to_numpy()
    return n if n[1].any() else None


def log_ratios(n: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    p = np.log(n + ALPHA) - np.log(n.sum(axis=1, keepdims=True) + ALPHA * (1 << BITS))
    return (p[1] - p[0]).astype(np.float32)


def left_out_ratio(n: np.ndarray, totals: np.ndarray, at: np.ndarray) -> float:
    """The ratio a trusted text with the buckets ``at`` would have if the
    target counts did not hold it, as they don't hold other texts."""
    found, times = np.unique(at, return_counts=True)
    target = np.log(n[1, found] - times + ALPHA) - np.log(totals[1] - len(at) + ALPHA * (1 << BITS))
    raw = np.log(n[0, found] + ALPHA) - np.log(totals[0] + ALPHA * (1 << BITS))
    return float(times @ (target - raw)) / len(at)


def lowest_ratio(trusted: DataFrame, n: np.ndarray, min_ratio: float = MIN_RATIO, low: float = LOW) -> float:
    """The quantile ``low`` of the left-out ratios of the trusted texts
    (column raw) that pass the base rules, exact on a grid of 1 / GRID; with m
    of them it has weight m / (m + PRIOR) beside ``min_ratio``, so no number
    of texts is a border. At least ``min_ratio``."""
    totals = n.sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [r for r in (x.as_py() for x in b.column(0)) if not base_failed(*features(r))]
            yield pa.RecordBatch.from_arrays([pa.array([left_out_ratio(n, totals, buckets(r)) for r in raws], pa.float64())], ["ratio"])

    grid = (trusted.select("raw").mapInArrow(run, "ratio double").groupBy(F.round(F.col("ratio") * GRID).alias("at"))
            .agg(F.count("*").alias("n")))
    got = grid.agg(F.sum("n").alias("n"), F.percentile("at", F.lit(low), F.col("n")).alias("q")).first()
    m = got.n or 0
    return max(min_ratio, (m * got.q / GRID + PRIOR * min_ratio) / (m + PRIOR)) if m else min_ratio


def repeated_words(words: list[bytes]) -> int:
    """Words in those 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) < IDS:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        key = pairs[:-1] * len(seen) + ids[2:]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    inside = np.zeros(len(words), bool)
    for d in range(3):
        inside[at + d] = True
    return int(inside.sum())


def features(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(seen[0x80:0xC0].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), points - int(seen[list(SPACES)].sum()), int(seen[list(SYMBOLS)].sum()),
            len(lines) - len(set(lines)), repeated_words(words))


def base_failed(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, log_ratio for every row of ``docs`` (doc_id, text).

    log_ratio is the mean over a text's n-grams (zero if it has none); kept
    needs the base rules passed and log_ratio >= ``lowest_ratio``.
    The target counts come from all trusted documents, the raw counts from
    all documents. Null and empty texts have no words and fail the base rules;
    without any trusted document log_ratio is null and the base rules alone
    decide; ids that are null or repeated are judged row by row; other
    columns are ignored; an empty table gives no rows."""
    prepare(spark)
    flagged = keyed(docs).join(trusted_ids(spark, labels), "doc_id", "left")
    n_buckets = collected(count_buckets(flagged))
    ratios = None if n_buckets is None else log_ratios(n_buckets)
    if n_buckets is not None:
        min_ratio = lowest_ratio(flagged.where("trusted"), n_buckets, min_ratio)
    out = ("doc_id long,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,"
           "base_failed boolean,kept boolean,log_ratio double")
    schema = pa_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(1):
                raw = raw.as_py()
                n, chars, symbols, dup, again = features(raw)
                failed = base_failed(n, chars, symbols, dup, again)
                at = buckets(raw)
                score = None if ratios is None else float(ratios[at].mean(dtype=np.float64)) if len(at) else 0.0
                rows.append((n, chars, symbols, dup, again, failed, not failed and (score is None or score >= min_ratio), score))
            if rows:
                cols = [b.column(0), *(pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(schema)[1:]))]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return keyed(docs).select(F.col("doc_id").cast("long"), "raw").mapInArrow(run, out)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
