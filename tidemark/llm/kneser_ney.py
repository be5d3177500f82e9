"""Quality classifier: interpolated modified Kneser-Ney model of byte
n-grams, trained on trusted text; counts and requests meet in sharded joins."""

from __future__ import annotations

import bz2
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, new_dir, pa_schema, prepare, table, without, written
from tidemark.llm.quality_rules import trusted_ids
from tidemark.llm.token_files import file_system

ORDER = 5  # bytes; up to 7 fit a long
PIECE = 1 << 20  # n-grams that are sorted or looked up at a time
PACK_BYTES = 16 << 20  # text of the documents that ask for probabilities together
HELD_OUT = 10  # one trusted text in so many calibrates the thresholds
PRIOR_HELD_OUT = 20.0  # held-out texts with which the quantile over all languages counts beside a language's own
KEEP = 0.97  # reject above this quantile of the language's held-out scores
PRIOR_BYTES = 100.0  # bytes at the language's median that are added to a text's own
GRID = 1000  # quantiles are taken of bits rounded to 1 / GRID
PACKS = ("pack long,ids array<long>,keys array<long>,langs array<string>,roles array<long>,"
         "sizes array<long>,path string,grams array<long>,counts array<long>")


def grams(raw: bytes, order: int = ORDER) -> np.ndarray:
    """One n-gram for each byte, packed with that byte lowest; bytes before
    the text are zero."""
    a = np.frombuffer(b"\0" * (order - 1) + raw, np.uint8).astype(np.int64)
    n = len(a) - order + 1
    out = np.zeros(n, np.int64)
    for i in range(order):
        out = (out << 8) | a[i:n + i]
    return out


def pieces(raw: bytes, order: int = ORDER) -> Iterator[np.ndarray]:
    """The n-grams of a text, at most PIECE at a time."""
    padded = b"\0" * (order - 1) + raw
    for i in range(0, len(raw), PIECE):
        yield grams(padded[i:i + PIECE + order - 1], order)[order - 1:]


def _distinct(raws: Iterable[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts in order and their counts; besides them
    holds the n-grams of about two pieces."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        both = np.union1d(keys, new)
        total = np.zeros(len(both), np.int64)
        total[np.searchsorted(both, keys)] += counts
        total[np.searchsorted(both, new)] += n
        return both, total

    size = 0
    for part in (p for raw in raws for p in pieces(raw, order)):
        held.append(part)
        size += len(part)
        if size >= PIECE:
            (keys, counts), size = fold(), 0
    return fold() if held else (keys, counts)


def packs(docs: DataFrame, folder: str, order: int = ORDER) -> DataFrame:
    """Documents (doc_id, text_key, lang, role, raw) in blocks of about
    PACK_BYTES, each with its distinct n-grams and, for texts of role 1
    (training), their counts. A text longer than that is a block alone. The
    texts are a file in ``folder``, so that they go through no shuffle; an
    attempt writes under a name of its own and renames at the end."""
    schema = pa_schema(PACKS)
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, rows = TaskContext.get().partitionId() << 32, 0, []
        attempt = TaskContext.get().taskAttemptId()
        system, root = file_system(folder)

        def seal() -> pa.RecordBatch:
            mine, n = _distinct((r[4] for r in rows if r[3] == 1), order)
            every = np.union1d(mine, _distinct((r[4] for r in rows if r[3] != 1), order)[0])
            counts = np.zeros(len(every), np.int64)
            counts[np.searchsorted(every, mine)] = n
            ids, keys, langs, roles, raws = zip(*rows)
            with system.open_output_stream(f"{root}/{number}.try{attempt}", compression=None) as f:
                f.write(bz2.compress(b"".join(raws)))
            system.move(f"{root}/{number}.try{attempt}", f"{root}/{number}.bz2")
            cols = (number, ids, keys, langs, roles, [len(x) for x in raws], f"{folder}/{number}.bz2", every, counts)
            return pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            for *head, raw in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                raw = raw.as_py()
                if rows and size + len(raw) > PACK_BYTES:
                    yield seal()
                    number, size, rows = number + 1, 0, []
                rows.append((*head, raw))
                size += len(raw)
        if rows:
            yield seal()

    return docs.select(F.col("doc_id").cast("long"), "text_key", "lang", "role", "raw").mapInArrow(run, PACKS)


def _low(gram: Column, order: int) -> Column:
    return gram.bitwiseAND((1 << 8 * order) - 1)


def _high(gram: Column, order: int) -> Column:
    """The first byte of an n-gram of this order."""
    return F.shiftright(gram, 8 * (order - 1))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; 0.75 of the count's usual
    discount where a table is too small to estimate one."""
    n = [float(x) for x in counts.agg(*[F.count_if(F.col("cnt") == i) for i in (1, 2, 3, 4)]).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.75
    found = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.75 for i in range(3)]
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def probabilities(spark: SparkSession, counts: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p) for every row of ``wanted`` (gram, distinct), seen or not,
    from the trained ``counts`` (gram, cnt) of the highest order.

    Lower orders count the distinct bytes before an n-gram (occurrences for
    n-grams at the beginning of a text). Each order is three joins by
    n-gram or context: its counts, its contexts, the order below."""
    level, need = {order: counts}, {order: wanted}
    for n in range(order - 1, 0, -1):
        upper = level[n + 1].select(_low(F.col("gram"), n).alias("gram"), "cnt")
        level[n] = written(spark, upper.groupBy("gram").agg(
            F.sum("cnt").alias("all"), F.count("*").alias("kinds"))
            .select("gram", F.when(_high(F.col("gram"), n) == 0, F.col("all")).otherwise(F.col("kinds")).alias("cnt")), "counts")
        need[n] = need[n + 1].select(_low(F.col("gram"), n).alias("gram")).distinct()
    lower = None
    for n in range(1, order + 1):
        d = _discounts(level[n])
        cut = F.when(F.col("cnt") == 1, d[0]).when(F.col("cnt") == 2, d[1]).otherwise(d[2])
        contexts = level[n].groupBy(F.shiftright("gram", 8).alias("context")).agg(
            F.sum("cnt").alias("total"), F.sum(cut).alias("freed"))
        rows = (need[n].withColumn("context", F.shiftright("gram", 8))
                .join(level[n], "gram", "left").join(contexts, "context", "left"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", _low(F.col("gram"), n - 1)).join(
                lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise(
            (F.coalesce(F.col("cnt") - cut, F.lit(0.0)) + F.col("freed") * F.col("below")) / F.col("total"))
        lower = written(spark, rows.select("gram", p.alias("p")), "probabilities")
    return lower


def perplexities(spark: SparkSession, docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, text_key, lang, role, n_bytes, bits (mean bits a byte; null
    for empty texts) for every row of ``docs`` (doc_id, text, lang)."""
    prepare(spark)
    out = "doc_id long,text_key long,lang string,role long,n_bytes long,bits double"
    schema = pa_schema(out)
    role = F.when(F.col("trusted").isNull(), 0).when(F.pmod("text_key", F.lit(HELD_OUT)) == 0, 2).otherwise(1)
    flagged = keyed(docs, "lang").join(trusted_ids(spark, labels), "doc_id", "left").withColumn("role", role.cast("long"))
    blocks = written(spark, packs(flagged, new_dir(spark, "pack-texts"), order), "packs")
    pairs = blocks.select("pack", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("counts").alias("cnt"))))
    counts = written(spark, pairs.where("cnt > 0").groupBy("gram").agg(F.sum("cnt").alias("cnt")), "counts")
    asked = blocks.select("pack", F.explode("grams").alias("gram"))
    known = probabilities(spark, counts, written(spark, asked.select("gram").distinct(), "asked"), order)
    answers = asked.join(known, "gram").select(F.col("pack").alias("pack_id"), "gram", F.log2("p").cast("float").alias("bits"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = {f.name: [] for f in schema}
        keys, bits = right["gram"].to_numpy(), right["bits"].to_numpy().astype(np.float64)
        by = np.argsort(keys)
        keys, bits = keys[by], bits[by]
        for r in left.to_pylist():
            system, path = file_system(r["path"])
            with system.open_input_stream(path, compression=None) as f:
                raw, at = bz2.decompress(f.read()), 0
            for size in r["sizes"]:
                text = raw[at:at + size]
                at += size
                total = sum(float(bits[np.searchsorted(keys, part)].sum()) for part in pieces(text, order))
                cols["bits"].append(-total / size if size else None)
            for name, part in (("doc_id", "ids"), ("text_key", "keys"), ("lang", "langs"), ("role", "roles"), ("n_bytes", "sizes")):
                cols[name].extend(r[part])
        return pa.table([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)

    texts = blocks.select("pack", "ids", "keys", "langs", "roles", "sizes", "path")
    return texts.groupBy("pack").cogroup(answers.groupBy("pack_id")).applyInArrow(score, out)


def _with_quantile(scored: DataFrame, value: Column, at: float, name: str) -> DataFrame:
    """``scored`` and a column ``name``: the quantile ``at`` of the held-out
    trusted texts of a row's language, exact on a grid of 1 / GRID, drawn
    towards that of all languages: with n such texts it has the weight
    n / (n + PRIOR_HELD_OUT), and without any none."""
    grid = (scored.where("role = 2 and bits is not null").groupBy("lang", F.round(value * GRID).alias("at"))
            .agg(F.count("*").alias("n")))
    q = F.percentile("at", F.lit(at), F.col("n")) / GRID
    own = grid.groupBy(F.col("lang").alias("_lang")).agg(q.alias("_own"), F.sum("n").alias("_n"))
    joined = scored.join(own, scored["lang"].eqNullSafe(own["_lang"]), "left").crossJoin(F.broadcast(grid.agg(q.alias("_all"))))
    drawn = (F.col("_n") * F.col("_own") + PRIOR_HELD_OUT * F.col("_all")) / (F.col("_n") + PRIOR_HELD_OUT)
    return joined.withColumn(name, F.coalesce(drawn, "_all")).drop("_lang", "_own", "_n", "_all")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, order: int = ORDER, keep: float = KEEP) -> DataFrame:
    """doc_id, text_key, lang, n_bytes, bits, perplexity, score, threshold,
    kept.

    bits is the mean over a text's bytes; score is that mean with
    PRIOR_BYTES more bytes at the language's median, so that a few words
    alone don't decide. A document is rejected if its score exceeds its
    language's threshold, the quantile ``keep`` of the scores of the
    held-out trusted texts of that language. Null and empty texts have
    no perplexity and are rejected; median and threshold of a
    language (null is one) are drawn towards those over all languages, the
    more the fewer held-out trusted texts it has, and only without any in
    any language are all texts kept; rows
    with null or repeated ids are judged one by one; other columns are
    ignored; an empty table gives no rows."""
    scored = written(spark, perplexities(spark, docs, labels, order), "scored")
    score = (F.col("bits") * F.col("n_bytes") + PRIOR_BYTES * F.col("centre")) / (F.col("n_bytes") + PRIOR_BYTES)
    scored = written(spark, _with_quantile(scored, F.col("bits"), 0.5, "centre").withColumn("score", score).drop("centre"), "scored")
    passed = F.col("threshold").isNull() | (F.col("score") <= F.col("threshold"))
    return _with_quantile(scored, F.col("score"), keep, "threshold").select(
        "doc_id", "text_key", "lang", "n_bytes", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "score", "threshold",
        (F.col("bits").isNotNull() & passed).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects."""
    bad = classify(spark, docs, labels).where(~F.col("kept")).select("doc_id", "text_key")
    return without(docs, written(spark, bad, "rejected"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")
