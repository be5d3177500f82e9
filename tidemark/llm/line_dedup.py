"""Line dedup by site-relative frequency. The counting uses DataFrame
functions only; pages that are about the same are grouped beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, small, table, unused, written
from tidemark.llm.superminhash import near_groups

RATIO = 0.05  # lines on more than this share of a host's pages are dropped
PRIOR = 40  # pages without any line in common that every host has besides its own


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _code(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.concat(F.hex(F.xxhash64(line)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), line)))


def boilerplate(spark: SparkSession, docs: DataFrame, host: str = "source", ratio: float = RATIO,
                prior: float = PRIOR, page: str | None = None) -> DataFrame:
    """(host, codes): the codes of a host's lines that are on more than
    ``ratio`` of its pages, PRIOR pages added. Texts with the same ``page``
    (without such a column: equal texts) count as one page, so one that is
    copied often, with or without edits, is no boilerplate. At most (lines of
    a page on average) / ratio codes for a host."""
    own = F.xxhash64("text") if page is None else F.col(page)
    rows = docs.where(F.col("text").isNotNull()).select(F.col(host).alias("host"), own.alias("page"),
                      F.array_distinct(F.filter(_lines(), lambda x: F.trim(x) != "")).alias("lines"))
    totals = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = (rows.select("host", "page", F.explode("lines").alias("line"))
            .select("host", "page", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b")).distinct()
            .groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") > ratio * prior)
            .withColumnRenamed("host", "_host"))
    over = seen.join(totals, F.col("_host").eqNullSafe(F.col("host"))).where(F.col("n") > ratio * (F.col("pages") + prior))
    codes = F.collect_list(F.concat(F.hex("a"), F.lit("-"), F.hex("b")))
    return written(spark, over.groupBy("host").agg(codes.alias("codes")), "boilerplate")


def with_page(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that texts which are about the same share
    (``near_groups``: 0.8 of their two-word shingles); null texts have null."""
    groups = near_groups(spark, docs).withColumnRenamed("text_key", "_key").withColumnRenamed("page", "_page")
    joined = docs.join(small(groups, 300_000), F.xxhash64("text") == F.col("_key"), "left")
    own = F.when(F.col("text").isNotNull(), F.coalesce("_page", F.xxhash64("text"))).alias(name)
    return joined.select(*[docs[c] for c in docs.columns], own)


def dedup_lines(spark: SparkSession, docs: DataFrame, host: str = "source", ratio: float = RATIO,
                prior: float = PRIOR, page: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus
    ``n_dropped``; n_chars, if there, is counted anew. page: the column that
    names a row's page, or None for one that ``with_page`` computes.

    Lines are parts between ``\\n``; blank lines are never dropped. Every
    row stays, with an empty text if all its lines go. A null text stays
    null; null hosts are one host; repeated rows count as one page and are
    all rewritten, as are near copies; an empty table gives no rows; other columns pass, but for
    one named n_dropped, which is replaced."""
    prepare(spark)
    who = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    paged, own = (docs, page) if page else (docs.select(F.col(host).alias("host"), "text", who.alias("doc_id")), "page")
    bad = boilerplate(spark, paged if page else with_page(spark, paged, own), host if page else "host", ratio, prior, own)
    codes, here, text = (unused(docs, x) for x in ("codes", "here", "kept_text"))
    bad = bad.select(F.col("host").alias(unused(docs, "bad_host")), F.col("codes").alias(codes))
    joined = docs.join(bad, docs[host].eqNullSafe(bad[0]), "left")
    found = F.array_intersect(F.transform(_lines(), _code), F.col(codes))
    joined = joined.withColumn(here, F.when(F.col("text").isNotNull() & F.col(codes).isNotNull(), found))
    some = F.size(here) > 0
    rest = F.filter(_lines(), lambda x: ~F.array_contains(F.col(here), _code(x)))
    joined = joined.withColumn(text, F.when(some, F.array_join(rest, "\n")).otherwise(F.col("text")))
    made = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        chars = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(some, chars).otherwise(F.col("n_chars"))
    dropped = F.when(some, F.size(_lines()) - F.size(rest)).otherwise(0).cast("long")
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns if c != "n_dropped"], dropped.alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(spark, docs).select("doc_id", "source", "n_dropped", "text")


#: Over a table that names each row's page; the groups of pages have no SQL form.
SQL = """
WITH l AS (
  SELECT DISTINCT source, page, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT source, count(DISTINCT page) AS pages FROM documents GROUP BY source),
f AS (SELECT source, line, count(*) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY source, line),
bad AS (SELECT f.source, list(line) AS lines FROM f JOIN t ON f.source = t.source
  WHERE n > 0.05 * (pages + 40) GROUP BY f.source),
k AS (
  SELECT doc_id, d.source, string_split(text, chr(10)) AS parts, coalesce(lines, []) AS lines
  FROM documents d LEFT JOIN bad ON d.source = bad.source)
SELECT doc_id, source, len([x for x in parts if list_contains(lines, x)]) AS n_dropped,
  array_to_string([x for x in parts if NOT list_contains(lines, x)], chr(10)) AS text
FROM k
"""
