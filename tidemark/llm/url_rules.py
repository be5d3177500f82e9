"""URL filter: host-suffix and path-prefix expressions joined to rules on
short hash prefixes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("rule_host", "rule_path", "rule_verdict"))]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased;
    empty for null or where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of ``pages``.

    Every distinct (host, path) is expanded into those host suffixes and
    path prefixes whose number of labels and length some rule has, so the
    work is linear in a url's length; expressions are joined to rules on the
    first ``prefix_hex`` hex digits of their SHA-256 alone, the full digest
    then confirms, and the longest rule wins (then the longer host, then block
    over allow). Rows that no rule fits get ``default`` and a null rule.
    Null urls, urls without ``://`` and empty tables are judged like any
    other (empty host and path); repeated rows each get their own row; a
    rule table without rows leaves every page at ``default``. Other columns
    of ``pages`` are ignored.
    """
    pages = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rules = rules.select(
        "rule_host", "rule_path", "rule_verdict",
        F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256).alias("rule_digest"),
    ).withColumn("rule_prefix", F.substring("rule_digest", 1, prefix_hex))
    # lengths in use: whatever the number of rules, at most the longest host's labels and the longest path
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    labels = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect())
    parts = F.split("host", r"\.")
    suffixes = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    some = lambda found: F.filter(F.array(*found), lambda p: p.isNotNull()) if found else F.array().cast("array<string>")
    urls = pages.select("host", "path").distinct()
    expressions = (
        urls.select("host", "path", F.explode(some(suffixes)).alias("suffix"))
        .select("host", "path", "suffix", F.explode(some(prefixes)).alias("prefix"))
        .withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256))
        .withColumn("short", F.substring("digest", 1, prefix_hex))
    )
    # the rules of one short prefix are few: digests that happen to begin alike
    lists = rules.groupBy("rule_prefix").agg(F.collect_list(F.struct("rule_digest", "rule_host", "rule_path", "rule_verdict")).alias("rules"))
    hits = expressions.join(lists, F.col("short") == F.col("rule_prefix")).select(
        "host", "path", F.inline(F.filter("rules", lambda r: r["rule_digest"] == F.col("digest"))))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        F.col("rule_verdict").alias("verdict"),
        F.concat("rule_host", "rule_path").alias("rule"),
    )).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH p AS (
  SELECT page_id,
    translate(coalesce(CASE WHEN instr(url, '://') > 0
      THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') END, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(CASE WHEN instr(url, '://') > 0
      THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path,
    row_number() OVER () AS k
  FROM pages),
r(h, pre, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT k, arg_max(h || pre, length(h) + length(pre)) AS rule, arg_max(verdict, length(h) + length(pre)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (k)
"""
