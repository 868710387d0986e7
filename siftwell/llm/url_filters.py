"""URL filters (operator 2): DataFrame functions only.

A URL is expanded into expressions: each suffix of its host by labels, with
each prefix of its path that is as long as some rule's path.  Their digests'
first bytes are joined with those of the rules, full digests confirm, and of
the rules that fit the longest wins.  Labels and lengths that no rule has are
not expanded, so a URL gives at most (label counts x path lengths) of the rules.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end; a null URL, or one without ``://``, has neither.

Results: one row for each input row, also for repeated ones and null ids; where
no rule fits, ``rule`` is null and the verdict is ``default``.  If one rule is
given twice with both actions, ``block`` wins.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Hexadecimal digits of a short hash prefix; rules up to which they are broadcast; parts of a hot expression beyond that.
SHORT, BROADCAST_RULES, SALTS = 8, 100_000, 16


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict); ``rules`` has action, host and path."""
    # Few numbers, however many rules: label counts and path lengths.
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")).first()
    url = F.col(f"`{url_col}`")
    pages = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("row", F.monotonically_increasing_id())
    if not shape.n:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    hosts = F.array_distinct(F.array_compact(F.array(*(F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(shape.labels)))))
    paths = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape.lengths))))
    broad = shape.n <= BROADCAST_RULES
    expanded = pages.withColumn("e_host", F.explode_outer(hosts)).withColumn("e_path", F.explode_outer(paths))
    expanded = expanded.withColumn("digest", digest(F.col("e_host"), F.col("e_path"))).withColumn("short", F.substring("digest", 1, SHORT)).drop("e_host", "e_path")
    known = (
        rules.groupBy("host", "path").agg(F.max("action").alias("action"))  # block after allow
        .select(digest(F.col("host"), F.col("path")).alias("full"), F.concat("host", "path").alias("rule"), "action")
        .withColumn("r_short", F.substring("full", 1, SHORT))
    )
    if broad:
        known = F.broadcast(known)
        on = F.col("short") == F.col("r_short")
    else:  # an expression like com/ may be in most URLs: it is dealt out over salts, and the rules repeated for each
        expanded = expanded.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        known = known.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        on = (F.col("short") == F.col("r_short")) & (F.col("salt") == F.col("r_salt"))
    fits = F.when(F.col("full") == F.col("digest"), F.struct(F.length("rule").alias("n"), F.length(F.substring_index("rule", "/", 1)).alias("h"), "rule", "action"))
    best = expanded.join(known, on, "left").groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, spark.createDataFrame(RULES, "action string, host string, path string"))


OP2_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT p.*, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE k = 1"""
