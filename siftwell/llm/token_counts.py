"""Token counts through a cache of digests (operator 9).

A document's normalised content (null as empty; the tokenizer itself changes
nothing before it encodes) and the tokenizer's version each have a digest.
Stored counts are joined on both; only distinct contents that the cache lacks
are encoded, once each, and their counts are appended to it.

The cache is a Parquet folder by tokenizer version.  Appending is all that is
ever done to it, so a job that fails half-way leaves it right: rows that two
jobs append twice hold the same count and are merged when they are read.

Results: every input row gives a row; null text has 0 bytes and 0 tokens; rows
with the same text share one encoding; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, id_text, materialise, rows_batch, slices, strings_of, table, tidied, work_dir, write_parts
from .pieces import chunk_table, model_path

LIMIT = 4096
#: Copies from which on a digest's count goes to its rows; digests (32 bytes each) that are broadcast at most.
COPIES, BROADCAST_ROWS = 256, 1_000_000
STORED = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library's version."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + sentencepiece.__version__.encode()).hexdigest()


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts in the cache, one row a digest; empty if there is no cache yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document; the cache gets what it lacked."""
    spark, path = docs.sparkSession, path or model_path()
    folder = f"{cache.rstrip('/')}/tokenizer={tokenizer_version(path)}"
    text = F.coalesce("text", F.lit(""))
    keyed = id_text(docs).select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    # Digests alone tell what is missing; only texts of missing ones move.
    digests = materialise(keyed.groupBy("digest").agg(F.count("*").alias("copies")), "digests")
    missing = materialise(digests.join(stored_counts(spark, folder), "digest", "left_anti").select("digest"), "missing-digests")
    if n := missing.count():
        # Nothing is stored yet: all digests are missing, and no join need say so.
        wanted = keyed if n == digests.count() else keyed.join(F.broadcast(missing) if n <= BROADCAST_ROWS else missing, "digest", "left_semi")
        # A digest's copies meet before the shuffle, so that a text in a third of all rows is one row a task.
        texts = wanted.groupBy("digest").agg(F.first("text").alias("text"))

        @tidied(("chunks", path))
        def run(batches):
            tab = chunk_table(path)
            for b in slices(batches):
                yield rows_batch(arrow_schema(STORED), [b.column(0), tab.count(strings_of(b))])

        write_parts(texts, folder, run, STORED)
    # Counts of digests with many copies go to the rows; all else meets its count by digest.
    counts, hot = stored_counts(spark, folder), digests.where(F.col("copies") > COPIES).select("digest")
    known = hot.join(counts, "digest").select(F.col("digest").alias("hot_digest"), F.col("n_tokens").alias("hot_tokens"))
    if hot.count() > BROADCAST_ROWS:
        known = known.limit(0)  # more hot digests than may be sent: rows of each are few beside all rows
    rows = keyed.select("doc_id", "digest", "n_bytes").join(F.broadcast(known), F.col("digest") == F.col("hot_digest"), "left")
    key = F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.monotonically_increasing_id().cast("string"))))
    rows = rows.withColumn("key", key).join(counts.withColumnRenamed("digest", "key"), "key", "left")
    n_tokens = F.coalesce("hot_tokens", "n_tokens")
    return rows.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a new cache, so that the figures are those of encoding every distinct text."""
    return token_counts(table(spark, sf_dir, "documents"), work_dir(spark, "token-counts"))
