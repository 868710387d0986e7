"""siftwell: content inspection and training-data preparation on Spark DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES, BATCH_CONF = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver started, and get rows by bytes, so that long texts come a few at a time.

    Functions sent to workers are pickled by reference.  On one machine the
    repository folder is put on the workers' path; on a cluster ship the
    package with ``--py-files`` or install it, and this changes nothing.
    """
    if int(spark.conf.get(BATCH_CONF).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark
