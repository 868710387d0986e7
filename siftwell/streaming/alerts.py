"""Alerts over event time and over live conversations; both work on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.policy import Policy
from siftwell.operators.scan import scan


def windowed_alerts(events: DataFrame, least: float, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events at or over ``least`` in tumbling windows by type; state older than the watermark goes."""
    if events.isStreaming and dict(events.dtypes)["ts"] == "timestamp_ntz":  # a watermark needs a zone, the session's
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    hot = events.where(F.col("value") >= least).withWatermark("ts", late)
    return hot.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def watch(turns: DataFrame, policy: Policy | None = None, late: str | None = None) -> DataFrame:
    """Each value once a conversation.

    Of a table all findings are compared.  Of a stream (with a time column ``ts``) those within ``late``, the watermark: it bounds the state, so a
    stream needs it.
    """
    if turns.isStreaming and late is None:
        raise ValueError("a stream needs late, by which its state is bounded")
    kept = [c for c in ("conv_id", "turn", "role", "ts") if c in turns.columns]
    source = turns.withWatermark("ts", late) if late is not None else turns
    found = scan(source.select(*kept, "text"), "text", policy).select(*kept, F.explode("findings").alias("f")).select(*kept, "f.rule_id", "f.severity", "f.preview", "f.fingerprint")
    return found.dropDuplicates(["conv_id", "fingerprint"]) if late is None else found.dropDuplicatesWithinWatermark(["conv_id", "fingerprint"])
