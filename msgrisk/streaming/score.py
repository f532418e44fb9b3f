"""Streaming extension: signals on arriving messages, and flagged counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.functions.signals import with_signals
from msgrisk.functions.urls import Suffixes


def signal_stream(messages: DataFrame, suffixes: Suffixes) -> DataFrame:
    """Stateless: works on a streaming frame as on a batch one."""
    return with_signals(messages, suffixes)


def flagged_counts(scored: DataFrame, rule: str, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Messages and flagged messages by event-time window; later than ``late`` is dropped by the watermark."""
    return scored.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.expr(rule)).alias("flagged")).select(F.col("w.start").alias("start"), "n", "flagged")
