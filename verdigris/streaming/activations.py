"""Leaf activations of a stream: events joined to a static table of leaves and counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, leaves: DataFrame, key: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """window, id, n: activations of each leaf by time window; rows later than ``late`` are dropped with the state."""
    j = events.withWatermark("ts", late).join(leaves, key)
    return j.groupBy(F.window("ts", window), "id").agg(F.count("*").alias("n"))
