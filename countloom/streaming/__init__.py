"""Structured Streaming: workload counts kept as rows arrive, and windows of a trajectory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.operators.workload import Query, matches


def streaming_counts(rows: DataFrame, queries: Sequence[Query], time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window_start, qid, answer): matching rows in each event-time window; rows later than ``late`` are not waited for."""
    x = rows.withWatermark(time, late).withColumn("__t", F.col(time))
    hit = matches(x, queries, ["__t"])
    return hit.groupBy(F.window("__t", window).alias("w"), "qid").agg(F.count("*").alias("answer")).select(F.col("w.start").alias("window_start"), "qid", "answer")


def streaming_windows(observations: DataFrame, size: int) -> DataFrame:
    """(run, block, n, l1_mean) of tumbling windows of rounds over an unbounded trajectory."""
    x = observations.where("round > 0").withColumn("block", F.floor((F.col("round") - 1) / size).cast("int"))
    return x.groupBy("run", "block").agg(F.count("*").alias("n"), F.avg("l1").alias("l1_mean"))
