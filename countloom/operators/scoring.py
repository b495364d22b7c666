"""Residuals, losses, fitness, acceptance and step decomposition.

Answers are frames (qid, target, q) with optional sigma and w.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.operators.workload import Query, matches


def excess(target: Column, q: Column, sigma: Column | None = None, kappa: float = 1.0) -> Column:
    """|target - q| beyond the tolerance kappa * sigma."""
    gap = F.abs(target - q).cast("double")
    return gap if sigma is None else F.greatest(gap - kappa * sigma, F.lit(0.0))


def residual(target: Column, q: Column, n_records: int, sigma: Column | None = None, kappa: float = 1.0, geometry: str = "absolute", floor: float = 8.0) -> Column:
    """Signed excess as a share of the records; ``relative`` divides by the target first, but not by less than ``floor``."""
    if n_records <= 0:
        raise ValueError("n_records must be positive")
    if geometry not in ("absolute", "relative"):
        raise ValueError(f"unknown geometry {geometry!r}")
    size = excess(target, q, sigma, kappa)
    if geometry == "relative":
        size = size / F.greatest(target.cast("double"), F.lit(float(floor)))
    return F.signum((target - q).cast("double")) * size / F.lit(float(n_records))


def loss(target: Column, q: Column, sigma: Column | None = None, kappa: float = 1.0, weight: Column | None = None) -> Column:
    """Half the (weighted) sum of squared excesses."""
    e = excess(target, q, sigma, kappa)
    return 0.5 * F.sum((F.lit(1.0) if weight is None else weight) * e * e)


def normalized_l1(target: Column, q: Column, n_records: int) -> Column:
    return F.avg(F.abs(target - q)) / F.lit(float(n_records))


def error_metrics(answers: DataFrame, n_records: int) -> DataFrame:
    """One row: count, mean, median, p90, max of |target - q| / N and the squared loss; no queries is an error."""
    e = F.abs(F.col("target") - F.col("q")) / F.lit(float(n_records))
    return answers.agg(
        F.count("*").alias("query_count"), F.avg(e).alias("mean"), F.percentile(e, 0.5).alias("median"), F.percentile(e, 0.9).alias("p90"), F.max(e).alias("max"), loss(F.col("target"), F.col("q")).alias("squared_loss")
    ).withColumn("query_count", F.when(F.col("query_count") > 0, F.col("query_count")).otherwise(F.raise_error(F.lit("no queries")).cast("long")))


def fitness(df: DataFrame, queries: Sequence[Query], answers: DataFrame, key: str, n_records: int, centred: bool = True) -> DataFrame:
    """(key, fitness): sum of w * eps over the queries a row meets, less (if centred) their mean share.

    ``answers``: qid, q, eps and optionally w.
    """
    w = F.col("w") if "w" in answers.columns else F.lit(1.0)
    weighted = answers.select("qid", (w * F.col("eps")).alias("we"), "q")
    gained = matches(df, queries, [key]).join(weighted, "qid").groupBy(key).agg(F.sum("we").alias("gain"))
    out = df.select(key).join(gained, key, "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    if centred:
        centre = weighted.agg(F.coalesce(F.sum(F.col("we") * F.col("q") / F.lit(float(n_records))), F.lit(0.0)).alias("centre"))
        out = out.crossJoin(F.broadcast(centre)).withColumn("gain", F.col("gain") - F.col("centre"))
    return out.select(key, F.col("gain").alias("fitness"))


def accept(rule: str, dq: Column, dl1: Column, eps_q: float = 0.0, eps_l1: float = 0.0) -> Column:
    """A0: the loss falls by more than eps_q. A1: the L1 falls by more than eps_l1, or stays within it and A0 holds."""
    a0 = dq < -eps_q
    if rule == "A0":
        return a0
    if rule == "A1":
        return F.when(dl1 < -eps_l1, True).when(F.abs(dl1) <= eps_l1, a0).otherwise(False)
    raise ValueError(f"unknown rule {rule!r}")


def row_query_deltas(before: DataFrame, after: DataFrame, queries: Sequence[Query], key: str) -> DataFrame:
    """(key, qid, delta): +1 or -1 where a row begins or ceases to meet a query; zeros are left out."""
    was, now = matches(before, queries, [key]).withColumn("a", F.lit(-1)), matches(after, queries, [key]).withColumn("a", F.lit(1))
    both = was.unionByName(now).groupBy(key, "qid").agg(F.sum("a").cast("int").alias("delta"))
    return both.where("delta <> 0")


def decompose_step(deltas: DataFrame, residuals: DataFrame) -> DataFrame:
    """One row: linear, self, cross and net gain of a step. ``residuals``: qid, r (counts)."""
    per = deltas.groupBy("qid").agg(F.sum("delta").alias("d"), F.count("*").alias("ones"))
    joined = per.join(residuals, "qid")
    total = joined.agg(
        F.coalesce(F.sum(F.col("r") * F.col("d")), F.lit(0)).cast("double").alias("linear"),
        (0.5 * F.coalesce(F.sum("ones"), F.lit(0))).alias("self"),
        (0.5 * F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0))).alias("quad"),
    )
    return total.select("linear", "self", (F.col("quad") - F.col("self")).alias("cross"), (F.col("linear") - F.col("quad")).alias("net"))
