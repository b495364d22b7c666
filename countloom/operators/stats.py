"""Comparison statistics: paired differences, t intervals, slopes, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d if abs(1 + term * d) > tiny else tiny)
        c = 1 + term / c if abs(1 + term / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return 1.0 if df <= 0 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The p-quantile (p > 1/2) of Student's t, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def paired_rows(baseline: DataFrame, candidate: DataFrame, on: str, value: str) -> DataFrame:
    """(on, a, b): both sides of each pair; unmatched or repeated keys are an error when rows are computed."""
    a = baseline.groupBy(on).agg(F.first(value).alias("a"), F.count("*").alias("na"))
    b = candidate.groupBy(on).agg(F.first(value).alias("b"), F.count("*").alias("nb"))
    both = a.join(b, on, "full")
    bad = F.coalesce(F.col("na") != 1, F.lit(True)) | F.coalesce(F.col("nb") != 1, F.lit(True))
    return both.select(on, F.when(bad, F.raise_error(F.lit("pairs do not match one to one")).cast("double")).otherwise(F.col("a").cast("double")).alias("a"), F.col("b").cast("double").alias("b"))


def paired(pairs: DataFrame) -> DataFrame:
    """One row: n, mean and sample standard deviation of b - a, t, wins (b lower), ties, losses, relative change of the means."""
    d = F.col("b") - F.col("a")
    x = pairs.agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std_diff"),
        F.count_if(d < 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d > 0).alias("losses"), F.avg("a").alias("__a"), F.avg("b").alias("__b"),
    )
    t = F.when(F.col("std_diff") > 0, F.col("mean_diff") / (F.col("std_diff") / F.sqrt("n")))
    return x.withColumn("t", t).withColumn("relative_change", F.when(F.col("__a") != 0, (F.col("__b") - F.col("__a")) / F.col("__a"))).drop("__a", "__b")


def paired_test(pairs: DataFrame, level: float = 0.95) -> dict[str, float | None]:
    """The row of :func:`paired` with its p-value and interval; without spread p is 1 for no difference, else 0."""
    r = paired(pairs).first().asDict()
    n = r["n"]
    half = t_quantile((1 + level) / 2, n - 1) * r["std_diff"] / math.sqrt(n) if n > 1 else 0.0
    p = t_two_sided(r["t"], n - 1) if r["t"] is not None else 1.0 if r["mean_diff"] == 0 else 0.0
    return r | {"p": p, "low": r["mean_diff"] - half, "high": r["mean_diff"] + half}


def mean_interval(value: Column, quantile: float) -> tuple[Column, Column, Column]:
    """(mean, low, high): mean -+ quantile * s / sqrt(n)."""
    half = F.lit(quantile) * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))
    return F.avg(value), F.avg(value) - half, F.avg(value) + half


def independent(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """One row: means, t and degrees of freedom of two independent groups of equal variance (pooled)."""
    g = lambda k, f: f(F.when(F.col(group) == k, F.col(value)))
    x = df.agg(g(a, F.avg).alias("mean_a"), g(b, F.avg).alias("mean_b"), g(a, F.var_samp).alias("va"), g(b, F.var_samp).alias("vb"), g(a, F.count).alias("na"), g(b, F.count).alias("nb"))
    dof = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / dof
    return x.withColumn("dof", dof).withColumn("t", (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))).select("mean_a", "mean_b", "t", "dof")


def independent_test(df: DataFrame, group: str, value: str, a, b) -> dict[str, float | None]:
    """The row of :func:`independent` with its two-sided p-value."""
    r = independent(df, group, value, a, b).first().asDict()
    return r | {"p": None if r["t"] is None else t_two_sided(r["t"], r["dof"])}


def mean_intervals(df: DataFrame, group: str, value: str, level: float = 0.95) -> DataFrame:
    """(group, n, mean, low, high): t intervals; the quantile is found once for each number of observations."""
    x = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    sizes = [r.n for r in x.select("n").distinct().collect() if r.n > 1]
    table = df.sparkSession.createDataFrame([(n, t_quantile((1 + level) / 2, n - 1)) for n in sizes], "n long, quantile double")
    half = F.coalesce(F.col("quantile") * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return x.join(table, "n", "left").select(group, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def stage_interaction(df: DataFrame, seed: str, stage: str, value: str, early, late) -> DataFrame:
    """One row: late minus early by seed, how many rise, fall or stay, and the common direction."""
    wide = df.groupBy(seed).agg(F.avg(F.when(F.col(stage) == early, F.col(value))).alias("e"), F.avg(F.when(F.col(stage) == late, F.col(value))).alias("l")).where("e is not null and l is not null")
    d = F.col("l") - F.col("e")
    x = wide.agg(F.count("*").alias("n"), F.avg(d).alias("mean_change"), F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"))
    return x.withColumn("direction", F.when(F.col("up") == F.col("n"), "all_up").when(F.col("down") == F.col("n"), "all_down").otherwise("mixed"))


def gate(pairs: DataFrame, least_wins: int, least_gain: float) -> DataFrame:
    """One row: wins, median gain (a - b) / a, and whether both reach their bars."""
    gain = F.when(F.col("a") != 0, (F.col("a") - F.col("b")) / F.col("a")).otherwise(F.lit(0.0))
    x = pairs.agg(F.count_if(F.col("b") < F.col("a")).alias("wins"), F.percentile(gain, 0.5).alias("median_gain"))
    return x.withColumn("passed", (F.col("wins") >= least_wins) & (F.col("median_gain") >= least_gain))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * F.sum(F.abs(p - q))
