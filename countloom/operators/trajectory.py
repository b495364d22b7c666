"""Recorded trajectories: tumbling windows, range evidence, detectors, trends, clocks.

Observations are rows (run, round, l1, unique_rate, entropy, changed_rows); round
0 is the initial state. Answers are rows (run, round, qid, answer).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    """Thresholds of a stationarity check."""

    window_size: int = 10
    query_mean_shift: float = 0.01
    query_p95_shift: float = 0.02
    l1_mean_shift: float = 0.01
    l1_spread_shift: float = 0.01
    unique_rate_shift: float = 0.05
    entropy_shift: float = 0.05
    least_active_rate: float = 0.5
    least_changed_fraction: float = 0.001
    stall_patience: int = 2
    query_max_shift: float | None = None

    def __post_init__(self) -> None:
        if self.window_size < 1 or self.stall_patience < 1:
            raise ValueError("window_size and stall_patience must be positive")
        for f in fields(self):
            v = getattr(self, f.name)
            if v is not None and v < 0:
                raise ValueError(f"{f.name} must not be negative")


def blocks(observations: DataFrame, size: int) -> DataFrame:
    """Observations with ``block``: tumbling windows of ``size`` rounds; round 0 and the incomplete tail are left out."""
    x = observations.where("round > 0").withColumn("block", F.floor((F.col("round") - 1) / size).cast("int"))
    return x.withColumn("__n", F.count("*").over(Window.partitionBy("run", "block"))).where(F.col("__n") == size).drop("__n")


def window_summary(observations: DataFrame, size: int, n_records: int) -> DataFrame:
    """(run, block, last_round, l1_mean, l1_spread, l1_p95, unique_rate, entropy, active_rate, changed_fraction)."""
    x = blocks(observations, size)
    return x.groupBy("run", "block").agg(
        F.max("round").alias("last_round"),
        F.avg("l1").alias("l1_mean"),
        (F.percentile("l1", 0.9) - F.percentile("l1", 0.1)).alias("l1_spread"),
        F.percentile("l1", 0.95).alias("l1_p95"),
        F.avg("unique_rate").alias("unique_rate"),
        F.avg("entropy").alias("entropy"),
        F.avg((F.col("changed_rows") > 0).cast("double")).alias("active_rate"),
        (F.avg("changed_rows") / F.lit(float(n_records))).alias("changed_fraction"),
    )


def query_means(answers: DataFrame, observations: DataFrame, size: int, n_records: int) -> DataFrame:
    """(run, block, qid, mean): each query's mean share of the records in each window."""
    kept = blocks(observations, size).select("run", "round", "block")
    return answers.join(kept, ["run", "round"]).groupBy("run", "block", "qid").agg((F.avg("answer") / F.lit(float(n_records))).alias("mean"))


def query_shifts(means: DataFrame) -> DataFrame:
    """(run, block, query_mean_shift, query_p95_shift, query_max_shift, worst_qid): over the pairs of three windows that end at block."""
    per_query = Window.partitionBy("run", "qid").orderBy("block")
    x = means.withColumn("m1", F.lag("mean", 1).over(per_query)).withColumn("m2", F.lag("mean", 2).over(per_query)).where(F.col("m2").isNotNull())
    pairs = F.array(F.abs(F.col("mean") - F.col("m1")), F.abs(F.col("mean") - F.col("m2")), F.abs(F.col("m1") - F.col("m2")))
    flat = x.select("run", "block", "qid", F.posexplode(pairs).alias("pair", "shift"))
    per_pair = flat.groupBy("run", "block", "pair").agg(F.avg("shift").alias("a"), F.percentile("shift", 0.95).alias("p"), F.max("shift").alias("m"))
    # The worst query; ties go to the least qid.
    worst = flat.groupBy("run", "block").agg(F.min(F.struct((-F.round("shift", 12)).alias("s"), F.col("qid")))["qid"].alias("worst_qid"))
    return per_pair.groupBy("run", "block").agg(F.max("a").alias("query_mean_shift"), F.max("p").alias("query_p95_shift"), F.max("m").alias("query_max_shift")).join(worst, ["run", "block"])


def _range3(name: str) -> Column:
    w = Window.partitionBy("run").orderBy("block")
    parts = [F.col(name), F.lag(name, 1).over(w), F.lag(name, 2).over(w)]
    return F.greatest(*parts) - F.least(*parts)


def range_evidence(observations: DataFrame, answers: DataFrame, size: int, n_records: int) -> DataFrame:
    """Threshold-free evidence at every block from the third on."""
    w = Window.partitionBy("run").orderBy("block")
    s = window_summary(observations, size, n_records)
    least = lambda n: F.least(F.col(n), F.lag(n, 1).over(w), F.lag(n, 2).over(w))
    s = s.select(
        "run", "block", "last_round", _range3("l1_mean").alias("l1_mean_shift"), _range3("l1_spread").alias("l1_spread_shift"), _range3("unique_rate").alias("unique_rate_shift"),
        _range3("entropy").alias("entropy_shift"), least("active_rate").alias("least_active_rate"), least("changed_fraction").alias("least_changed_fraction"),
    )
    return s.where("block >= 2").join(query_shifts(query_means(answers, observations, size, n_records)), ["run", "block"])


def checks(evidence: DataFrame, d: Detector) -> DataFrame:
    """Evidence with stable, moving, check_status and the two streaks."""
    stable = (
        (F.col("query_mean_shift") <= d.query_mean_shift) & (F.col("query_p95_shift") <= d.query_p95_shift) & (F.col("l1_mean_shift") <= d.l1_mean_shift)
        & (F.col("l1_spread_shift") <= d.l1_spread_shift) & (F.col("unique_rate_shift") <= d.unique_rate_shift) & (F.col("entropy_shift") <= d.entropy_shift)
    )
    if d.query_max_shift is not None:
        stable = stable & (F.col("query_max_shift") <= d.query_max_shift)
    moving = (F.col("least_active_rate") >= d.least_active_rate) & (F.col("least_changed_fraction") >= d.least_changed_fraction)
    x = evidence.withColumn("stable", stable).withColumn("moving", moving)
    x = x.withColumn("check_status", F.when(F.col("stable") & F.col("moving"), "stability_pass").when(F.col("stable"), "insufficient_movement").otherwise("running"))
    order = Window.partitionBy("run").orderBy("block")
    changed = F.coalesce((F.col("check_status") != F.lag("check_status").over(order)).cast("int"), F.lit(1))
    x = x.withColumn("__c", changed).withColumn("island", F.sum("__c").over(order))
    streak = F.row_number().over(Window.partitionBy("run", "island").orderBy("block"))
    return x.withColumn("streak", streak).drop("__c", "island")


def replay(evidence: DataFrame, d: Detector, termination: str = "in_progress") -> DataFrame:
    """(run, status, state_round): qualified after two passes in a row, stalled after ``stall_patience`` stable checks without movement."""
    c = checks(evidence, d)
    hit = F.when((F.col("check_status") == "stability_pass") & (F.col("streak") >= 2), "stationary_qualified").when((F.col("check_status") == "insufficient_movement") & (F.col("streak") >= d.stall_patience), "stalled")
    first = c.withColumn("hit", hit).groupBy("run").agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("block", "hit", "last_round"))).alias("f"), F.max_by("check_status", "block").alias("last"))
    rest = F.lit("horizon_reached") if termination in ("max_rounds", "candidate_budget") else F.lit("terminated_before_qualification") if termination != "in_progress" else F.when(F.col("last") == "insufficient_movement", "insufficient_movement").otherwise("running")
    return first.select("run", F.coalesce("f.hit", rest).alias("status"), F.col("f.last_round").alias("state_round"))


def violations(observations: DataFrame) -> DataFrame:
    """(run, gaps, bad_rates, bad_changes): counts of broken invariants between and within states."""
    w = Window.partitionBy("run").orderBy("round")
    x = observations.withColumn("__prev", F.lag("round").over(w))
    return x.groupBy("run").agg(
        F.count_if(F.coalesce(F.col("round") != F.col("__prev") + 1, F.col("round") != 0)).alias("gaps"),
        F.count_if(~F.col("unique_rate").between(0.0, 1.0) | ~F.col("entropy").between(0.0, 1.0)).alias("bad_rates"),
        F.count_if((F.col("changed_rows") < 0) | ((F.col("round") == 0) & (F.col("changed_rows") != 0))).alias("bad_changes"),
    )


def summary_quantiles(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, count, min, p10, p25, p50, p75, p90, p95, max), percentiles by linear interpolation."""
    q = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    return df.groupBy(*group).agg(F.count(value).alias("count"), F.min(value).alias("min"), *(F.percentile(value, p).alias(n) for n, p in q.items()), F.max(value).alias("max"))


def ends(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, initial, final, lowest, highest) of an ordered series."""
    return df.groupBy(group).agg(F.min_by(value, order).alias("initial"), F.max_by(value, order).alias("final"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def envelope(df: DataFrame, order: str, value: str) -> DataFrame:
    return df.groupBy(order).agg(F.min(value).alias("low"), F.percentile(value, 0.5).alias("mid"), F.max(value).alias("high"))


def completeness(df: DataFrame, left: str, right: str, expected: int) -> DataFrame:
    """(left, right, n): cells of the full grid whose row count is not ``expected``."""
    grid = df.select(left).distinct().crossJoin(df.select(right).distinct())
    n = df.groupBy(left, right).agg(F.count("*").alias("n"))
    return grid.join(n, [left, right], "left").select(left, right, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") != expected)


def round_band(round_: Column, budget: int) -> Column:
    """Quarter of the budget that a round falls in: 0 to 3."""
    return F.least(F.floor((round_ - 1) * 4 / budget), F.lit(3)).cast("int")


def calibrate(evidence: DataFrame, cell: str, high: list[str], low: list[str]) -> DataFrame:
    """One row: for shifts the largest P95 over cells, for movement the least P05."""
    per = evidence.groupBy(cell).agg(*(F.percentile(n, 0.95).alias(n) for n in high), *(F.percentile(n, 0.05).alias(n) for n in low))
    return per.agg(*(F.max(n).alias(n) for n in high), *(F.min(n).alias(n) for n in low))


def trend(df: DataFrame, every: int, value: str = "l1") -> DataFrame:
    """(run, checkpoint, mean, median, last, relative_change, descending): windows between checkpoints compared with the one before."""
    x = df.where("round > 0").withColumn("checkpoint", (F.floor((F.col("round") - 1) / every) + 1).cast("int"))
    per = x.groupBy("run", "checkpoint").agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.max_by(value, "round").alias("last"))
    before = F.lag("mean").over(Window.partitionBy("run").orderBy("checkpoint"))
    return per.withColumn("relative_change", F.when(before != 0, (F.col("mean") - before) / before)).withColumn("descending", F.col("relative_change") < 0)


def clock(df: DataFrame, ticks: str, value: str) -> DataFrame:
    """(run, clock, value): running sum of ticks; of equal clock readings the last stays. A negative tick is an error."""
    order = Window.partitionBy("run").orderBy("round")
    t = F.when(F.col(ticks) < 0, F.raise_error(F.lit("the clock runs backwards")).cast("double")).otherwise(F.col(ticks))
    x = df.withColumn("clock", F.sum(t).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.lead("clock").over(order)
    return x.withColumn("__next", after).where(F.col("__next").isNull() | (F.col("__next") != F.col("clock"))).select("run", "clock", F.col(value).alias("value"))


def interpolate(readings: DataFrame, grid: DataFrame) -> DataFrame:
    """(run, at, value): linear interpolation of (run, clock, value) at the grid's points (at); outside the readings there is none.

    Readings are split at their neighbours, so each grid point meets one interval.
    """
    w = Window.partitionBy("run").orderBy("clock")
    spans = readings.withColumn("c2", F.lead("clock").over(w)).withColumn("v2", F.lead("value").over(w))
    hit = grid.join(spans, (F.col("at") >= F.col("clock")) & ((F.col("at") < F.col("c2")) | (F.col("c2").isNull() & (F.col("at") == F.col("clock")))))
    share = (F.col("at") - F.col("clock")) / (F.col("c2") - F.col("clock"))
    return hit.select("run", "at", F.when(F.col("c2").isNull(), F.col("value")).otherwise(F.col("value") + share * (F.col("v2") - F.col("value"))).alias("value"))


def best_so_far(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("best", F.min(value).over(Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))


def cooling(df: DataFrame, power: float = 1.0, monotone: bool = False) -> DataFrame:
    """``df`` (run, round, l1) with ``ratio``: min(1, l1 / the first l1) to a power; monotone takes the least so far."""
    w = Window.partitionBy("run").orderBy("round")
    r = F.pow(F.least(F.lit(1.0), F.col("l1") / F.first("l1").over(w)), F.lit(power))
    x = df.withColumn("ratio", r)
    return x.withColumn("ratio", F.min("ratio").over(w.rowsBetween(Window.unboundedPreceding, 0))) if monotone else x


def linear(start: float, end: float, round_: Column, rounds: int) -> Column:
    return F.lit(start) + (end - start) * (round_ - 1) / F.lit(float(max(rounds - 1, 1)))


def geometric(start: float, end: float, round_: Column, rounds: int) -> Column:
    return F.lit(start) * F.pow(F.lit(end / start), (round_ - 1) / F.lit(float(max(rounds - 1, 1))))


def drift_by_state(df: DataFrame, state: str, rate: str, bins: int, least: int) -> DataFrame:
    """(bin, transitions, rate): mean rate by quantile bin of the state; bins of fewer than ``least`` transitions go."""
    edges = df.agg(F.percentile(state, F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("edges"))
    x = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(state))))
    return x.groupBy("bin").agg(F.count("*").alias("transitions"), F.avg(rate).alias("rate")).where(F.col("transitions") >= least)
