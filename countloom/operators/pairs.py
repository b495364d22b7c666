"""Distances, selection probabilities and donor draws between rows and candidates.

Pairs are rows (rid, cand, ...) where they are wanted themselves.  To draw donors,
``draw_donors`` makes no rows of pairs: blocks of states meet all candidate states in
a matrix, while these fit a broadcast; beyond that pairs are made by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions import clip, uniform
from countloom.schema import NUMERIC, Schema

#: A pool of at most so many rows is broadcast.
POOL_ROWS = 200_000
#: Cells of the matrix that a block of states has with the pool.
BLOCK_CELLS = 2_000_000
MODES = ("squared", "linear", "none", "multiplicative", "geometric")


def distance(schema: Schema, left: str, right: str, weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over attributes: numeric |a - b| / range, categorical a <> b. ``left``/``right`` prefix the columns."""
    parts, total = [], 0.0
    for a in schema.attributes:
        w = (weights or {}).get(a.name, 1.0)
        x, y = F.col(f"{left}{a.name}"), F.col(f"{right}{a.name}")
        d = F.abs(x - y) / F.lit(float(max(a.high - a.low, 1))) if a.kind == NUMERIC else (~x.eqNullSafe(y)).cast("double")
        parts.append(F.lit(w) * d)
        total += w
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return reduce(lambda a, b: a + b, parts) / F.lit(total)


def pair_distances(rows: DataFrame, pool: DataFrame, schema: Schema, key: str, exclude_self: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """(rid, cand, d) for every row and candidate of the pool; the pool is broadcast if it is small."""
    a = rows.select(F.col(key).alias("rid"), *(F.col(x).alias(f"l_{x}") for x in schema.names))
    b = pool.select(F.col(key).alias("cand"), *(F.col(x).alias(f"r_{x}") for x in schema.names))
    pairs = a.crossJoin(F.broadcast(b) if pool.limit(POOL_ROWS + 1).count() <= POOL_ROWS else b)
    if exclude_self:
        pairs = pairs.where("rid <> cand")
    return pairs.select("rid", "cand", distance(schema, "l_", "r_", weights).alias("d"))


def _softmax(pairs: DataFrame, logit: Column, mass: Column) -> DataFrame:
    row = Window.partitionBy("rid")
    x = pairs.withColumn("z", logit)
    x = x.withColumn("e", mass * F.exp(F.col("z") - F.max("z").over(row)))
    return x.withColumn("p", F.col("e") / F.sum("e").over(row)).drop("z", "e")


def selection(
    pairs: DataFrame, fitness: DataFrame, mode: str = "geometric", beta: float = 1.0, h: float = 1.0, power: float = 1.0, lam: float = 0.5, alpha: float = 1.0, delta: float = 0.01,
    winsorize: tuple[float, float] = (0.05, 0.95), exclude_self: bool = False, scale_invariant: bool = False, min_spread: float = 0.05,
    count: str | None = None,
) -> DataFrame:
    """(rid, cand, p): each row's distribution over its candidates. ``fitness``: cand, fitness (of the pool).

    With ``count``, a column of ``fitness``, rid and cand are states of so many rows each: sums, quantiles and
    moments are those of the rows, and ``exclude_self`` takes off one copy of a row's own state.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if exclude_self and count is None:
        pairs = pairs.where("rid <> cand")
    x, mass = pairs.join(F.broadcast(fitness), "cand"), F.lit(1.0)
    if count is not None:
        own = (F.col("rid") == F.col("cand")).cast("double") if exclude_self else F.lit(0.0)
        x, mass = x.withColumn("mass", F.col(count) - own).where("mass > 0"), F.col("mass")
    f, d = F.col("fitness"), F.col("d")
    row = Window.partitionBy("rid")
    if mode in ("squared", "linear", "none"):
        penalty = {"squared": d * d / (2 * h * h), "linear": d / h, "none": F.lit(0.0)}[mode]
        return _softmax(x, beta * f - penalty, mass).select("rid", "cand", "p")
    if mode == "multiplicative":
        top = fitness.agg(F.max(beta * f).alias("top"))
        w = x.crossJoin(F.broadcast(top)).withColumn("w", mass * F.exp(beta * f - F.col("top")) * F.pow(1 - d, F.lit(power)))
        return w.withColumn("p", F.col("w") / F.sum("w").over(row)).select("rid", "cand", "p")
    times = F.lit(1) if count is None else F.col(count)
    q = fitness.agg(F.percentile("fitness", winsorize[0], times).alias("lo"), F.percentile("fitness", winsorize[1], times).alias("hi"))
    x = x.crossJoin(F.broadcast(q))
    spread = F.col("hi") - F.col("lo")
    share = F.when(spread < 1e-8, 1.0).otherwise((F.least(F.greatest(f, F.col("lo")), F.col("hi")) - F.col("lo")) / (spread + 1e-8))
    log = lam * F.log(delta + (1 - delta) * share) + (1 - lam) * F.log(delta + (1 - delta) * (1 - clip(d, 0.0, 1.0)))
    x = x.withColumn("log", log)
    logit = alpha * F.col("log")
    if scale_invariant:
        if count is None:
            x = x.withColumn("mean", F.avg("log").over(row)).withColumn("sd", F.stddev_pop("log").over(row))
        else:
            x = x.withColumn("rows", F.sum(mass).over(row)).withColumn("mean", F.sum(mass * F.col("log")).over(row) / F.col("rows"))
            gap = F.col("log") - F.col("mean")
            x = x.withColumn("sd", F.sqrt(F.sum(mass * gap * gap).over(row) / F.col("rows")))
        logit = alpha * (F.col("log") - F.col("mean")) / F.greatest("sd", F.lit(min_spread))
    return _softmax(x, logit, mass).select("rid", "cand", "p")


def draw(probabilities: DataFrame, seed: int, round_: int = 0) -> DataFrame:
    """(rid, cand): one donor a row by its inverse distribution function, in order of cand.

    If rounding leaves the uniform above the last sum, the last candidate is taken.
    """
    order = Window.partitionBy("rid").orderBy("cand").rowsBetween(Window.unboundedPreceding, 0)
    c = probabilities.withColumn("cum", F.sum("p").over(order)).withColumn("u", uniform(seed, F.lit(round_), "donor", F.col("rid")))
    return c.groupBy("rid").agg(F.coalesce(F.min(F.when(F.col("u") < F.col("cum"), F.col("cand"))), F.max("cand")).alias("cand"))


def draw_by_state(probabilities: DataFrame, rows: DataFrame, seed: int, round_: int = 0) -> DataFrame:
    """(rid, cand): :func:`draw` for every row of ``rows`` (rid, state) from its state's distribution (rid, cand, p)."""
    order = Window.partitionBy("rid").orderBy("cand").rowsBetween(Window.unboundedPreceding, 0)
    c = probabilities.withColumn("cum", F.sum("p").over(order))
    c = c.groupBy(F.col("rid").alias("state")).agg(F.array_sort(F.collect_list(F.struct("cand", "cum"))).alias("c"))
    x = rows.join(c, "state").withColumn("u", uniform(seed, F.lit(round_), "donor", F.col("rid")))
    below = F.size(F.filter("c", lambda s: s["cum"] <= F.col("u")))
    return x.select("rid", F.element_at("c", F.least(below + 1, F.size("c")))["cand"].alias("cand"))


def draw_donors(
    rows: DataFrame, pool: DataFrame, schema: Schema, seed: int, round_: int, mode: str = "geometric", beta: float = 1.0, h: float = 1.0, power: float = 1.0, lam: float = 0.5, alpha: float = 1.0, delta: float = 0.01,
    winsorize: tuple[float, float] = (0.05, 0.95), exclude_self: bool = False, scale_invariant: bool = False, min_spread: float = 0.05,
) -> DataFrame:
    """(rid, cand): :func:`selection` between states and :func:`draw_by_state`, without rows of pairs.

    ``rows``: rid, __state and the schema's columns. ``pool``: __cand (a state), its columns, __fitness and __n (its rows).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if pool.limit(POOL_ROWS + 1).count() > POOL_ROWS:
        near = pair_distances(rows.select("__state", *schema.names).distinct(), pool.withColumnRenamed("__cand", "__state"), schema, "__state")
        p = selection(near, pool.select(F.col("__cand").alias("cand"), F.col("__fitness").alias("fitness"), F.col("__n").alias("n")), mode, beta, h, power, lam, alpha, delta, winsorize, exclude_self, scale_invariant, min_spread, "n")
        return draw_by_state(p, rows.select("rid", F.col("__state").alias("state")), seed, round_)
    held = pool.orderBy("__cand").toPandas()
    q = pool.agg(F.percentile("__fitness", winsorize[0], F.col("__n")).alias("lo"), F.percentile("__fitness", winsorize[1], F.col("__n")).alias("hi")).first()
    numeric = [(a.name, float(max(a.high - a.low, 1))) for a in schema.attributes if a.kind == NUMERIC]
    other = [a.name for a in schema.attributes if a.kind != NUMERIC]
    name = {n: {v: k for k, v in enumerate(held[n].unique())} for n in other}
    code = lambda frame: np.stack([frame[n].map(lambda v, n=n: name[n].get(v, -1)).to_numpy(np.int32) for n in other], 1) if other else np.zeros((len(frame), 0), np.int32)
    value = lambda frame: np.stack([frame[x].to_numpy(float) / width for x, width in numeric], 1) if numeric else np.zeros((len(frame), 0))
    shared = rows.sparkSession.sparkContext.broadcast((held["__cand"].to_numpy(), value(held), code(held), held["__fitness"].to_numpy(float), held["__n"].to_numpy(float), name))
    lo, hi = (float(q.lo), float(q.hi)) if q.lo is not None else (0.0, 0.0)
    count = len(schema.attributes)

    def draw_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cand, values, codes, fit, n, known = shared.value
        share = np.ones(len(fit)) if hi - lo < 1e-8 else (np.clip(fit, lo, hi) - lo) / (hi - lo + 1e-8)
        place = {c: k for k, c in enumerate(cand)}
        for batch in batches:
            at, states = pd.factorize(batch["__state"])
            first = np.unique(at, return_index=True)[1]
            one = batch.iloc[first]
            mine = value(one)
            kinds = np.stack([one[c].map(lambda v, c=c: known[c].get(v, -1)).to_numpy(np.int32) for c in other], 1) if other else np.zeros((len(one), 0), np.int32)
            chosen, u = np.zeros(len(batch), np.int64), batch["__u"].to_numpy()
            size = max(1, BLOCK_CELLS // max(1, len(cand)))
            for low in range(0, len(one), size):
                block = range(low, min(low + size, len(one)))
                d = np.zeros((len(block), len(cand)))
                for k in range(values.shape[1]):
                    d += np.abs(mine[block, k, None] - values[None, :, k])
                for k in range(codes.shape[1]):
                    d += kinds[block, k, None] != codes[None, :, k]
                d /= count
                mass = np.broadcast_to(n, d.shape).copy()
                if exclude_self:
                    for i, b in enumerate(block):
                        if states[b] in place:
                            mass[i, place[states[b]]] -= 1
                if mode == "multiplicative":
                    w = mass * np.exp(beta * (fit - fit.max())) * (1 - d) ** power
                else:
                    if mode == "geometric":
                        log = lam * np.log(delta + (1 - delta) * share) + (1 - lam) * np.log(delta + (1 - delta) * (1 - np.clip(d, 0, 1)))
                        if scale_invariant:
                            total = mass.sum(axis=1, keepdims=True)
                            mean = (mass * log).sum(axis=1, keepdims=True) / total
                            sd = np.sqrt((mass * (log - mean) ** 2).sum(axis=1, keepdims=True) / total)
                            log = (log - mean) / np.maximum(sd, min_spread)
                        z = alpha * log
                    else:
                        z = beta * fit - {"squared": d * d / (2 * h * h), "linear": d / h, "none": 0.0}[mode]
                        z = np.broadcast_to(z, d.shape)
                    w = mass * np.exp(z - np.where(mass > 0, z, -np.inf).max(axis=1, keepdims=True))
                cum = np.cumsum(np.where(mass > 0, w, 0), axis=1)
                cum /= cum[:, -1:]
                here = np.flatnonzero((at >= low) & (at < low + len(block)))
                by = here[np.argsort(at[here], kind="stable")]
                for i, part in enumerate(np.split(by, np.searchsorted(at[by], np.arange(low + 1, low + len(block))))):
                    last = int(np.flatnonzero(mass[i] > 0)[-1])
                    chosen[part] = np.minimum(np.searchsorted(cum[i], u[part], side="right"), last)
            yield pd.DataFrame({"rid": batch["rid"], "cand": cand[chosen]})

    asked = rows.withColumn("__u", uniform(seed, F.lit(round_), "donor", F.col("rid")))
    kind = f"rid {rows.schema['rid'].dataType.simpleString()}, cand {pool.schema['__cand'].dataType.simpleString()}"
    return asked.select("rid", "__state", *schema.names, "__u").mapInPandas(draw_batch, kind)


def concentration(probabilities: DataFrame) -> DataFrame:
    """One row: mean of the rows' largest probabilities and of the exponentials of their entropies."""
    p = F.col("p")
    per = probabilities.groupBy("rid").agg(F.max("p").alias("top"), F.exp(-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("effective"))
    return per.agg(F.avg("top").alias("mean_top"), F.avg("effective").alias("mean_effective"))


def self_rate() -> Column:
    """Share of rows that drew themselves, over (rid, cand)."""
    return F.avg((F.col("rid") == F.col("cand")).cast("double"))


def top_share(choices: DataFrame) -> DataFrame:
    """One row: the most drawn donor's share."""
    return choices.groupBy("cand").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("top_share"))


def gumbel_choice(weights: DataFrame, seed: int, group: str = "rid", index: str = "idx", logp: str = "logp") -> DataFrame:
    """(group, index): argmax of logp plus Gumbel noise, a draw from softmax(logp)."""
    u = uniform(seed, "gumbel", F.col(group), F.col(index))
    noise = -F.log(-F.log(F.greatest(u, F.lit(1e-300))))
    return weights.withColumn("g", F.col(logp) + noise).groupBy(group).agg(F.max_by(index, "g").alias(index))


def subsample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows by the rank of a seeded hash of their key: the same rows under any partitioning."""
    return df.withColumn("__u", uniform(seed, "subsample", F.col(key))).orderBy("__u", key).limit(k).drop("__u")


def blind_top(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """``k`` rows a group by the rank of the SHA-256 of their key, which no result can influence."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.sha2(F.col(key).cast("string").cast("binary"), 256), key))
    return df.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")
