"""State transitions: copying, mutation, directions, masks and their distributions, cell conditionals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions import clip, sigmoid, uniform
from countloom.operators.scoring import fitness
from countloom.operators.workload import Query, evaluate, matches
from countloom.schema import CATEGORICAL, Schema

MAX_MASK_BITS = 20


def legal_value(schema: Schema, name: str, u: Column) -> Column:
    """A uniform legal value of an attribute from a uniform number."""
    a = schema[name]
    k = F.floor(u * F.lit(len(a.domain)))
    if a.kind == CATEGORICAL:
        return F.element_at(F.array(*(F.lit(v) for v in a.values)), k.cast("int") + 1)
    return (F.lit(a.low) + k).cast("int")


def evolve_step(current: DataFrame, donors: DataFrame, schema: Schema, key: str, rho: float, eta: float, mu: float, seed: int, round_: int = 0, scores: DataFrame | None = None, strength: float = 0.0, logit_clip: float = 30.0) -> DataFrame:
    """The next state: a row takes part with probability rho; it copies each differing block from its donor with
    probability eta, or eta tilted by ``scores`` (key, attr, score); then with probability mu one block mutates.

    ``donors``: key and the schema's columns, one row for each of ``current``. Draws are keyed by (seed, round,
    purpose, row, attribute), so partitioning changes nothing and strength 0 equals no scores.
    """
    r, rid = F.lit(round_), F.col(key)
    x = current.join(donors.select(key, *(F.col(n).alias(f"__d_{n}") for n in schema.names)), key)
    if scores is not None and strength != 0.0:
        wide = scores.groupBy(key).pivot("attr", schema.names).agg(F.first("score"))
        x = x.join(wide.select(key, *(F.col(n).alias(f"__s_{n}") for n in schema.names)), key, "left")
    part = uniform(seed, r, "participate", rid) < rho
    mutate = uniform(seed, r, "mutate", rid) < mu
    block = F.floor(uniform(seed, r, "block", rid) * F.lit(len(schema.names)))
    out = []
    for k, n in enumerate(schema.names):
        copy = F.lit(eta)
        if scores is not None and strength != 0.0:
            copy = tilted(eta, F.coalesce(F.col(f"__s_{n}"), F.lit(0.0)), strength, logit_clip)
        copied = F.when(part & ~F.col(n).eqNullSafe(F.col(f"__d_{n}")) & (uniform(seed, r, "copy", rid, F.lit(n)) < copy), F.col(f"__d_{n}")).otherwise(F.col(n))
        value = legal_value(schema, n, uniform(seed, r, "value", rid))
        out.append(F.when(part & mutate & (block == k), value).otherwise(copied).alias(n))
    return x.select(key, *out)


def copy_direction_scores(current: DataFrame, donors: DataFrame, schema: Schema, queries: Sequence[Query], answers: DataFrame, key: str, n_records: int) -> DataFrame:
    """(key, attr, score): how much the potential changes if one differing block is copied. Equal blocks give no row."""
    x = current.join(donors.select(key, *(F.col(n).alias(f"__d_{n}") for n in schema.names)), key)
    hybrids = []
    for n in schema.names:
        columns = [(F.col(f"__d_{m}") if m == n else F.col(m)).alias(m) for m in schema.names]
        hybrids.append(F.when(~F.col(n).eqNullSafe(F.col(f"__d_{n}")), F.struct(F.lit(n).alias("attr"), *columns)))
    flat = x.select(key, F.explode(F.filter(F.array(*hybrids), lambda h: h.isNotNull())).alias("h")).select(F.concat_ws("|", F.col(key).cast("string"), "h.attr").alias("hid"), key, "h.*")
    tried = fitness(flat, queries, answers, "hid", n_records, centred=False).withColumnRenamed("fitness", "after")
    base = fitness(current, queries, answers, key, n_records, centred=False).withColumnRenamed("fitness", "before")
    return flat.select("hid", key, "attr").join(tried, "hid").join(base, key).select(key, "attr", (F.col("after") - F.col("before")).alias("score"))


def rms(df: DataFrame, column: str, name: str = "scale") -> DataFrame:
    """One row: the root of the mean square, scaled by the largest value so that squares neither overflow nor vanish; 0 where all is 0 or nothing is there."""
    x = F.col(column).cast("double")
    top = df.agg(F.max(F.abs(x)).alias("__top"))
    scaled = df.crossJoin(F.broadcast(top)).agg(F.max("__top").alias("__top"), F.avg(F.when(F.col("__top") > 0, (x / F.col("__top")) * (x / F.col("__top")))).alias("__mean"))
    return scaled.select(F.coalesce(F.col("__top") * F.sqrt("__mean"), F.lit(0.0)).alias(name))


def tilted(eta: float, score: Column, strength: float, logit_clip: float = 30.0) -> Column:
    """sigmoid(clip(logit(eta) + strength * score)); a zero score gives eta itself, and 0 and 1 stay."""
    if not 0.0 <= eta <= 1.0:
        raise ValueError("eta must be a probability")
    if eta in (0.0, 1.0) or strength == 0.0:
        return F.lit(float(eta))
    base = float(np.log(eta) - np.log1p(-eta))
    return F.when(score == 0, F.lit(eta)).otherwise(sigmoid(clip(F.lit(base) + strength * score, -logit_clip, logit_clip)))


def bernoulli_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log(p) - (1 - p) * F.log(1 - p))


def bernoulli_kl(p: Column, q: Column) -> Column:
    """Divergence in nats, never below 0; infinite where p has mass that q lacks."""
    first = F.when(p <= 0, 0.0).when(q <= 0, F.lit(float("inf"))).otherwise(p * F.log(p / q))
    second = F.when(p >= 1, 0.0).when(q >= 1, F.lit(float("inf"))).otherwise((1 - p) * F.log((1 - p) / (1 - q)))
    return F.greatest(first + second, F.lit(0.0))


def drift_diagnostics(scores: DataFrame, eta: float, strength: float) -> DataFrame:
    """One row: drift at eta, expected drift under the tilt, the limit (all gains, no losses), and the share of the way."""
    s = F.col("score")
    t = scores.agg(F.sum(eta * s).alias("baseline"), F.sum(tilted(eta, s, strength) * s).alias("expected"), F.sum(F.greatest(s, F.lit(0.0))).alias("limit"))
    room = F.col("limit") - F.col("baseline")
    return t.withColumn("utilisation", F.when(room > 0, (F.col("expected") - F.col("baseline")) / room))


def masks(df: DataFrame, bits: Column, most: int = MAX_MASK_BITS) -> DataFrame:
    """``df`` with one row for each mask of ``bits`` bits, least significant first; more than ``most`` bits is an error."""
    checked = F.when(bits > most, F.raise_error(F.lit("too many blocks for full enumeration")).cast("long")).otherwise(F.pow(F.lit(2.0), bits).cast("long"))
    return df.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), checked - 1)))


def popcount(mask: Column) -> Column:
    return F.bit_count(mask)


def mask_log_prior(mask: Column, bits: Column, eta: float) -> Column:
    """log of the independent copy distribution at eta."""
    on = popcount(mask)
    return on * F.lit(float(np.log(eta))) + (bits - on) * F.lit(float(np.log1p(-eta)))


def mask_direction(mask: Column, directions: Sequence[Column]) -> Column:
    """Sum of the selected single directions."""
    return sum((F.when(F.shiftright(mask, k) % 2 == 1, d).otherwise(0.0) for k, d in enumerate(directions)), F.lit(0.0))


def gibbs_log_probabilities(df: DataFrame, group: str, prior: Column, energy: Column, strength: float) -> DataFrame:
    """``df`` with ``logp``: prior times exp(strength * energy), normalised within ``group``."""
    w = Window.partitionBy(group)
    x = df.withColumn("__z", prior + strength * energy)
    top = F.max("__z").over(w)
    return x.withColumn("logp", F.col("__z") - top - F.log(F.sum(F.exp(F.col("__z") - F.max("__z").over(w))).over(w))).drop("__z")


def mask_diagnostics(df: DataFrame, group: str, prior: str = "prior", logp: str = "logp", energy: str = "energy") -> DataFrame:
    """(group, kl, entropy, up_mass, down_mass, zero_mass, mean_energy) of the mask distributions."""
    p, e = F.exp(F.col(logp)), F.col(energy)
    return df.groupBy(group).agg(
        F.greatest(F.sum(p * (F.col(logp) - F.col(prior))), F.lit(0.0)).alias("kl"),
        F.greatest(-F.sum(p * F.col(logp)), F.lit(0.0)).alias("entropy"),
        F.sum(F.when(e > 1e-12, p).otherwise(0.0)).alias("up_mass"),
        F.sum(F.when(e < -1e-12, p).otherwise(0.0)).alias("down_mass"),
        F.sum(F.when(F.abs(e) <= 1e-12, p).otherwise(0.0)).alias("zero_mass"),
        F.sum(p * e).alias("mean_energy"),
    )


def factor_energies(truth: DataFrame, max_order: int = 3) -> DataFrame:
    """(rid, scope, mask, value): local tables of each row's sparse energy, centred at the empty mask.

    ``truth``: rid, qid, we (weight times residual), scope (sorted block numbers the query names among the differing
    ones), bits_now and bits_donor (bit k: the condition on block scope[k] holds before / after copying), rest (the
    query's other conditions hold). Zero tables are dropped; a scope beyond ``max_order`` is an error.
    """
    k = F.size("scope")
    size = F.when(k > max_order, F.raise_error(F.lit("a factor exceeds the largest order")).cast("int")).otherwise(F.pow(F.lit(2.0), k).cast("int"))
    full = (F.pow(F.lit(2.0), k) - 1).cast("long")
    x = truth.where("rest").withColumn("mask", F.explode(F.sequence(F.lit(0), size - 1))).withColumn("mask", F.col("mask").cast("long"))
    held = F.col("bits_now").bitwiseAND(full - F.col("mask")).bitwiseOR(F.col("bits_donor").bitwiseAND(F.col("mask")))
    x = x.withColumn("on", (held == full).cast("int"))
    at_empty = (F.col("bits_now") == full).cast("int")
    return x.groupBy("rid", "scope", "mask").agg(F.sum(F.col("we") * (F.col("on") - at_empty)).alias("value")).where("value <> 0")


def energy_of_masks(factors: DataFrame, tried: DataFrame) -> DataFrame:
    """(rid, mask, energy) for ``tried`` (rid, mask) over all blocks: sums of factor lookups."""
    f = factors.withColumnRenamed("mask", "local")
    projected = F.aggregate(
        F.transform("scope", lambda b, i: (F.floor(F.col("mask") / F.pow(F.lit(2.0), b)) % 2).cast("long") * F.pow(F.lit(2.0), i).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v
    )
    hits = tried.join(f, "rid").where(F.col("local") == projected).groupBy("rid", "mask").agg(F.sum("value").alias("energy"))
    return tried.join(hits, ["rid", "mask"], "left").select("rid", "mask", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def conditional_copy(difference: Column, eta: float, strength: float, logit_clip: float = 30.0) -> Column:
    """Probability that a block is copied given the others: the tilt by the energy difference."""
    return tilted(eta, difference, strength, logit_clip)


def heatbath(df: DataFrame, group: str, energy: str, beta: float, n_records: int | None = None) -> DataFrame:
    """``df`` with ``p``: exp(-beta * (E - min E)), over N if given, normalised within ``group``.

    Every candidate must keep a positive probability; one that underflows is an error when rows are computed.
    """
    if not 0 <= beta < float("inf"):
        raise ValueError("beta must be finite and not negative")
    w = Window.partitionBy(group)
    z = -beta * (F.col(energy) - F.min(energy).over(w)) / F.lit(float(n_records or 1))
    x = df.withColumn("__e", F.exp(z))
    p = F.col("__e") / F.sum("__e").over(w)
    sound = (F.col("__e") > 0) & (p > 0) & ~F.isnan(p)
    return x.withColumn("p", F.when(sound, p).otherwise(F.raise_error(F.lit("a conditional probability underflows")).cast("double"))).drop("__e")


def conditional_summary(df: DataFrame, group: str, energy: str, current: Column) -> DataFrame:
    """(group, entropy, expected_energy, uphill_mass) of conditionals with ``p``; uphill is above the energy of the row where ``current`` holds."""
    p, e = F.col("p"), F.col(energy)
    x = df.withColumn("__now", F.max(F.when(current, e)).over(Window.partitionBy(group)))
    return x.groupBy(group).agg((-F.sum(p * F.log(p))).alias("entropy"), F.sum(p * e).alias("expected_energy"), F.sum(F.when(e > F.col("__now"), p).otherwise(0.0)).alias("uphill_mass"))


def audit_state(df: DataFrame, schema: Schema, queries: Sequence[Query], answers: DataFrame, loss: float) -> DataFrame:
    """One row: illegal cells, carried answers (qid, target, q) that differ from the table's, and the carried loss's error."""
    illegal = df.agg(F.coalesce(F.sum(sum(((~schema[n].valid(F.col(n), df.schema[n].dataType)).cast("long") for n in schema.names), F.lit(0))), F.lit(0)).alias("illegal_cells"))
    both = evaluate(df, queries).join(answers, "qid", "full")
    gap = F.col("target") - F.col("answer")
    said = both.agg(F.count_if(~F.col("answer").eqNullSafe(F.col("q"))).alias("wrong_answers"), F.abs(0.5 * F.sum(gap * gap) - F.lit(float(loss))).alias("loss_error"))
    return illegal.crossJoin(said)


def cell_conditional(df: DataFrame, key: str, attr: str, schema: Schema, queries: Sequence[Query], answers: DataFrame, energy: str = "squared", n_records: int | None = None) -> DataFrame:
    """(key, value, delta_loss): the energy's change if one cell takes each legal value. ``answers``: qid, target, q.

    ``squared``: half the sum of squared gaps. ``l1``: the mean absolute gap over ``n_records``.
    """
    if energy not in ("squared", "l1") or (energy == "l1" and not (queries and n_records)):
        raise ValueError("energy is squared, or l1 with queries and n_records")
    domain = df.sparkSession.createDataFrame([(v,) for v in schema[attr].domain], f"value {schema[attr].spark_type.simpleString()}")
    tried = df.crossJoin(F.broadcast(domain)).withColumn(attr, F.col("value")).withColumn("__h", F.concat_ws("|", F.col(key).cast("string"), F.col("value").cast("string")))
    now = matches(df, queries, [key]).select(key, "qid").withColumn("was", F.lit(1))
    then = matches(tried, queries, ["__h", key, "value"]).withColumn("now", F.lit(1))
    touched = tried.select("__h", key, "value").join(now, key)
    both = touched.join(then.select("__h", "qid", "now"), ["__h", "qid"], "full").withColumn("delta", F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).where("delta <> 0")
    gain = both.join(answers, "qid")
    r = F.col("target") - F.col("q")
    after = r - F.col("delta")
    change = 0.5 * F.sum(after * after - r * r) if energy == "squared" else F.sum(F.abs(after) - F.abs(r)) / F.lit(float(len(queries) * (n_records or 1)))
    loss = gain.groupBy("__h").agg(change.alias("d"))
    return tried.select("__h", key, "value").join(loss, "__h", "left").select(key, "value", F.coalesce("d", F.lit(0.0)).alias("delta_loss"))


def gibbs_chain(factors: DataFrame, eta: float, strength: float, steps: int, seed: int) -> DataFrame:
    """(rid, mask): random-scan Gibbs over each row's blocks. Rows are independent; a row's steps are sequential.

    ``factors``: rid, k (blocks), scopes ARRAY<ARRAY<INT>>, tables ARRAY<ARRAY<DOUBLE>> (each of 2^order values).
    """
    base = float(np.log(eta) - np.log1p(-eta))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                rng = np.random.default_rng([seed, int(row.rid)])
                state = rng.random(row.k) < eta
                by_block = [[(list(s), np.asarray(t)) for s, t in zip(row.scopes, row.tables, strict=True) if b in s] for b in range(row.k)]
                for b in rng.integers(0, max(row.k, 1), steps if row.k else 0):
                    gap = 0.0
                    for scope, values in by_block[b]:
                        bit = 1 << scope.index(b)
                        at = sum(1 << i for i, s in enumerate(scope) if state[s] and s != b)
                        gap += values[at | bit] - values[at]
                    z = np.clip(base + strength * gap, -30, 30)
                    state[b] = rng.random() < 1 / (1 + np.exp(-z))
                out.append(sum(1 << i for i, s in enumerate(state) if s))
            yield pd.DataFrame({"rid": part.rid, "mask": np.array(out, np.int64)})

    return factors.mapInPandas(run, "rid long, mask long")


def exact_chain(k: int, energies: Sequence[float], eta: float, strength: float, steps: int) -> np.ndarray:
    """Distribution over the 2^k masks after ``steps`` of the chain above, from its exact transition matrix (k <= 12)."""
    if k > 12:
        raise ValueError("k is too large for the exact distribution")
    n, base = 1 << k, np.log(eta) - np.log1p(-eta)
    on = np.array([bin(m).count("1") for m in range(n)])
    p = eta**on * (1 - eta) ** (k - on)
    e = np.asarray(energies, float)
    for _ in range(steps if k else 0):
        new = np.zeros(n)
        for b in range(k):
            with_b, without = np.arange(n) | (1 << b), np.arange(n) & ~(1 << b)
            q = 1 / (1 + np.exp(-np.clip(base + strength * (e[with_b] - e[without]), -30, 30)))
            np.add.at(new, with_b, p * q / k)
            np.add.at(new, without, p * (1 - q) / k)
        p = new
    return p


def strength_for_kl(energies: Sequence[float], prior: Sequence[float], target: float, most: float = 1e6) -> float:
    """The strength at which the tilted mask distribution is ``target`` nats from its prior, by bracketing and bisection."""
    e, logq = np.asarray(energies, float), np.log(np.asarray(prior, float))

    def kl(s: float) -> float:
        z = logq + s * e
        z -= z.max()
        logp = z - np.log(np.exp(z).sum())
        return float((np.exp(logp) * (logp - logq)).sum())

    if target <= 0:
        return 0.0
    high = 1.0
    while kl(high) < target:
        high *= 2
        if high > most:
            raise ValueError("the divergence cannot be reached")
    low = 0.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if kl(mid) < target else (low, mid)
    return (low + high) / 2


def curvature_energy(deltas: DataFrame, residuals: DataFrame, gamma: float, n_records: int, key: str = "mask") -> DataFrame:
    """(key, energy): <e, D> - gamma / (2N) * |D|^2 of the query changes D. ``deltas``: key, qid, d; ``residuals``: qid, eps."""
    x = deltas.join(residuals, "qid")
    return x.groupBy(key).agg((F.sum(F.col("eps") * F.col("d")) - gamma / (2.0 * n_records) * F.sum(F.col("d") * F.col("d"))).alias("energy"))
