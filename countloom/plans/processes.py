"""Queries on pairs and selection, transitions, initial tables, trajectories and statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countloom import engine
from countloom.functions import uniform, uniform_sql
from countloom.operators import compare, init, kernels, pairs, scoring, stats, trajectory, workload
from countloom.plans.fixtures import CU, CUSTOMER_SCHEMA, EV, PAIRS, SEGMENTS, STATES, customer_states, customers, events, lines
from countloom.plans.tables import r6
from countloom.schema import CATEGORICAL, Attribute, Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 7


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# Pairs and selection: all distinct states of the customers against each other.


def _pairs(spark, sf_dir):
    s = customer_states(spark, sf_dir)
    return s, pairs.pair_distances(s, s, CUSTOMER_SCHEMA, "rid"), s.select(F.col("rid").alias("cand"), "fitness")


@query("d01_pair_distance", f"WITH {PAIRS} SELECT rid, round(sum(d), 5) AS total, round(max(d), 6) AS furthest FROM pr GROUP BY 1")
def d01(spark, sf_dir):
    _, p, _ = _pairs(spark, sf_dir)
    return p.groupBy("rid").agg(F.round(F.sum("d"), 5).alias("total"), r6(F.max("d"), "furthest"))


_LOGITS = {
    "squared": "0.7 * fitness - d * d / (2 * 0.3 * 0.3)",
    "linear": "0.7 * fitness - d / 0.3",
    "none": "0.7 * fitness",
}
_SM = "e AS (SELECT rid, cand, exp(z - max(z) OVER (PARTITION BY rid)) AS e FROM z), p AS (SELECT rid, cand, e / sum(e) OVER (PARTITION BY rid) AS p FROM e)"
_TOP = "SELECT rid, round(max(p), 6) AS top, round(exp(-sum(p * ln(p))), 4) AS effective FROM p GROUP BY 1"


def _tops(p: DataFrame) -> DataFrame:
    x = F.col("p")
    return p.groupBy("rid").agg(r6(F.max("p"), "top"), F.round(F.exp(-F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0))), 4).alias("effective"))


for _k, _mode in enumerate(_LOGITS):

    @query(f"p{19 + _k}_selection_{_mode}", f"WITH {PAIRS}, z AS (SELECT rid, cand, {_LOGITS[_mode]} AS z FROM pr), {_SM} {_TOP}")
    def selection(spark, sf_dir, mode=_mode):
        _, p, f = _pairs(spark, sf_dir)
        return _tops(pairs.selection(p, f, mode, beta=0.7, h=0.3))


@query("p22_selection_multiplicative", f"WITH {PAIRS}, w AS (SELECT rid, cand, exp(0.7 * fitness - max(0.7 * fitness) OVER ()) * pow(1 - d, 2.0) AS w FROM pr), p AS (SELECT rid, cand, w / sum(w) OVER (PARTITION BY rid) AS p FROM w) SELECT rid, round(max(p), 6) AS top, round(sum(p * p), 6) AS squares FROM p GROUP BY 1")
def p22(spark, sf_dir):
    _, p, f = _pairs(spark, sf_dir)
    return pairs.selection(p, f, "multiplicative", beta=0.7, power=2.0).groupBy("rid").agg(r6(F.max("p"), "top"), r6(F.sum(F.col("p") * F.col("p")), "squares"))


_GEO = f"{PAIRS}, qq AS (SELECT quantile_cont(fitness, 0.05) AS lo, quantile_cont(fitness, 0.95) AS hi FROM st), l AS (SELECT rid, cand, d, 0.5 * ln(0.01 + 0.99 * CASE WHEN hi - lo < 1e-8 THEN 1.0 ELSE (least(greatest(fitness, lo), hi) - lo) / (hi - lo + 1e-8) END) + 0.5 * ln(0.01 + 0.99 * (1 - least(greatest(d, 0.0), 1.0))) AS g FROM pr, qq)"


@query("p23_selection_geometric", f"WITH {_GEO}, z AS (SELECT rid, cand, 3.0 * g AS z FROM l), {_SM} {_TOP}")
def p23(spark, sf_dir):
    _, p, f = _pairs(spark, sf_dir)
    return _tops(pairs.selection(p, f, "geometric", alpha=3.0))


@query("p24_selection_scale_invariant", f"WITH {_GEO}, z AS (SELECT rid, cand, 3.0 * (g - avg(g) OVER (PARTITION BY rid)) / greatest(stddev_pop(g) OVER (PARTITION BY rid), 0.05) AS z FROM l WHERE rid <> cand), {_SM} {_TOP}")
def p24(spark, sf_dir):
    _, p, f = _pairs(spark, sf_dir)
    return _tops(pairs.selection(p, f, "geometric", alpha=3.0, exclude_self=True, scale_invariant=True))


@query("p25_exclude_self", f"WITH {_GEO}, z AS (SELECT rid, cand, 3.0 * g AS z FROM l WHERE rid <> cand), {_SM} SELECT rid, count(*) AS candidates, round(sum(p), 6) AS mass, round(max(p), 6) AS top FROM p GROUP BY 1")
def p25(spark, sf_dir):
    _, p, f = _pairs(spark, sf_dir)
    return pairs.selection(p, f, "geometric", alpha=3.0, exclude_self=True).groupBy("rid").agg(F.count("*").alias("candidates"), r6(F.sum("p"), "mass"), r6(F.max("p"), "top"))


_DRAW = f"{_GEO}, z AS (SELECT rid, cand, 3.0 * g AS z FROM l), {_SM}, c AS (SELECT rid, cand, sum(p) OVER (PARTITION BY rid ORDER BY cand) AS cum, {uniform_sql(SEED, '0', chr(39) + 'donor' + chr(39), 'rid')} AS u FROM p), ch AS (SELECT rid, coalesce(min(CASE WHEN u < cum THEN cand END), max(cand)) AS cand FROM c GROUP BY 1)"


def _draw(spark, sf_dir):
    _, p, f = _pairs(spark, sf_dir)
    return pairs.draw(pairs.selection(p, f, "geometric", alpha=3.0), SEED)


@query("p27_draw_donors", f"WITH {_DRAW} SELECT rid, cand FROM ch")
def p27(spark, sf_dir):
    return _draw(spark, sf_dir)


@query("p28_concentration", f"WITH {_GEO}, z AS (SELECT rid, cand, 3.0 * g AS z FROM l), {_SM}, r AS (SELECT max(p) AS top, exp(-sum(p * ln(p))) AS eff FROM p GROUP BY rid) SELECT round(avg(top), 6) AS mean_top, round(avg(eff), 4) AS mean_effective FROM r")
def p28(spark, sf_dir):
    _, p, f = _pairs(spark, sf_dir)
    return pairs.concentration(pairs.selection(p, f, "geometric", alpha=3.0)).select(r6("mean_top", "mean_top"), F.round("mean_effective", 4).alias("mean_effective"))


@query("p29_self_rate", f"WITH {_DRAW} SELECT round(avg(CASE WHEN rid = cand THEN 1.0 ELSE 0.0 END), 6) AS self_rate FROM ch")
def p29(spark, sf_dir):
    return _draw(spark, sf_dir).agg(r6(pairs.self_rate(), "self_rate"))


@query("a16_top_share", f"WITH {_DRAW} SELECT round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS top_share FROM (SELECT count(*) AS n FROM ch GROUP BY cand)")
def a16(spark, sf_dir):
    return pairs.top_share(_draw(spark, sf_dir)).select(r6("top_share", "top_share"))


@query("j03_donor_gather", f"WITH {_DRAW} SELECT ch.rid, st.seg, st.nat FROM ch JOIN st ON st.rid = ch.cand")
def j03(spark, sf_dir):
    s = customer_states(spark, sf_dir)
    return _draw(spark, sf_dir).join(s.select(F.col("rid").alias("cand"), "seg", "nat"), "cand").select("rid", "seg", "nat")


@query("d02_mean_selected_distance", f"WITH {_DRAW} SELECT round(avg(d), 6) AS mean_distance FROM ch JOIN pr USING (rid, cand)")
def d02(spark, sf_dir):
    _, p, _ = _pairs(spark, sf_dir)
    return _draw(spark, sf_dir).join(p, ["rid", "cand"]).agg(r6(F.avg("d"), "mean_distance"))


@query("p30_gumbel_max", f"WITH {STATES}, g AS (SELECT seg, nat, ln(fitness) - ln(-ln(greatest({uniform_sql(SEED, chr(39) + 'gumbel' + chr(39), 'seg', 'nat')}, 1e-300))) AS g FROM st) SELECT seg, arg_max(nat, g) AS nat FROM g GROUP BY 1")
def p30(spark, sf_dir):
    s = customer_states(spark, sf_dir).withColumn("logp", F.log("fitness"))
    return pairs.gumbel_choice(s, SEED, "seg", "nat")


@query("p31_subsample", f"WITH {CU} SELECT rid, seg, nat FROM cu ORDER BY {uniform_sql(SEED, chr(39) + 'subsample' + chr(39), 'rid')}, rid LIMIT 50")
def p31(spark, sf_dir):
    return pairs.subsample(customers(spark, sf_dir), "rid", 50, SEED)


@query("p32_blind_top", f"WITH {CU} SELECT rid, seg, nat FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY sha256(CAST(rid AS VARCHAR)), rid) AS r FROM cu) WHERE r <= 8")
def p32(spark, sf_dir):
    return pairs.blind_top(customers(spark, sf_dir), "seg", "rid", 8)


@query("h04_counter_uniforms", f"WITH {CU} SELECT rid, round({uniform_sql(SEED, 'rid', 'seg')}, 9) AS u FROM cu")
def h04(spark, sf_dir):
    return customers(spark, sf_dir).select("rid", F.round(uniform(SEED, F.col("rid"), F.col("seg")), 9).alias("u"))


# Transitions: every customer; its donor is the customer with the mirrored key.

_DON = f"{CU}, m AS (SELECT min(rid) + max(rid) AS s FROM cu), dn AS (SELECT s - rid AS rid, seg AS dseg, nat AS dnat FROM cu, m), al AS (SELECT cu.rid, seg, nat, dseg, dnat FROM cu JOIN dn USING (rid))"


def _aligned(spark, sf_dir):
    c = customers(spark, sf_dir)
    s = c.agg((F.min("rid") + F.max("rid")).alias("s"))
    d = c.crossJoin(F.broadcast(s)).select((F.col("s") - F.col("rid")).alias("rid"), "seg", "nat")
    return c.join(d.select("rid"), "rid", "left_semi"), d


_U = lambda purpose, *k: uniform_sql(SEED, "0", f"'{purpose}'", "rid", *k)
_SEG_LIST = "[" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]"
_PART = f"{_U('participate')} < 0.6"
_MUT = f"({_PART} AND {_U('mutate')} < 0.2 AND floor({_U('block')} * 2) = {{k}})"


@query(
    "k01_evolve_step",
    f"WITH {_DON} SELECT rid, CASE WHEN {_MUT.format(k=0)} THEN {_SEG_LIST}[CAST(floor({_U('value')} * 5) AS INT) + 1] WHEN {_PART} AND seg <> dseg AND {_U('copy', chr(39) + 'seg' + chr(39))} < 0.5 THEN dseg ELSE seg END AS seg, "
    f"CASE WHEN {_MUT.format(k=1)} THEN CAST(floor({_U('value')} * 25) AS INT) WHEN {_PART} AND nat <> dnat AND {_U('copy', chr(39) + 'nat' + chr(39))} < 0.5 THEN dnat ELSE nat END AS nat FROM al",
)
def k01(spark, sf_dir):
    c, d = _aligned(spark, sf_dir)
    return kernels.evolve_step(c, d, CUSTOMER_SCHEMA, "rid", 0.6, 0.5, 0.2, SEED)


@query("k02_legal_values", f"WITH {CU} SELECT rid, {_SEG_LIST}[CAST(floor({uniform_sql(SEED, 'rid')} * 5) AS INT) + 1] AS seg, CAST(floor({uniform_sql(SEED, 'rid')} * 25) AS INT) AS nat FROM cu")
def k02(spark, sf_dir):
    u = uniform(SEED, F.col("rid"))
    return customers(spark, sf_dir).select("rid", kernels.legal_value(CUSTOMER_SCHEMA, "seg", u).alias("seg"), kernels.legal_value(CUSTOMER_SCHEMA, "nat", u).alias("nat"))


@query("j04_differing_cells", f"WITH {_DON} SELECT CAST(count(*) FILTER (WHERE seg <> dseg) AS BIGINT) AS seg_differs, CAST(count(*) FILTER (WHERE nat <> dnat) AS BIGINT) AS nat_differs, count(*) AS rows_ FROM al")
def j04(spark, sf_dir):
    c, d = _aligned(spark, sf_dir)
    x = c.join(d.select("rid", F.col("seg").alias("dseg"), F.col("nat").alias("dnat")), "rid")
    return x.agg(F.count_if(~F.col("seg").eqNullSafe(F.col("dseg"))).alias("seg_differs"), F.count_if(~F.col("nat").eqNullSafe(F.col("dnat"))).alias("nat_differs"), F.count("*").alias("rows_"))


@query("j05_changed_cells", f"WITH {_DON} SELECT CAST(count(*) FILTER (WHERE seg <> dseg OR nat <> dnat) AS BIGINT) AS changed_rows, CAST(sum(CASE WHEN seg <> dseg THEN 1 ELSE 0 END + CASE WHEN nat <> dnat THEN 1 ELSE 0 END) AS BIGINT) AS changed_cells FROM al")
def j05(spark, sf_dir):
    c, d = _aligned(spark, sf_dir)
    return compare.changed(c, d, ["seg", "nat"], "rid")


CUSTOMER_WORKLOAD = [
    {"conditions": [{"attribute": "seg", "operator": "==", "value": "BUILDING"}]},
    {"conditions": [{"attribute": "nat", "operator": ">=", "value": 12}]},
    {"conditions": [{"attribute": "seg", "operator": "==", "value": "MACHINERY"}, {"attribute": "nat", "operator": "between", "lower": 3, "upper": 9}]},
]
_CW = ("{p}seg = 'BUILDING'", "{p}nat >= 12", "{p}seg = 'MACHINERY' AND {p}nat BETWEEN 3 AND 9")
_EPS = (0.25, -0.5, 1.0)


def _fixed_answers(spark):
    return spark.createDataFrame([(k, e, 0) for k, e in enumerate(_EPS)], "qid int, eps double, q int")


def _potential(seg: str, nat: str) -> str:
    return " + ".join(f"CASE WHEN {c.format(p='').replace('seg', seg).replace('nat', nat)} THEN {e} ELSE 0 END" for c, e in zip(_CW, _EPS, strict=True))


_DIRECTIONS = f"{_DON}, dr AS (SELECT rid, 'seg' AS attr, CAST(({_potential('dseg', 'nat')}) - ({_potential('seg', 'nat')}) AS DOUBLE) AS score FROM al WHERE seg <> dseg UNION ALL SELECT rid, 'nat', CAST(({_potential('seg', 'dnat')}) - ({_potential('seg', 'nat')}) AS DOUBLE) FROM al WHERE nat <> dnat)"


def _directions(spark, sf_dir):
    c, d = _aligned(spark, sf_dir)
    return kernels.copy_direction_scores(c, d, CUSTOMER_SCHEMA, CUSTOMER_WORKLOAD, _fixed_answers(spark), "rid", 1000)


@query("k03_copy_directions", f"WITH {_DIRECTIONS} SELECT rid, attr, round(score, 6) AS score FROM dr")
def k03(spark, sf_dir):
    return _directions(spark, sf_dir).select("rid", "attr", r6("score", "score"))


@query("k04_rms_scale", f"WITH {_DIRECTIONS} SELECT round(sqrt(avg(score * score)), 6) AS scale FROM dr")
def k04(spark, sf_dir):
    return kernels.rms(_directions(spark, sf_dir), "score").select(r6("scale", "scale"))


_TILT = "CASE WHEN score = 0 THEN 0.3 ELSE 1 / (1 + exp(-(ln(0.3 / 0.7) + 2.0 * score))) END"


@query("k05_tilted_probabilities", f"WITH {_DIRECTIONS} SELECT rid, attr, round({_TILT}, 6) AS p FROM dr")
def k05(spark, sf_dir):
    return _directions(spark, sf_dir).select("rid", "attr", r6(kernels.tilted(0.3, F.col("score"), 2.0), "p"))


@query("k06_bernoulli_entropy_kl", f"WITH {_DIRECTIONS}, t AS (SELECT rid, attr, {_TILT} AS p FROM dr) SELECT rid, attr, round(-p * ln(p) - (1 - p) * ln(1 - p), 6) AS entropy, round(greatest(p * ln(p / 0.3) + (1 - p) * ln((1 - p) / 0.7), 0.0), 6) AS kl FROM t")
def k06(spark, sf_dir):
    p = kernels.tilted(0.3, F.col("score"), 2.0)
    return _directions(spark, sf_dir).select("rid", "attr", r6(kernels.bernoulli_entropy(p), "entropy"), r6(kernels.bernoulli_kl(p, F.lit(0.3)), "kl"))


@query("k07_drift", f"WITH {_DIRECTIONS}, t AS (SELECT sum(0.3 * score) AS b, sum(({_TILT}) * score) AS e, sum(greatest(score, 0)) AS l FROM dr) SELECT round(b, 4) AS baseline, round(e, 4) AS expected, round(l, 4) AS upper, round((e - b) / (l - b), 6) AS utilisation FROM t")
def k07(spark, sf_dir):
    d = kernels.drift_diagnostics(_directions(spark, sf_dir), 0.3, 2.0)
    return d.select(F.round("baseline", 4).alias("baseline"), F.round("expected", 4).alias("expected"), F.round("limit", 4).alias("upper"), r6("utilisation", "utilisation"))


_LAND = f"{_DON}, ms AS (SELECT rid, seg, nat, dseg, dnat, mask FROM al, (SELECT unnest([0, 1, 2, 3]) AS mask) WHERE seg <> dseg AND nat <> dnat), la AS (SELECT rid, CAST(mask AS BIGINT) AS mask, ({_potential('(CASE WHEN mask % 2 = 1 THEN dseg ELSE seg END)', '(CASE WHEN mask >= 2 THEN dnat ELSE nat END)')}) - ({_potential('seg', 'nat')}) AS energy, bit_count(mask) * ln(0.3) + (2 - bit_count(mask)) * ln(0.7) AS prior FROM ms)"


def _landscape(spark, sf_dir):
    c, d = _aligned(spark, sf_dir)
    x = c.join(d.select("rid", F.col("seg").alias("dseg"), F.col("nat").alias("dnat")), "rid").where("seg <> dseg and nat <> dnat")
    m = kernels.masks(x, F.lit(2))
    hybrid = m.select(F.concat_ws("|", "rid", "mask").alias("hid"), "rid", "mask", F.when(F.col("mask") % 2 == 1, F.col("dseg")).otherwise(F.col("seg")).alias("seg"), F.when(F.col("mask") >= 2, F.col("dnat")).otherwise(F.col("nat")).alias("nat"))
    f = hybrid.join(scoring.fitness(hybrid, CUSTOMER_WORKLOAD, _fixed_answers(spark), "hid", 1000, centred=False), "hid")
    base = f.where("mask = 0").select("rid", F.col("fitness").alias("base"))
    return f.join(base, "rid").select("rid", "mask", (F.col("fitness") - F.col("base")).alias("energy"), kernels.mask_log_prior(F.col("mask"), F.lit(2), 0.3).alias("prior"))


@query("k08_masks", f"WITH {_LAND} SELECT mask, count(*) AS rows_, round(avg(prior), 6) AS prior FROM la GROUP BY 1")
def k08(spark, sf_dir):
    return _landscape(spark, sf_dir).groupBy("mask").agg(F.count("*").alias("rows_"), r6(F.avg("prior"), "prior"))


@query("k13_mask_landscape", f"WITH {_LAND} SELECT rid, mask, round(energy, 6) AS energy FROM la")
def k13(spark, sf_dir):
    return _landscape(spark, sf_dir).select("rid", "mask", r6("energy", "energy"))


_GIBBS = f"{_LAND}, gb AS (SELECT rid, mask, energy, prior, prior + 2.0 * energy - ln(sum(exp(prior + 2.0 * energy)) OVER (PARTITION BY rid)) AS logp FROM la)"


@query("k09_gibbs_masks", f"WITH {_GIBBS} SELECT rid, mask, round(exp(logp), 6) AS p FROM gb")
def k09(spark, sf_dir):
    g = kernels.gibbs_log_probabilities(_landscape(spark, sf_dir), "rid", F.col("prior"), F.col("energy"), 2.0)
    return g.select("rid", "mask", r6(F.exp("logp"), "p"))


@query("k11_mask_diagnostics", f"WITH {_GIBBS} SELECT rid, round(greatest(sum(exp(logp) * (logp - prior)), 0.0), 6) AS kl, round(greatest(-sum(exp(logp) * logp), 0.0), 6) AS entropy, round(sum(CASE WHEN energy > 1e-12 THEN exp(logp) ELSE 0 END), 6) AS up_mass, round(sum(exp(logp) * energy), 6) AS mean_energy FROM gb GROUP BY 1")
def k11(spark, sf_dir):
    g = kernels.gibbs_log_probabilities(_landscape(spark, sf_dir), "rid", F.col("prior"), F.col("energy"), 2.0)
    return kernels.mask_diagnostics(g, "rid").select("rid", *(r6(c, c) for c in ("kl", "entropy", "up_mass", "mean_energy")))


@query("k10_additive_directions", f"WITH {_DIRECTIONS}, w AS (SELECT rid, sum(CASE WHEN attr = 'seg' THEN score END) AS a, sum(CASE WHEN attr = 'nat' THEN score END) AS b FROM dr GROUP BY 1 HAVING count(*) = 2) SELECT rid, mask, round((CASE WHEN mask % 2 = 1 THEN a ELSE 0 END) + (CASE WHEN mask >= 2 THEN b ELSE 0 END), 6) AS direction FROM w, (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS mask)")
def k10(spark, sf_dir):
    w = _directions(spark, sf_dir).groupBy("rid").pivot("attr", ["seg", "nat"]).agg(F.first("score")).where("seg is not null and nat is not null")
    return kernels.masks(w, F.lit(2)).select("rid", "mask", r6(kernels.mask_direction(F.col("mask"), [F.col("seg"), F.col("nat")]), "direction"))


def _factors(spark, sf_dir):
    """Sparse factors of the same landscape: each query's scope and truth bits, block 0 seg, block 1 nat."""
    c, d = _aligned(spark, sf_dir)
    x = c.join(d.select("rid", F.col("seg").alias("dseg"), F.col("nat").alias("dnat")), "rid").where("seg <> dseg and nat <> dnat")
    bit = lambda c: c.cast("long")
    terms = []
    for eps, blocks in zip(_EPS, (("seg",), ("nat",), ("seg", "nat")), strict=True):
        def truth(p: str, blocks=blocks):
            tests = {"seg": F.col(f"{p}seg") == ("BUILDING" if len(blocks) == 1 else "MACHINERY"), "nat": F.col(f"{p}nat") >= 12 if len(blocks) == 1 else F.col(f"{p}nat").between(3, 9)}
            return sum((bit(tests[b]) * (1 << i) for i, b in enumerate(blocks)), F.lit(0).cast("long"))
        terms.append(F.struct(F.lit(eps).alias("we"), F.array(*(F.lit(("seg", "nat").index(b)) for b in blocks)).alias("scope"), truth("").alias("bits_now"), truth("d").alias("bits_donor"), F.lit(True).alias("rest")))
    return kernels.factor_energies(x.select("rid", F.explode(F.array(*terms)).alias("t")).select("rid", "t.*")), kernels.masks(x.select("rid"), F.lit(2))


@query("k14_sparse_factors", f"WITH {_LAND} SELECT rid, mask, round(energy, 6) AS energy FROM la")
def k14(spark, sf_dir):
    f, m = _factors(spark, sf_dir)
    return kernels.energy_of_masks(f, m).select("rid", "mask", r6("energy", "energy"))


@query("k16_conditional_copy", f"WITH {_LAND} SELECT a.rid, a.mask, round(1 / (1 + exp(-(ln(0.3 / 0.7) + 2.0 * (b.energy - a.energy)))), 6) AS p FROM la a JOIN la b ON a.rid = b.rid AND b.mask = a.mask + 1 WHERE a.mask % 2 = 0")
def k16(spark, sf_dir):
    f, m = _factors(spark, sf_dir)
    e = kernels.energy_of_masks(f, m)
    other = e.where("mask % 2 = 1").select("rid", (F.col("mask") - 1).alias("mask"), F.col("energy").alias("on"))
    return e.join(other, ["rid", "mask"]).select("rid", "mask", r6(kernels.conditional_copy(F.col("on") - F.col("energy"), 0.3, 2.0), "p"))


@query("sd1_row_query_deltas", f"WITH {_DON} SELECT * FROM (" + " UNION ALL ".join(f"SELECT rid, {k} AS qid, CAST(({c.format(p='d')}) AS INT) - CAST(({c.format(p='')}) AS INT) AS delta FROM al" for k, c in enumerate(_CW)) + ") WHERE delta <> 0")
def sd1(spark, sf_dir):
    c, d = _aligned(spark, sf_dir)
    return scoring.row_query_deltas(c, d, CUSTOMER_WORKLOAD, "rid")


_R = (12, -5, 30)


@query("sd2_step_decomposition", f"WITH {_DON}, dl AS (" + " UNION ALL ".join(f"SELECT rid, {k} AS qid, {_R[k]} AS r, CAST(({c.format(p='d')}) AS INT) - CAST(({c.format(p='')}) AS INT) AS delta FROM al WHERE rid % 3 = 0 OR seg < dseg" for k, c in enumerate(_CW)) + "), pq AS (SELECT qid, max(r) AS r, sum(delta) AS d, sum(abs(delta)) AS o FROM dl WHERE delta <> 0 GROUP BY 1), t AS (SELECT sum(r * d) AS lin, 0.5 * sum(o) AS se, 0.5 * sum(d * d) AS qu FROM pq) SELECT CAST(lin AS DOUBLE) AS linear, CAST(se AS DOUBLE) AS self, CAST(qu - se AS DOUBLE) AS cross_, CAST(lin - qu AS DOUBLE) AS net FROM t")
def sd2(spark, sf_dir):
    c, d = _aligned(spark, sf_dir)
    d = c.join(d.select("rid", F.col("seg").alias("ds"), F.col("nat").alias("dn")), "rid").select("rid", *(F.when((F.col("rid") % 3 == 0) | (F.col("seg") < F.col("ds")), F.col(x)).otherwise(F.col(n)).alias(n) for n, x in (("seg", "ds"), ("nat", "dn"))))
    r = spark.createDataFrame(list(enumerate(_R)), "qid int, r int")
    return scoring.decompose_step(scoring.row_query_deltas(c, d, CUSTOMER_WORKLOAD, "rid"), r).withColumnRenamed("cross", "cross_")


@query("k21_curvature_energy", f"WITH {_DON}, dl AS (" + " UNION ALL ".join(f"SELECT seg, {k} AS qid, {_EPS[k]} AS eps, CAST(({c.format(p='d')}) AS INT) - CAST(({c.format(p='')}) AS INT) AS delta FROM al" for k, c in enumerate(_CW)) + "), pq AS (SELECT seg, qid, max(eps) AS eps, sum(delta) AS d FROM dl GROUP BY 1, 2) SELECT seg, round(sum(eps * d) - 0.8 / 2000.0 * sum(d * d), 6) AS energy FROM pq GROUP BY 1")
def k21(spark, sf_dir):
    c, d = _aligned(spark, sf_dir)
    deltas = scoring.row_query_deltas(c, d, CUSTOMER_WORKLOAD, "rid").join(c.select("rid", "seg"), "rid").groupBy("seg", "qid").agg(F.sum("delta").alias("d"))
    return kernels.curvature_energy(deltas, _fixed_answers(spark), 0.8, 1000, "seg").select("seg", r6("energy", "energy"))


def _cell_losses(spark, sf_dir):
    a = spark.createDataFrame([(k, r, 0) for k, r in enumerate(_R)], "qid int, target int, q int")
    return kernels.cell_conditional(customers(spark, sf_dir), "rid", "seg", CUSTOMER_SCHEMA, CUSTOMER_WORKLOAD, a)


_DELTA = [f"(CAST(({c.format(p='').replace('seg', 'v')}) AS INT) - CAST(({c.format(p='')}) AS INT))" for c in _CW]
_CELLS = f"{CU}, cl AS (SELECT rid, v AS value, " + " + ".join(f"0.5 * (({r} - {d}) * ({r} - {d}) - {r * r})" for r, d in zip(_R, _DELTA, strict=True)) + f" AS dl FROM cu, (SELECT unnest({_SEG_LIST}) AS v))"


@query("k24_cell_losses", f"WITH {_CELLS} SELECT rid, value, CAST(dl AS DOUBLE) AS delta_loss FROM cl")
def k24(spark, sf_dir):
    return _cell_losses(spark, sf_dir)


@query("k25_heatbath", f"WITH {_CELLS}, e AS (SELECT rid, value, exp(-0.2 * (dl - min(dl) OVER (PARTITION BY rid))) AS e FROM cl) SELECT rid, value, round(e / sum(e) OVER (PARTITION BY rid), 6) AS p FROM e")
def k25(spark, sf_dir):
    return kernels.heatbath(_cell_losses(spark, sf_dir), "rid", "delta_loss", 0.2).select("rid", "value", r6("p", "p"))


@query("k27_gain_rms", f"WITH {_CELLS} SELECT round(sqrt(avg(dl * dl)), 6) AS scale FROM cl WHERE dl <> 0")
def k27(spark, sf_dir):
    return kernels.rms(_cell_losses(spark, sf_dir).where("delta_loss <> 0"), "delta_loss").select(r6("scale", "scale"))


@query("k17_gibbs_chain")
def k17(spark, sf_dir):
    f, _ = _factors(spark, sf_dir)
    per = f.groupBy("rid", "scope").agg(F.map_from_entries(F.collect_list(F.struct("mask", "value"))).alias("m"))
    table = F.transform(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.size("scope")).cast("int") - 1), lambda k: F.coalesce(F.element_at("m", k.cast("long")), F.lit(0.0)))
    grouped = per.withColumn("t", table).groupBy("rid").agg(F.collect_list("scope").alias("scopes"), F.collect_list("t").alias("tables")).withColumn("k", F.lit(2))
    return kernels.gibbs_chain(grouped, 0.3, 2.0, 16, SEED)


@query("k18_exact_distribution")
def k18(spark, sf_dir):
    p = kernels.exact_chain(2, [0.0, 0.25, -0.5, 1.0], 0.3, 2.0, 200)
    want = np.array([0.49, 0.21, 0.21, 0.09]) * np.exp(2 * np.array([0.0, 0.25, -0.5, 1.0]))
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(p, want / want.sum(), strict=True))], "mask int, p double, stationary double")


# Initial tables.


@query("mg7_random_table", f"SELECT rid, {_SEG_LIST}[CAST(floor({uniform_sql(SEED, chr(39) + 'init' + chr(39), 'rid', chr(39) + 'seg' + chr(39))} * 5) AS INT) + 1] AS seg, CAST(floor({uniform_sql(SEED, chr(39) + 'init' + chr(39), 'rid', chr(39) + 'nat' + chr(39))} * 25) AS INT) AS nat FROM (SELECT unnest(range(500)) AS rid)")
def mg7(spark, sf_dir):
    return init.random_table(spark, CUSTOMER_SCHEMA, 500, SEED)


def _marginals(spark, sf_dir):
    c = customers(spark, sf_dir)
    seg = c.groupBy("seg").agg(F.count("*").alias("n")).select(F.lit("seg").alias("attribute"), F.pmod(F.crc32(F.col("seg").cast("binary")), F.lit(100000)).cast("int").alias("cell"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.col("seg").alias("value"), "n")
    bins = c.groupBy((F.floor(F.col("nat") / 5)).cast("int").alias("b")).agg(F.count("*").alias("n")).select(F.lit("nat").alias("attribute"), F.col("b").alias("cell"), (F.col("b") * 5).cast("long").alias("lo"), (F.col("b") * 5 + 4).cast("long").alias("hi"), F.lit(None).cast("string").alias("value"), "n")
    return seg.unionByName(bins)


_FILL = f"{CU}, mc AS (SELECT floor(nat / 5) AS b, count(*) AS n FROM cu GROUP BY 1), s AS (SELECT b, n * 200.0 / sum(n) OVER () AS v FROM mc), q AS (SELECT b, floor(v) + CASE WHEN row_number() OVER (ORDER BY round(v - floor(v), 9) DESC, b) <= 200 - sum(floor(v)) OVER () THEN 1 ELSE 0 END AS k FROM s), f AS (SELECT b * 5 + i % 5 AS nat FROM q, (SELECT unnest(range(200)) AS i) WHERE i < k)"


@query("mg5_bin_fill", f"WITH {_FILL} SELECT CAST(nat AS VARCHAR) AS value, count(*) AS n FROM (SELECT CAST(nat AS INT) AS nat FROM f) GROUP BY 1")
def mg5(spark, sf_dir):
    return init.marginal_columns(_marginals(spark, sf_dir), 200).where("attribute = 'nat'").groupBy("value").agg(F.count("*").alias("n"))


@query("mg6_table_from_marginals", f"WITH {_FILL} SELECT CAST(nat AS INT) AS nat, count(*) AS n FROM f GROUP BY 1")
def mg6(spark, sf_dir):
    return init.table_from_marginals(spark, CUSTOMER_SCHEMA, _marginals(spark, sf_dir), 200, SEED).groupBy("nat").agg(F.count("*").alias("n"))


_CAT = Schema((Attribute("flag", CATEGORICAL, ("A", "N", "R")), Attribute("status", CATEGORICAL, ("F", "O")), Attribute("line", CATEGORICAL, (1, 2, 3, 4, 5, 6, 7))))


@query("mg8_state_space", "SELECT flag, status, line FROM (SELECT unnest(['A', 'N', 'R']) AS flag), (SELECT unnest(['F', 'O']) AS status), (SELECT CAST(unnest(range(1, 8)) AS INT) AS line)")
def mg8(spark, sf_dir):
    return spark.createDataFrame(init.enumerate_states(_CAT), "flag string, status string, line int")


def _pair_queries(spark, sf_dir):
    c = workload.states(lines(spark, sf_dir), ("flag", "status", "line")).collect()  # 42 states whatever the input
    out = []
    for a, b in (("flag", "status"), ("status", "line")):
        cells: dict = {}
        for r in c:
            cells[r[a], r[b]] = cells.get((r[a], r[b]), 0) + r[workload.ROWS]
        out += [{"conditions": [{"attribute": a, "operator": "==", "value": x}, {"attribute": b, "operator": "==", "value": y}], "result": n} for (x, y), n in sorted(cells.items(), key=str)]
    return out, sum(r[workload.ROWS] for r in c)


@query("mg10_maxent", "WITH li AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line FROM lineitem), t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM li), fs AS (SELECT flag, status, count(*) / max(n) AS p FROM li, t GROUP BY 1, 2), sl AS (SELECT status, line, count(*) / max(n) AS p FROM li, t GROUP BY 1, 2), s AS (SELECT status, count(*) / max(n) AS p FROM li, t GROUP BY 1) SELECT flag, fs.status, line, round(fs.p * sl.p / s.p, 6) AS p FROM fs JOIN sl ON fs.status = sl.status JOIN s ON s.status = fs.status")
def mg10(spark, sf_dir):
    queries, n = _pair_queries(spark, sf_dir)
    p, _ = init.maxent(_CAT, init.pair_targets(_CAT, queries, n))
    rows = [(*s, round(float(x), 6)) for s, x in zip(init.enumerate_states(_CAT), p, strict=True)]
    return spark.createDataFrame(rows, "flag string, status string, line int, p double")


# Trajectories.

_W = 5
_WS = f"{EV}, bl AS (SELECT * FROM (SELECT *, CAST(floor((round - 1) / {_W}.0) AS INT) AS block, count(*) OVER (PARTITION BY run, floor((round - 1) / {_W}.0)) AS c FROM obs WHERE round > 0) WHERE c = {_W}), ws AS (SELECT run, block, max(round) AS last_round, avg(l1) AS l1_mean, quantile_cont(l1, 0.9) - quantile_cont(l1, 0.1) AS l1_spread, quantile_cont(l1, 0.95) AS l1_p95, avg(unique_rate) AS unique_rate, avg(entropy) AS entropy, avg(CASE WHEN changed_rows > 0 THEN 1.0 ELSE 0.0 END) AS active_rate, avg(changed_rows) / 20.0 AS changed_fraction FROM bl GROUP BY 1, 2)"


@query("w01_tumbling_windows", f"WITH {_WS} SELECT run, block, round, changed_rows FROM bl")
def w01(spark, sf_dir):
    return trajectory.blocks(events(spark, sf_dir)[0], _W).select("run", "block", "round", "changed_rows")


_SUMMARY = ("l1_mean", "l1_spread", "l1_p95", "unique_rate", "entropy", "active_rate", "changed_fraction")


@query("w02_window_summary", f"WITH {_WS} SELECT run, block, last_round, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUMMARY) + " FROM ws")
def w02(spark, sf_dir):
    s = trajectory.window_summary(events(spark, sf_dir)[0], _W, 20)
    return s.select("run", "block", "last_round", *(r6(c, c) for c in _SUMMARY))


_RANGE = lambda c: f"greatest({c}, lag({c}, 1) OVER w, lag({c}, 2) OVER w) - least({c}, lag({c}, 1) OVER w, lag({c}, 2) OVER w)"
_EVID = (
    f"{_WS}, qm AS (SELECT run, block, qid, avg(answer) / 20.0 AS mean FROM ans JOIN bl USING (run, round) GROUP BY 1, 2, 3), ql AS (SELECT *, lag(mean, 1) OVER w AS m1, lag(mean, 2) OVER w AS m2 FROM qm WINDOW w AS (PARTITION BY run, qid ORDER BY block)), "
    "qp AS (SELECT run, block, qid, 0 AS pair, abs(mean - m1) AS s FROM ql WHERE m2 IS NOT NULL UNION ALL SELECT run, block, qid, 1, abs(mean - m2) FROM ql WHERE m2 IS NOT NULL UNION ALL SELECT run, block, qid, 2, abs(m1 - m2) FROM ql WHERE m2 IS NOT NULL), "
    "qs AS (SELECT run, block, max(a) AS query_mean_shift, max(p) AS query_p95_shift, max(m) AS query_max_shift FROM (SELECT run, block, pair, avg(s) AS a, quantile_cont(s, 0.95) AS p, max(s) AS m FROM qp GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "qw AS (SELECT run, block, arg_min(qid, (-round(s, 12), qid)) AS worst_qid FROM qp GROUP BY 1, 2), "
    f"rg AS (SELECT run, block, last_round, {_RANGE('l1_mean')} AS l1_mean_shift, {_RANGE('l1_spread')} AS l1_spread_shift, {_RANGE('unique_rate')} AS unique_rate_shift, {_RANGE('entropy')} AS entropy_shift, least(active_rate, lag(active_rate, 1) OVER w, lag(active_rate, 2) OVER w) AS least_active_rate, least(changed_fraction, lag(changed_fraction, 1) OVER w, lag(changed_fraction, 2) OVER w) AS least_changed_fraction FROM ws WINDOW w AS (PARTITION BY run ORDER BY block)), "
    "evd AS (SELECT * FROM rg JOIN qs USING (run, block) JOIN qw USING (run, block) WHERE block >= 2)"
)
_SHIFTS = ("query_mean_shift", "query_p95_shift", "query_max_shift", "l1_mean_shift", "l1_spread_shift", "unique_rate_shift", "entropy_shift", "least_active_rate", "least_changed_fraction")


def _evidence(spark, sf_dir):
    return trajectory.range_evidence(*events(spark, sf_dir), _W, 20)


@query("w03_range_evidence", f"WITH {_EVID} SELECT run, block, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SHIFTS) + " FROM evd")
def w03(spark, sf_dir):
    return _evidence(spark, sf_dir).select("run", "block", *(r6(c, c) for c in _SHIFTS))


@query("w04_worst_query", f"WITH {_EVID} SELECT run, block, worst_qid, round(query_max_shift, 6) AS query_max_shift FROM evd")
def w04(spark, sf_dir):
    return _evidence(spark, sf_dir).select("run", "block", "worst_qid", r6("query_max_shift", "query_max_shift"))


_DET = trajectory.Detector(_W, 0.06, 0.2, 0.0008, 0.002, 0.08, 0.06, 0.9, 0.45, 2)
_STABLE = f"query_mean_shift <= {_DET.query_mean_shift} AND query_p95_shift <= {_DET.query_p95_shift} AND l1_mean_shift <= {_DET.l1_mean_shift} AND l1_spread_shift <= {_DET.l1_spread_shift} AND unique_rate_shift <= {_DET.unique_rate_shift} AND entropy_shift <= {_DET.entropy_shift}"
_CHECK = (
    f"{_EVID}, ck AS (SELECT run, block, last_round, CASE WHEN ({_STABLE}) AND least_active_rate >= {_DET.least_active_rate} AND least_changed_fraction >= {_DET.least_changed_fraction} THEN 'stability_pass' WHEN {_STABLE} THEN 'insufficient_movement' ELSE 'running' END AS check_status FROM evd), "
    "isl AS (SELECT *, sum(ch) OVER (PARTITION BY run ORDER BY block) AS island FROM (SELECT *, CASE WHEN check_status = lag(check_status) OVER (PARTITION BY run ORDER BY block) THEN 0 ELSE 1 END AS ch FROM ck)), sk AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, island ORDER BY block) AS INT) AS streak FROM isl)"
)


@query("w06_detector_checks", f"WITH {_CHECK} SELECT run, block, check_status, streak FROM sk")
def w06(spark, sf_dir):
    return trajectory.checks(_evidence(spark, sf_dir), _DET).select("run", "block", "check_status", "streak")


@query("w06_detector_replay", f"WITH {_CHECK}, h AS (SELECT *, CASE WHEN check_status = 'stability_pass' AND streak >= 2 THEN 'stationary_qualified' WHEN check_status = 'insufficient_movement' AND streak >= 2 THEN 'stalled' END AS hit FROM sk) SELECT run, coalesce(arg_min(hit, block) FILTER (WHERE hit IS NOT NULL), CASE WHEN arg_max(check_status, block) = 'insufficient_movement' THEN 'insufficient_movement' ELSE 'running' END) AS status, arg_min(last_round, block) FILTER (WHERE hit IS NOT NULL) AS state_round FROM h GROUP BY 1")
def w06b(spark, sf_dir):
    return trajectory.replay(_evidence(spark, sf_dir), _DET)


@query("w07_invariants", f"WITH {EV}, l AS (SELECT *, lag(round) OVER (PARTITION BY run ORDER BY round) AS prev FROM obs) SELECT run, CAST(count(*) FILTER (WHERE CASE WHEN prev IS NULL THEN round <> 0 ELSE round <> prev + 1 END) AS BIGINT) AS gaps, CAST(count(*) FILTER (WHERE NOT (unique_rate BETWEEN 0 AND 1) OR NOT (entropy BETWEEN 0 AND 1)) AS BIGINT) AS bad_rates, CAST(count(*) FILTER (WHERE changed_rows < 0 OR (round = 0 AND changed_rows <> 0)) AS BIGINT) AS bad_changes FROM l GROUP BY 1")
def w07(spark, sf_dir):
    return trajectory.violations(events(spark, sf_dir)[0])


@query("w10_calibration", f"WITH {_EVID}, c AS (SELECT run, quantile_cont(query_mean_shift, 0.95) AS a, quantile_cont(l1_mean_shift, 0.95) AS b, quantile_cont(least_active_rate, 0.05) AS c FROM evd GROUP BY 1) SELECT round(max(a), 6) AS query_mean_shift, round(max(b), 6) AS l1_mean_shift, round(min(c), 6) AS least_active_rate FROM c")
def w10(spark, sf_dir):
    c = trajectory.calibrate(_evidence(spark, sf_dir), "run", ["query_mean_shift", "l1_mean_shift"], ["least_active_rate"])
    return c.select(*(r6(n, n) for n in ("query_mean_shift", "l1_mean_shift", "least_active_rate")))


_TREND = f"{EV}, c AS (SELECT run, CAST(floor((round - 1) / 10.0) + 1 AS INT) AS checkpoint, round, l1 FROM obs WHERE round > 0), g AS (SELECT run, checkpoint, avg(l1) AS mean, quantile_cont(l1, 0.5) AS median, arg_max(l1, round) AS last FROM c GROUP BY 1, 2), t AS (SELECT *, lag(mean) OVER (PARTITION BY run ORDER BY checkpoint) AS b FROM g)"


@query("w13_trend", f"WITH {_TREND} SELECT run, checkpoint, round(mean, 7) AS mean, round(median, 7) AS median, round(last, 6) AS last, round(CASE WHEN b <> 0 THEN (mean - b) / b END, 6) AS relative_change, CASE WHEN b <> 0 THEN (mean - b) / b < 0 END AS descending FROM t")
def w13(spark, sf_dir):
    return trajectory.trend(events(spark, sf_dir)[0], 10).select("run", "checkpoint", F.round("mean", 7).alias("mean"), F.round("median", 7).alias("median"), r6("last", "last"), r6("relative_change", "relative_change"), "descending")


@query("w14_ranking", f"WITH {EV}, m AS (SELECT run, avg(l1) AS m FROM obs WHERE round > 5 GROUP BY 1) SELECT run, CAST(row_number() OVER (ORDER BY round(m, 9), run) AS INT) AS rank FROM m")
def w14(spark, sf_dir):
    m = events(spark, sf_dir)[0].where("round > 5").groupBy("run").agg(F.avg("l1").alias("m"))  # one row a run
    return m.select("run", F.row_number().over(Window.orderBy(F.round("m", 9), "run")).alias("rank"))


_CLOCK = f"{EV}, ck AS (SELECT *, sum(changed_rows) OVER (PARTITION BY run ORDER BY round ROWS UNBOUNDED PRECEDING) AS clock FROM obs), cl AS (SELECT run, CAST(clock AS BIGINT) AS clock, l1 AS value FROM (SELECT *, lead(clock) OVER (PARTITION BY run ORDER BY round) AS nx FROM ck) WHERE nx IS NULL OR nx <> clock)"


@query("w15_clock", f"WITH {_CLOCK} SELECT run, clock, round(value, 6) AS value FROM cl")
def w15(spark, sf_dir):
    return trajectory.clock(events(spark, sf_dir)[0], "changed_rows", "l1").select("run", F.col("clock").cast("long").alias("clock"), r6("value", "value"))


@query("j13_interpolation", f'WITH {_CLOCK}, s AS (SELECT *, lead(clock) OVER w AS c2, lead(value) OVER w AS v2 FROM cl WINDOW w AS (PARTITION BY run ORDER BY clock)), g AS (SELECT CAST(unnest(range(10, 200, 7)) AS BIGINT) AS "at") SELECT run, "at", round(CASE WHEN c2 IS NULL THEN value ELSE value + ("at" - clock) / CAST(c2 - clock AS DOUBLE) * (v2 - value) END, 6) AS value FROM g JOIN s ON "at" >= clock AND ("at" < c2 OR (c2 IS NULL AND "at" = clock))')
def j13(spark, sf_dir):
    readings = trajectory.clock(events(spark, sf_dir)[0], "changed_rows", "l1")
    grid = spark.range(10, 200, 7).withColumnRenamed("id", "at")
    return trajectory.interpolate(readings, F.broadcast(grid)).select("run", "at", r6("value", "value"))


@query("w17_drift_by_state", f"WITH {EV}, q AS (SELECT [quantile_cont(l1, 0.25), quantile_cont(l1, 0.5), quantile_cont(l1, 0.75)] AS e FROM obs), b AS (SELECT len(list_filter(e, lambda x: x <= l1)) AS bin, changed_rows FROM obs, q) SELECT CAST(bin AS INT) AS bin, count(*) AS transitions, round(avg(changed_rows), 6) AS rate FROM b GROUP BY 1 HAVING count(*) >= 3")
def w17(spark, sf_dir):
    return trajectory.drift_by_state(events(spark, sf_dir)[0], "l1", "changed_rows", 4, 3).select("bin", "transitions", r6("rate", "rate"))


@query("w18_schedules", f"WITH {EV} SELECT run, round, round(1.5 + 4.5 * (round - 1) / 99.0, 6) AS alpha, round(0.4 * pow(0.1 / 0.4, (round - 1) / 99.0), 6) AS rho, round(min(least(1.0, l1 / f)) OVER (PARTITION BY run ORDER BY round ROWS UNBOUNDED PRECEDING), 6) AS ratio FROM (SELECT *, first_value(l1) OVER (PARTITION BY run ORDER BY round) AS f FROM obs)")
def w18(spark, sf_dir):
    x = trajectory.cooling(events(spark, sf_dir)[0], monotone=True)
    return x.select("run", "round", r6(trajectory.linear(1.5, 6.0, F.col("round"), 100), "alpha"), r6(trajectory.geometric(0.4, 0.1, F.col("round"), 100), "rho"), r6("ratio", "ratio"))


@query("w20_best_so_far", f"WITH {EV} SELECT run, round, round(min(l1) OVER (PARTITION BY run ORDER BY round ROWS UNBOUNDED PRECEDING), 6) AS best FROM obs")
def w20(spark, sf_dir):
    return trajectory.best_so_far(events(spark, sf_dir)[0], "l1").select("run", "round", r6("best", "best"))


_QN = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query("a10_quantile_summary", f"WITH {EV} SELECT run, count(l1) AS count, round(min(l1), 6) AS min, " + ", ".join(f"round(quantile_cont(l1, {p}), 5) AS {n}" for n, p in _QN.items()) + ", round(max(l1), 6) AS max FROM obs GROUP BY 1")
def a10(spark, sf_dir):
    return trajectory.summary_quantiles(events(spark, sf_dir)[0], ["run"], "l1").select("run", "count", r6("min", "min"), *(F.round(c, 5).alias(c) for c in _QN), r6("max", "max"))


@query("a11_band_summary", f"WITH {EV} SELECT run, CAST(least(floor((round - 1) * 4 / 120.0), 3) AS INT) AS band, count(l1) AS count, round(quantile_cont(l1, 0.5), 7) AS p50, round(quantile_cont(l1, 0.95), 5) AS p95 FROM obs WHERE round > 0 GROUP BY 1, 2")
def a11(spark, sf_dir):
    x = events(spark, sf_dir)[0].where("round > 0").withColumn("band", trajectory.round_band(F.col("round"), 120))
    return trajectory.summary_quantiles(x, ["run", "band"], "l1").select("run", "band", "count", F.round("p50", 7).alias("p50"), F.round("p95", 5).alias("p95"))


@query("a12_series_ends", f"WITH {EV} SELECT run, round(arg_min(l1, round), 6) AS initial, round(arg_max(l1, round), 6) AS final, round(min(l1), 6) AS lowest, round(max(l1), 6) AS highest FROM obs GROUP BY 1")
def a12(spark, sf_dir):
    return trajectory.ends(events(spark, sf_dir)[0], "run", "round", "l1").select("run", *(r6(c, c) for c in ("initial", "final", "lowest", "highest")))


@query("a13_envelope", f"WITH {EV} SELECT round, round(min(l1), 6) AS low, round(quantile_cont(l1, 0.5), 7) AS mid, round(max(l1), 6) AS high FROM obs GROUP BY 1")
def a13(spark, sf_dir):
    return trajectory.envelope(events(spark, sf_dir)[0], "round", "l1").select("round", r6("low", "low"), F.round("mid", 7).alias("mid"), r6("high", "high"))


@query("a14_completeness", f"WITH {EV}, g AS (SELECT * FROM (SELECT DISTINCT run FROM ev), (SELECT DISTINCT event_type FROM ev)), n AS (SELECT run, event_type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT run, event_type, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (run, event_type) WHERE coalesce(n, 0) <> 500")
def a14(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("run", (F.col("user_id") % 4).cast("int"))
    return trajectory.completeness(e, "run", "event_type", 500)


@query("a15_weighted_mean", f"WITH {EV} SELECT run, round(CASE WHEN sum(changed_rows) = 0 THEN 0 ELSE sum(l1 * changed_rows) / sum(changed_rows) END, 6) AS mean FROM obs GROUP BY 1")
def a15(spark, sf_dir):
    w = F.col("changed_rows")
    return events(spark, sf_dir)[0].groupBy("run").agg(r6(F.when(F.sum(w) == 0, 0.0).otherwise(F.sum(F.col("l1") * w) / F.sum(w)), "mean"))


# Statistics: event types paired by user, purchases against clicks.

_PAIRED = "ev2 AS (SELECT user_id AS seed, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 100 // count(value) / 10000.0 AS v FROM events GROUP BY 1, 2), pa AS (SELECT a.seed, a.v AS a, b.v AS b FROM (SELECT * FROM ev2 WHERE event_type = 'click') a JOIN (SELECT * FROM ev2 WHERE event_type = 'purchase') b USING (seed))"


def _by_user(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("seed"), "event_type").agg((F.expr("sum(cast(round(value * 100) as bigint)) * 100 div count(value)") / 10000.0).alias("v"))


def _paired(spark, sf_dir):
    x = _by_user(spark, sf_dir)
    a, b = x.where("event_type = 'click'"), x.where("event_type = 'purchase'")
    return stats.paired_rows(a.join(b.select("seed"), "seed", "left_semi"), b.join(a.select("seed"), "seed", "left_semi"), "seed", "v")


@query("j11_pairs", f"WITH {_PAIRED} SELECT seed, round(a, 4) AS a, round(b, 4) AS b FROM pa")
def j11(spark, sf_dir):
    return _paired(spark, sf_dir).select("seed", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("t01_paired", f"WITH {_PAIRED}, d AS (SELECT count(*) AS n, avg(b - a) AS m, coalesce(stddev_samp(b - a), 0) AS s, CAST(count(*) FILTER (WHERE b < a) AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE a = b) AS BIGINT) AS ties, CAST(count(*) FILTER (WHERE b > a) AS BIGINT) AS losses, avg(a) AS ma, avg(b) AS mb FROM pa) SELECT n, round(m, 5) AS mean_diff, round(s, 5) AS std_diff, round(m / (s / sqrt(n)), 5) AS t, wins, ties, losses, round((mb - ma) / ma, 6) AS relative_change FROM d")
def t01(spark, sf_dir):
    p = stats.paired(_paired(spark, sf_dir))
    return p.select("n", *(F.round(c, 5).alias(c) for c in ("mean_diff", "std_diff", "t")), "wins", "ties", "losses", r6("relative_change", "relative_change"))


@query("t02_mean_interval", f"WITH {_PAIRED} SELECT event_type, round(avg(v), 5) AS mean, round(avg(v) - 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(v)), 5) AS low, round(avg(v) + 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(v)), 5) AS high FROM ev2 GROUP BY 1")
def t02(spark, sf_dir):
    m, low, high = stats.mean_interval(F.col("v"), 1.96)
    return _by_user(spark, sf_dir).groupBy("event_type").agg(F.round(m, 5).alias("mean"), F.round(low, 5).alias("low"), F.round(high, 5).alias("high"))


@query("t03_independent", f"WITH {_PAIRED}, g AS (SELECT avg(v) FILTER (WHERE event_type = 'click') AS ma, avg(v) FILTER (WHERE event_type = 'purchase') AS mb, var_samp(v) FILTER (WHERE event_type = 'click') AS va, var_samp(v) FILTER (WHERE event_type = 'purchase') AS vb, count(v) FILTER (WHERE event_type = 'click') AS na, count(v) FILTER (WHERE event_type = 'purchase') AS nb FROM ev2) SELECT round(ma, 5) AS mean_a, round(mb, 5) AS mean_b, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 5) AS t, na + nb - 2 AS dof FROM g")
def t03(spark, sf_dir):
    return stats.independent(_by_user(spark, sf_dir), "event_type", "v", "click", "purchase").select(*(F.round(c, 5).alias(c) for c in ("mean_a", "mean_b", "t")), "dof")


@query("t04_stage_interaction", f"WITH {_PAIRED}, w AS (SELECT b - a AS d FROM pa) SELECT count(*) AS n, round(avg(d), 5) AS mean_change, CAST(count(*) FILTER (WHERE d > 0) AS BIGINT) AS up, CAST(count(*) FILTER (WHERE d < 0) AS BIGINT) AS down, CASE WHEN count(*) FILTER (WHERE d > 0) = count(*) THEN 'all_up' WHEN count(*) FILTER (WHERE d < 0) = count(*) THEN 'all_down' ELSE 'mixed' END AS direction FROM w")
def t04(spark, sf_dir):
    s = stats.stage_interaction(_by_user(spark, sf_dir), "seed", "event_type", "v", "click", "purchase")
    return s.withColumn("mean_change", F.round("mean_change", 5))


@query("t05_slope", f"WITH {EV} SELECT run, round(regr_slope(l1, round), 9) AS slope FROM obs GROUP BY 1")
def t05(spark, sf_dir):
    return events(spark, sf_dir)[0].groupBy("run").agg(F.round(F.regr_slope("l1", "round"), 9).alias("slope"))


@query("t07_gate", f"WITH {_PAIRED}, g AS (SELECT CAST(count(*) FILTER (WHERE b < a) AS BIGINT) AS wins, quantile_cont(CASE WHEN a <> 0 THEN (a - b) / a ELSE 0 END, 0.5) AS m FROM pa) SELECT wins, round(m, 6) AS median_gain, wins >= 10 AND m >= 0.01 AS passed FROM g")
def t07(spark, sf_dir):
    return stats.gate(_paired(spark, sf_dir), 10, 0.01).withColumn("median_gain", F.round("median_gain", 6))


@query("t08_kernel_distance", f"WITH {_GIBBS} SELECT rid, round(0.5 * sum(abs(exp(logp) - exp(prior))), 6) AS tvd, round(sum(exp(logp) * (logp - prior)), 6) AS kl FROM gb GROUP BY 1")
def t08(spark, sf_dir):
    g = kernels.gibbs_log_probabilities(_landscape(spark, sf_dir), "rid", F.col("prior"), F.col("energy"), 2.0)
    return g.groupBy("rid").agg(r6(stats.total_variation(F.exp("logp"), F.exp("prior")), "tvd"), r6(F.sum(F.exp("logp") * (F.col("logp") - F.col("prior"))), "kl"))


# Drivers.


def _run(spark, sf_dir, **more):
    table = customers(spark, sf_dir)
    targets = workload.evaluate(table, CUSTOMER_WORKLOAD).select("qid", F.col("answer").cast("long").alias("target"))
    return targets, engine.Config(n_records=table.count(), rounds=2, seed=SEED, **more)


@query("e01_evolution")
def e01(spark, sf_dir):
    targets, config = _run(spark, sf_dir)
    best, _ = engine.run_evolution(spark, CUSTOMER_WORKLOAD, targets, CUSTOMER_SCHEMA, config)
    return best


@query("e02_fixed_process")
def e02(spark, sf_dir):
    targets, config = _run(spark, sf_dir)
    return engine.run_fixed_process(spark, CUSTOMER_WORKLOAD, targets, CUSTOMER_SCHEMA, config)[0]


@query("e06_retries")
def e06(spark, sf_dir):
    targets, config = _run(spark, sf_dir, max_retries=1, strength=1.0)
    _, said = engine.run_evolution(spark, CUSTOMER_WORKLOAD, targets, CUSTOMER_SCHEMA, config)
    return spark.createDataFrame([(r["round"], float(r["loss"]), bool(r["accepted"])) for r in said["rounds"]], "round int, loss double, accepted boolean")
