"""Compositions: snapshots, identities, workload choice, several window sizes, gates, chains."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countloom import sources
from countloom.functions import condition
from countloom.operators import chains, compare, contingency, kernels, scoring, stats, trajectory, workload
from countloom.plans import processes as P
from countloom.plans.fixtures import CUSTOMER_SCHEMA, EV, LI, WORKLOAD, customers, events, lines, sides
from countloom.plans.tables import _UNION, FOUR, NAMES, _PAIR, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


_SPECIFIC = [q for q in WORKLOAD if q["conditions"]]
_ARRAY = "[" + ", ".join(f"sha256('{workload.canonical(q)}')" for q in _SPECIFIC) + "]"


@query("q02_set_identity", f"SELECT sha256(array_to_string(list_sort({_ARRAY}), chr(10))) AS identity")
def q02(spark, sf_dir):
    prints = spark.createDataFrame([(workload.canonical(q),) for q in _SPECIFIC], "payload string").select(F.sha2(F.col("payload").cast("binary"), 256).alias("p"))
    return prints.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("p")), "\n").cast("binary"), 256).alias("identity"))


@query("h02_ordered_identity", f"SELECT sha256(array_to_string({_ARRAY}, chr(10))) AS identity")
def h02(spark, sf_dir):
    return spark.createDataFrame([(workload.set_identity(_SPECIFIC, ordered=True),)], "identity string")


@query("h01_table_hash")
def h01(spark, sf_dir):
    return spark.createDataFrame([(sources.table_hash(customers(spark, sf_dir)),)], "hash string")


_BINS = [(1, 10), (11, 20), (21, 50)]
_CONDS = [("between", None, 1, 10), (">=", 21, None, None), (">=", 11, None, None), ("==", 4, None, None), ("between", None, 11, 21)]


@query("p15_condition_cells", "SELECT * FROM (VALUES (0, '[1,10]'), (1, '[21,50]'), (2, NULL), (3, NULL), (4, NULL)) t(k, cell)")
def p15(spark, sf_dir):
    found = [contingency.cell_of_condition({"operator": o, "value": v, "lower": a, "upper": b}, _BINS, 50) for o, v, a, b in _CONDS]
    return spark.createDataFrame(list(enumerate(found)), "k int, cell string")


@query("p18_round_bands", f"WITH {EV} SELECT CAST(least(floor((round - 1) * 4 / 60.0), 3) AS INT) AS band, count(*) AS n FROM obs WHERE round > 0 GROUP BY 1")
def p18(spark, sf_dir):
    return events(spark, sf_dir)[0].where("round > 0").groupBy(trajectory.round_band(F.col("round"), 60).alias("band")).agg(F.count("*").alias("n"))


@query("q06_quality_snapshot", f"{_UNION} SELECT 'unique_overlap' AS metric, CAST(count(*) FILTER (WHERE a > 0 AND b > 0) AS DOUBLE) AS value FROM u UNION ALL SELECT 'mass_inside', round(sum(CASE WHEN a > 0 THEN b ELSE 0 END) / CAST(sum(b) AS DOUBLE), 6) FROM u UNION ALL SELECT 'tvd', round(0.5 * sum(abs(a / CAST(na AS DOUBLE) - b / CAST(nb AS DOUBLE))), 6) FROM u, t UNION ALL SELECT 'unique_rows', CAST(count(*) FILTER (WHERE b > 0) AS DOUBLE) FROM u")
def q06(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    s, j, d = compare.support_metrics(a, b, FOUR), compare.joint_metrics(a, b, FOUR), compare.diversity(b, FOUR)
    rows = [(s, "unique_overlap"), (s, "mass_inside"), (j, "tvd"), (d, "unique_rows")]
    return reduce(DataFrame.unionByName, (f.select(F.lit(n).alias("metric"), F.round(F.col(n).cast("double"), 6).alias("value")) for f, n in rows))


@query("q11_diversity_pair", f"{_UNION} SELECT CAST(count(*) FILTER (WHERE b > 0) AS BIGINT) AS unique_rows, round(100 * (1 - count(*) FILTER (WHERE b > 0) / CAST(sum(b) AS DOUBLE)), 5) AS duplicate_percent, round(100 * max(b) / CAST(sum(b) AS DOUBLE), 5) AS max_percent FROM u")
def q11(spark, sf_dir):
    counts = compare.row_counts(sides(spark, sf_dir)[1], FOUR)
    return counts.agg(F.count("*").alias("unique_rows"), F.round(100 * (1 - F.count("*") / F.sum("n")), 5).alias("duplicate_percent"), F.round(100 * F.max("n") / F.sum("n"), 5).alias("max_percent"))


@query("q15_informative_cells", f"{_PAIR}, s AS (SELECT a, b, x, y, round(abs(n - e), 4) AS gain, row_number() OVER (PARTITION BY a, b ORDER BY round(abs(n - e), 4) DESC, x, y) AS k FROM z) SELECT a, b, x, y, gain FROM s WHERE k <= 2")
def q15(spark, sf_dir):
    df = lines(spark, sf_dir)
    one, total = contingency.cells(df, NAMES, 1), df.agg(F.count("*").alias("total"))
    p = contingency.pair_counts(df, NAMES)
    for k, (a, x) in enumerate((("a", "x"), ("b", "y"))):
        p = p.join(one.select(F.col("attrs").alias(a), F.col("key").alias(x), F.col("n").alias(f"n{k}")), [a, x])
    p = p.crossJoin(F.broadcast(total)).withColumn("gain", F.round(F.abs(F.col("n") - F.col("n0") * F.col("n1") / F.col("total")), 4))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("gain"), "x", "y"))
    return p.withColumn("k", rank).where("k <= 2").select("a", "b", "x", "y", "gain")


@query("w05_window_sizes", " UNION ALL ".join(f"SELECT * FROM (WITH {EV}, b AS (SELECT *, CAST(floor((round - 1) / {w}.0) AS INT) AS block, count(*) OVER (PARTITION BY run, floor((round - 1) / {w}.0)) AS c FROM obs WHERE round > 0), s AS (SELECT run, block, avg(l1) AS m FROM b WHERE c = {w} GROUP BY 1, 2), e AS (SELECT run, block, greatest(m, lag(m, 1) OVER w, lag(m, 2) OVER w) - least(m, lag(m, 1) OVER w, lag(m, 2) OVER w) AS d FROM s WINDOW w AS (PARTITION BY run ORDER BY block)) SELECT {w} AS size, run, block, round(d, 6) AS l1_mean_shift FROM e WHERE block >= 2)" for w in (3, 7)))
def w05(spark, sf_dir):
    obs, ans = events(spark, sf_dir)
    return reduce(DataFrame.unionByName, (trajectory.range_evidence(obs, ans, w, 20).select(F.lit(w).alias("size"), "run", "block", r6("l1_mean_shift", "l1_mean_shift")) for w in (3, 7)))


@query("w08_row_entropy", "WITH c AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1), t AS (SELECT n, sum(n) OVER () AS t FROM c) SELECT round(-sum(n / t * ln(n / t)) / ln(max(t)), 6) AS normalized_entropy FROM t")
def w08(spark, sf_dir):
    return compare.diversity(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"]).select(r6("normalized_entropy", "normalized_entropy"))


@query("w11_unstable_streaks", f"WITH {P._CHECK} SELECT run, CAST(count(*) AS BIGINT) AS checks, CAST(max(CASE WHEN check_status = 'running' THEN streak ELSE 0 END) AS INT) AS longest_unstable FROM sk GROUP BY 1")
def w11(spark, sf_dir):
    c = trajectory.checks(P._evidence(spark, sf_dir), P._DET)
    return c.groupBy("run").agg(F.count("*").alias("checks"), F.max(F.when(F.col("check_status") == "running", F.col("streak")).otherwise(0)).alias("longest_unstable"))


@query("w12_gates", f"WITH {P._EVID}, r AS (SELECT run, bool_and(query_mean_shift <= 0.1) AS ok FROM evd GROUP BY 1) SELECT count(*) AS cells, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS passed, coalesce(bool_and(ok), false) AND count(*) = 4 AS all_pass FROM r")
def w12(spark, sf_dir):
    per = P._evidence(spark, sf_dir).groupBy("run").agg(F.bool_and(F.col("query_mean_shift") <= 0.1).alias("ok"))
    return per.agg(F.count("*").alias("cells"), F.count_if("ok").alias("passed"), (F.coalesce(F.bool_and("ok"), F.lit(False)) & (F.count("*") == 4)).alias("all_pass"))


@query("w16_matched_clock", f'WITH {P._CLOCK}, s AS (SELECT *, lead(clock) OVER w AS c2, lead(value) OVER w AS v2 FROM cl WINDOW w AS (PARTITION BY run ORDER BY clock)), g AS (SELECT CAST(unnest(range(20, 100, 5)) AS BIGINT) AS "at"), i AS (SELECT run, "at", CASE WHEN c2 IS NULL THEN value ELSE value + ("at" - clock) / CAST(c2 - clock AS DOUBLE) * (v2 - value) END AS value FROM g JOIN s ON "at" >= clock AND ("at" < c2 OR (c2 IS NULL AND "at" = clock))) SELECT round(avg(a.value - b.value), 6) AS mean_gap, count(*) AS points FROM i a JOIN i b ON a."at" = b."at" WHERE a.run = 0 AND b.run = 1')
def w16(spark, sf_dir):
    readings = trajectory.clock(events(spark, sf_dir)[0], "changed_rows", "l1")
    i = trajectory.interpolate(readings, F.broadcast(spark.range(20, 100, 5).withColumnRenamed("id", "at")))
    a, b = (i.where(F.col("run") == k).select("at", F.col("value").alias(f"v{k}")) for k in (0, 1))
    return a.join(b, "at").agg(r6(F.avg(F.col("v0") - F.col("v1")), "mean_gap"), F.count("*").alias("points"))


@query("t06_paired_performance", f"WITH {P._PAIRED} SELECT round(quantile_cont(100 * (a - b) / a, 0.5), 5) AS median_percent, CAST(count(*) FILTER (WHERE b < a) AS BIGINT) AS wins FROM pa")
def t06(spark, sf_dir):
    gain = 100 * (F.col("a") - F.col("b")) / F.col("a")
    return P._paired(spark, sf_dir).agg(F.round(F.percentile(gain, 0.5), 5).alias("median_percent"), F.count_if(F.col("b") < F.col("a")).alias("wins"))


@query("t09_gain_summary", f"WITH {P._DIRECTIONS} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) AS median, min(score) AS low, max(score) AS high, round(avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_rate FROM dr")
def t09(spark, sf_dir):
    s = F.col("score")
    return P._directions(spark, sf_dir).agg(r6(F.avg(s), "mean"), r6(F.stddev_pop(s), "std"), r6(F.percentile(s, 0.5), "median"), F.min(s).alias("low"), F.max(s).alias("high"), r6(F.avg((s > 0).cast("double")), "up_rate"))


@query("t10_equivalence", "SELECT * FROM (VALUES ('same', NULL), ('other', 'loss')) t(pair, first_difference)")
def t10(spark, sf_dir):
    a = {"loss": 1, "rows": 2, "run_elapsed_sec": 3}
    rows = [("same", sources.first_difference(a, a | {"run_elapsed_sec": 9})), ("other", sources.first_difference(a, a | {"loss": 2, "rows": 3}))]
    return spark.createDataFrame(rows, "pair string, first_difference string")


_MASKED = [c.format(p="").replace("seg", "(CASE WHEN mask % 2 = 1 THEN dseg ELSE seg END)").replace("nat", "(CASE WHEN mask >= 2 THEN dnat ELSE nat END)") for c in P._CW]


@query("k20_mask_query_deltas", f"WITH {P._LAND} SELECT * FROM (" + " UNION ALL ".join(f"SELECT rid, CAST(mask AS BIGINT) AS mask, {k} AS qid, CAST(({m}) AS INT) - CAST(({c.format(p='')}) AS INT) AS delta FROM ms" for k, (m, c) in enumerate(zip(_MASKED, P._CW, strict=True))) + ") WHERE delta <> 0")
def k20(spark, sf_dir):
    c, d = P._aligned(spark, sf_dir)
    x = c.join(d.select("rid", F.col("seg").alias("dseg"), F.col("nat").alias("dnat")), "rid").where("seg <> dseg and nat <> dnat")
    m = kernels.masks(x, F.lit(2)).withColumn("hid", F.concat_ws("|", "rid", "mask"))
    after = m.select("hid", F.when(F.col("mask") % 2 == 1, F.col("dseg")).otherwise(F.col("seg")).alias("seg"), F.when(F.col("mask") >= 2, F.col("dnat")).otherwise(F.col("nat")).alias("nat"))
    deltas = scoring.row_query_deltas(m.select("hid", "seg", "nat"), after, P.CUSTOMER_WORKLOAD, "hid")
    return deltas.join(m.select("hid", "rid", "mask"), "hid").select("rid", "mask", "qid", "delta")


@query("k12_strength_for_kl")
def k12(spark, sf_dir):
    rows = [(t, kernels.strength_for_kl([0.0, 0.25, -0.5, 1.0], [0.49, 0.21, 0.21, 0.09], t)) for t in (0.01, 0.1, 0.5)]
    return spark.createDataFrame(rows, "target double, strength double")


@query("k19_gibbs_step", P.ORACLE_SQL["k01_evolve_step"])
def k19(spark, sf_dir):
    """Without sweeps the Gibbs-refined step is the plain one."""
    c, d = P._aligned(spark, sf_dir)
    return chains.evolve_step_gibbs(c, d, CUSTOMER_SCHEMA, P.CUSTOMER_WORKLOAD, P._fixed_answers(spark), "rid", 0.6, 0.5, 0.2, 2.0, 0, P.SEED)


@query("k19_gibbs_step_refined")
def k19b(spark, sf_dir):
    c, d = P._aligned(spark, sf_dir)
    return chains.evolve_step_gibbs(c, d, CUSTOMER_SCHEMA, P.CUSTOMER_WORKLOAD, P._fixed_answers(spark), "rid", 0.6, 0.5, 0.2, 2.0, 4, P.SEED)


@query("k22_curvature_step")
def k22(spark, sf_dir):
    c, d = P._aligned(spark, sf_dir)
    return chains.evolve_step_curvature(c, d, CUSTOMER_SCHEMA, P.CUSTOMER_WORKLOAD, P._EPS, "rid", 0.5, 2.0, 0.5, 1, P.SEED)[0]


@query("k26_heatbath_chain")
def k26(spark, sf_dir):
    c = customers(spark, sf_dir)
    targets = [r.answer for r in workload.evaluate(c, P.CUSTOMER_WORKLOAD).orderBy("qid").collect()]
    return chains.heatbath_chain(c, CUSTOMER_SCHEMA, P.CUSTOMER_WORKLOAD, [t + 5 for t in targets], "rid", 50.0, 30, P.SEED)[0]


@query("p05_unknown_operator", "SELECT 'ValueError' AS raised")
def p05(spark, sf_dir):
    df = lines(spark, sf_dir)
    try:
        condition(F.col("qty"), df.schema["qty"].dataType, {"attribute": "qty", "operator": "<", "value": 3})
        name = "none"
    except ValueError as e:
        name = type(e).__name__
    return spark.createDataFrame([(name,)], "raised string")


@query("a04_general_join", f"WITH {LI} {' UNION ALL '.join(f'SELECT {k} AS qid, count(*) AS answer FROM li WHERE flag = {chr(39)}{f}{chr(39)} AND line = {n} AND disc >= {d}' for k, (f, n, d) in enumerate((f, n, d) for f in 'ANR' for n in (1, 2) for d in (0, 5)))}")
def a04(spark, sf_dir):
    eq = lambda a, v: {"attribute": a, "operator": "==", "value": v}
    queries = [{"conditions": [eq("flag", f), eq("line", n), {"attribute": "disc", "operator": ">=", "value": d}]} for f in "ANR" for n in (1, 2) for d in (0, 5)]
    return workload.evaluate(lines(spark, sf_dir), queries)


@query("t08_gap_recovery", f"WITH {P._GIBBS}, d AS (SELECT rid, 0.5 * sum(abs(exp(logp) - exp(prior))) AS r FROM gb GROUP BY 1) SELECT round(avg(1 - r / 1.0), 6) AS recovery FROM d")
def t08(spark, sf_dir):
    g = kernels.gibbs_log_probabilities(P._landscape(spark, sf_dir), "rid", F.col("prior"), F.col("energy"), 2.0)
    return g.groupBy("rid").agg(stats.total_variation(F.exp("logp"), F.exp("prior")).alias("r")).agg(r6(F.avg(1 - F.col("r")), "recovery"))
