"""Queries on predicates, workload counts, scores and contingency tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions import condition
from countloom.operators import compare, contingency, scoring, workload
from countloom.plans.fixtures import LI, LINE_SCHEMA, SIDES, WORKLOAD, answers_sql, lines, query_sql, sides
from countloom.schema import CATEGORICAL, NUMERIC, Attribute, Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name)


NAMES = ("flag", "line", "disc")
ALL = ("qty", "flag", "line", "disc", "tax")
DOMAINS = {"flag": ("A", "N", "R"), "line": tuple(range(1, 8)), "disc": tuple(range(11)), "tax": tuple(range(9))}


def _one(name: str, spec: dict, numeric_sql: str) -> None:
    @query(name, f"WITH {LI} SELECT CAST(count(*) FILTER (WHERE {numeric_sql}) AS BIGINT) AS hits, count(*) AS total FROM li")
    def run(spark, sf_dir, spec=spec):
        df = lines(spark, sf_dir)
        return df.agg(F.count_if(condition(F.col(spec["attribute"]), df.schema[spec["attribute"]].dataType, spec)).alias("hits"), F.count("*").alias("total"))


_one("p02_equals", {"attribute": "line", "operator": "==", "value": "4"}, "line = 4")
_one("p01_coerced_literal", {"attribute": "line", "operator": "==", "value": "four"}, "FALSE")
_one("p03_at_least", {"attribute": "qty", "operator": ">=", "value": 30}, "qty >= 30")
_one("p04_between", {"attribute": "qty", "operator": "between", "lower": 5, "upper": 12}, "qty BETWEEN 5 AND 12")


@query("p06_query_mask", f"WITH {LI} SELECT flag, line, CAST(count(*) FILTER (WHERE {query_sql(WORKLOAD[11])}) AS BIGINT) AS hits FROM li GROUP BY 1, 2")
def p06(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.groupBy("flag", "line").agg(F.count_if(workload.query_mask(df, WORKLOAD[11])).alias("hits"))


@query("p09_match_pairs", f"WITH {LI} " + " UNION ALL ".join(f"SELECT {k} AS qid, status, count(*) AS n FROM li WHERE {query_sql(q)} GROUP BY status" for k, q in enumerate(WORKLOAD)))
def p09(spark, sf_dir):
    return workload.matches(lines(spark, sf_dir), WORKLOAD, ["status"]).groupBy("qid", "status").agg(F.count("*").alias("n"))


_CONDITIONS = sorted({(c["attribute"], c["operator"], str(c["value"]) if "value" in c else None) for q in WORKLOAD for c in q["conditions"]}, key=str)


@query("p11_distinct_conditions", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{o}', {f'{chr(39)}{v}{chr(39)}' if v is not None else 'CAST(NULL AS VARCHAR)'})" for a, o, v in _CONDITIONS) + ") t(attribute, operator, value)")
def p11(spark, sf_dir):
    conditions, _ = workload.condition_dimension(lines(spark, sf_dir), WORKLOAD)
    return conditions.select("attribute", "operator", "value").distinct()


@query("p12_schema_projection", f"WITH {LI} SELECT qty, flag, line, disc, tax, count(*) AS n FROM li GROUP BY ALL")
def p12(spark, sf_dir):
    return LINE_SCHEMA.project(lines(spark, sf_dir)).groupBy(*LINE_SCHEMA.names).agg(F.count("*").alias("n"))


_TIGHT = Schema((Attribute("qty", NUMERIC, low=1, high=40), Attribute("flag", CATEGORICAL, ("A", "N")), Attribute("line", NUMERIC, low=1, high=7)))


@query("p13_valid_values", f"WITH {LI} SELECT flag, CAST(count(*) FILTER (WHERE qty BETWEEN 1 AND 40) AS BIGINT) AS qty_ok, CAST(count(*) FILTER (WHERE flag IN ('A', 'N')) AS BIGINT) AS flag_ok FROM li GROUP BY flag")
def p13(spark, sf_dir):
    df = lines(spark, sf_dir)
    ok = lambda n: F.count_if(_TIGHT[n].valid(F.col(n), df.schema[n].dataType)).alias(f"{n}_ok")
    return df.groupBy("flag").agg(ok("qty"), ok("flag"))


_BINS = [(1, 10), (11, 20), (21, 35), (36, 50)]


@query("p14_discretise", f"WITH {LI} SELECT CASE " + " ".join(f"WHEN qty BETWEEN {a} AND {b} THEN '[{a},{b}]'" for a, b in _BINS) + " END AS bin, count(*) AS n FROM li GROUP BY 1")
def p14(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(contingency.discretise(F.col("qty"), _BINS).alias("bin")).agg(F.count("*").alias("n"))


@query("p17_rare_common", f"WITH {LI}, a AS ({answers_sql('li')}), t AS (SELECT count(*) AS n FROM li) SELECT CASE WHEN answer / CAST(n AS DOUBLE) < 0.05 THEN 'rare' ELSE 'common' END AS band, count(*) AS queries, CAST(sum(answer) AS BIGINT) AS total FROM a, t GROUP BY 1")
def p17(spark, sf_dir):
    df = lines(spark, sf_dir)
    share = workload.evaluate(df, WORKLOAD).crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))
    return share.groupBy(F.when(F.col("answer") / F.col("n") < 0.05, "rare").otherwise("common").alias("band")).agg(F.count("*").alias("queries"), F.sum("answer").alias("total"))


@query("a01_one_count", f"WITH {LI} SELECT count(*) AS answer FROM li WHERE {query_sql(WORKLOAD[10])}")
def a01(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.where(workload.query_mask(df, WORKLOAD[10])).agg(F.count("*").alias("answer"))


@query("a02_workload_counts", f"WITH {LI} {answers_sql('li')}")
def a02(spark, sf_dir):
    return workload.evaluate(lines(spark, sf_dir).drop("status"), WORKLOAD)


def _scored(spark, sf_dir, geometry="absolute"):
    reference, synthetic = sides(spark, sf_dir)
    a = workload.evaluate(reference, WORKLOAD).withColumnRenamed("answer", "target")
    b = workload.evaluate(synthetic, WORKLOAD).withColumnRenamed("answer", "q")
    n = synthetic.count()
    both = a.join(b, "qid")
    return both.withColumn("eps", scoring.residual(F.col("target"), F.col("q"), n, geometry=geometry)), synthetic, n


_AB = f"WITH {SIDES}, a AS ({answers_sql('ref', 'target')}), b AS ({answers_sql('syn', 'q')}), t AS (SELECT count(*) AS n FROM syn), x AS (SELECT qid, target, q, n FROM a JOIN b USING (qid), t)"


@query("a03_counts_and_residuals", f"{_AB} SELECT qid, target, q, round((target - q) / CAST(n AS DOUBLE), 6) AS eps FROM x")
def a03(spark, sf_dir):
    x, _, _ = _scored(spark, sf_dir)
    return x.select("qid", "target", "q", r6("eps", "eps"))


@query("a05_verify", f"{_AB} SELECT qid, target AS expected, q AS answer FROM x WHERE target <> q")
def a05(spark, sf_dir):
    reference, synthetic = sides(spark, sf_dir)
    stored = workload.evaluate(reference, WORKLOAD).select("qid", F.col("answer").alias("expected"))
    return workload.evaluate(synthetic, WORKLOAD).join(stored, "qid").where("answer <> expected").select("qid", "expected", "answer")


@query("a06_row_frequency", f"WITH {LI} SELECT copies, count(*) AS states FROM (SELECT count(*) AS copies FROM li GROUP BY qty, flag, line, disc, tax) GROUP BY 1")
def a06(spark, sf_dir):
    return compare.row_counts(lines(spark, sf_dir), ALL).groupBy(F.col("n").alias("copies")).agg(F.count("*").alias("states"))


def _cells_sql(order: int, table: str = "li", names=NAMES, name: str = "n") -> str:
    return " UNION ALL ".join(
        f"SELECT '{','.join(s)}' AS attrs, {(' || ' + chr(39) + '|' + chr(39) + ' || ').join(f'CAST({a} AS VARCHAR)' for a in s)} AS key, count(*) AS {name} FROM {table} GROUP BY 1, 2" for s in combinations(names, order)
    )


def _domain_sql(order: int, domains: dict) -> str:
    value = lambda a: f"(SELECT CAST(unnest([{', '.join(repr(str(v)) for v in domains[a])}]) AS VARCHAR) AS v)"
    return " UNION ALL ".join(
        f"SELECT '{','.join(s)}' AS attrs, {(' || ' + chr(39) + '|' + chr(39) + ' || ').join(f'd{k}.v' for k in range(order))} AS key FROM {', '.join(f'{value(a)} d{k}' for k, a in enumerate(s))}" for s in combinations(domains, order)
    )


for _k in (1, 2, 3):

    @query(f"a07_contingency_{_k}way", f"WITH {LI}, c AS ({_cells_sql(_k, names=tuple(DOMAINS))}), e AS ({_domain_sql(_k, DOMAINS)}) SELECT e.attrs, e.key, coalesce(n, 0) AS n FROM e LEFT JOIN c ON e.attrs = c.attrs AND e.key = c.key")
    def a07(spark, sf_dir, k=_k):
        return contingency.completed(lines(spark, sf_dir), DOMAINS, k)


@query("a08_pair_tables", f"WITH {LI} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y, count(*) AS n FROM li GROUP BY 3, 4" for a, b in (("flag", "line"), ("flag", "disc"), ("line", "disc"))))
def a08(spark, sf_dir):
    return contingency.pair_counts(lines(spark, sf_dir), NAMES)


@query("a09_summaries", f"WITH {LI} SELECT flag, round(avg(qty), 6) AS mean, round(stddev_pop(qty), 6) AS std, min(qty) AS low, max(qty) AS high FROM li GROUP BY flag")
def a09(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("flag").agg(r6(F.avg("qty"), "mean"), r6(F.stddev_pop("qty"), "std"), F.min("qty").alias("low"), F.max("qty").alias("high"))


@query("a17_duplicates", f"WITH {LI}, s AS (SELECT count(*) AS n FROM li GROUP BY flag, line, disc, tax) SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, round(1 - count(*) / CAST(sum(n) AS DOUBLE), 6) AS duplicate_rate FROM s")
def a17(spark, sf_dir):
    s = compare.row_counts(lines(spark, sf_dir), ("flag", "line", "disc", "tax"))
    return s.agg(F.sum("n").alias("total_rows"), F.count("*").alias("distinct_rows"), r6(1 - F.count("*") / F.sum("n"), "duplicate_rate"))


@query("r01_residual_tolerance", f"{_AB} SELECT qid, round(sign(target - q) * greatest(abs(target - q) - 2.0 * 15.0, 0.0) / n, 6) AS eps FROM x")
def r01(spark, sf_dir):
    x, _, n = _scored(spark, sf_dir)
    return x.select("qid", r6(scoring.residual(F.col("target"), F.col("q"), n, F.lit(15.0), 2.0), "eps"))


@query("r02_residual_relative", f"{_AB} SELECT qid, round((target - q) / greatest(CAST(target AS DOUBLE), 8.0) / n, 9) AS eps FROM x")
def r02(spark, sf_dir):
    x, _, _ = _scored(spark, sf_dir, "relative")
    return x.select("qid", F.round("eps", 9).alias("eps"))


@query("r03_weighted_loss", f"{_AB} SELECT round(0.5 * CAST(sum((qid + 1) * (target - q) * (target - q)) AS DOUBLE), 6) AS loss FROM x")
def r03(spark, sf_dir):
    x, _, _ = _scored(spark, sf_dir)
    return x.agg(r6(scoring.loss(F.col("target"), F.col("q"), weight=F.col("qid") + 1), "loss"))


@query("r06_all_metrics", f"{_AB} SELECT round(avg(abs(target - q)) / max(n), 6) AS l1, 0.5 * CAST(sum((target - q) * (target - q)) AS DOUBLE) AS squared_loss, CAST(sum(target - q) AS BIGINT) AS raw FROM x")
def r06(spark, sf_dir):
    x, _, n = _scored(spark, sf_dir)
    t, q = F.col("target"), F.col("q")
    return x.agg(r6(scoring.normalized_l1(t, q, n), "l1"), scoring.loss(t, q).alias("squared_loss"), F.sum(t - q).alias("raw"))


@query("r07_error_metrics", f"{_AB}, e AS (SELECT abs(target - q) / CAST(n AS DOUBLE) AS e, (target - q) AS g FROM x) SELECT count(*) AS query_count, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90, round(max(e), 6) AS max, 0.5 * CAST(sum(g * g) AS DOUBLE) AS squared_loss FROM e")
def r07(spark, sf_dir):
    x, _, n = _scored(spark, sf_dir)
    return scoring.error_metrics(x, n).select("query_count", *(r6(c, c) for c in ("mean", "median", "p90", "max")), "squared_loss")


_FIT = f"{_AB}, w AS (SELECT qid, (target - q) / CAST(n AS DOUBLE) AS eps, q / CAST(n AS DOUBLE) AS p FROM x), st AS (SELECT qty, flag, line, disc, tax, count(*) AS c FROM syn GROUP BY ALL)"
_GAIN = " + ".join(f"(CASE WHEN {query_sql(q)} THEN (SELECT eps FROM w WHERE qid = {k}) ELSE 0 END)" for k, q in enumerate(WORKLOAD))


def _states(synthetic):
    s = compare.row_counts(synthetic, ALL)
    return s.withColumn("sid", F.concat_ws("|", *(F.col(a).cast("string") for a in ALL)))


@query("f01_fitness", f"{_FIT} SELECT flag, line, round(sum(c * ({_GAIN} - (SELECT sum(eps * p) FROM w))), 4) AS total FROM st GROUP BY 1, 2")
def f01(spark, sf_dir):
    x, synthetic, n = _scored(spark, sf_dir)
    s = _states(synthetic)
    f = scoring.fitness(s, WORKLOAD, x, "sid", n)
    return s.join(f, "sid").groupBy("flag", "line").agg(F.round(F.sum(F.col("n") * F.col("fitness")), 4).alias("total"))


@query("f02_potential", f"{_FIT} SELECT flag, disc, round(sum(c * ({_GAIN})), 4) AS total FROM st GROUP BY 1, 2")
def f02(spark, sf_dir):
    x, synthetic, n = _scored(spark, sf_dir)
    s = _states(synthetic)
    f = scoring.fitness(s, WORKLOAD, x, "sid", n, centred=False)
    return s.join(f, "sid").groupBy("flag", "disc").agg(F.round(F.sum(F.col("n") * F.col("fitness")), 4).alias("total"))


_ACC = f"{_AB}, y AS (SELECT a.qid, a.target, a.q, (a.q + a.target) // 2 AS c, a.n FROM x a), d AS (SELECT 0.5 * CAST(sum((target - c) * (target - c) - (target - q) * (target - q)) AS DOUBLE) AS dq, (avg(abs(target - c)) - avg(abs(target - q))) / max(n) AS dl1 FROM y)"


def _steps(spark, sf_dir):
    x, _, n = _scored(spark, sf_dir)
    t, q, c = F.col("target"), F.col("q"), F.expr("(q + target) div 2")
    return x.withColumn("c", c).agg((0.5 * F.sum((t - F.col("c")) * (t - F.col("c")) - (t - q) * (t - q))).alias("dq"), ((F.avg(F.abs(t - F.col("c"))) - F.avg(F.abs(t - q))) / n).alias("dl1"))


@query("ac1_accept_loss", f"{_ACC} SELECT dq, dq < -1.0 AS accepted FROM d")
def ac1(spark, sf_dir):
    d = _steps(spark, sf_dir)
    return d.select("dq", scoring.accept("A0", F.col("dq"), F.col("dl1"), 1.0).alias("accepted"))


@query("ac2_accept_l1", f"{_ACC} SELECT round(dl1, 6) AS dl1, CASE WHEN dl1 < -0.5 THEN true WHEN abs(dl1) <= 0.5 THEN dq < -1.0 ELSE false END AS accepted FROM d")
def ac2(spark, sf_dir):
    d = _steps(spark, sf_dir)
    return d.select(r6("dl1", "dl1"), scoring.accept("A1", F.col("dq"), F.col("dl1"), 1.0, 0.5).alias("accepted"))


@query("ac3_loop_gate", f"{_ACC} SELECT dq <= 0.0 AS accepted FROM d")
def ac3(spark, sf_dir):
    return _steps(spark, sf_dir).select((F.col("dq") <= 0.0).alias("accepted"))


@query("j01_states_by_workload", f"WITH {LI}, st AS (SELECT qty, flag, line, disc, tax, count(*) AS n FROM li GROUP BY ALL) " + " UNION ALL ".join(f"SELECT {k} AS qid, count(*) AS states, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM st WHERE {query_sql(q)} HAVING count(*) > 0" for k, q in enumerate(WORKLOAD)))
def j01(spark, sf_dir):
    s = compare.row_counts(lines(spark, sf_dir), ALL)
    return workload.matches(s, WORKLOAD, ["n"]).groupBy("qid").agg(F.count("*").alias("states"), F.sum("n").alias("total"))


_UNION = f"WITH {SIDES}, a AS (SELECT flag, line, disc, tax, count(*) AS a FROM ref GROUP BY ALL), b AS (SELECT flag, line, disc, tax, count(*) AS b FROM syn GROUP BY ALL), u AS (SELECT flag, line, disc, tax, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (flag, line, disc, tax)), t AS (SELECT sum(a) AS na, sum(b) AS nb FROM u)"
FOUR = ("flag", "line", "disc", "tax")


@query("j06_support_union", f"{_UNION} SELECT flag, line, disc, tax, a, b FROM u")
def j06(spark, sf_dir):
    return compare.support_union(*sides(spark, sf_dir), FOUR)


@query("j07_only_in_reference", f"WITH {SIDES} SELECT DISTINCT qty, flag, line, disc, tax FROM ref EXCEPT SELECT qty, flag, line, disc, tax FROM syn")
def j07(spark, sf_dir):
    return compare.only_in(*sides(spark, sf_dir), ALL)


@query("j08_domain_completion", f"WITH {LI}, c AS ({_cells_sql(2, names=('flag', 'tax'))}), e AS ({_domain_sql(2, {'flag': ('A', 'N', 'R', 'X'), 'tax': range(12)})}) SELECT e.attrs, e.key, coalesce(n, 0) AS n FROM e LEFT JOIN c ON e.attrs = c.attrs AND e.key = c.key")
def j08(spark, sf_dir):
    return contingency.completed(lines(spark, sf_dir), {"flag": ("A", "N", "R", "X"), "tax": range(12)}, 2)


@query("j09_unmeasured_cells", f"WITH e AS ({_domain_sql(2, DOMAINS)}) SELECT attrs, count(*) AS cells FROM e WHERE NOT (attrs = 'flag,line' AND key LIKE 'A|%') GROUP BY 1")
def j09(spark, sf_dir):
    every = contingency.domain_cells(spark, DOMAINS, 2)
    measured = every.where((F.col("attrs") == "flag,line") & F.col("key").startswith("A|"))
    return every.join(measured, ["attrs", "key"], "left_anti").groupBy("attrs").agg(F.count("*").alias("cells"))


@query("j12_attribute_bridge", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {k})" for a, k in sorted({(c["attribute"], k) for k, q in enumerate(WORKLOAD) for c in q["conditions"]})) + ") t(attr, qid)")
def j12(spark, sf_dir):
    return workload.bridge(lines(spark, sf_dir), WORKLOAD)


@query("q01_query_fingerprints", "SELECT * FROM (VALUES " + ", ".join(f"({k}, sha256('{workload.canonical(q)}'))" for k, q in enumerate(WORKLOAD) if q["conditions"]) + ") t(qid, fingerprint)")
def q01(spark, sf_dir):
    rows = [(k, workload.canonical(q)) for k, q in enumerate(WORKLOAD) if q["conditions"]]
    return spark.createDataFrame(rows, "qid int, payload string").select("qid", F.sha2(F.col("payload").cast("binary"), 256).alias("fingerprint"))


@query("q03_validity", f"WITH {LI} SELECT * FROM (SELECT 'qty' AS attribute, CAST(sum(CASE WHEN qty BETWEEN 1 AND 40 THEN 0 ELSE 1 END) AS BIGINT) AS invalid_count, round(1 - sum(CASE WHEN qty BETWEEN 1 AND 40 THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE), 6) AS valid_rate FROM li UNION ALL SELECT 'flag', CAST(sum(CASE WHEN flag IN ('A', 'N') THEN 0 ELSE 1 END) AS BIGINT), round(1 - sum(CASE WHEN flag IN ('A', 'N') THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE), 6) FROM li UNION ALL SELECT 'line', 0, 1.0 UNION ALL SELECT '*', CAST(sum(CASE WHEN qty BETWEEN 1 AND 40 AND flag IN ('A', 'N') THEN 0 ELSE 1 END) AS BIGINT), round(1 - sum(CASE WHEN qty BETWEEN 1 AND 40 AND flag IN ('A', 'N') THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE), 6) FROM li)")
def q03(spark, sf_dir):
    return contingency.validity(lines(spark, sf_dir), _TIGHT).select("attribute", "invalid_count", r6("valid_rate", "valid_rate"))


_DIV = "SELECT CAST(max(t) AS BIGINT) AS total_rows, count(*) AS unique_rows, round(1 - count(*) / max(t), 6) AS duplicate_rate, round(-sum(n / t * ln(n / t)), 6) AS entropy, round(exp(-sum(n / t * ln(n / t))), 3) AS effective_rows, round(-sum(n / t * ln(n / t)) / ln(max(t)), 6) AS normalized_entropy"


@query("q04_diversity", f"WITH {LI}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM li GROUP BY flag, line, disc, tax), u AS (SELECT n, sum(n) OVER () AS t FROM s) {_DIV} FROM u")
def q04(spark, sf_dir):
    d = compare.diversity(lines(spark, sf_dir), FOUR)
    return d.select(F.col("rows").alias("total_rows"), "unique_rows", *(r6(c, c) for c in ("duplicate_rate", "entropy")), F.round("effective_rows", 3).alias("effective_rows"), r6("normalized_entropy", "normalized_entropy"))


@query("q04_attribute_diversity", f"WITH {LI}, c AS ({_cells_sql(1, names=FOUR)}), t AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY attrs) AS DOUBLE) AS p FROM c) SELECT attrs AS attribute, round(exp(-sum(p * ln(p))), 6) AS effective_support, round(exp(-sum(p * ln(p))) / max(CASE attrs WHEN 'flag' THEN 3 WHEN 'line' THEN 7 WHEN 'disc' THEN 11 ELSE 9 END), 6) AS ratio FROM t GROUP BY 1")
def q04b(spark, sf_dir):
    d = compare.attribute_diversity(lines(spark, sf_dir), FOUR, {k: len(v) for k, v in DOMAINS.items()})
    return d.select("attribute", r6("effective_support", "effective_support"), r6("ratio", "ratio"))


@query("q05_support", f"{_UNION} SELECT CAST(count(*) FILTER (WHERE a > 0 AND b > 0) AS BIGINT) AS unique_overlap, round(sum(CASE WHEN a > 0 THEN b ELSE 0 END) / CAST(sum(b) AS DOUBLE), 6) AS mass_inside, round(sum(CASE WHEN b > 0 THEN a ELSE 0 END) / CAST(sum(a) AS DOUBLE), 6) AS mass_covered FROM u")
def q05(spark, sf_dir):
    s = compare.support_metrics(*sides(spark, sf_dir), FOUR)
    return s.select("unique_overlap", r6("mass_inside", "mass_inside"), r6("mass_covered", "mass_covered"))


for _k in (2, 3):

    @query(
        f"q07_cell_error_{_k}way",
        f"WITH {SIDES}, e AS ({_domain_sql(_k, DOMAINS)}), a AS ({_cells_sql(_k, 'ref', tuple(DOMAINS), 'a')}), b AS ({_cells_sql(_k, 'syn', tuple(DOMAINS), 'b')}), t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ref), "
        "d AS (SELECT abs(coalesce(a, 0) - coalesce(b, 0)) / n AS v FROM e LEFT JOIN a ON e.attrs = a.attrs AND e.key = a.key LEFT JOIN b ON e.attrs = b.attrs AND e.key = b.key, t) "
        "SELECT count(*) AS cells, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS max FROM d",
    )
    def q07(spark, sf_dir, k=_k):
        reference, synthetic = sides(spark, sf_dir)
        return contingency.cell_errors(reference, synthetic, DOMAINS, k, reference.count()).select("cells", *(r6(c, c) for c in ("mean", "median", "p90", "max")))


@query("q08_joint_tvd", f"{_UNION} SELECT round(0.5 * sum(abs(a / CAST(na AS DOUBLE) - b / CAST(nb AS DOUBLE))), 6) AS tvd, CAST(count(*) FILTER (WHERE b > 0) AS BIGINT) AS unique_rows, round(1 - count(*) FILTER (WHERE b > 0) / CAST(max(nb) AS DOUBLE), 6) AS duplicate_rate, CAST(count(*) FILTER (WHERE a > 0 AND b > 0) AS BIGINT) AS overlap, round(sum(CASE WHEN b = 0 THEN a ELSE 0 END) / CAST(max(na) AS DOUBLE), 6) AS missing_reference_mass, round(sum(CASE WHEN a = 0 THEN b ELSE 0 END) / CAST(max(nb) AS DOUBLE), 6) AS novel_mass FROM u, t")
def q08(spark, sf_dir):
    m = compare.joint_metrics(*sides(spark, sf_dir), FOUR)
    return m.select(r6("tvd", "tvd"), "unique_rows", r6("duplicate_rate", "duplicate_rate"), "overlap", r6("missing_reference_mass", "missing_reference_mass"), r6("novel_mass", "novel_mass"))


_TOP = "SELECT flag, line, disc, tax, count(*) AS n FROM {t} GROUP BY ALL ORDER BY n DESC, flag, line, disc, tax LIMIT 10"


@query("q10_top_cover", f"WITH {SIDES}, a AS ({_TOP.format(t='ref')}), b AS ({_TOP.format(t='syn')}), i AS (SELECT flag, line, disc, tax FROM a INTERSECT SELECT flag, line, disc, tax FROM b) SELECT round((SELECT max(n) FROM b) / CAST((SELECT count(*) FROM syn) AS DOUBLE), 6) AS top_rate, (SELECT count(*) FROM i) AS top_cover")
def q10(spark, sf_dir):
    return compare.top_cover(*sides(spark, sf_dir), FOUR).select(r6("top_rate", "top_rate"), "top_cover")


_PAIR = f"WITH {LI}, one AS ({_cells_sql(1)}), pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y, CAST(count(*) AS DOUBLE) AS n FROM li GROUP BY 3, 4" for a, b in (("flag", "line"), ("flag", "disc"), ("line", "disc"))) + "), t AS (SELECT CAST(count(*) AS DOUBLE) AS tot FROM li), z AS (SELECT pr.*, u.n * v.n / tot AS e, tot FROM pr JOIN one u ON u.attrs = a AND u.key = x JOIN one v ON v.attrs = b AND v.key = y, t)"


@query("q12_pair_association", f"{_PAIR} SELECT a, b, round((sum(n * n / e) - max(tot)) / max(tot), 6) AS phi2, round(2 * sum(n * ln(n / e)), 5) AS g2 FROM z GROUP BY 1, 2")
def q12(spark, sf_dir):
    return contingency.association(lines(spark, sf_dir), NAMES).select("a", "b", r6("phi2", "phi2"), F.round("g2", 5).alias("g2"))


@query("q13_three_way_score", f"{_PAIR}, g2 AS (SELECT a, b, 2 * sum(n * ln(n / e)) AS g FROM z GROUP BY 1, 2), tr AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(flag AS VARCHAR) AS f, CAST(line AS VARCHAR) AS l, CAST(disc AS VARCHAR) AS d FROM li GROUP BY 2, 3, 4), g3 AS (SELECT 2 * sum(tr.n * ln(tr.n * tot * tot / (u.n * v.n * w.n))) AS g FROM tr JOIN one u ON u.attrs = 'flag' AND u.key = f JOIN one v ON v.attrs = 'line' AND v.key = l JOIN one w ON w.attrs = 'disc' AND w.key = d, t) SELECT 'flag' AS a, 'line' AS b, 'disc' AS c, round(g3.g - (SELECT sum(g) FROM g2), 4) AS score FROM g3")
def q13(spark, sf_dir):
    return contingency.three_way_scores(lines(spark, sf_dir), NAMES).select("a", "b", "c", F.round("score", 4).alias("score"))


@query("q14_top_residual_cells", f"{_PAIR}, r AS (SELECT a, b, x, y, CAST(n AS BIGINT) AS n, round(abs(n - e) / sqrt(e), 6) AS z FROM z WHERE n >= 30) SELECT a, b, x, y, n, z, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY z DESC, x, y) AS rank FROM r) WHERE rank <= 2")
def q14(spark, sf_dir):
    return contingency.top_residual_cells(lines(spark, sf_dir), NAMES)


_CELL_BINS = {"qty": [(1, 25), (26, 50)], "flag": ["A", "N", "R"]}


@query("q16_cell_queries", f"WITH {LI} " + " UNION ALL ".join(f"SELECT {k} AS qid, count(*) AS answer FROM li WHERE {query_sql(q)}" for k, q in enumerate(contingency.cell_queries(_CELL_BINS, 2))))
def q16(spark, sf_dir):
    return workload.evaluate(lines(spark, sf_dir), contingency.cell_queries(_CELL_BINS, 2))


_MG_COND = [("qty", ">=", 10, None, None), ("qty", "<", 30, None, None), ("qty", "<=", 19, None, None), ("qty", ">", 44, None, None), ("qty", "==", 50, None, None), ("disc", "between", None, 3, 7), ("disc", "like", 1, None, None)]
_MG_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in c) + ")" for c in _MG_COND)
_CUTS = f"""c(attribute, operator, value, lower, upper) AS (VALUES {_MG_VALUES}), cuts AS (SELECT DISTINCT attribute, cut FROM (
 SELECT attribute, value AS cut FROM c WHERE operator IN ('>=', '<') UNION ALL SELECT attribute, value + 1 FROM c WHERE operator IN ('>', '<=') UNION ALL SELECT attribute, value FROM c WHERE operator = '=='
 UNION ALL SELECT attribute, value + 1 FROM c WHERE operator = '==' UNION ALL SELECT attribute, lower FROM c WHERE operator = 'between' UNION ALL SELECT attribute, upper + 1 FROM c WHERE operator = 'between')),
 r(attribute, low, high) AS (VALUES ('qty', 1, 50), ('disc', 0, 10), ('tax', 0, 8)),
 pts AS (SELECT attribute, least(greatest(cut, low), high + 1) AS cut FROM cuts JOIN r USING (attribute) UNION SELECT attribute, low FROM r WHERE attribute IN (SELECT attribute FROM cuts) UNION SELECT attribute, high + 1 FROM r WHERE attribute IN (SELECT attribute FROM cuts)),
 bins AS (SELECT attribute, cut AS lo, nxt - 1 AS hi FROM (SELECT attribute, cut, lead(cut) OVER (PARTITION BY attribute ORDER BY cut) AS nxt FROM pts) WHERE nxt IS NOT NULL)"""


def _conditions(spark):
    return spark.createDataFrame(_MG_COND, "attribute string, operator string, value int, lower int, upper int")


def _bins(spark):
    return contingency.derive_bins(_conditions(spark), spark.createDataFrame([("qty", 1, 50), ("disc", 0, 10), ("tax", 0, 8)], "attribute string, low int, high int"))


@query("mg1_cut_points", f"WITH {_CUTS} SELECT attribute, cut FROM cuts")
def mg1(spark, sf_dir):
    return contingency.cut_points(_conditions(spark))


@query("mg2_derived_bins", f"WITH {_CUTS} SELECT attribute, lo, hi FROM bins")
def mg2(spark, sf_dir):
    return _bins(spark)


_BIN_COUNTS = f"{_CUTS}, {LI}, mc AS (SELECT b.attribute, lo, hi, count(v) AS n FROM bins b LEFT JOIN (SELECT 'qty' AS attribute, qty AS v FROM li UNION ALL SELECT 'disc', disc FROM li) x ON x.attribute = b.attribute AND v BETWEEN lo AND hi GROUP BY 1, 2, 3)"


@query("mg3_bin_counts", f"WITH {_BIN_COUNTS} SELECT * FROM mc")
def mg3(spark, sf_dir):
    return contingency.bin_counts(lines(spark, sf_dir), _bins(spark))


@query("mg4_largest_remainder", f"WITH {_BIN_COUNTS}, s AS (SELECT attribute, lo AS cell, n * 1000.0 / sum(n) OVER (PARTITION BY attribute) AS v FROM mc), q AS (SELECT attribute, cell, floor(v) AS f, row_number() OVER (PARTITION BY attribute ORDER BY round(v - floor(v), 9) DESC, cell) AS k, 1000 - sum(floor(v)) OVER (PARTITION BY attribute) AS rest FROM s) SELECT attribute, cell, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q")
def mg4(spark, sf_dir):
    counts = contingency.bin_counts(lines(spark, sf_dir), _bins(spark)).select("attribute", F.col("lo").alias("cell"), "n")
    return contingency.quotas(counts, 1000)
