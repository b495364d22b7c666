"""Hand-computed values, invariants and errors."""

import math
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom import engine, sources
from countloom.functions import coerce_literal, condition
from countloom.operators import compare, contingency, init, kernels, pairs, scoring, stats, trajectory, workload
from countloom.schema import CATEGORICAL, NUMERIC, Attribute, Schema


def eq(a, v):
    return {"attribute": a, "operator": "==", "value": v}


def answers(spark, target, q):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(target, q))], "qid int, target double, q double")


def test_four_state_fitness(spark):
    df = spark.createDataFrame([(0, "0", "0"), (1, "0", "1"), (2, "1", "0"), (3, "1", "1")], "rid long, a string, b string")
    queries = [{"conditions": [eq("a", "0")]}, {"conditions": [eq("b", "0")]}]
    x = workload.evaluate(df, queries).withColumnRenamed("answer", "q").withColumn("eps", F.when(F.col("qid") == 0, -0.125).otherwise(0.125))
    got = {r.rid: r.fitness for r in scoring.fitness(df, queries, x, "rid", 4).collect()}
    assert got == {0: 0.0, 1: -0.125, 2: 0.125, 3: 0.0}


def test_residual_loss_and_l1(spark):
    x = answers(spark, [180, 95, 42], [170, 100, 42])
    t, q = F.col("target"), F.col("q")
    eps = [r.e for r in x.select("qid", scoring.residual(t, q, 300).alias("e")).orderBy("qid").collect()]
    assert np.allclose(eps, [10 / 300, -5 / 300, 0])
    r = x.agg(scoring.loss(t, q).alias("loss"), scoring.normalized_l1(t, q, 300).alias("l1")).first()
    assert r.loss == 62.5 and math.isclose(r.l1, 5 / 300)
    wide = [r.e for r in x.select("qid", scoring.residual(t, q, 300, F.lit(4.0), 2.0).alias("e")).orderBy("qid").collect()]
    assert np.allclose(wide, [2 / 300, 0, 0])
    rel = [r.e for r in x.select("qid", scoring.residual(t, q, 300, geometry="relative", floor=100).alias("e")).orderBy("qid").collect()]
    assert np.allclose(rel, [10 / 180 / 300, -5 / 100 / 300, 0])
    with pytest.raises(ValueError):
        scoring.residual(t, q, 300, geometry="other")


def test_error_metrics(spark):
    r = scoring.error_metrics(answers(spark, [4, 0, 2], [2, 1, 2]), 4).first()
    assert (r.query_count, r["median"], r["max"], r.squared_loss) == (3, 0.25, 0.5, 2.5)
    with pytest.raises(Exception, match="no queries"):
        scoring.error_metrics(answers(spark, [4], [2]).limit(0), 4).collect()


def test_literals_and_missing_values(spark):
    df = spark.createDataFrame([("0", 1, 1.0), ("1", 2, float("nan")), ("2_plus", None, None), ("0", 3, 2.0)], "s string, i int, d double")
    count = lambda *c: workload.count_one(df, {"conditions": list(c)})
    assert count(eq("s", 0)) == 2 and count(eq("i", "2")) == 1 and count(eq("i", "x")) == 0
    assert count({"attribute": "d", "operator": ">=", "value": 0}) == 2
    assert count({"attribute": "d", "operator": "between", "lower": 0, "upper": 5}) == 2
    assert count() == 4
    assert coerce_literal(df.schema["i"].dataType, "2.5") == 2.5
    with pytest.raises(ValueError, match="unknown operator"):
        condition(F.col("i"), df.schema["i"].dataType, {"operator": "<", "value": 1})
    queries = [{"conditions": c} for c in ([], [eq("i", "x")], [eq("s", 0), {"attribute": "d", "operator": ">=", "value": 0}], [{"attribute": "d", "operator": ">=", "value": 0}])]
    assert [r.answer for r in workload.evaluate(df, queries).orderBy("qid").collect()] == [4, 0, 2, 2]
    assert workload.evaluate(df, []).count() == 0
    with pytest.raises(ValueError, match="unknown attribute"):
        workload.evaluate(df, [{"conditions": [eq("zz", 1)]}])


def test_workload_does_not_depend_on_plan_or_partitions(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 7).cast("int").alias("a"), (F.col("id") % 5).cast("string").alias("b"), (F.col("id") % 11).cast("int").alias("c"))
    queries = [{"conditions": [eq("a", k)]} for k in range(7)] + [{"conditions": [eq("b", k), {"attribute": "c", "operator": ">=", "value": k}]} for k in range(5)]
    want = [workload.count_one(df, q) for q in queries]
    answer = lambda x: [r.answer for r in workload.evaluate(x, queries).orderBy("qid").collect()]
    assert answer(df) == answer(df.repartition(7)) == want
    monkeypatch.setattr(workload, "BROADCAST_BOUNDS", 0)
    assert answer(df) == want


def test_workload_of_many_shapes_and_ranges(spark, monkeypatch):
    """A thousand queries of up to three of ten attributes: more shapes than a plan could name, ranges in bins, every join by equal keys."""
    rng, names = np.random.default_rng(2), [f"a{k}" for k in range(10)]
    values = [tuple(int(v) if rng.random() > 0.02 else None for v in r) for r in rng.integers(0, 9, (400, 10))]
    df = spark.createDataFrame(values, ", ".join(f"{n} {'double' if k % 3 == 0 else 'long'}" for k, n in enumerate(names)).replace("double", "int"))
    queries = []
    for k in range(1000):
        cs = []
        for a in rng.choice(names, 1 if k % 3 == 0 else int(rng.integers(1, 4)), replace=False):
            low, high = sorted(int(v) for v in rng.integers(-1, 10, 2))
            cs.append([eq(str(a), low), {"attribute": str(a), "operator": ">=", "value": low + 0.5}, {"attribute": str(a), "operator": "between", "lower": low, "upper": high}][int(rng.integers(3))])
        queries.append({"conditions": cs})
    monkeypatch.setattr(workload, "BINNED", 8)
    w = workload.compile_workload(df, queries)
    assert len(w.shapes) > 64 and any(p[2] >= 0 for p in w.patterns)
    holds = lambda v, c: v is not None and (v == c["value"] if c["operator"] == "==" else v >= c["value"] if c["operator"] == ">=" else c["lower"] <= v <= c["upper"])
    want = [sum(all(holds(r[names.index(c["attribute"])], c) for c in q["conditions"]) for r in values) for q in queries]
    assert [r.answer for r in workload.evaluate(df, queries).orderBy("qid").collect()] == want
    met = workload.matches(df.withColumn("rid", F.monotonically_increasing_id()), queries, ["rid"])
    assert {r.qid: r["count"] for r in met.groupBy("qid").count().collect()} == {k: n for k, n in enumerate(want) if n}
    plan = workload.evaluate(df, queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bounds_beyond_doubles(spark):
    df = spark.createDataFrame([(9007199254740993, Decimal("0.10"), -0.0)], "i long, m decimal(10,2), d double")
    tests = [[eq("i", 9007199254740992)], [eq("i", 9007199254740993)], [{"attribute": "i", "operator": ">=", "value": 9007199254740993.0}], [{"attribute": "m", "operator": "between", "lower": 0.1, "upper": 0.1}], [eq("d", 0)], [{"attribute": "i", "operator": ">=", "value": 1e30}]]
    queries = [{"conditions": c} for c in tests]
    got = [r.answer for r in workload.evaluate(df, queries).orderBy("qid").collect()]
    assert got == [0, 1, 1, 1, 1, 0]


def test_fingerprints():
    a = {"id": "x", "conditions": [eq("a", 1), eq("b", 2)]}
    b = {"id": "y", "result": 3, "conditions": [eq("b", 2), eq("a", 1)]}
    assert workload.fingerprint(a) == workload.fingerprint(b)
    with pytest.raises(ValueError):
        workload.set_identity([a, b])
    with pytest.raises(ValueError):
        workload.check_partition([a], [b])
    with pytest.raises(ValueError):
        workload.fingerprint({"conditions": []})
    c = {"conditions": [eq("a", 2)]}
    assert workload.set_identity([a, c]) == workload.set_identity([c, a]) and workload.set_identity([a, c], True) != workload.set_identity([c, a], True)


def test_three_way_score_of_counts_whose_product_is_beyond_a_long(spark):
    # c is the parity of a and b: pairs are independent, a triple's cells hold N / 4 rows for N / 8 expected.
    n = 6_000_000
    a, b = F.col("id") % 2, F.floor(F.col("id") / 2) % 2
    r = contingency.three_way_scores(spark.range(n).select(a.alias("a"), b.alias("b"), ((a + b) % 2).alias("c")), ["a", "b", "c"]).collect()
    assert [(x.a, x.b, x.c) for x in r] == [("a", "b", "c")] and math.isclose(r[0].score, 2 * n * math.log(2))


def test_validity_and_support(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", float("nan")), ("z", 99.0)], "category string, number double")
    schema = Schema((Attribute("category", CATEGORICAL, ("a", "b")), Attribute("number", NUMERIC, low=0, high=10)))
    got = {r.attribute: (r.invalid_count, r.valid_rate) for r in contingency.validity(df, schema).collect()}
    assert got == {"category": (2, 0.5), "number": (2, 0.5), "*": (3, 0.25)}
    one = lambda s: spark.createDataFrame([(c,) for c in s], "x string")
    r = compare.support_metrics(one("aabb"), one("aacc"), ["x"]).first()
    assert (r.unique_overlap, r.mass_inside, r.mass_covered) == (1, 0.5, 0.5)
    d = compare.diversity(one("aaaa"), ["x"]).first()
    assert (d.unique_rows, d.entropy, d.normalized_entropy) == (1, 0.0, 0.0)
    assert compare.diversity(one("a"), ["x"]).first().normalized_entropy == 1.0


def test_quotas(spark):
    got = {r.cell: r.quota for r in contingency.quotas(spark.createDataFrame([("a", 0, 1.5), ("a", 1, 1.5), ("a", 2, -3.0), ("a", 3, 1.0)], "attribute string, cell int, n double"), 10).collect()}
    assert sum(got.values()) == 10 and got[2] == 0
    even = {r.cell: r.quota for r in contingency.quotas(spark.createDataFrame([("a", k, 0.0) for k in range(3)], "attribute string, cell int, n double"), 10).collect()}
    assert even == {0: 4, 1: 3, 2: 3}


def test_kernels_at_their_ends(spark):
    schema = Schema((Attribute("x", CATEGORICAL, ("a", "b", "c")), Attribute("n", NUMERIC, low=0, high=9)))
    now, donors = init.random_table(spark, schema, 60, 1), init.random_table(spark, schema, 60, 2)
    rows = lambda df: {r.rid: (r.x, r.n) for r in df.collect()}
    step = lambda *a, **k: rows(kernels.evolve_step(now, donors, schema, "rid", *a, seed=5, **k))
    assert step(0.0, 1.0, 1.0) == rows(now) and step(1.0, 0.0, 0.0) == rows(now) and step(1.0, 1.0, 0.0) == rows(donors)
    scores = spark.createDataFrame([(k, "x", 1.0) for k in range(60)], "rid long, attr string, score double")
    assert step(0.5, 0.5, 0.2) == step(0.5, 0.5, 0.2, scores=scores, strength=0.0)
    assert step(0.5, 0.5, 0.2) == rows(kernels.evolve_step(now.repartition(5), donors, schema, "rid", 0.5, 0.5, 0.2, 5))
    assert all(v in ("a", "b", "c") and 0 <= n <= 9 for v, n in step(1.0, 0.5, 1.0).values())


def test_exact_chain_and_strength():
    e = np.array([0.0, 0.5, -1.0, 2.0])
    prior = np.array([0.49, 0.21, 0.21, 0.09])
    want = prior * np.exp(1.5 * e)
    assert np.allclose(kernels.exact_chain(2, e, 0.3, 1.5, 400), want / want.sum(), atol=1e-9)
    s = kernels.strength_for_kl(e, prior, 0.2)
    p = prior * np.exp(s * e)
    p /= p.sum()
    assert math.isclose((p * np.log(p / prior)).sum(), 0.2, rel_tol=1e-6)
    with pytest.raises(ValueError):
        kernels.strength_for_kl(np.zeros(4), prior, 0.2)


def test_gibbs_chain_follows_its_distribution(spark):
    n = 4000
    rows = [(k, 2, [[0, 1]], [[0.0, 0.5, -1.0, 2.0]]) for k in range(n)]
    df = spark.createDataFrame(rows, "rid long, k int, scopes array<array<int>>, tables array<array<double>>")
    got = np.bincount([r["mask"] for r in kernels.gibbs_chain(df, 0.3, 1.5, 40, 3).collect()], minlength=4) / n
    assert np.abs(got - kernels.exact_chain(2, [0.0, 0.5, -1.0, 2.0], 0.3, 1.5, 40)).max() < 0.03
    again = {r.rid: r["mask"] for r in kernels.gibbs_chain(df.repartition(3), 0.3, 1.5, 40, 3).collect()}
    assert again == {r.rid: r["mask"] for r in kernels.gibbs_chain(df, 0.3, 1.5, 40, 3).collect()}


def test_draws_in_blocks_are_those_of_pairs(spark, monkeypatch):
    """Donors from the matrix against donors from rows of pairs, for every mode and either size of the pool."""
    rows = init.random_table(spark, SCHEMA, 60, 5).withColumn("__state", F.to_json(F.struct("x", "n"))).cache()
    fit = F.col("n") * 0.3 + (F.col("x") == "a").cast("double")
    pool = rows.groupBy(F.col("__state").alias("__cand"), "x", "n").agg(F.count("*").alias("__n")).withColumn("__fitness", fit).cache()
    for mode in pairs.MODES:
        for more in ({}, {"exclude_self": True, "scale_invariant": True, "alpha": 4.0}):
            got = {r.rid: r.cand for r in pairs.draw_donors(rows, pool, SCHEMA, 3, 1, mode, **more).collect()}
            monkeypatch.setattr(pairs, "POOL_ROWS", 2)
            want = {r.rid: r.cand for r in pairs.draw_donors(rows, pool, SCHEMA, 3, 1, mode, **more).collect()}
            monkeypatch.undo()
            assert got == want and len(got) == 60


def test_rms_at_the_ends_of_doubles(spark):
    of = lambda *v: kernels.rms(spark.createDataFrame([(x,) for x in v], "s double"), "s").first().scale
    assert math.isclose(of(1e200, 2e200), 1e200 * math.sqrt(2.5)) and math.isclose(of(3e-200, 4e-200), 1e-200 * math.sqrt(12.5))
    assert of(0.0, 0.0) == of() == 0.0


def test_heatbath_refuses_underflow(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0)], "g int, e double")
    assert [round(r.p, 6) for r in kernels.heatbath(df, "g", "e", 2.0).orderBy("e").collect()] == [0.880797, 0.119203]
    with pytest.raises(Exception, match="underflows"):
        kernels.heatbath(df, "g", "e", 1e5).collect()


def test_independent_groups_and_intervals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 2.0), ("b", 3.0), ("b", 7.0)], "g string, v double")
    r = stats.independent_test(df, "g", "v", "a", "b")
    assert r["dof"] == 4 and math.isclose(r["t"], -(5 / 3) / math.sqrt(14 / 3 * 2 / 3)) and math.isclose(r["p"], 0.398208, abs_tol=2e-6)
    i = {x.g: x for x in stats.mean_intervals(df, "g", "v").collect()}["a"]
    assert math.isclose(i.high - i.mean, 4.302652729911275 * math.sqrt(7 / 3) / math.sqrt(3), rel_tol=1e-9)


def test_maxent(spark):
    schema = Schema((Attribute("a", CATEGORICAL, ("x", "y")), Attribute("b", CATEGORICAL, ("x", "y")), Attribute("c", CATEGORICAL, ("x", "y"))))
    cells = [("a", "x", "b", "x", 30), ("a", "x", "b", "y", 10), ("a", "y", "b", "x", 20), ("b", "x", "c", "x", 40), ("b", "x", "c", "y", 10), ("b", "y", "c", "x", 25), ("b", "y", "c", "y", 25)]
    queries = [{"conditions": [eq(p, u), eq(q, v)], "result": n} for p, u, q, v, n in cells]
    targets = init.pair_targets(schema, queries, 100)
    assert np.allclose(targets[0, 1], [[0.3, 0.1], [0.2, 0.4]])  # the missing cell is what is left
    p, said = init.maxent(schema, targets)
    assert said["max_pair_error"] < 1e-8 and math.isclose(p.sum(), 1.0)
    table, _ = init.table_from_pairs(spark, schema, queries, 100, 0)
    assert table.count() == 100
    with pytest.raises(ValueError):
        init.enumerate_states(Schema((Attribute("n", NUMERIC, low=0, high=3),)))


def _trace(spark, statuses):
    """Evidence whose checks come out as given: p pass, m stable without movement, r running."""
    rows = [("run", k + 2, 10 * k, *([1.0 if s == "r" else 0.0] + [0.0] * 6), 0.0 if s == "m" else 1.0, 1.0) for k, s in enumerate(statuses)]
    names = "run string, block int, last_round int, query_mean_shift double, query_p95_shift double, query_max_shift double, l1_mean_shift double, l1_spread_shift double, unique_rate_shift double, entropy_shift double, least_active_rate double, least_changed_fraction double"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize(("statuses", "want"), [("rpp", "stationary_qualified"), ("prp", "running"), ("mm", "stalled"), ("mpm", "insufficient_movement"), ("rr", "running"), ("pmpp", "stationary_qualified")])
def test_detector(spark, statuses, want):
    assert trajectory.replay(_trace(spark, statuses), trajectory.Detector()).first().status == want


def test_detector_end_and_limits(spark):
    assert trajectory.replay(_trace(spark, "rr"), trajectory.Detector(), "max_rounds").first().status == "horizon_reached"
    assert trajectory.replay(_trace(spark, "rr"), trajectory.Detector(), "exact").first().status == "terminated_before_qualification"
    with pytest.raises(ValueError):
        trajectory.Detector(window_size=0)


def test_statistics(spark):
    assert math.isclose(stats.t_two_sided(2.262157, 9), 0.05, rel_tol=1e-5) and math.isclose(stats.t_quantile(0.975, 9), 2.262157, rel_tol=1e-6)
    a = spark.createDataFrame([(k, float(k)) for k in range(4)], "seed int, v double")
    r = stats.paired_test(stats.paired_rows(a, a.withColumn("v", F.col("v") - 1 - F.col("seed") * 0.1), "seed", "v"))
    assert r["wins"] == 4 and r["p"] < 0.05 and r["low"] < r["mean_diff"] < r["high"]
    assert stats.paired_test(stats.paired_rows(a, a, "seed", "v"))["p"] == 1.0
    with pytest.raises(Exception, match="one to one"):
        stats.paired_rows(a, a.where("seed < 3"), "seed", "v").collect()


def test_clock_and_interpolation(spark):
    df = spark.createDataFrame([("r", 1, 2.0, 10.0), ("r", 2, 0.0, 20.0), ("r", 3, 4.0, 40.0)], "run string, round int, ticks double, v double")
    c = trajectory.clock(df, "ticks", "v")
    assert sorted((r.clock, r.value) for r in c.collect()) == [(2.0, 20.0), (6.0, 40.0)]
    grid = spark.createDataFrame([(1.0,), (3.0,), (6.0,), (9.0,)], "at double")
    assert sorted((r.at, r.value) for r in trajectory.interpolate(c, grid).collect()) == [(3.0, 25.0), (6.0, 40.0)]
    with pytest.raises(Exception, match="backwards"):
        trajectory.clock(df.withColumn("ticks", F.lit(-1.0)), "ticks", "v").collect()


SCHEMA = Schema((Attribute("x", CATEGORICAL, ("a", "b")), Attribute("n", NUMERIC, low=0, high=4)))
QUERIES = [{"conditions": [eq("x", "a")]}, {"conditions": [{"attribute": "n", "operator": ">=", "value": 3}]}]


def test_evolution_gate_and_seeds(spark):
    targets = spark.createDataFrame([(0, 25), (1, 5)], "qid int, target long")
    config = engine.Config(n_records=30, rounds=3, seed=1, strength=0.5, max_retries=1)
    best, said = engine.run_evolution(spark, QUERIES, targets, SCHEMA, config)
    losses = [r["loss"] for r in said["rounds"]]
    assert losses == sorted(losses, reverse=True) and best.count() == 30 and said["best_loss"] == losses[-1]
    _, again = engine.run_evolution(spark, QUERIES, targets, SCHEMA, config)
    assert sources.scientific_hash(again["rounds"]) == sources.scientific_hash(said["rounds"])
    _, budget = engine.run_evolution(spark, QUERIES, targets, SCHEMA, engine.Config(n_records=30, rounds=3, max_candidates=0))
    assert budget["termination_reason"] == "candidate_budget"
    with pytest.raises(ValueError):
        engine.Config.from_dict({"bogus": 1})
    with pytest.raises(ValueError):
        engine.Config(rho=2.0)


@pytest.mark.parametrize("exclude_self,scale_invariant", [(False, False), (True, True)])
def test_selection_between_states_is_that_between_rows(spark, exclude_self, scale_invariant):
    rows = init.random_table(spark, SCHEMA, 40, 5).withColumn("state", F.to_json(F.struct("x", "n"))).cache()
    fit = F.col("n") * 0.3 + (F.col("x") == "a").cast("double")
    states = rows.groupBy("state", "x", "n").agg(F.count("*").alias("k")).cache()
    more = {"alpha": 4.0, "exclude_self": exclude_self, "scale_invariant": scale_invariant}
    for mode in pairs.MODES:
        wide = pairs.selection(pairs.pair_distances(rows, rows, SCHEMA, "rid"), rows.select(F.col("rid").alias("cand"), fit.alias("fitness")), mode, **more)
        names = rows.select("rid", "state")
        by_row = wide.join(names, "rid").join(names.toDF("cand", "to"), "cand").groupBy("rid", "state", "to").agg(F.sum("p").alias("p"))
        want = {(r.state, r.to): r.p for r in by_row.collect()}
        p = pairs.selection(pairs.pair_distances(states, states, SCHEMA, "state"), states.select(F.col("state").alias("cand"), fit.alias("fitness"), "k"), mode, count="k", **more)
        got = {(r.rid, r.cand): r.p for r in p.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_donors_come_from_all_rows_of_a_large_table(spark):
    start = spark.range(3000).select(F.col("id").alias("rid"), F.when(F.col("id") == 7, "a").otherwise("b").alias("x"), F.lit(0).alias("n"))
    queries = [{"conditions": [eq("x", "a")]}]
    a = workload.evaluate(start, queries).withColumnRenamed("answer", "q").withColumn("eps", F.lit(0.9))
    config = engine.Config(n_records=3000, mode="none")
    donors = engine._donors(start, a, queries, SCHEMA, config, 1, 1.0)
    # Row 7 alone is fitter, by 0.9: one draw in 3000 / e^0.9 goes to it.
    assert donors.count() == 3000 and 0 < donors.where("x = 'a'").count() < 10
    with pytest.raises(ValueError, match="pool"):
        engine.Config(n_records=3000, pool=512, exclude_self=True)


def test_driver_query_rewrites_a_table_of_full_size(spark):
    from countloom.plans import QUERIES as registered

    assert registered["e01_evolution"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count() != 120


@pytest.mark.parametrize("more", [{"start": "pairwise_maxent", "exclude_self": False}, {"start": "marginal", "gibbs_sweeps": 2, "strength": 1.0}, {"fixed_alpha": 3.0, "cooling": True, "cooling_monotone": True, "scale_invariant": True}])
def test_evolution_options(spark, more):
    schema = Schema((Attribute("x", CATEGORICAL, ("a", "b")), Attribute("y", CATEGORICAL, ("u", "v"))))
    queries = [{"conditions": [eq("x", p), eq("y", q)]} for p in "ab" for q in "uv"]
    targets = spark.createDataFrame([(k, t, 0.5, 2.0) for k, t in enumerate((20, 5, 5, 10))], "qid int, target long, sigma double, w double")
    marginals = spark.createDataFrame([("x", "a", None, None, "a", 25), ("x", "b", None, None, "b", 15), ("y", "u", None, None, "u", 25), ("y", "v", None, None, "v", 15)], "attribute string, cell string, lo int, hi int, value string, n long")
    best, said = engine.run_evolution(spark, queries, targets, schema, engine.Config(n_records=40, rounds=2, seed=4, **more), marginals=marginals)
    losses = [r["loss"] for r in said["rounds"]]
    assert best.count() == 40 and losses == sorted(losses, reverse=True)
    if more.get("start") == "marginal":
        assert said["direction_scale"] is None or said["direction_scale"] > 0


def test_contradicting_pairs_and_unknown_values():
    schema = Schema((Attribute("a", CATEGORICAL, ("x", "y")), Attribute("b", CATEGORICAL, ("x", "y")), Attribute("c", CATEGORICAL, ("x", "y"))))
    cell = lambda p, u, q, v, n: {"conditions": [eq(p, u), eq(q, v)], "result": n}
    full = lambda p, q, on: [cell(p, u, q, v, 50 * ((u == v) == on)) for u in "xy" for v in "xy"]
    assert init.pair_targets(schema, [cell("a", "zz", "b", "x", 3), cell("a", "x", "nope", "x", 3)], 100) == {}
    with pytest.raises(ValueError, match="contradict"):
        init.maxent(schema, init.pair_targets(schema, full("a", "b", True) + full("b", "c", True) + full("a", "c", False), 100))


def test_tasks_keep_their_order():
    import time

    assert engine.run_tasks([lambda k=k: (time.sleep(0.05 * (3 - k)), k)[1] for k in range(3)], 3) == [0, 1, 2]
    with pytest.raises(ValueError):
        engine.run_tasks([], 0)


def test_exact_target_stops(spark):
    start = init.random_table(spark, SCHEMA, 20, 3)
    targets = workload.evaluate(start, QUERIES).withColumnRenamed("answer", "target")
    _, said = engine.run_evolution(spark, QUERIES, targets, SCHEMA, engine.Config(n_records=20, rounds=2), start)
    assert said["termination_reason"] == "exact" and said["best_loss"] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿x,n\na,1\nb,2\na,\n", encoding="utf-8")
    df = sources.read_table(spark, str(tmp_path / "t.csv"), SCHEMA)
    assert df.schema["x"].dataType.simpleString() == "string" and df.count() == 3 and df.where("n is null").count() == 1
    with pytest.raises(ValueError):
        sources.read_table(spark, str(tmp_path / "t.csv"))
    (tmp_path / "h.data").write_text("a,1\nb,2\n")
    assert sources.read_headerless(spark, str(tmp_path / "h.data"), SCHEMA).count() == 2
    m = sources.build_marginals(df, SCHEMA, {"n": [(0, 1), (2, 4)]})
    assert m["attributes"]["n"]["counts"] == [1, 1] and m["attributes"]["x"]["counts"] == [2, 1]
    assert sources.marginals_frame(spark, m).count() == 4
    sources.write_json(tmp_path / "m.json", m | {"bad": float("nan")})
    assert sources.read_marginals(str(tmp_path / "m.json"))["bad"] is None
    sources.write_queries(tmp_path / "q.jsonl", QUERIES)
    with pytest.raises(FileExistsError):
        sources.write_queries(tmp_path / "q.jsonl", QUERIES[:1])
    (tmp_path / "s.yaml").write_text("attributes:\n  - {name: x, type: categorical, values: ['0', '1']}\n  - {name: n, type: numeric, range: [0, 4]}\n")
    assert sources.read_schema(str(tmp_path / "s.yaml"))["x"].values == ("0", "1")
    now = datetime(2024, 1, 2, 3, 4, 5)
    assert [sources.run_folder(str(tmp_path), now).name for _ in range(2)] == ["20240102_030405", "20240102_030405_1"]
    at = sources.save_run(df, {"loss": 1.0}, str(tmp_path / "runs"))
    assert (at / "diagnostics.json").exists()
    assert sources.queries_frame(spark, QUERIES).count() == 2
    assert sources.table_hash(df) == sources.table_hash(df.repartition(3)) != sources.table_hash(df.limit(2))


def test_trace_is_bound_to_its_hashes(spark, tmp_path):
    obs = spark.createDataFrame([("r", 0, 0.5)], "run string, round int, l1 double")
    ans = spark.createDataFrame([("r", 0, 1, 2)], "run string, round int, qid int, answer int")
    at = str(tmp_path / "trace")
    sources.save_trace(obs, ans, {"n": 1}, at)
    a, b, meta = sources.load_trace(spark, at)
    assert a.count() == b.count() == 1 and meta == {"n": 1}
    with pytest.raises(FileExistsError):
        sources.save_trace(obs, ans, {}, at)
    obs.withColumn("l1", F.lit(0.9)).write.mode("overwrite").parquet(f"{at}/observations.parquet")
    with pytest.raises(ValueError, match="hash"):
        sources.load_trace(spark, at)


def test_run_log(spark, tmp_path):
    log = sources.RunLog()
    log.add("rounds", round=1, loss=2.0, accepted=True)
    log.add("rounds", round=2, loss=None, accepted=False)
    assert log.frame(spark, "rounds").count() == 2
    log.publish(str(tmp_path / "log"), {"best": 2.0})
    with pytest.raises(FileExistsError):
        log.publish(str(tmp_path / "log"), {})
    with pytest.raises(ValueError):
        log.add("other", x=1)
    assert sources.first_difference({"a": 1, "t_elapsed_sec": 2}, {"a": 1, "t_elapsed_sec": 3}) is None
    assert sources.first_difference({"a": 1}, {"a": 2}) == "a"


def test_streaming_counts(spark, tmp_path):
    from countloom.streaming import streaming_counts

    rows = [(datetime(2024, 1, 1, k // 3, k), "ab"[k % 2], k % 5) for k in range(12)]
    spark.createDataFrame(rows, "ts timestamp, x string, n int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x string, n int").parquet(str(tmp_path / "in"))
    q = streaming_counts(stream, QUERIES, "ts").writeStream.outputMode("update").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    total = {r.qid: r.n for r in spark.sql("SELECT qid, sum(answer) AS n FROM counts GROUP BY qid").collect()}
    assert total == {0: 6, 1: sum(k % 5 >= 3 for k in range(12))}
