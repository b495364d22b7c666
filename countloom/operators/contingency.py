"""Contingency tables over attribute subsets, domain completion, cell errors, association measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.operators.workload import ROWS, states
from countloom.schema import NUMERIC, Schema


def cells(df: DataFrame, names: Sequence[str], order: int) -> DataFrame:
    """(attrs, key, n) over all ``order``-subsets of ``names``: non-empty cells, values as strings joined by '|'.

    One EXPAND over distinct states; no pass for each subset.
    """
    held = states(df, names)
    value = {n: F.coalesce(F.col(n).cast("string"), F.lit("\x00")) for n in names}
    subsets = F.array(*(F.struct(F.lit(",".join(s)).alias("attrs"), F.concat_ws("|", *(value[a] for a in s)).alias("key")) for s in combinations(names, order)))
    return held.select(F.explode(subsets).alias("c"), ROWS).groupBy("c.attrs", "c.key").agg(F.sum(ROWS).alias("n"))


def domain_cells(spark, domains: dict[str, Sequence[Any]], order: int) -> DataFrame:
    """(attrs, key): every cell of every subset, from the attributes' public domains.

    Domains are crossed on the executors; only single values come from the driver.
    """
    single = spark.createDataFrame([(a, str(v)) for a, values in domains.items() for v in values], "attr string, value string")

    def of(subset: tuple[str, ...]) -> DataFrame:
        parts = [single.where(F.col("attr") == a).select(F.col("value").alias(f"v{k}")) for k, a in enumerate(subset)]
        whole = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), parts)
        return whole.select(F.lit(",".join(subset)).alias("attrs"), F.concat_ws("|", *(f"v{k}" for k in range(len(subset)))).alias("key"))

    return reduce(DataFrame.unionByName, (of(s) for s in combinations(domains, order)))


def completed(df: DataFrame, domains: dict[str, Sequence[Any]], order: int) -> DataFrame:
    """(attrs, key, n) over the whole domain, zeros included."""
    return domain_cells(df.sparkSession, domains, order).join(cells(df, list(domains), order), ["attrs", "key"], "left").select("attrs", "key", F.coalesce("n", F.lit(0)).alias("n"))


def cell_errors(reference: DataFrame, synthetic: DataFrame, domains: dict[str, Sequence[Any]], order: int, n_reference: int, excluded: DataFrame | None = None) -> DataFrame:
    """One row of |count difference| / N over all cells less ``excluded`` (attrs, key): n, mean, median, p90, max."""
    a = cells(reference, list(domains), order).withColumnRenamed("n", "a")
    b = cells(synthetic, list(domains), order).withColumnRenamed("n", "b")
    every = domain_cells(reference.sparkSession, domains, order)
    if excluded is not None:
        every = every.join(excluded, ["attrs", "key"], "left_anti")
    e = F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))) / F.lit(float(n_reference))
    both = every.join(a, ["attrs", "key"], "left").join(b, ["attrs", "key"], "left").select(e.alias("e"))
    return both.agg(F.count("*").alias("cells"), F.avg("e").alias("mean"), F.percentile("e", 0.5).alias("median"), F.percentile("e", 0.9).alias("p90"), F.max("e").alias("max"))


def discretise(column: Column, bins: Sequence[tuple[int, int]]) -> Column:
    """The bin's label ``[lo,hi]``; a value outside every bin is an error."""
    out = F.when(column.isNull(), F.raise_error(F.lit("a value is null")))
    for lo, hi in bins:
        out = out.when(column.between(lo, hi), F.lit(f"[{lo},{hi}]"))
    return out.otherwise(F.raise_error(F.concat(F.lit("outside all bins: "), column.cast("string"))))


def cell_of_condition(condition: dict[str, Any], bins: Sequence[tuple[int, int]], top: int) -> str | None:
    """The label of the one bin a condition selects exactly, or None."""
    op = condition["operator"]
    lo, hi = (condition["lower"], condition["upper"]) if op == "between" else (condition.get("value", condition.get("lower")), top) if op == ">=" else (condition["value"], condition["value"])
    return f"[{lo},{hi}]" if (lo, hi) in [tuple(b) for b in bins] else None


def pair_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, x, y, n): two-way counts of all pairs of attributes."""
    wide = cells(df, names, 2)
    at, key = F.split("attrs", ","), F.split("key", r"\|")
    return wide.select(at[0].alias("a"), at[1].alias("b"), key[0].alias("x"), key[1].alias("y"), "n")


def association(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, phi2, g2) of every pair: chi-square over N against independence, and 2 * sum o ln(o / e)."""
    pairs, one = pair_counts(df, names), cells(df, names, 1)
    total = df.count()
    left = one.select(F.col("attrs").alias("a"), F.col("key").alias("x"), F.col("n").alias("nx"))
    right = one.select(F.col("attrs").alias("b"), F.col("key").alias("y"), F.col("n").alias("ny"))
    # Products of counts are taken in doubles, as longs overflow.
    e = F.col("nx").cast("double") * F.col("ny") / F.lit(float(total))
    # Cells without rows add e each to the chi-square; all e sum to N.
    o = F.col("n").cast("double")
    return (
        pairs.join(left, ["a", "x"])
        .join(right, ["b", "y"])
        .groupBy("a", "b")
        .agg(((F.sum(o * o / e) - F.lit(float(total))) / F.lit(float(total))).alias("phi2"), (2 * F.sum(o * F.log(o / e))).alias("g2"))
    )


def three_way_scores(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, c, score): G2 of a triple against independence less the G2 of its three pairs."""
    total = float(df.count())
    one = cells(df, names, 1)
    at, key = F.split("attrs", ","), F.split("key", r"\|")
    triples = cells(df, names, 3).select(*(at[k].alias("abc"[k]) for k in range(3)), *(key[k].alias("xyz"[k]) for k in range(3)), "n")
    for k in range(3):
        triples = triples.join(one.select(F.col("attrs").alias("abc"[k]), F.col("key").alias("xyz"[k]), F.col("n").alias(f"n{k}")), ["abc"[k], "xyz"[k]])
    # In doubles: the product of three counts is beyond a long from some million rows on.
    e = F.col("n0").cast("double") * F.col("n1") * F.col("n2") / F.lit(total * total)
    g3 = triples.groupBy("a", "b", "c").agg((2 * F.sum(F.col("n") * F.log(F.col("n") / e))).alias("g3"))
    g2 = association(df, names).select("a", "b", "g2")
    for k, (x, y) in enumerate((("a", "b"), ("a", "c"), ("b", "c"))):
        g3 = g3.join(g2.select(F.col("a").alias(x), F.col("b").alias(y), F.col("g2").alias(f"g2_{k}")), [x, y])
    return g3.select("a", "b", "c", (F.col("g3") - F.col("g2_0") - F.col("g2_1") - F.col("g2_2")).alias("score"))


def top_residual_cells(df: DataFrame, names: Sequence[str], per_pair: int = 2, least: int = 30) -> DataFrame:
    """(a, b, x, y, n, z, rank): cells of ``least`` rows or more with the largest standardised residual of their pair."""
    total = float(df.count())
    one = cells(df, names, 1)
    p = pair_counts(df, names).join(one.select(F.col("attrs").alias("a"), F.col("key").alias("x"), F.col("n").alias("nx")), ["a", "x"])
    p = p.join(one.select(F.col("attrs").alias("b"), F.col("key").alias("y"), F.col("n").alias("ny")), ["b", "y"])
    e = F.col("nx") * F.col("ny") / F.lit(total)
    z = F.round(F.abs(F.col("n") - e) / F.sqrt(e), 6)
    ranked = p.where(F.col("n") >= least).withColumn("z", z)
    order = Window.partitionBy("a", "b").orderBy(F.desc("z"), "x", "y")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_pair).select("a", "b", "x", "y", "n", "z", "rank")


def validity(df: DataFrame, schema: Schema) -> DataFrame:
    """(attribute, invalid_count, valid_rate) by attribute, and one row ``*`` for whole rows."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    tests = {a.name: a.valid(F.col(a.name), kinds[a.name]) for a in schema.attributes}
    tests["*"] = reduce(lambda x, y: x & y, list(tests.values()), F.lit(True))
    flat = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("attribute"), (~t).cast("long").alias("bad")) for n, t in tests.items()))).alias("c"))
    return flat.groupBy("c.attribute").agg(F.sum("c.bad").alias("invalid_count"), (1 - F.sum("c.bad") / F.count("*")).alias("valid_rate"))


def cut_points(conditions: DataFrame) -> DataFrame:
    """(attribute, cut) from (attribute, operator, value, lower, upper): where a condition's truth changes."""
    v, lo, hi, op = F.col("value"), F.col("lower"), F.col("upper"), F.col("operator")
    points = (
        F.when(op.isin(">=", "<"), F.array(v)).when(op.isin(">", "<="), F.array(v + 1)).when(op == "==", F.array(v, v + 1)).when(op == "between", F.array(lo, hi + 1)).otherwise(F.array().cast("array<int>"))
    )
    return conditions.select("attribute", F.explode(points).alias("cut")).distinct()


def derive_bins(conditions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(attribute, lo, hi): contiguous closed bins of each attribute that some condition cuts.

    ``ranges``: attribute, low, high. Cuts outside the range are clipped to its ends.
    """
    cuts = cut_points(conditions).join(ranges, "attribute")
    inside = cuts.select("attribute", "low", "high", F.least(F.greatest("cut", "low"), F.col("high") + 1).alias("cut"))
    ends = inside.select("attribute", "low", "high", F.col("low").alias("cut")).union(inside.select("attribute", "low", "high", F.col("high") + 1))
    every = inside.union(ends).distinct()
    after = F.lead("cut").over(Window.partitionBy("attribute").orderBy("cut"))
    return every.withColumn("next", after).where(F.col("next").isNotNull()).select("attribute", F.col("cut").alias("lo"), (F.col("next") - 1).alias("hi"))


def bin_counts(df: DataFrame, bins: DataFrame) -> DataFrame:
    """(attribute, lo, hi, n): rows in each bin, zeros included. ``bins`` is as small as the schema."""
    names = [r.attribute for r in bins.select("attribute").distinct().collect()]
    long = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("attribute"), F.col(n).cast("long").alias("v")) for n in names))).alias("c")).groupBy("c.attribute", "c.v").agg(F.count("*").alias("n"))
    hit = long.join(F.broadcast(bins), "attribute").where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("attribute", "lo", "hi").agg(F.sum("n").alias("n"))
    return bins.join(hit, ["attribute", "lo", "hi"], "left").select("attribute", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def quotas(counts: DataFrame, n_records: int, by: str = "attribute", cell: str = "cell") -> DataFrame:
    """(by, cell, quota): counts scaled to ``n_records`` by the largest remainder; ties go in cell order.

    Negative counts are zero; counts that are all zero are spread evenly.
    """
    c = F.greatest(F.col("n").cast("double"), F.lit(0.0))
    per = Window.partitionBy(by)
    total, size = F.sum("c").over(per), F.count("*").over(per)
    share = counts.withColumn("c", c).withColumn("scaled", F.when(total > 0, F.col("c") * F.lit(float(n_records)) / total).otherwise(F.lit(float(n_records)) / size))
    share = share.withColumn("base", F.floor("scaled")).withColumn("part", F.round(F.col("scaled") - F.floor("scaled"), 9))
    left = F.lit(n_records) - F.sum("base").over(per)
    rank = F.row_number().over(per.orderBy(F.desc("part"), cell))
    return share.withColumn("left", left).withColumn("rank", rank).select(by, cell, (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("quota"))


def cell_queries(bins: dict[str, Sequence[Any]], order: int) -> list[dict[str, Any]]:
    """Every ``order``-way cell of the public bins as a query; a bin is (lo, hi) or a value."""
    def conditions(attr: str, cell: Any) -> dict[str, Any]:
        return {"attribute": attr, "operator": "between", "lower": cell[0], "upper": cell[1]} if isinstance(cell, tuple) else {"attribute": attr, "operator": "==", "value": cell}

    out: list[dict[str, Any]] = []
    for subset in combinations(bins, order):
        rows: list[list[dict[str, Any]]] = [[]]
        for a in subset:
            rows = [r + [conditions(a, c)] for r in rows for c in bins[a]]
        out += [{"conditions": r} for r in rows]
    return out


def domains_of(schema: Schema) -> dict[str, tuple]:
    return {a.name: a.domain for a in schema.attributes if a.kind != NUMERIC or a.high - a.low < 1000}
