"""Comparing two tables by whole rows: joint distance, support, diversity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.functions import xlogx
from countloom.operators.workload import ROWS, states


def row_counts(df: DataFrame, names: Sequence[str], out: str = "n") -> DataFrame:
    """Distinct rows with their count in the column ``out``."""
    return df.groupBy(*names).agg(F.count("*").alias(out))


def support_union(reference: DataFrame, synthetic: DataFrame, names: Sequence[str], left: str = "a", right: str = "b") -> DataFrame:
    """(names..., left, right): counts of each distinct row in both tables; nulls are a value of their own."""
    tagged = states(reference, names).withColumn("__side", F.lit(0)).unionByName(states(synthetic, names).withColumn("__side", F.lit(1)))
    n = lambda s: F.sum(F.when(F.col("__side") == s, F.col(ROWS)).otherwise(0))
    return tagged.groupBy(*names).agg(n(0).alias(left), n(1).alias(right))


def joint_metrics(reference: DataFrame, synthetic: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: total variation, distinct rows, duplicate rate, overlap, missing reference mass, novel mass."""
    u = support_union(reference, synthetic, names, "__a", "__b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    t = u.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, q = F.col("a") / F.col("na"), F.col("b") / F.col("nb")
    return u.crossJoin(F.broadcast(t)).agg(
        (0.5 * F.sum(F.abs(p - q))).alias("tvd"),
        F.count_if(F.col("b") > 0).alias("unique_rows"),
        (1 - F.count_if(F.col("b") > 0) / F.max("nb")).alias("duplicate_rate"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("overlap"),
        (F.sum(F.when(F.col("b") == 0, F.col("a")).otherwise(0)) / F.max("na")).alias("missing_reference_mass"),
        (F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)) / F.max("nb")).alias("novel_mass"),
    )


def support_metrics(reference: DataFrame, synthetic: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: distinct rows in both, synthetic mass inside the reference's support, reference mass covered."""
    u = support_union(reference, synthetic, names, "__a", "__b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    both = (F.col("a") > 0) & (F.col("b") > 0)
    return u.agg(F.count_if(both).alias("unique_overlap"), (F.sum(F.when(both, F.col("b")).otherwise(0)) / F.sum("b")).alias("mass_inside"), (F.sum(F.when(both, F.col("a")).otherwise(0)) / F.sum("a")).alias("mass_covered"))


def _entropy(n: Column, total: Column) -> Column:
    return -F.sum(xlogx(n / total))


def diversity(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: rows, distinct rows, duplicate rate, entropy of rows, its exponential, and entropy over ln N (1 for one row)."""
    counts = states(df, names).select(F.col(ROWS).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    h = counts.crossJoin(F.broadcast(total)).agg(F.max("total").alias("rows"), F.count("*").alias("unique_rows"), _entropy(F.col("n"), F.col("total")).alias("entropy"))
    return h.select(
        "rows", "unique_rows", (1 - F.col("unique_rows") / F.col("rows")).alias("duplicate_rate"), "entropy", F.exp("entropy").alias("effective_rows"), F.when(F.col("rows") <= 1, 1.0).otherwise(F.col("entropy") / F.log(F.col("rows").cast("double"))).alias("normalized_entropy")
    )


def attribute_diversity(df: DataFrame, names: Sequence[str], domain_sizes: dict[str, int]) -> DataFrame:
    """(attribute, effective_support, ratio): exp of the column's entropy, and that over the domain's size."""
    flat = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("v")) for n in names))).alias("c")).groupBy("c.attribute", "c.v").agg(F.count("*").alias("n"))
    total = flat.groupBy("attribute").agg(F.sum("n").alias("total"))
    e = F.exp(_entropy(F.col("n"), F.col("total")))
    size = F.element_at(F.create_map(*(F.lit(x) for n in names for x in (n, float(domain_sizes[n])))), F.col("attribute"))
    return flat.join(total, "attribute").groupBy("attribute").agg(e.alias("effective_support")).withColumn("ratio", F.col("effective_support") / size)


def top_cover(reference: DataFrame, synthetic: DataFrame, names: Sequence[str], k: int = 10) -> DataFrame:
    """One row: share of the most frequent synthetic row, and how many of the reference's top k rows the synthetic top k holds; ties in row order."""
    order = [F.desc(ROWS), *names]
    a, b = states(reference, names).orderBy(*order).limit(k), states(synthetic, names).orderBy(*order).limit(k)
    total = synthetic.count()
    held = a.drop(ROWS).intersect(b.drop(ROWS)).agg(F.count("*").alias("top_cover"))
    return b.agg((F.max(ROWS) / F.lit(float(total))).alias("top_rate")).crossJoin(held)


def only_in(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return left.select(*names).distinct().exceptAll(right.select(*names).distinct())


def changed(before: DataFrame, after: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """One row: changed rows and changed cells between two states aligned by ``key``."""
    b = after.select(key, *(F.col(n).alias(f"__{n}") for n in names))
    cells = sum((~F.col(n).eqNullSafe(F.col(f"__{n}"))).cast("long") for n in names)
    return before.join(b, key).select(cells.alias("c")).agg(F.count_if(F.col("c") > 0).alias("changed_rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("changed_cells"))
