"""Workload evaluation: thousands of conjunctive count queries in one pass.

A query is a list of conditions joined by AND; an empty list is every row.
Rows are first reduced to distinct states of the attributes in use.  States are
rolled up to one set of cells for each combination of attributes that some
query names (its shape), and the cells are joined with the workload, whose
conditions have become closed bounds of the columns' own types.

The join is always by equal keys.  Queries of one shape whose equalities name the
same attributes form a pattern; a pattern's key is the hash of those attributes'
values.  Where a pattern has no equality but many queries, its first numeric
range is cut into bins at the queries' own bounds: a cell has one bin, a query
all that its range meets.  The bounds themselves are then tested pair by pair.
Patterns are rows of an array, so the plan does not grow with the workload.
"""

from __future__ import annotations

import hashlib
import json
import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.functions import coerce_literal, condition

Query = dict[str, Any]
#: A workload of more bounds than this is joined without a broadcast.
BROADCAST_BOUNDS = 1_000_000
#: Bins of a pattern without equalities that has more queries than BINNED.
BINS, BINNED = 32, 64


def query_mask(df: DataFrame, query: Query) -> Column:
    """The AND of a query's conditions."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    tests = []
    for c in query["conditions"]:
        if c["attribute"] not in kinds:
            raise ValueError(f"unknown attribute {c['attribute']!r}")
        tests.append(condition(F.col(c["attribute"]), kinds[c["attribute"]], c))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def count_one(df: DataFrame, query: Query) -> int:
    return df.where(query_mask(df, query)).count()


def bounds(schema: T.StructType, query: Query) -> dict[str, tuple[Any, Any]] | None:
    """attribute -> (low or None, high or None), closed; None if no row can match."""
    kinds = {f.name: f.dataType for f in schema.fields}
    out: dict[str, tuple[Any, Any]] = {}
    for c in query["conditions"]:
        name, op = c["attribute"], c["operator"]
        if name not in kinds:
            raise ValueError(f"unknown attribute {name!r}")
        if op == "==":
            value = coerce_literal(kinds[name], c["value"])
            if value is None:
                return None
            low, high = value, value
        elif op == ">=":
            low, high = c.get("value", c.get("lower")), None
        elif op == "between":
            low, high = c["lower"], c["upper"]
        else:
            raise ValueError(f"unknown operator {op!r}")
        was = out.get(name, (None, None))
        low = was[0] if low is None else low if was[0] is None else max(low, was[0])
        high = was[1] if high is None else high if was[1] is None else min(high, was[1])
        if low is not None and high is not None and low > high:
            return None
        out[name] = (low, high)
    return out


def _bound_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    return T.DoubleType() if isinstance(kind, (T.DoubleType, T.FloatType)) else kind


def _closed(kind: T.DataType, low: Any, high: Any) -> tuple[Any, Any] | None:
    """The bounds as values of the column's type: whole or scaled numbers are rounded inwards, so none is lost to a double."""
    number = lambda v: Decimal(str(v)) if isinstance(v, float) else Decimal(v)
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        unit = Decimal(1) if isinstance(kind, T.IntegralType) else Decimal(1).scaleb(-kind.scale)
        most = Decimal(1 << 63) if isinstance(kind, T.IntegralType) else Decimal(10) ** (kind.precision - kind.scale)
        with localcontext(prec=80):
            low = None if low is None or low == -math.inf else max(number(low), -most)
            high = None if high is None or high == math.inf else min(number(high), most - unit)
            low = None if low is None else (low / unit).to_integral_value(ROUND_CEILING) * unit
            high = None if high is None else (high / unit).to_integral_value(ROUND_FLOOR) * unit
        if (low is not None and low > most - unit) or (high is not None and high < -most) or (low is not None and high is not None and low > high):
            return None
        if isinstance(kind, T.IntegralType):
            low, high = None if low is None else int(low), None if high is None else int(high)
    elif isinstance(kind, T.NumericType):
        low, high = None if low is None else float(low) + 0.0, None if high is None else float(high) + 0.0  # no -0.0: it hashes apart
    return low, high


class Workload(NamedTuple):
    frame: DataFrame  #: (qid, __pattern, __bin, __low_a, __high_a, ...) of the queries that can match
    names: list[str]  #: attributes in use
    shapes: list[tuple[str, ...]]
    patterns: list[tuple[int, list[int], int, list[float]]]  #: shape, places of the attributes with equalities, place of the binned one or -1, cuts


def compile_workload(df: DataFrame, queries: Sequence[Query]) -> Workload:
    spark, kinds = df.sparkSession, {f.name: f.dataType for f in df.schema.fields}
    found = []
    for q, query in enumerate(queries):
        b = bounds(df.schema, query)
        b = b and {n: _closed(kinds[n], *x) for n, x in b.items()}
        if b is not None and all(x is not None for x in b.values()):
            found.append((q, b))
    used = [f for f in df.schema.fields if any(f.name in b for _, b in found)]
    names = [f.name for f in used]
    shapes = sorted({tuple(n for n in names if n in b) for _, b in found})
    shape_of = {s: k for k, s in enumerate(shapes)}
    groups: dict[tuple[int, tuple[int, ...]], list[tuple[int, dict]]] = {}
    for q, b in found:
        equal = tuple(i for i, n in enumerate(names) if n in b and b[n][0] is not None and b[n][0] == b[n][1])
        groups.setdefault((shape_of[tuple(n for n in names if n in b)], equal), []).append((q, b))
    patterns, rows = [], []
    for k, ((shape, equal), members) in enumerate(sorted(groups.items())):
        at, cuts = -1, []
        numeric = [i for i, n in enumerate(names) if n in shapes[shape] and isinstance(kinds[n], T.NumericType)]
        if not equal and len(members) > BINNED and numeric:
            at = numeric[0]
            ends = sorted({float(v) for _, b in members for v in b[names[at]] if v is not None and math.isfinite(v)})
            cuts = [ends[i * len(ends) // BINS] for i in range(1, BINS)] if len(ends) > BINS else ends
            cuts = sorted(set(cuts))
        patterns.append((shape, list(equal), at, cuts))
        for q, b in members:
            span = range(1)
            if at >= 0:
                low, high = b[names[at]]
                span = range(0 if low is None else bisect_right(cuts, float(low)), (len(cuts) if high is None else bisect_right(cuts, float(high))) + 1)
            row = [v for n in names for v in b.get(n, (None, None))]
            rows += [(q, k, i, *row) for i in span]
    fields = [T.StructField(n, T.IntegerType()) for n in ("qid", "__pattern", "__bin")]
    fields += [T.StructField(f"__{side}_{f.name}", _bound_type(f.dataType)) for f in used for side in ("low", "high")]
    frame = spark.createDataFrame(rows, T.StructType(fields))
    frame = frame.withColumn("__key", _key(names, lambda n: F.col(f"__low_{n}"), _constant([p[1] for p in patterns], "array<array<int>>")[F.col("__pattern")]) if patterns else F.lit(0).cast("long"))
    return Workload(_small(frame, len(rows) * max(1, 2 * len(names))), names, shapes, patterns)


def _constant(value: Any, kind: str) -> Column:
    """A nested constant as one literal, which is folded once, whatever its size."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _key(names: Sequence[str], value: Callable[[str], Column], equal: Column) -> Column:
    """Hash of the pattern, the bin and the values of the attributes at the places ``equal``."""
    return F.xxhash64("__pattern", "__bin", *(F.when(F.array_contains(equal, i), value(n)) for i, n in enumerate(names)))


def _by_pattern(df: DataFrame, w: Workload, shape: Column | None = None) -> DataFrame:
    """``df`` with (__pattern, __key): a row for each pattern, or for each of the row's ``shape``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not w.patterns:
        return df.where(F.lit(False)).withColumns({"__pattern": F.lit(0), "__key": F.lit(0).cast("long")})

    row = "array<struct<id:int,equal:array<int>,at:int,cuts:array<double>>>"
    known = [(s, {"id": k, "equal": equal, "at": at, "cuts": cuts}) for k, (s, equal, at, cuts) in enumerate(w.patterns)]
    if shape is None:
        mine = _constant([p for _, p in known], row)
    else:
        mine = _constant([[p for s, p in known if s == k] for k in range(len(w.shapes))], f"array<{row}>")[shape]
    x = df.withColumn("__p", F.explode(mine))
    numeric = [(i, n) for i, n in enumerate(w.names) if any(p[2] == i for p in w.patterns)]
    value = F.coalesce(*(F.when(F.col("__p.at") == i, F.col(n).cast("double")) for i, n in numeric)) if numeric else F.lit(None).cast("double")
    place = F.when(F.col("__p.at") < 0, F.lit(0)).otherwise(F.size(F.filter(F.col("__p.cuts"), lambda c: c <= value)))

    def typed(n: str) -> Column:
        kind = _bound_type(kinds[n])
        return F.col(n).cast(kind) + F.lit(0.0) if isinstance(kind, T.DoubleType) else F.col(n).cast(kind)

    x = x.withColumns({"__pattern": F.col("__p.id"), "__bin": place.cast("int")})
    return x.withColumn("__key", _key(w.names, typed, F.col("__p.equal"))).drop("__p", "__bin")


def _met(df: DataFrame, w: Workload) -> DataFrame:
    """``df`` (with __pattern, __key) joined with the queries it meets."""
    return df.join(w.frame.drop("__bin").withColumnsRenamed({"__key": "__wkey", "__pattern": "__wpattern"}), (F.col("__key") == F.col("__wkey")) & (F.col("__pattern") == F.col("__wpattern")) & _inside(df, w.names))


def _small(frame: DataFrame, cells: int) -> DataFrame:
    return F.broadcast(frame) if cells <= BROADCAST_BOUNDS else frame


def _inside(df: DataFrame, names: Sequence[str]) -> Column:
    """Whether a state meets the bounds beside it; an attribute without bounds does not count."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = F.lit(True)
    for n in names:
        low, high, x = F.col(f"__low_{n}"), F.col(f"__high_{n}"), F.col(n)
        free = low.isNull() & high.isNull()
        test = (low.isNull() | (x >= low)) & (high.isNull() | (x <= high))
        if isinstance(kinds[n], (T.DoubleType, T.FloatType)):
            test = test & ~F.isnan(x)
        out = out & (free | F.coalesce(test, F.lit(False)))
    return out


#: Column of row counts beside attributes, whose names may be anything.
ROWS = "__rows"


def states(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct values of the columns with their row count ``__rows``."""
    return df.groupBy(*names).agg(F.count("*").alias(ROWS))


def evaluate(df: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(qid, answer) for every query, zeros included; qid is the query's place."""
    spark = df.sparkSession
    everyone = spark.range(len(queries)).select(F.col("id").cast("int").alias("qid"))
    w = compile_workload(df, queries)
    shapes = _constant([{"id": k, "held": [w.names.index(n) for n in s]} for k, s in enumerate(w.shapes)], "array<struct<id:int,held:array<int>>>")
    cells = states(df, w.names).withColumn("__s", F.explode(shapes))
    rolled = cells.select(F.col("__s.id").alias("__shape"), *(F.when(F.array_contains("__s.held", i), F.col(n)).alias(n) for i, n in enumerate(w.names)), ROWS)
    rolled = rolled.groupBy("__shape", *w.names).agg(F.sum(ROWS).alias(ROWS))
    counted = _met(_by_pattern(rolled, w, F.col("__shape")), w).groupBy("qid").agg(F.sum(ROWS).alias("answer"))
    return everyone.join(counted, "qid", "left").select("qid", F.coalesce("answer", F.lit(0)).cast("long").alias("answer"))


def matches(df: DataFrame, queries: Sequence[Query], keep: Sequence[str]) -> DataFrame:
    """(keep..., qid): every pair of a row and a query it meets."""
    w = compile_workload(df, queries)
    return _met(_by_pattern(df.select(*dict.fromkeys([*keep, *w.names])), w), w).select(*keep, "qid")


def verify(df: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(qid, expected, answer) where a query's stored ``result`` differs from its count."""
    stored = df.sparkSession.createDataFrame([(k, int(q["result"])) for k, q in enumerate(queries)], "qid int, expected long")
    return evaluate(df, queries).join(stored, "qid").where("answer <> expected").select("qid", "expected", "answer")


def canonical(query: Query) -> str:
    """A query's identity: its conditions in canonical JSON, sorted; names and results do not count."""
    if not query["conditions"]:
        raise ValueError("a query without conditions has no identity")
    parts = sorted(json.dumps({k: c[k] for k in ("attribute", "operator", "value", "lower", "upper") if k in c}, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for c in query["conditions"])
    return "[" + ",".join(parts) + "]"


def fingerprint(query: Query) -> str:
    return hashlib.sha256(canonical(query).encode()).hexdigest()


def set_identity(queries: Sequence[Query], ordered: bool = False) -> str:
    """The identity of a set of distinct queries, or of their order."""
    prints = [fingerprint(q) for q in queries]
    if len(set(prints)) != len(prints):
        raise ValueError("queries repeat")
    return hashlib.sha256("\n".join(prints if ordered else sorted(prints)).encode()).hexdigest()


def target_identity(targets: Sequence[int]) -> str:
    return hashlib.sha256("\n".join(map(str, targets)).encode()).hexdigest()


def check_partition(measured: Sequence[Query], held_out: Sequence[Query]) -> tuple[str, str]:
    """Identities of two sets of queries that must not overlap."""
    out = set_identity(measured), set_identity(held_out)
    both = {fingerprint(q) for q in measured} & {fingerprint(q) for q in held_out}
    if both:
        raise ValueError(f"{len(both)} queries are in both sets")
    return out


def bridge(df: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(attr, qid): which queries name an attribute."""
    rows = sorted({(c["attribute"], k) for k, q in enumerate(queries) for c in q["conditions"]})
    return df.sparkSession.createDataFrame(rows, "attr string, qid int")


def condition_dimension(df: DataFrame, queries: Sequence[Query]) -> tuple[DataFrame, DataFrame]:
    """(cid, attribute, operator, value, lower, upper) of distinct conditions, and (qid, cid)."""
    text = lambda v: None if v is None else str(v)
    number: dict[tuple, int] = {}
    links = []
    for k, q in enumerate(queries):
        for c in q["conditions"]:
            key = (c["attribute"], c["operator"], text(c.get("value")), text(c.get("lower")), text(c.get("upper")))
            links.append((k, number.setdefault(key, len(number))))
    spark = df.sparkSession
    return (
        spark.createDataFrame([(i, *key) for key, i in number.items()], "cid int, attribute string, operator string, value string, lower string, upper string"),
        spark.createDataFrame(sorted(set(links)), "qid int, cid int"),
    )
