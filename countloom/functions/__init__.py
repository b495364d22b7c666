"""Column functions: predicates, counter-based random numbers, guarded arithmetic."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("==", ">=", "between")


def coerce_literal(dtype: T.DataType, value: Any) -> Any | None:
    """The literal that ``==`` compares with a column of ``dtype``; None if nothing can equal it."""
    if isinstance(dtype, T.NumericType):
        try:
            return int(value if isinstance(value, int) else str(value))  # whole numbers beyond 2^53 stay what they are
        except ValueError:
            pass
        try:
            number = float(value)
        except (TypeError, ValueError):
            return None
        return None if number != number else int(number) if number.is_integer() else number
    return str(value)


def _guarded(column: Column, dtype: T.DataType, test: Column) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        test = test & ~F.isnan(column)
    return F.coalesce(test, F.lit(False))


def condition(column: Column, dtype: T.DataType, spec: dict[str, Any]) -> Column:
    """The truth of one condition; null and NaN cells are false."""
    op = spec["operator"]
    if op == "==":
        value = coerce_literal(dtype, spec["value"])
        return F.lit(False) if value is None else _guarded(column, dtype, column == F.lit(value))
    if op == ">=":
        return _guarded(column, dtype, column >= F.lit(spec.get("value", spec.get("lower"))))
    if op == "between":
        return _guarded(column, dtype, column.between(spec["lower"], spec["upper"]))
    raise ValueError(f"unknown operator {op!r}; known: {', '.join(OPERATORS)}")


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) fixed by the seed and the key, whatever the partitioning: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.lit(k) if isinstance(k, str) else k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed: int, *key: str) -> str:
    """The same number in the oracle's SQL; keys are SQL expressions."""
    text = ", ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in key)])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def xlogx(p: Column) -> Column:
    return F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))
