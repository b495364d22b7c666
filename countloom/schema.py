"""Table schemas: ordered attributes with their public domains."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL = "numeric", "categorical"


@dataclass(frozen=True)
class Attribute:
    """One column: numeric with an inclusive integer range, or categorical with listed values."""

    name: str
    kind: str
    values: tuple = ()
    low: int = 0
    high: int = 0
    description: str = ""

    def __post_init__(self) -> None:
        if self.kind not in (NUMERIC, CATEGORICAL):
            raise ValueError(f"{self.name}: unknown type {self.kind}")
        if self.kind == CATEGORICAL and not self.values:
            raise ValueError(f"{self.name}: a categorical attribute needs values")
        if self.kind == NUMERIC and self.low > self.high:
            raise ValueError(f"{self.name}: empty range")

    @property
    def domain(self) -> tuple:
        """All legal values."""
        return self.values if self.kind == CATEGORICAL else tuple(range(self.low, self.high + 1))

    @property
    def spark_type(self) -> T.DataType:
        whole = self.kind == NUMERIC or all(isinstance(v, int) for v in self.values)
        return T.IntegerType() if whole else T.StringType()

    def valid(self, column: Column, dtype: T.DataType) -> Column:
        """Not null and in the domain; a numeric attribute in a column of another type is never valid."""
        if self.kind == CATEGORICAL:
            return F.coalesce(column.isin(*self.values), F.lit(False))
        if not isinstance(dtype, T.NumericType):
            return F.lit(False)
        inside = column.between(self.low, self.high)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            inside = inside & ~F.isnan(column)
        return F.coalesce(inside, F.lit(False))


@dataclass(frozen=True)
class Schema:
    """Attributes in order; the order is part of the meaning."""

    attributes: tuple[Attribute, ...]

    def __post_init__(self) -> None:
        if len({a.name for a in self.attributes}) != len(self.attributes):
            raise ValueError("attribute names repeat")

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    def __getitem__(self, name: str) -> Attribute:
        for a in self.attributes:
            if a.name == name:
                return a
        raise KeyError(name)

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, a.spark_type, True, {"description": a.description}) for a in self.attributes])

    def project(self, df: DataFrame) -> DataFrame:
        """The schema's columns in its order; a missing one is an error."""
        missing = [n for n in self.names if n not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        return df.select(*self.names)

    @staticmethod
    def from_dict(raw: dict[str, Any]) -> Schema:
        out = []
        for x in raw["attributes"]:
            unknown = set(x) - {"name", "type", "description", "values", "range"}
            if unknown:
                raise ValueError(f"unknown keys: {sorted(unknown)}")
            low, high = x.get("range") or (0, 0)
            out.append(Attribute(x["name"], x["type"], tuple(x.get("values") or ()), low, high, x.get("description", "")))
        return Schema(tuple(out))
