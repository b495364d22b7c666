"""Sources and sinks: tables, schemas, workloads, marginals, runs, traces, logs."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.schema import NUMERIC, Schema


def read_table(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    """A CSV with header, or Parquet; a CSV needs its schema, types are never inferred."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return schema.project(df) if schema else df
    if schema is None:
        raise ValueError("a CSV is read with a schema")
    return spark.read.schema(schema.struct_type()).option("header", True).option("enforceSchema", False).csv(path)


def read_headerless(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Comma-separated values without a header, in the schema's column order."""
    return spark.read.schema(schema.struct_type()).option("header", False).csv(path)


def read_queries(path: str) -> list[dict[str, Any]]:
    """The queries of a workload file, in order."""
    return json.loads(Path(path).read_text(encoding="utf-8"))["queries"]


def queries_frame(spark: SparkSession, queries: Sequence[dict[str, Any]]) -> DataFrame:
    """(qid, id, type, conditions, result): the workload as data."""
    text = lambda v: None if v is None else str(v)
    rows = [(k, q.get("id"), q.get("type"), [(c["attribute"], c["operator"], text(c.get("value")), text(c.get("lower")), text(c.get("upper"))) for c in q["conditions"]], q.get("result")) for k, q in enumerate(queries)]
    condition = "struct<attribute:string,operator:string,value:string,lower:string,upper:string>"
    return spark.createDataFrame(rows, f"qid int, id string, type string, conditions array<{condition}>, result long")


def read_schema(path: str) -> Schema:
    import yaml

    return Schema.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def read_marginals(path: str) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def marginals_frame(spark: SparkSession, marginals: dict[str, Any]) -> DataFrame:
    """(attribute, cell, lo, hi, value, n): one row a bin or value."""
    rows = []
    for name, m in marginals["attributes"].items():
        for k, n in enumerate(m["counts"]):
            lo, hi = m["bins"][k] if m["type"] == NUMERIC else (None, None)
            rows.append((name, k, lo, hi, None if m["type"] == NUMERIC else str(m["values"][k]), float(n)))
    return spark.createDataFrame(rows, "attribute string, cell int, lo long, hi long, value string, n double")


def build_marginals(df: DataFrame, schema: Schema, bins: dict[str, Sequence[tuple[int, int]]], dataset: str = "") -> dict[str, Any]:
    """Counts by bin and by value over the whole table, zero cells kept; the result is as small as the schema."""
    tests = [(a, k, c, F.col(a.name).between(*c) if a.kind == NUMERIC else F.col(a.name) == F.lit(c)) for a in schema.attributes for k, c in enumerate(bins.get(a.name, ()) if a.kind == NUMERIC else a.values)]
    row = df.agg(F.count("*").alias("rows"), *(F.count_if(t).alias(f"{a.name}__{k}") for a, k, _, t in tests)).first()
    out: dict[str, Any] = {"dataset": dataset, "n_records": row["rows"], "attributes": {}}
    for a, k, c, _ in tests:
        m = out["attributes"].setdefault(a.name, {"type": a.kind, "bins" if a.kind == NUMERIC else "values": [], "counts": []})
        m["bins" if a.kind == NUMERIC else "values"].append(list(c) if a.kind == NUMERIC else c)
        m["counts"].append(row[f"{a.name}__{k}"])
    return out


def write_json(path: str | Path, value: Any) -> None:
    """Writes beside the target and renames, so a reader never sees half a file; NaN and infinities become null."""

    def clean(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        if hasattr(v, "item") and not isinstance(v, (str, bytes)):
            v = v.item() if getattr(v, "size", 1) == 1 else clean(v.tolist())
        return None if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{os.getpid()}")
    beside.write_text(json.dumps(clean(value), ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    os.replace(beside, path)


def run_folder(parent: str, now: datetime | None = None) -> Path:
    """A new folder named by the time, with _1, _2, ... where that is taken."""
    stem = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    for k in range(10_000):
        at = Path(parent) / (stem if k == 0 else f"{stem}_{k}")
        try:
            at.mkdir(parents=True)
            return at
        except FileExistsError:
            continue
    raise FileExistsError(parent)


def save_run(best: DataFrame, diagnostics: dict[str, Any], parent: str) -> Path:
    """Writes the best table and the diagnostics into a new folder."""
    at = run_folder(parent)
    best.write.parquet(str(at / "best_synthetic.parquet"))
    write_json(at / "diagnostics.json", diagnostics)
    return at


def write_queries(path: str | Path, queries: Sequence[dict[str, Any]]) -> None:
    """One query a line; a file that holds other queries is not overwritten."""
    text = "".join(json.dumps(q, sort_keys=True, ensure_ascii=False) + "\n" for q in queries)
    path = Path(path)
    if path.exists() and path.read_text(encoding="utf-8") != text:
        raise FileExistsError(f"{path} holds other queries")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def table_hash(df: DataFrame) -> str:
    """An identity of the rows, repeats included, in any order."""
    h = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)))
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha256(f"{r.n}|{r.s}|{r.x}".encode()).hexdigest()


def save_trace(observations: DataFrame, answers: DataFrame, metadata: dict[str, Any], at: str) -> None:
    """A trajectory as two Parquet tables and a manifest with their hashes; an existing trace is an error."""
    if Path(at).exists():
        raise FileExistsError(at)
    observations.write.parquet(f"{at}/observations.parquet")
    answers.write.parquet(f"{at}/answers.parquet")
    write_json(f"{at}/manifest.json", {"metadata": metadata, "observations": table_hash(observations), "answers": table_hash(answers)})


def load_trace(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """What :func:`save_trace` wrote; tables that do not match the manifest are an error."""
    manifest = json.loads(Path(f"{at}/manifest.json").read_text(encoding="utf-8"))
    if set(manifest) != {"metadata", "observations", "answers"}:
        raise ValueError("unexpected keys in the manifest")
    tables = {n: spark.read.parquet(f"{at}/{n}.parquet") for n in ("observations", "answers")}
    for n, df in tables.items():
        if table_hash(df) != manifest[n]:
            raise ValueError(f"{n} does not match its hash")
    return tables["observations"], tables["answers"], manifest["metadata"]


class RunLog:
    """Rounds, blocks and probes of a run, published together."""

    KINDS = ("rounds", "blocks", "probes")

    def __init__(self) -> None:
        self.records: dict[str, list[dict[str, Any]]] = {k: [] for k in self.KINDS}

    def add(self, kind: str, **values: Any) -> None:
        if kind not in self.records:
            raise ValueError(f"unknown kind {kind!r}")
        self.records[kind].append(values)

    def publish(self, at: str, summary: dict[str, Any]) -> None:
        """Writes to a folder beside ``at`` and renames it; an existing ``at`` is an error."""
        target = Path(at)
        if target.exists():
            raise FileExistsError(at)
        beside = target.with_name(f".{target.name}.{os.getpid()}")
        for kind, rows in self.records.items():
            write_json(beside / f"{kind}.json", rows)
        write_json(beside / "summary.json", summary)
        os.replace(beside, target)

    def frame(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = self.records[kind]
        names = list(dict.fromkeys(k for r in rows for k in r))
        kinds = {n: next((type(r[n]) for r in rows if r.get(n) is not None), str) for n in names}
        types = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}
        fields = [T.StructField(n, types.get(kinds[n], T.StringType())) for n in names]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], T.StructType(fields))


TIMING = "_elapsed_sec"


def scientific_payload(value: Any) -> Any:
    """``value`` without its timing entries."""
    if isinstance(value, dict):
        return {k: scientific_payload(v) for k, v in value.items() if not k.endswith(TIMING)}
    return [scientific_payload(v) for v in value] if isinstance(value, (list, tuple)) else value


def scientific_hash(value: Any) -> str:
    return hashlib.sha256(json.dumps(scientific_payload(value), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def first_difference(a: dict[str, Any], b: dict[str, Any]) -> str | None:
    """The first key, in order, by which two payloads differ; None if they are equal."""
    x, y = scientific_payload(a), scientific_payload(b)
    return next((k for k in sorted(set(x) | set(y)) if x.get(k) != y.get(k) or (k in x) != (k in y)), None)
