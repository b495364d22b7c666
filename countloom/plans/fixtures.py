"""Views of the star-schema tables in the shapes the operators work on, in Spark and in SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countloom.schema import CATEGORICAL, NUMERIC, Attribute, Schema

LINE_SCHEMA = Schema(
    (
        Attribute("qty", NUMERIC, low=1, high=50),
        Attribute("flag", CATEGORICAL, ("A", "N", "R")),
        Attribute("line", CATEGORICAL, (1, 2, 3, 4, 5, 6, 7)),
        Attribute("disc", NUMERIC, low=0, high=10),
        Attribute("tax", NUMERIC, low=0, high=8),
    )
)

LI = (
    "li AS (SELECT CAST(l_quantity AS INT) AS qty, l_returnflag AS flag, l_linenumber AS line, CAST(round(l_discount * 100) AS INT) AS disc, "
    "CAST(round(l_tax * 100) AS INT) AS tax, l_linestatus AS status FROM lineitem)"
)

#: Queries over the view: single, double and triple; one that nothing matches, one attribute named twice, one empty range.
WORKLOAD: list[dict[str, Any]] = [
    {"conditions": c}
    for c in (
        [{"attribute": "flag", "operator": "==", "value": "A"}],
        [{"attribute": "flag", "operator": "==", "value": "Z"}],
        [{"attribute": "line", "operator": "==", "value": "3"}],
        [{"attribute": "line", "operator": "==", "value": "three"}],
        [{"attribute": "qty", "operator": ">=", "value": 40}],
        [{"attribute": "qty", "operator": "between", "lower": 10, "upper": 20}],
        [{"attribute": "qty", "operator": ">=", "value": 10}, {"attribute": "qty", "operator": "between", "lower": 1, "upper": 15}],
        [{"attribute": "qty", "operator": "between", "lower": 20, "upper": 10}],
        [{"attribute": "flag", "operator": "==", "value": "N"}, {"attribute": "line", "operator": "==", "value": 1}],
        [{"attribute": "disc", "operator": "between", "lower": 2, "upper": 5}, {"attribute": "tax", "operator": ">=", "value": 4}],
        [{"attribute": "flag", "operator": "==", "value": "R"}, {"attribute": "qty", "operator": "between", "lower": 1, "upper": 25}],
        [{"attribute": "flag", "operator": "==", "value": "A"}, {"attribute": "line", "operator": "==", "value": 2}, {"attribute": "disc", "operator": ">=", "value": 5}],
        [{"attribute": "qty", "operator": "between", "lower": 30, "upper": 50}, {"attribute": "disc", "operator": "==", "value": 0}, {"attribute": "tax", "operator": "==", "value": 8}],
        [{"attribute": "line", "operator": "==", "value": 7}, {"attribute": "tax", "operator": "between", "lower": 0, "upper": 3}],
        [],
    )
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(
        F.col("l_quantity").cast("int").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), F.col("l_linestatus").alias("status"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows of status F stand for the reference table, the others for the synthetic one."""
    df = lines(spark, sf_dir)
    return df.where("status = 'F'").drop("status"), df.where("status <> 'F'").drop("status")


SIDES = LI + ", ref AS (SELECT * FROM li WHERE status = 'F'), syn AS (SELECT * FROM li WHERE status <> 'F')"


def condition_sql(c: dict[str, Any], numeric: bool) -> str:
    a, op = c["attribute"], c["operator"]
    if op == "==":
        if numeric:
            try:
                return f"{a} = {int(float(c['value']))}"
            except ValueError:
                return "FALSE"
        return f"{a} = '{c['value']}'"
    return f"{a} >= {c['value']}" if op == ">=" else f"{a} BETWEEN {c['lower']} AND {c['upper']}"


def query_sql(query: dict[str, Any]) -> str:
    return " AND ".join([condition_sql(c, c["attribute"] != "flag") for c in query["conditions"]] or ["TRUE"])


def answers_sql(table: str, name: str = "answer") -> str:
    """(qid, name) of the fixture's workload over ``table``."""
    return " UNION ALL ".join(f"SELECT {k} AS qid, count(*) AS {name} FROM {table} WHERE {query_sql(q)}" for k, q in enumerate(WORKLOAD))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.select(F.col("c_custkey").alias("rid"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))


CU = "cu AS (SELECT c_custkey AS rid, c_mktsegment AS seg, c_nationkey AS nat FROM customer)"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CUSTOMER_SCHEMA = Schema((Attribute("seg", CATEGORICAL, SEGMENTS), Attribute("nat", NUMERIC, low=0, high=24)))


def customer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, seg, nat, fitness): the distinct states of all customers; the count of a state stands for its fitness."""
    return customers(spark, sf_dir).groupBy("seg", "nat").agg((F.count("*") / 100.0).alias("fitness")).withColumn("rid", F.concat_ws("|", "seg", F.col("nat").cast("string")))


STATES = CU + ", st AS (SELECT seg || '|' || CAST(nat AS VARCHAR) AS rid, seg, nat, count(*) / 100.0 AS fitness FROM cu GROUP BY seg, nat)"
PAIRS = (
    STATES + ", pr AS (SELECT a.rid, b.rid AS cand, b.fitness, ((CASE WHEN a.seg = b.seg THEN 0.0 ELSE 1.0 END) + abs(a.nat - b.nat) / 24.0) / 2.0 AS d FROM st a CROSS JOIN st b)"
)


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(observations, answers): events dealt into 4 runs by user, 20 to a round in time order; answers count them by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = e.withColumn("run", (F.col("user_id") % 4).cast("int"))
    x = x.withColumn("round", F.floor((F.row_number().over(Window.partitionBy("run").orderBy("ts", "event_id")) - 1) / 20).cast("int"))
    obs = x.groupBy("run", "round").agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")) / 1000000.0).alias("l1"), (F.count_distinct("user_id") / 20.0).alias("unique_rate"), (F.count_distinct("event_type") / 10.0).alias("entropy"), F.count_if(F.col("value") > 100).alias("changed_rows")
    )
    kinds = x.select("event_type").distinct()
    cells = x.groupBy("run", "round", "event_type").agg(F.count("*").alias("answer"))
    grid = obs.select("run", "round").crossJoin(F.broadcast(kinds))
    return obs, grid.join(cells, ["run", "round", "event_type"], "left").select("run", "round", F.col("event_type").alias("qid"), F.coalesce("answer", F.lit(0)).alias("answer"))


EV = """ev AS (SELECT *, CAST(user_id % 4 AS INT) AS run, CAST(floor((row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1) / 20.0) AS INT) AS round FROM events),
obs AS (SELECT run, round, sum(CAST(round(value * 100) AS BIGINT)) / 1000000.0 AS l1, count(DISTINCT user_id) / 20.0 AS unique_rate, count(DISTINCT event_type) / 10.0 AS entropy,
        CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS changed_rows FROM ev GROUP BY run, round),
ans AS (SELECT o.run, o.round, k.event_type AS qid, count(e.event_id) AS answer FROM obs o CROSS JOIN (SELECT DISTINCT event_type FROM events) k
        LEFT JOIN ev e ON e.run = o.run AND e.round = o.round AND e.event_type = k.event_type GROUP BY 1, 2, 3)"""
