"""Facts of evaluation runs as views of the test tables: runs, findings, nodes, edges, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels

DIFFICULTIES = ["very easy", "easy", "medium", "hard", "very hard"]
SURFACES = list(labels.SURFACES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run. Priorities are difficulties, status F is success, market segments are models."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    at = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    rank = 5 - F.substring("o_orderpriority", 1, 1).cast("int")
    run, node = F.col("o_orderkey"), F.col("o_custkey")
    return orders.join(customers, "o_custkey").select(
        run.alias("run_id"), node.alias("node_id"), F.col("c_mktsegment").alias("model"), rank.alias("difficulty_rank"), at(DIFFICULTIES, rank).alias("difficulty"),
        at(SURFACES, node % 6).alias("surface"), (1 + run % 3).cast("int").alias("phase"), (F.col("o_orderstatus") == "F").alias("success"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("judge_is_secure"), (1 + run % 4).cast("int").alias("attempts"), (run % 5 == 0).alias("used_fixer"),
        F.when(F.col("o_orderstatus") != "P", (node % 100) / F.lit(128.0)).alias("judge_risk"), ((run % 101) / F.lit(128.0)).alias("functionality"),
        F.array_sort(F.array_distinct(F.array(F.concat(F.lit("C"), (node % 7).cast("string")), F.concat(F.lit("C"), (run % 11).cast("string"))))).alias("concepts"),
        F.concat(F.lit("CWE-"), (20 + node % 25).cast("string")).alias("target_cwe"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("at"),
        (run % 4).alias("false_positives"), (run % 50 == 0).alias("scan_failed"), (5 + run % 120).alias("loc"), (run % 10 != 0).alias("parses"), (1 + run % 17).alias("cyclomatic"), F.when(run % 4 != 0, (run % 21 - 10) / F.lit(16.0)).alias("risk_delta"),
    )


RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS node_id, c_mktsegment AS model, 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS difficulty_rank,
 ['very easy','easy','medium','hard','very hard'][6 - CAST(substr(o_orderpriority, 1, 1) AS INT)] AS difficulty,
 """ + str(SURFACES) + """[o_custkey % 6 + 1] AS surface,
 CAST(1 + o_orderkey % 3 AS INT) AS phase, o_orderstatus = 'F' AS success, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS judge_is_secure,
 CAST(1 + o_orderkey % 4 AS INT) AS attempts, o_orderkey % 5 = 0 AS used_fixer, CASE WHEN o_orderstatus <> 'P' THEN (o_custkey % 100) / 128e0 END AS judge_risk,
 (o_orderkey % 101) / 128e0 AS functionality, list_sort(list_distinct(['C' || (o_custkey % 7), 'C' || (o_orderkey % 11)])) AS concepts,
 'CWE-' || (20 + o_custkey % 25) AS target_cwe, o_totalprice AS value, o_orderdate AS "at", o_orderkey % 4 AS false_positives, o_orderkey % 50 = 0 AS scan_failed, 5 + o_orderkey % 120 AS loc, o_orderkey % 10 <> 0 AS parses, 1 + o_orderkey % 17 AS cyclomatic, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 21 - 10) / 16e0 END AS risk_delta FROM orders JOIN customer ON o_custkey = c_custkey)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per finding. A line item's number is the attempt, its flags are the levels, its part gives the weakness."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    level = lambda c, m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(c))
    return items.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("attempt"), F.col("l_quantity").cast("int").alias("line"), F.concat(F.lit("T"), (F.col("l_suppkey") % 20).cast("string")).alias("test_id"),
        F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("tool"), F.concat(F.lit("CWE-"), (20 + F.col("l_partkey") % 25).cast("string")).alias("cwe"),
        level("l_returnflag", {"A": "LOW", "N": "MEDIUM", "R": "HIGH"}).alias("severity"), level("l_linestatus", {"F": "HIGH", "O": "LOW"}).alias("confidence"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )


FINDINGS = """findings AS (SELECT l_orderkey AS run_id, l_linenumber AS attempt, CAST(l_quantity AS INT) AS line, 'T' || (l_suppkey % 20) AS test_id, ['alpha','beta','gamma'][l_suppkey % 3 + 1] AS tool,
 'CWE-' || (20 + l_partkey % 25) AS cwe, CASE l_returnflag WHEN 'A' THEN 'LOW' WHEN 'N' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE l_linestatus WHEN 'F' THEN 'HIGH' ELSE 'LOW' END AS confidence,
 l_partkey AS part, l_suppkey AS supp FROM lineitem)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search tree over customers: node k hangs under node k div 4; visits and values follow from its runs."""
    stats = runs(spark, sf_dir).groupBy("node_id").agg(F.count("*").alias("visits"), F.round(F.avg(F.col("success").cast("double")), 6).alias("value"), F.min("phase").alias("phase"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("model"))
    parent = F.when(F.col("node_id") > 0, F.floor(F.col("node_id") / 4))
    return ids.join(stats, "node_id", "left").select("node_id", "model", parent.cast("bigint").alias("parent_id"), F.coalesce("visits", F.lit(0)).cast("bigint").alias("visits"), F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("phase", F.lit(1)).alias("phase"))


NODES = """nodes AS (SELECT c_custkey AS node_id, c_mktsegment AS model, CASE WHEN c_custkey > 0 THEN c_custkey // 4 END AS parent_id, coalesce(visits, 0) AS visits, coalesce(s.value, 0e0) AS value, coalesce(phase, 1) AS phase
 FROM customer LEFT JOIN (SELECT node_id, count(*) AS visits, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS value, min(phase) AS phase FROM runs GROUP BY node_id) s ON node_id = c_custkey)"""
