"""Queries on labels, selections and reshaping, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import texts as T
from ..operators import labels as B
from ..sources import surrogate as src
from . import failures
from .reports import RECORDS, recs

QUERIES, ORACLES = {}, {}
OK = "CASE WHEN success THEN 1e0 ELSE 0e0 END"


def query(name, sql, prelude=src.RUNS):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = (f"WITH {prelude} " if prelude else "") + sql
        return f

    return put


_SPELL = ["Very  Easy", " EASY", "medium", "Hard ", "VeryHard", "none of them"]


@query("difficulty_labels", f", x AS (SELECT run_id, {_SPELL}[run_id % 6 + 1] AS raw, run_id % 6 AS k FROM runs) SELECT run_id, ['very easy','easy','medium','hard','very hard','unknown'][k + 1] AS difficulty, CASE WHEN k < 5 THEN CAST(k AS INT) END AS rank, CASE WHEN k < 2 THEN 'Very Easy/Easy' WHEN k = 2 THEN 'Medium' WHEN k < 5 THEN 'Hard/Very Hard' END AS axis, CASE WHEN k < 5 THEN 1e0 + k / 2e0 END AS weight, CASE WHEN k < 5 THEN ['easy','medium','hard','very hard','very hard'][k + 1] END AS harder FROM x")
def _(spark, d):
    raw = F.element_at(F.array(*map(F.lit, _SPELL)), (F.col("run_id") % 6 + 1).cast("int"))
    return B.resolve_difficulty(src.runs(spark, d).select("run_id", raw.alias("raw")), "raw").drop("raw")


@query("success_definitions", "SELECT model, count(*) FILTER (success) AS final, count(*) FILTER (total_issues = 0) AS sast_clean, count(*) FILTER (success AND attempts = 1) AS one_shot FROM recs GROUP BY 1", RECORDS)
def _(spark, d):
    return recs(spark, d).groupBy("model").agg(*[F.count_if(B.succeeded(x)).alias(x) for x in ("final", "sast_clean", "one_shot")])


@query("single_concept_runs", f"SELECT concepts[1] AS concept, count(*) AS runs, round(avg({OK}), 6) AS success_rate FROM runs WHERE phase <> 3 AND len(concepts) = 1 GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    one = src.runs(spark, d).where("phase <> 3 and size(concepts) = 1").withColumn("concept", F.get("concepts", F.lit(0)))
    return one.groupBy("concept").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate")).where("runs >= 2")


for _name, _least in (("nodes_over_threshold", 0.5), ("nodes_top_when_none", 5.0)):

    @query(_name, f"SELECT node_id, value FROM nodes WHERE value >= {_least} UNION ALL SELECT * FROM (SELECT node_id, value FROM nodes WHERE (SELECT count(*) FROM nodes WHERE value >= {_least}) = 0 ORDER BY value DESC, node_id LIMIT 5)", f"{src.RUNS}, {src.NODES}")
    def _(spark, d, least=_least):
        return B.threshold_or_top(src.nodes(spark, d).select("node_id", "value"), "value", least, 5, "node_id")


@query("description_tokens", "SELECT p_partkey AS id, array_to_string(list_filter([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]], lambda w: length(w) >= 3 AND w <> 'ring'), '|') AS n FROM part", "")
def _(spark, d):
    p = src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("w"), F.concat_ws(" ", "p_name", F.lit("CWE-79 b2 ring")).alias("t"))
    return p.select("id", F.array_join(B.duplicate_tokens(F.col("t"), ["ring"]), "|").alias("n"))


@query("test_counters", "SELECT run_id, CAST(greatest(run_id % 9 - run_id % 3 - run_id % 2, 0) AS INT) AS passed, CAST(run_id % 3 AS INT) AS failed, CAST(run_id % 2 AS INT) AS errored FROM runs")
def _(spark, d):
    n = lambda k: (F.col("run_id") % k).cast("string")
    output = F.concat(F.lit("Ran "), n(9), F.lit(" tests in 0.1s\nFAILED (failures="), n(3), F.lit(", errors="), n(2), F.lit(")"))
    passed, failed, errored = B.test_counters(output)
    return src.runs(spark, d).select("run_id", passed.alias("passed"), failed.alias("failed"), errored.alias("errored"))


@query("cell_annotations", f", c AS (SELECT concepts[1] AS concept, difficulty, round(1 - avg({OK}), 6) AS f, row_number() OVER (PARTITION BY concepts[1] ORDER BY count(*) DESC, difficulty_rank DESC) = 1 AS p FROM runs WHERE len(concepts) = 1 GROUP BY concepts[1], difficulty, difficulty_rank) SELECT concept, difficulty, CASE WHEN f = 0 THEN '✓' WHEN f = 1 THEN '✗' ELSE printf('%.2f', f) END || CASE WHEN p THEN '†' ELSE '' END AS cell FROM c")
def _(spark, d):
    one = src.runs(spark, d).where("size(concepts) = 1").withColumn("concept", F.get("concepts", F.lit(0)))
    cells = one.groupBy("concept", "difficulty", "difficulty_rank").agg(F.count("*").alias("n"), F.round(1 - F.avg(F.col("success").cast("double")), 6).alias("f"))
    first = Window.partitionBy("concept").orderBy(F.desc("n"), F.desc("difficulty_rank"))
    marked = cells.withColumn("p", F.row_number().over(first) == 1)
    return marked.select("concept", "difficulty", T.annotate(F.col("f"), F.col("p")).alias("cell"))


@query("cut_texts", "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...[cut]' ELSE text END AS text FROM documents", "")
def _(spark, d):
    return src.table(spark, d, "documents").select("doc_id", B.cut(F.col("text"), 120).alias("text"))


@query("steering_records", "SELECT run_id, primary_reason, array_to_string(final_ids[1:6], '|') AS ids, 'Run failed with ' || primary_reason || CASE WHEN len(persistent_ids) > 0 THEN '; still open: ' || array_to_string(persistent_ids[1:3], ', ') ELSE '' END || '.' AS summary FROM failed", failures.ROWS)
def _(spark, d):
    return B.steering(failures.rows(spark, d))


_FAMILIES = {"T1": "injection", "T2": "injection", "T3": "crypto", "T7": "files"}


@query("families_by_model", "SELECT model, CASE id WHEN 'T1' THEN 'injection' WHEN 'T2' THEN 'injection' WHEN 'T3' THEN 'crypto' WHEN 'T7' THEN 'files' ELSE id END AS family, count(*) AS n FROM (SELECT model, unnest(first_ids) AS id FROM rows) GROUP BY 1, 2", failures.ROWS)
def _(spark, d):
    ids = failures.rows(spark, d).select("model", F.explode("first_ids").alias("id"))
    return ids.groupBy("model", B.family("id", _FAMILIES).alias("family")).agg(F.count("*").alias("n"))


@query("mismatch_rates", ", x AS (SELECT model, difficulty, ['very easy','easy','medium','hard','very hard'][run_id % 5 + 1] AS declared FROM runs) SELECT model, count(*) AS n, count(*) FILTER (declared <> difficulty) AS mismatches, round(count(*) FILTER (declared <> difficulty) / CAST(count(*) AS DOUBLE), 6) AS rate FROM x GROUP BY 1")
def _(spark, d):
    meta = src.runs(spark, d).select("run_id", "model", "difficulty")
    texts = src.runs(spark, d).select("run_id", F.concat(F.lit("x\nDifficulty:  "), F.element_at(F.array(*map(F.lit, B.DIFFICULTIES)), (F.col("run_id") % 5 + 1).cast("int"))).alias("text"))
    declared = T.normal(F.regexp_extract("text", r"(?im)^\s*difficulty\s*:\s*(.+?)\s*$", 1))
    both = meta.join(texts, "run_id", "left").withColumn("bad", declared != F.col("difficulty"))
    return both.groupBy("model").agg(F.count("*").alias("n"), F.count_if("bad").alias("mismatches"), F.round(S.ratio(F.count_if("bad"), F.count("*")), 6).alias("rate"))


@query("unused_cells", "SELECT concept, surface FROM (SELECT 'C' || range AS concept FROM range(11)) CROSS JOIN (SELECT DISTINCT surface FROM runs) WHERE (concept, surface) NOT IN (SELECT DISTINCT c, surface FROM (SELECT unnest(concepts) AS c, surface FROM runs WHERE value > 250000))")
def _(spark, d):
    r = src.runs(spark, d)
    universe = spark.range(11).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("concept")).crossJoin(F.broadcast(r.select("surface").distinct()))
    return B.unused(universe, r.where("value > 250000").select(F.explode("concepts").alias("concept"), "surface"), "concept", "surface")


@query("first_seen_combos", "SELECT combo, arg_min(run_id, run_id) AS run_id, arg_min(model, run_id) AS model FROM (SELECT array_to_string(concepts, '|') AS combo, * FROM runs) GROUP BY combo")
def _(spark, d):
    return B.first_seen(src.runs(spark, d).select(F.array_join("concepts", "|").alias("combo"), "run_id", "model"), "combo", "run_id")


@query("tagged_union", "SELECT 'runs' AS experiment, phase, count(*) AS n, CAST(NULL AS BIGINT) AS findings FROM runs GROUP BY 2 UNION ALL SELECT 'findings', NULL, count(*), count(*) FROM findings", f"{src.RUNS}, {src.FINDINGS}")
def _(spark, d):
    a = src.runs(spark, d).groupBy("phase").agg(F.count("*").alias("n")).withColumn("experiment", F.lit("runs"))
    b = src.findings(spark, d).agg(F.count("*").alias("n"), F.count("*").alias("findings")).withColumn("experiment", F.lit("findings"))
    return a.unionByName(b, allowMissingColumns=True)


@query("issue_order", "SELECT run_id, string_agg(test_id || ':' || line, ',' ORDER BY CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END DESC, CASE confidence WHEN 'LOW' THEN 1 ELSE 3 END DESC, line, test_id) AS ordered FROM findings GROUP BY 1", src.FINDINGS)
def _(spark, d):
    key = F.struct((-S.level_rank(F.col("severity"))).alias("s"), (-S.level_rank(F.col("confidence"))).alias("c"), "line", "test_id")
    return src.findings(spark, d).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: F.concat_ws(":", x["test_id"], x["line"].cast("string"))), ",").alias("ordered"))


@query("pivot_success", "SELECT surface, " + ", ".join(f"round(avg({OK}) FILTER (difficulty = '{x}'), 6) AS \"{x}_rate\", count(run_id) FILTER (difficulty = '{x}') AS \"{x}_n\"" for x in src.DIFFICULTIES) + " FROM runs GROUP BY 1")
def _(spark, d):
    return src.runs(spark, d).groupBy("surface").pivot("difficulty", src.DIFFICULTIES).agg(F.round(F.avg(F.col("success").cast("double")), 6).alias("rate"), F.count("run_id").alias("n"))


_NUM = ["attempts", "functionality", "total_issues", "distinct_cwes"]


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM recs" for a in _NUM for b in _NUM), RECORDS)
def _(spark, d):
    return B.correlation_matrix(recs(spark, d), _NUM)


@query("runs_with_pair", f", p AS (SELECT * FROM (VALUES ('C0', 'C1'), ('C2', 'C9'), ('C5', 'C10')) t(a, b)) SELECT a, b, count(*) AS n, round(avg({OK}), 6) AS success_rate FROM p JOIN runs ON list_contains(concepts, a) AND list_contains(concepts, b) GROUP BY 1, 2")
def _(spark, d):
    pairs = F.broadcast(spark.createDataFrame([("C0", "C1"), ("C2", "C9"), ("C5", "C10")], "a string, b string"))
    r = src.runs(spark, d).select("success", "concepts", F.explode("concepts").alias("a"))
    return r.join(pairs, "a").where(F.array_contains("concepts", F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"))


@query("run_index_by_node", "SELECT node_id, run_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY \"at\", run_id) AS INT) AS run_index, round(avg(value) OVER (PARTITION BY node_id ORDER BY \"at\", run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM runs")
def _(spark, d):
    order = Window.partitionBy("node_id").orderBy("at", "run_id")
    return src.runs(spark, d).select("node_id", "run_id", F.row_number().over(order).alias("run_index"), F.round(F.avg("value").over(order.rowsBetween(-2, 0)), 4).alias("recent"))


@query("depth_range_share", "SELECT model, CASE WHEN depth <= 2 THEN 'shallow' WHEN depth <= 4 THEN 'middle' ELSE 'deep' END AS part, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY model) AS DOUBLE), 6) AS share FROM nd GROUP BY 1, 2", f"RECURSIVE {src.RUNS}, {src.NODES}, deep AS (SELECT node_id, 0 AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, d.depth + 1 FROM deep d JOIN nodes n ON n.parent_id = d.node_id), nd AS (SELECT * FROM nodes JOIN deep USING (node_id))")
def _(spark, d):
    from ..operators import compare, search_tree

    part = F.when(F.col("depth") <= 2, "shallow").when(F.col("depth") <= 4, "middle").otherwise("deep")
    return compare.share_within(search_tree.with_depth(src.nodes(spark, d)).withColumn("part", part), "model", "part")


@query("run_id_inference", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'k' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'run_' || o_custkey ELSE 'run_0' END AS run FROM orders", "")
def _(spark, d):
    o = src.table(spark, d, "orders")
    key = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("k"), F.col("o_orderkey").cast("string")))
    path = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("/a/run_"), F.col("o_custkey").cast("string"), F.lit("/x.json"))).otherwise(F.lit("/a/b"))
    named = o.select(F.col("o_orderkey").alias("id"), F.lit(" ").alias("trial_id"), key.alias("seed"), path.alias("log_dir"))
    return named.select("id", T.run_name(named.columns).alias("run"))
