"""Queries on search trees, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search_tree as T
from ..sources import surrogate as src

QUERIES, ORACLES = {}, {}
NODES = f"RECURSIVE {src.RUNS}, {src.NODES}, deep AS (SELECT node_id, 0 AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, d.depth + 1 FROM deep d JOIN nodes n ON n.parent_id = d.node_id), nd AS (SELECT * FROM nodes JOIN deep USING (node_id))"
REWARDS = f"{src.RUNS}, rw AS (SELECT node_id, run_id, CASE WHEN success THEN functionality ELSE 0e0 END AS reward FROM runs)"


def query(name, sql, prelude=NODES):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {prelude} {sql}"
        return f

    return put


def deep(spark, d):
    return T.with_depth(src.nodes(spark, d))


def rewards(spark, d):
    return src.runs(spark, d).select("node_id", "run_id", F.when(F.col("success"), F.col("functionality")).otherwise(0.0).alias("reward"))


def surfaced(spark, d):
    names = F.array(*map(F.lit, src.SURFACES))
    return src.nodes(spark, d).withColumn("surface", F.element_at(names, (F.col("node_id") % 6 + 1).cast("int")))


SURFACED = f"{src.RUNS}, {src.NODES}, sn AS (SELECT *, {src.SURFACES}[node_id % 6 + 1] AS surface FROM nodes)"


@query("tree_stats", "SELECT count(*) AS nodes, count(parent_id) AS edges, count(*) FILTER (children IS NULL) AS leaves, max(depth) AS max_depth, round(avg(children), 6) AS avg_branching, round(avg(value), 6) AS avg_value, round(median(value), 6) AS median_value, round(max(value), 6) AS max_value, round(avg(visits), 6) AS avg_visits, round(median(visits), 6) AS median_visits, max(visits) AS max_visits FROM nd LEFT JOIN (SELECT parent_id AS p, count(*) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1) ON p = node_id")
def _(spark, d):
    return T.tree_stats(deep(spark, d))


@query("tree_growth", "SELECT depth, nodes, avg_value, sum(nodes) OVER (ORDER BY depth)::BIGINT AS cumulative, round(100e0 * nodes / sum(nodes) OVER (), 6) AS percent, round(100e0 * sum(nodes) OVER (ORDER BY depth) / sum(nodes) OVER (), 6) AS cumulative_percent FROM (SELECT depth, count(*) AS nodes, round(avg(value), 6) AS avg_value FROM nd GROUP BY 1)")
def _(spark, d):
    return T.growth(deep(spark, d))


@query("tree_growth_by_model", "SELECT model, depth, nodes, avg_value, sum(nodes) OVER (PARTITION BY model ORDER BY depth)::BIGINT AS cumulative, round(100e0 * nodes / sum(nodes) OVER (PARTITION BY model), 6) AS percent, round(100e0 * sum(nodes) OVER (PARTITION BY model ORDER BY depth) / sum(nodes) OVER (PARTITION BY model), 6) AS cumulative_percent, round(nodes / CAST(sum(nodes) OVER (PARTITION BY depth) AS DOUBLE), 6) AS share_at_depth FROM (SELECT model, depth, count(*) AS nodes, round(avg(value), 6) AS avg_value FROM nd GROUP BY 1, 2)")
def _(spark, d):
    return T.growth(deep(spark, d), "model")


@query("tree_balance", "SELECT round(max(depth) / log2(sum(n) + 1e0), 6) AS depth_balance, round(avg(v), 6) AS value_balance, round(sum(used) / CAST(sum(n) AS DOUBLE), 6) AS utilisation, round(var_pop(n), 6) AS breadth_variance FROM (SELECT depth, count(*) AS n, avg(value) AS v, count(*) FILTER (visits > 0) AS used FROM nd GROUP BY 1)")
def _(spark, d):
    return T.balance(deep(spark, d))


@query("root_paths", "SELECT node_id, length, ((2 * total + length) // (2 * length)) / 1e6 AS path_value, path FROM walk", f"RECURSIVE {src.RUNS}, {src.NODES}, walk AS (SELECT node_id, 1 AS length, CAST(round(value * 1e6) AS BIGINT) AS total, CAST(node_id AS VARCHAR) AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, w.length + 1, w.total + CAST(round(n.value * 1e6) AS BIGINT), w.path || '>' || n.node_id FROM walk w JOIN nodes n ON n.parent_id = w.node_id)")
def _(spark, d):
    return T.root_paths(src.nodes(spark, d))


@query("backpropagation", "SELECT node_id, CAST(round(sum(reward), 6) AS DOUBLE) AS total, sum(n)::BIGINT AS rewards FROM up GROUP BY node_id", f"RECURSIVE {REWARDS}, {src.NODES}, up AS (SELECT node_id, CAST(sum(CAST(reward AS DECIMAL(28,16))) AS DECIMAL(28,16)) AS reward, count(*) AS n FROM rw GROUP BY 1 UNION ALL SELECT t.parent_id, CAST(u.reward * 0.9 AS DECIMAL(28,16)), u.n FROM up u JOIN nodes t ON t.node_id = u.node_id WHERE t.parent_id IS NOT NULL)")
def _(spark, d):
    return T.backpropagated(src.nodes(spark, d), rewards(spark, d)).withColumn("total", F.round("total", 6).cast("double"))


@query("td_values", "SELECT node_id, CAST(round(sum(CAST(0.9e0 * reward * pow(0.1e0, n - i) AS DECIMAL(24,15))), 6) AS DOUBLE) AS value, count(*) AS visits FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY run_id) AS i, count(*) OVER (PARTITION BY node_id) AS n FROM rw) GROUP BY node_id", REWARDS)
def _(spark, d):
    return T.td_values(rewards(spark, d)).withColumn("value", F.round("value", 6).cast("double"))


@query("convergence_points", ", a AS (SELECT *, coalesce(abs(reward - lag(reward) OVER (PARTITION BY node_id ORDER BY run_id)) < 0.1e0, false) AS calm FROM rw), b AS (SELECT *, sum(CASE WHEN calm THEN 0 ELSE 1 END) OVER (PARTITION BY node_id ORDER BY run_id) AS island FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY node_id, island, calm ORDER BY run_id) AS len FROM b) SELECT node_id, min(run_id) AS converged_at FROM c WHERE calm AND len >= 2 GROUP BY 1", REWARDS)
def _(spark, d):
    return T.convergence(rewards(spark, d), 0.1, 2)


@query("ucb_best_children", ", x AS (SELECT n.parent_id, n.node_id, CASE WHEN n.visits = 0 THEN 1e9 ELSE round(n.value + 1.414e0 * sqrt(ln(greatest(CAST(p.visits AS DOUBLE), 1e0)) / n.visits), 6) END AS ucb FROM nodes n JOIN nodes p ON p.node_id = n.parent_id) SELECT parent_id, arg_max(node_id, row(ucb, -node_id)) AS node_id, max(ucb) AS ucb, count(*) AS children FROM x GROUP BY 1", f"{src.RUNS}, {src.NODES}")
def _(spark, d):
    return T.best_children(src.nodes(spark, d))


@query("surface_priorities", ", g AS (SELECT surface, sum(value * visits) / sum(visits) AS m, sum(visits)::BIGINT AS n FROM sn GROUP BY 1) SELECT surface, n AS observations, round(0.5e0 * (1 - greatest(0e0, least(1e0, m))) + 0.3e0 / (n + 1e0) + 0.2e0 / sqrt(n + 1e0), 6) AS priority FROM g", SURFACED)
def _(spark, d):
    return T.surface_priorities(surfaced(spark, d))


@query("sampling_weights", ", w AS (SELECT *, (1.1e0 - value) / pow(visits + 1e0, 0.35e0) AS w FROM sn) SELECT node_id, surface, round(w / sum(w) OVER (PARTITION BY surface), 6) AS share FROM w", SURFACED)
def _(spark, d):
    return T.sampling_weights(surfaced(spark, d))


SETS = f"{src.RUNS}, sets AS (SELECT DISTINCT surface, array_to_string(concepts, '|') AS key, concepts AS items FROM runs)"


def sets(spark, d):
    return src.runs(spark, d).select("surface", F.array_join("concepts", "|").alias("key"), F.col("concepts").alias("items")).distinct()


@query("subset_parents", "SELECT c.surface, c.key AS child, arg_min(p.key, row(-len(p.items), p.key)) AS parent FROM sets c JOIN sets p ON c.surface = p.surface AND len(p.items) < len(c.items) AND list_has_all(c.items, p.items) GROUP BY 1, 2", SETS)
def _(spark, d):
    return T.subset_parents(sets(spark, d))


@query("novel_partners", ", q AS (SELECT x.surface, x.key AS a, y.key AS b, len(list_filter(y.items, lambda e: NOT list_contains(x.items, e))) AS gain FROM sets x JOIN sets y ON x.surface = y.surface AND x.key <> y.key) SELECT surface, a, CAST(max(gain) AS INT) AS gain, arg_min(b, row(-gain, b)) AS partner FROM q GROUP BY 1, 2", SETS)
def _(spark, d):
    return T.novel_partners(sets(spark, d))


@query("call_graph_closure", "SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM reach", "RECURSIVE edges AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 3 + n_regionkey) % 25 AS dst FROM nation), reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)")
def _(spark, d):
    n = src.table(spark, d, "nation")
    return T.closure(n.select(F.col("n_nationkey").cast("bigint").alias("src"), ((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).cast("bigint").alias("dst")).distinct())


@query("top_nodes_by_phase", "SELECT * FROM (SELECT phase, node_id, value, visits, CAST(row_number() OVER (PARTITION BY phase ORDER BY value DESC, visits DESC, node_id) AS INT) AS nth FROM nodes) WHERE nth <= 20", f"{src.RUNS}, {src.NODES}")
def _(spark, d):
    from pyspark.sql import Window

    best = Window.partitionBy("phase").orderBy(F.desc("value"), F.desc("visits"), "node_id")
    return src.nodes(spark, d).select("phase", "node_id", "value", "visits", F.row_number().over(best).alias("nth")).where("nth <= 20")


@query("pair_parents", ", c AS (SELECT c.surface, c.key AS child, c.items AS allx, p.key AS parent, p.items AS part FROM sets c JOIN sets p ON c.surface = p.surface AND len(p.items) < len(c.items) AND list_has_all(c.items, p.items)), w AS (SELECT x.surface, x.child, min(row(x.parent, y.parent)) AS pair FROM c x JOIN c y ON x.surface = y.surface AND x.child = y.child AND x.parent < y.parent AND list_has_all(list_concat(x.part, y.part), x.allx) GROUP BY 1, 2), s AS (SELECT surface, child, arg_min(parent, row(-len(part), parent)) AS largest FROM c GROUP BY 1, 2) SELECT surface, child, CASE WHEN pair IS NULL THEN largest ELSE pair[1] || '+' || pair[2] END AS parents FROM s LEFT JOIN w USING (surface, child)", SETS)
def _(spark, d):
    return T.parents_by_sets(sets(spark, d)).select("surface", "child", F.array_join("parents", "+").alias("parents"))


@query("least_covered_concepts", f", k AS (SELECT surface, unnest(concepts) AS concept FROM runs), o AS (SELECT surface, concept, count(*) AS n FROM k GROUP BY 1, 2), h AS (SELECT surface, concept, count(*) AS m FROM (SELECT DISTINCT surface, node_id, unnest(concepts) AS concept FROM runs) GROUP BY 1, 2), e AS (SELECT sn.node_id, sn.surface, 'C' || (sn.node_id % 7) AS sig, 'C' || i AS concept FROM sn, range(11) r(i) WHERE 'C' || i <> 'C' || (sn.node_id % 7)) SELECT node_id, arg_min(concept, row(coalesce(n, 0), coalesce(m, 0), CAST('0x' || substr(sha1(surface || '|' || sig || '|' || concept), 1, 8) AS BIGINT), concept)) AS concept FROM e LEFT JOIN o USING (surface, concept) LEFT JOIN h USING (surface, concept) GROUP BY 1", SURFACED)
def _(spark, d):
    r = src.runs(spark, d)
    sig = F.concat(F.lit("C"), (F.col("node_id") % 7).cast("string"))
    universe = F.array(*[F.lit(f"C{i}") for i in range(11)])
    each = surfaced(spark, d).select("node_id", "surface", sig.alias("signature"), F.array_except(universe, F.array(sig)).alias("candidates"))
    held = r.select("surface", "node_id", F.explode("concepts").alias("concept")).distinct()
    return T.least_covered(each, held.select("surface", "concept"), r.select("surface", F.explode("concepts").alias("concept")))


@query("first_tree", "SELECT difficulty, 'C' || i AS concepts, '' AS parents FROM range(11) r(i), unnest(['very easy','easy','medium','hard','very hard']) t(difficulty) UNION ALL SELECT difficulty, 'C' || x || '|C' || y, 'C' || x || '|C' || y FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY 'C' || x, 'C' || y) AS nth FROM range(11) a(x), range(11) b(y), unnest(['very easy','easy','medium','hard','very hard']) t(difficulty) WHERE 'C' || x < 'C' || y) WHERE nth <= 20", "one AS (SELECT 1)")
def _(spark, d):
    concepts = src.runs(spark, d).select(F.explode("concepts").alias("concept")).distinct()
    levels = spark.createDataFrame([(x,) for x in src.DIFFICULTIES], "difficulty string")
    return T.first_tree(concepts, levels, 20).select("difficulty", F.array_join("concepts", "|").alias("concepts"), F.array_join("parents", "|").alias("parents"))


@query("node_signatures", "SELECT run_id, 'p=' || phase || '|depth=' || len(concepts) || '|diff=' || difficulty || '|concepts=' || array_to_string(concepts, '|') AS signature FROM runs", src.RUNS)
def _(spark, d):
    return T.signature(src.runs(spark, d).withColumn("depth", F.size("concepts"))).select("run_id", "signature")


@query("first_of_signature", "SELECT surface, array_to_string(concepts, '|') AS key, min(node_id) AS node_id, count(*) AS nodes FROM runs GROUP BY 1, 2", src.RUNS)
def _(spark, d):
    return T.first_of_signature(src.runs(spark, d))


_PATHS = f"RECURSIVE {src.RUNS}, {src.NODES}, walk AS (SELECT node_id, model, 1 AS length, CASE WHEN value > 0.5 THEN 1e0 ELSE 0e0 END AS solved FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.model, w.length + 1, w.solved + CASE WHEN n.value > 0.5 THEN 1e0 ELSE 0e0 END FROM walk w JOIN nodes n ON n.parent_id = w.node_id), p AS (SELECT node_id, model, length, round(solved / length, 6) AS success FROM walk WHERE length > 1)"


def paths(spark, d):
    n = src.nodes(spark, d)
    return T.path_success(n.withColumn("solved", F.col("value") > 0.5)).join(n.select("node_id", "model"), "node_id")


@query("path_success_by_model", "SELECT model, length, count(*) AS paths, round(avg(success), 6) AS success FROM p GROUP BY 1, 2", _PATHS)
def _(spark, d):
    return T.path_success_by(paths(spark, d), "model")


@query("path_ratio", "SELECT round(coalesce(avg(length) FILTER (success > 0.5) / avg(length) FILTER (success <= 0.5), 1e0), 6) AS path_length_ratio, round((count(DISTINCT length) + 1) / CAST(max(length) - 1 AS DOUBLE), 6) AS depth_utilisation FROM p", _PATHS)
def _(spark, d):
    return T.path_ratio(paths(spark, d))


@query("challenge_bounds", ", m AS (SELECT node_id, avg(1 - functionality) AS mean FROM runs GROUP BY 1) SELECT n.node_id, CASE WHEN n.visits = 0 THEN -1e0 ELSE round(coalesce(mean, 0e0) + 1.414e0 * sqrt(ln(greatest(coalesce(p.visits, 1), 1)) / n.visits), 6) END AS ucb FROM nodes n LEFT JOIN m ON m.node_id = n.node_id LEFT JOIN nodes p ON p.node_id = n.parent_id", f"{src.RUNS}, {src.NODES}")
def _(spark, d):
    challenges = src.runs(spark, d).select("node_id", (1 - F.col("functionality")).alias("challenge"))
    found = T.challenge_bounds(src.nodes(spark, d), challenges)
    return found.select("node_id", F.when(F.col("ucb") == float("inf"), F.lit(-1.0)).otherwise(F.col("ucb")).alias("ucb"))


@query("weighted_draws", ", w AS (SELECT node_id, surface, (1.1e0 - least(greatest(value, 0), 1)) / pow(visits + 1e0, 0.35e0) AS w FROM sn), k AS (SELECT *, -ln((CAST('0x' || substr(md5('7:' || node_id), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0) / w AS key FROM w WHERE w > 0), p AS (SELECT surface, node_id, row_number() OVER (PARTITION BY surface ORDER BY key, node_id) AS place FROM k) SELECT surface, node_id, place FROM p WHERE place <= 20", SURFACED)
def _(spark, d):
    nodes = surfaced(spark, d).withColumn("w", (1.1 - F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0))) / F.pow(F.col("visits") + 1.0, F.lit(0.35)))
    return T.weighted_draws(nodes, "surface", "node_id", "w", 20, seed=7)


@query("rootless_nodes", ", n2 AS (SELECT node_id, CASE WHEN node_id % 97 = 5 THEN node_id * 4 WHEN node_id % 89 = 3 THEN -node_id ELSE parent_id END AS parent_id FROM nodes), ok AS (SELECT node_id FROM n2 WHERE parent_id IS NULL UNION ALL SELECT n2.node_id FROM n2 JOIN ok ON n2.parent_id = ok.node_id) SELECT node_id FROM n2 ANTI JOIN ok USING (node_id)", f"RECURSIVE {src.RUNS}, {src.NODES}")
def _(spark, d):
    n = src.nodes(spark, d)
    k = F.col("node_id")
    return T.rootless(n.select("node_id", F.when(k % 97 == 5, k * 4).when(k % 89 == 3, -k).otherwise(F.col("parent_id")).alias("parent_id"))).select("node_id")
