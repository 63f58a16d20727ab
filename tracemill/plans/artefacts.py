"""Queries on scenario rules, scanner reports and learned operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learned as L
from ..operators import scenario_rules as Q
from ..sources import files
from ..sources import surrogate as src

QUERIES, ORACLES = {}, {}


def query(name, sql=""):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def pick(*xs, by="run_id"):
    return F.element_at(F.array(*map(F.lit, xs)), (F.col(by) % len(xs) + 1).cast("int"))


def scenarios(spark, d):
    """Written scenarios whose difficulty profile and weaknesses follow from the run."""
    r = src.runs(spark, d)
    body = F.concat_ws(
        "\n", F.when(F.col("run_id") % 9 == 0, "Difficulty: medium").otherwise(F.concat(F.lit("Difficulty: "), "difficulty")), F.lit("- Security-critical inputs: one\n- Sensitive sink: log"), F.concat(F.lit("- State  dependency: "), pick("none", "workflow", "stateless")),
        F.concat(F.lit("- Cross-component interaction: "), pick("none", "service")), F.concat(F.lit("- Security-critical branches: "), pick("1", "2 multiple", "zero", "conditional")), F.when(F.col("run_id") % 5 == 0, "- Why this difficulty:").otherwise(F.lit("- Why this difficulty: so")), F.lit("### Security Requirements"),
        F.concat(F.lit("cover "), "target_cwe"), F.lit("### CWE Coverage"), F.when(F.col("run_id") % 7 == 0, F.lit("CWE-1")).otherwise(F.col("target_cwe")),
    )
    return r.select("run_id", body.alias("text"), "difficulty", F.lit(None).cast("string").alias("surface"), F.array("target_cwe").alias("expected"))


@query(
    "scenario_rules",
    f"""WITH {src.RUNS}, x AS (SELECT *, CASE WHEN run_id % 9 = 0 THEN 'medium' ELSE difficulty END AS said, ['none','workflow','stateless'][run_id % 3 + 1] AS s, ['none','service'][run_id % 2 + 1] AS c, ['1','2 multiple','zero','conditional'][run_id % 4 + 1] AS b, run_id % 5 <> 0 AS whole FROM runs)
SELECT run_id, array_to_string(list_filter([CASE WHEN said <> difficulty THEN 'difficulty_mismatch' END, CASE WHEN NOT whole THEN 'profile_incomplete' END, CASE WHEN whole AND said = 'very easy' AND s = 'workflow' THEN 'state' END, CASE WHEN whole AND said = 'very easy' AND c = 'service' THEN 'cross_component' END,
 CASE WHEN whole AND said = 'very easy' AND b = '2 multiple' THEN 'branching' END, CASE WHEN whole AND said = 'easy' AND s = 'workflow' THEN 'state' END, CASE WHEN whole AND said = 'easy' AND c = 'service' THEN 'cross_component' END, CASE WHEN whole AND said = 'medium' AND b = 'zero' AND c = 'none' THEN 'no_branching' END, CASE WHEN whole AND said = 'medium' AND s = 'workflow' THEN 'state' END,
 CASE WHEN whole AND said = 'very hard' AND s <> 'workflow' THEN 'no_state' END, CASE WHEN whole AND said = 'very hard' THEN 'no_context' END, CASE WHEN run_id % 7 = 0 THEN 'coverage_lacks_cwe' END, CASE WHEN run_id % 7 = 0 THEN 'coverage_adds_cwe' END], lambda v: v IS NOT NULL), ',') AS reasons FROM x""",
)
def _(spark, d):
    return Q.validate(scenarios(spark, d)).select("run_id", F.array_join("reasons", ",").alias("reasons"))


_GOOD = {"User Inputs & Data": "form and cookie", "Web Outputs & Rendering": "html render", "Storage & Filesystem": "file path", "Authentication & Access Control": "session token", "Data Exchange & External Services": "api webhook", "Execution Environment & Infrastructure": "shell command"}
_PROFILE = ["Entry points", "Exposure channel", "Sensitive asset / sink", "Security boundary", "External dependency / runtime context", "Why this attack surface"]


@query(
    "scenario_surface_rules",
    f"""WITH {src.RUNS}, rule AS (SELECT * FROM (VALUES ('Web Outputs & Rendering', 'no_rendering'), ('Storage & Filesystem', 'no_files'), ('Authentication & Access Control', 'no_identity'), ('Data Exchange & External Services', 'no_service'), ('Execution Environment & Infrastructure', 'no_runtime')) t(surface, reason)),
x AS (SELECT run_id, r.surface, reason, run_id % 4 AS k, run_id % 11 = 0 AS other FROM runs r LEFT JOIN rule USING (surface))
SELECT run_id, array_to_string(list_filter([CASE WHEN other THEN 'surface_mismatch' END, CASE WHEN k = 1 THEN 'surface_profile_incomplete' END, CASE WHEN k = 2 OR k = 3 AND surface <> 'Execution Environment & Infrastructure' THEN 'under_specified' END, CASE WHEN k >= 2 THEN reason END], lambda v: v IS NOT NULL), ',') AS reasons FROM x""",
)
def _(spark, d):
    r = src.runs(spark, d)
    good = F.element_at(F.create_map(*[F.lit(x) for kv in _GOOD.items() for x in kv]), F.col("surface"))
    profile = lambda value: F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), value) for name in _PROFILE])
    kind = F.col("run_id") % 4
    body = F.when(kind == 0, profile(good)).when(kind == 1, F.concat(F.lit("- Entry points: "), good)).when(kind == 2, F.lit("nothing much here")).otherwise(profile(F.lit("plain thing")))
    text = F.concat(F.lit("Attack surface: "), F.when(F.col("run_id") % 2 == 0, F.upper("surface")).otherwise(F.col("surface")), F.lit("\n"), body)
    names = F.array(*map(F.lit, src.SURFACES))
    asked = F.when(F.col("run_id") % 11 == 0, F.element_at(names, ((F.col("node_id") + 1) % 6 + 1).cast("int"))).otherwise(F.col("surface"))
    rows = r.select("run_id", text.alias("text"), F.lit("?").alias("difficulty"), asked.alias("surface"), F.array().cast("array<string>").alias("expected"))
    return Q.validate(rows).select("run_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "validator_verdicts",
    f"""WITH {src.RUNS}, x AS (SELECT run_id, target_cwe AS c, run_id % 2 AS v, run_id % 3 AS k, run_id % 5 AS p, run_id % 7 AS q FROM runs)
SELECT run_id, ['natural','contextualized','unknown'][k + 1] AS kind, array_to_string(list_filter([CASE WHEN v = 1 THEN 'rejected' END, CASE WHEN k = 2 THEN 'pair_unclear' END, CASE WHEN p = 0 THEN 'no_paths' END, CASE WHEN p = 1 THEN 'unexpected_paths' END, CASE WHEN p <= 1 THEN c || ' no_path' END,
 CASE WHEN p > 1 AND k = 2 THEN c || ' unclear' END, CASE WHEN p > 1 AND q = 0 THEN c || ' not_credible' END, CASE WHEN p > 1 AND q = 1 THEN c || ' evidence_incomplete' END, CASE WHEN p > 1 AND k = 1 AND q = 2 THEN c || ' no_bridge' END], lambda r: r IS NOT NULL), ',') AS reasons FROM x""",
)
def _(spark, d):
    r = src.runs(spark, d)
    kind = pick("direct", "in_context", "odd")
    p, q = F.col("run_id") % 5, F.col("run_id") % 7
    path = F.struct(
        F.when(p == 1, "cwe_1").otherwise(F.col("target_cwe")).alias("cwe"), kind.alias("classification"), F.when(q == 0, "no").otherwise("yes").alias("credible"), F.lit("a").alias("source"), F.lit("b").alias("trust_boundary"), F.when(q != 1, "c").alias("sensitive_sink"), F.lit("d").alias("required_control"), F.when(q != 2, "e").alias("bridge")
    )
    paths = F.when(p == 0, F.array().cast("array<struct<cwe:string,classification:string,credible:string,source:string,trust_boundary:string,sensitive_sink:string,required_control:string,bridge:string>>")).otherwise(F.array(path))
    payload = F.to_json(F.struct(F.when(F.col("run_id") % 2 == 0, True).otherwise(F.lit(False)).alias("is_valid"), kind.alias("pair_classification"), paths.alias("paths")))
    found = Q.verdict_reasons(r.select("run_id", payload.alias("payload"), F.array("target_cwe").alias("expected")))
    return found.select("run_id", F.col("pair_classification").alias("kind"), F.array_join("reasons", ",").alias("reasons"))


@query("surface_names", "SELECT o_orderkey AS id, ['User Inputs & Data','Storage & Filesystem','Execution Environment & Infrastructure','unknown'][o_orderkey % 4 + 1] AS surface, CAST([1,3,6,0][o_orderkey % 4 + 1] AS INT) AS rank, [1.0::DOUBLE,1.8::DOUBLE,3.0::DOUBLE,1.0::DOUBLE][o_orderkey % 4 + 1] AS weight, ['Web Outputs & Rendering','Authentication & Access Control','Execution Environment & Infrastructure','User Inputs & Data'][o_orderkey % 4 + 1] AS next FROM orders")
def _(spark, d):
    from ..operators import labels as B

    raw = pick("Entrées et  données utilisateur", " storage & filesystem", "ENVIRONNEMENT d’exécution & infrastructure", "elsewhere", by="o_orderkey")
    o = src.table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return B.resolve_surface(o, "raw").select(F.col("o_orderkey").alias("id"), "surface", "rank", "weight", "next")


def reports(spark, d):
    """SARIF reports that hold a run's findings."""
    f = src.findings(spark, d)
    result = F.struct(F.col("test_id").alias("ruleId"), F.element_at(F.create_map(*[F.lit(x) for x in ("LOW", "note", "MEDIUM", "warning", "HIGH", "error")]), F.col("severity")).alias("level"), F.struct(F.concat(F.lit("seen "), F.lower("cwe")).alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    rule = F.struct(F.col("test_id").alias("id"), F.col("test_id").alias("name"), F.struct(F.lit("high").alias("precision")).alias("properties"))
    each = f.groupBy("run_id").agg(F.collect_list(result).alias("results"), F.collect_set(rule).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit("q").alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return each.select("run_id", F.to_json(F.struct(F.array(run).alias("runs"))).alias("report"))


@query("sarif_findings", f"WITH {src.FINDINGS} SELECT run_id, test_id, cwe, severity, 'HIGH' AS confidence, line, count(*) AS n FROM findings GROUP BY ALL")
def _(spark, d):
    return files.sarif_findings(reports(spark, d)).groupBy("run_id", "test_id", "cwe", "severity", "confidence", "line").agg(F.count("*").alias("n"))


_A = "run_id, test_id, cwe, severity, confidence, line"


@query("scanner_report_findings", f"WITH {src.FINDINGS} SELECT {_A}, count(*) AS n FROM findings GROUP BY ALL")
def _(spark, d):
    f = src.findings(spark, d)
    row = F.struct("test_id", F.col("severity").alias("issue_severity"), F.col("confidence").alias("issue_confidence"), F.col("line").alias("line_number"), F.struct(F.substring("cwe", 5, 9).cast("int").alias("id")).alias("issue_cwe"))
    texts = f.groupBy("run_id").agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("report"))
    return files.scanner_a_findings(texts).groupBy(*_A.split(", ")).agg(F.count("*").alias("n"))


@query(
    "collapsed_duplicates",
    f"WITH {src.FINDINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt, part, supp, line, severity, confidence) AS ord FROM findings) SELECT run_id, min(ord) AS ord, line, cwe, ['LOW','MEDIUM','HIGH'][max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END)] AS severity, CAST(count(*) - 1 AS INT) AS merged FROM o GROUP BY run_id, line, cwe",
)
def _(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("attempt", "part", "supp", "line", "severity", "confidence")
    return L.collapse_duplicates(src.findings(spark, d).withColumn("ord", F.row_number().over(order).cast("bigint")).select("run_id", "ord", "line", "cwe", "severity"))


@query(
    "collapsed_chains",
    f"WITH RECURSIVE {src.FINDINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt, part, supp, line, severity, confidence) AS ord FROM findings), l AS (SELECT *, CASE WHEN ord % 4 = 0 THEN ord + 1 WHEN ord % 4 IN (1, 2) THEN ord - 1 WHEN ord % 5 = 0 THEN 99 END AS dup FROM o), "
    "e AS (SELECT a.*, b.ord AS up FROM l a LEFT JOIN l b ON a.run_id = b.run_id AND a.dup = b.ord), walk AS (SELECT run_id, ord, ord AS spot, up, 0 AS step FROM e UNION ALL SELECT w.run_id, w.ord, e.ord, e.up, step + 1 FROM walk w JOIN e ON e.run_id = w.run_id AND e.ord = w.up WHERE step < 40), "
    "fin AS (SELECT run_id, ord, coalesce(max(spot) FILTER (WHERE up IS NULL), min(spot) FILTER (WHERE step > 20)) AS root FROM walk GROUP BY 1, 2), p AS (SELECT f.run_id, f.ord, r.line, r.cwe, l.severity FROM fin f JOIN l USING (run_id, ord) JOIN l r ON r.run_id = f.run_id AND r.ord = f.root) "
    "SELECT run_id, min(ord) AS ord, line, cwe, ['LOW','MEDIUM','HIGH'][max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END)] AS severity, CAST(count(*) - 1 AS INT) AS merged FROM p GROUP BY run_id, line, cwe",
)
def _(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("attempt", "part", "supp", "line", "severity", "confidence")
    found = src.findings(spark, d).withColumn("ord", F.row_number().over(order).cast("bigint"))
    k = F.col("ord")
    to = F.when(k % 4 == 0, k + 1).when((k % 4).isin(1, 2), k - 1).when(k % 5 == 0, 99)
    return L.collapse_duplicates(found.select("run_id", "ord", "line", "cwe", "severity", to.alias("duplicate_of")))


@query("vector_linear_probe")
def _(spark, d):
    v = src.table(spark, d, "embeddings")
    return L.linear_probe(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"))


@query("vector_principal_components")
def _(spark, d):
    return L.principal_components(src.table(spark, d, "embeddings"), 3)
