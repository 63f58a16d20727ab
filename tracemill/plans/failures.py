"""Queries on failure reasons and patterns, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import failures as X
from ..sources import surrogate as src
from . import reports
from .reports import RECORDS, recs

QUERIES, ORACLES = {}, {}

#: Failure rows as DuckDB SQL. Surrogates: no code, syntax and tool errors follow from the run id.
ROWS = f"""{RECORDS}, span AS (SELECT run_id, min(attempt) AS lo, max(attempt) AS hi FROM findings GROUP BY run_id),
ids AS (SELECT f.run_id, list_sort(list_distinct(list(test_id) FILTER (attempt = lo))) AS first_ids, list_sort(list_distinct(list(test_id) FILTER (attempt = hi))) AS final_ids FROM findings f JOIN span USING (run_id) GROUP BY f.run_id),
sets AS (SELECT *, list_sort(list_intersect(first_ids, final_ids)) AS persistent_ids, list_sort(list_filter(first_ids, lambda x: NOT list_contains(final_ids, x))) AS resolved_ids, list_sort(list_filter(final_ids, lambda x: NOT list_contains(first_ids, x))) AS introduced_ids FROM ids),
joined AS (SELECT r.*, coalesce(first_ids, []) AS first_ids, coalesce(final_ids, []) AS final_ids, coalesce(persistent_ids, []) AS persistent_ids, coalesce(resolved_ids, []) AS resolved_ids, coalesce(introduced_ids, []) AS introduced_ids,
 CASE WHEN success AND attempts <= 1 THEN 'success_first_try' WHEN success THEN 'success_after_fixer' WHEN run_id % 23 = 0 THEN 'no_code' WHEN run_id % 17 = 0 THEN 'syntax_error' WHEN run_id % 19 = 0 THEN 'sast_tool_error'
 WHEN total_issues > 0 AND target_issues > 0 THEN 'unresolved_target_findings' WHEN total_issues > 0 THEN 'unresolved_off_target_findings' WHEN run_id % 13 = 0 THEN 'judge_error' WHEN functionality < 0.7e0 THEN 'functionality_low' WHEN judge_is_secure IS NOT NULL THEN 'judge_insecure_no_sast' ELSE 'unknown_failure' END AS primary_reason
 FROM recs r LEFT JOIN sets s USING (run_id)),
anchored AS (SELECT *, CASE WHEN primary_reason LIKE 'unresolved%' THEN coalesce(persistent_ids[1], final_ids[1]) END AS anchor FROM joined),
rows AS (SELECT *, CASE WHEN anchor IS NULL THEN primary_reason ELSE primary_reason || '::sast_test:' || anchor END AS pattern_id FROM anchored), failed AS (SELECT * FROM rows WHERE NOT success)"""


def query(name, sql, prelude=ROWS):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = f"WITH {prelude} {sql}"
        return f

    return put


def rows(spark, d):
    run = F.col("run_id")
    r = recs(spark, d).withColumns({"has_code": run % 23 != 0, "syntax_ok": run % 17 != 0, "tool_error": F.when(run % 19 == 0, "timeout"), "judge_error": F.when(run % 13 == 0, "no answer")})
    return X.failure_rows(r, src.findings(spark, d))


def _p(c):
    return F.array_join(c, "|").alias(c)


@query("failure_rows", "SELECT run_id, success, primary_reason, array_to_string(first_ids, '|') AS first_ids, array_to_string(final_ids, '|') AS final_ids, array_to_string(persistent_ids, '|') AS persistent_ids, array_to_string(resolved_ids, '|') AS resolved_ids, array_to_string(introduced_ids, '|') AS introduced_ids, pattern_id FROM rows")
def _(spark, d):
    return rows(spark, d).select("run_id", "success", "primary_reason", *[_p(c) for c in ("first_ids", "final_ids", "persistent_ids", "resolved_ids", "introduced_ids")], "pattern_id")


@query(
    "top_issue_detail",
    "SELECT run_id, test_id || ':' || cwe || ':' || severity || ':' || confidence AS top_issue FROM (SELECT f.*, row_number() OVER (PARTITION BY run_id ORDER BY (f.cwe = r.target_cwe) DESC, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END DESC, CASE confidence WHEN 'LOW' THEN 1 ELSE 3 END DESC, test_id, f.cwe, line, part, supp) AS r FROM findings f JOIN runs r USING (run_id)) WHERE r = 1",
    f"{src.RUNS}, {src.FINDINGS}",
)
def _(spark, d):
    return X.top_issue(src.findings(spark, d).join(src.runs(spark, d).select("run_id", "target_cwe"), "run_id"))


@query("failure_reasons", "SELECT primary_reason, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM failed) AS DOUBLE), 6) AS rate FROM failed GROUP BY 1")
def _(spark, d):
    return X.reason_counts(rows(spark, d))


@query(
    "failure_reason_by_surface",
    ", g AS (SELECT surface, primary_reason, n FROM (SELECT DISTINCT surface FROM failed) CROSS JOIN (SELECT DISTINCT primary_reason FROM failed) LEFT JOIN (SELECT surface, primary_reason, count(*) AS n FROM failed GROUP BY 1, 2) USING (surface, primary_reason)) SELECT surface, primary_reason, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY surface) AS DOUBLE), 6) AS rate FROM g",
)
def _(spark, d):
    return X.reason_counts(rows(spark, d), "surface")


@query(
    "failure_surface_summary",
    f", c AS (SELECT surface, primary_reason, count(*) AS n, list_position({list(X.REASONS)}, primary_reason) AS o FROM failed GROUP BY 1, 2) SELECT surface, sum(n)::BIGINT AS failed_runs, arg_max(primary_reason, row(n, -o)) AS top_reason, round(arg_max(n, row(n, -o)) / CAST(sum(n) AS DOUBLE), 6) AS top_share FROM c GROUP BY surface",
)
def _(spark, d):
    return X.surface_summary(rows(spark, d))


@query("failure_top_tests", "SELECT id, count(*) AS n FROM (SELECT unnest(final_ids) AS id FROM failed) GROUP BY 1 ORDER BY n DESC, id LIMIT 20")
def _(spark, d):
    return X.top_tokens(rows(spark, d), "final_ids")


@query("fixer_totals", "SELECT count(*) FILTER (len(first_ids) > 0) AS eligible, sum(len(resolved_ids))::BIGINT AS resolved, sum(len(introduced_ids))::BIGINT AS introduced, sum(len(persistent_ids))::BIGINT AS persistent FROM rows WHERE attempts > 1")
def _(spark, d):
    return X.fixer_totals(rows(spark, d))


@query(
    "failure_patterns",
    """, s AS (SELECT pattern_id, surface, count(*) AS n FROM failed GROUP BY 1, 2), w AS (SELECT pattern_id, target_cwe, count(*) AS n FROM failed GROUP BY 1, 2),
s1 AS (SELECT pattern_id, surface FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, surface) AS r FROM s) WHERE r = 1), w1 AS (SELECT pattern_id, target_cwe AS cwe FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, target_cwe) AS r FROM w) WHERE r = 1)
SELECT p.*, s1.surface, w1.cwe FROM (SELECT pattern_id, primary_reason, anchor, count(*) AS support, round(avg(total_issues), 6) AS avg_issues, round(count(*) / CAST((SELECT count(*) FROM failed) AS DOUBLE), 6) AS share, list_sort(list(run_id))[1:3] AS examples FROM failed GROUP BY 1, 2, 3 ORDER BY support DESC, pattern_id LIMIT 10) p JOIN s1 USING (pattern_id) JOIN w1 USING (pattern_id)""",
)
def _(spark, d):
    return X.mine_patterns(rows(spark, d))


for _by in ("surface", "target_cwe"):

    @query(
        f"pattern_specificity_by_{_by}",
        f""", g AS (SELECT {_by}, pattern_id, count(*) AS support FROM failed GROUP BY 1, 2), o AS (SELECT pattern_id, count(*) AS overall FROM failed GROUP BY 1), t AS (SELECT {_by}, count(*) AS in_group FROM failed GROUP BY 1),
x AS (SELECT g.{_by}, pattern_id, support, overall, (support / CAST(in_group AS DOUBLE)) / (overall / CAST((SELECT count(*) FROM failed) AS DOUBLE)) AS lift FROM g JOIN o USING (pattern_id) JOIN t USING ({_by}))
SELECT {_by}, pattern_id, support, overall, round(lift, 6) AS lift, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {_by} ORDER BY round(lift, 9) DESC, support DESC, pattern_id) AS INT) AS nth FROM x) WHERE nth <= 5""",
    )
    def _(spark, d, by=_by):
        return X.specificity(rows(spark, d), by)


_EVIDENCE = f"""{src.RUNS}, {src.FINDINGS}, c AS (SELECT cwe, test_id, difficulty, count(DISTINCT run_id) AS runs, count(*) AS hits FROM findings JOIN runs USING (run_id) GROUP BY 1, 2, 3),
pats AS (SELECT cwe, test_id, sum(runs)::BIGINT AS frequency, sum(hits)::BIGINT AS occurrences, array_to_string(list_sort(list(difficulty || '=' || runs)), ',') AS by_difficulty, substr(sha256(cwe || '|' || test_id), 1, 16) AS pattern_id FROM c GROUP BY 1, 2)"""


@query("evidence_patterns", "SELECT * FROM pats", _EVIDENCE)
def _(spark, d):
    return X.evidence_patterns(src.findings(spark, d), src.runs(spark, d))


@query("evidence_summary", "SELECT cwe, count(*) AS patterns, sum(frequency)::BIGINT AS frequency, round(avg(frequency), 6) AS avg_frequency, arg_max(test_id, row(frequency, test_id)) AS top_test FROM pats GROUP BY cwe", _EVIDENCE)
def _(spark, d):
    return X.evidence_summary(X.evidence_patterns(src.findings(spark, d), src.runs(spark, d)))


@query(
    "reason_top_or_other",
    ", top AS (SELECT primary_reason FROM failed GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) SELECT difficulty, CASE WHEN primary_reason IN (SELECT * FROM top) THEN primary_reason ELSE 'other' END AS bucket, count(*) AS n FROM failed GROUP BY 1, 2",
)
def _(spark, d):
    return X.top_or_other(rows(spark, d).where("not success"), "primary_reason", 4, "difficulty")


@query("persistent_by_difficulty", "SELECT id, " + ", ".join(f"count(*) FILTER (difficulty = '{x}') AS \"{x}\"" for x in src.DIFFICULTIES) + " FROM (SELECT unnest(persistent_ids) AS id, difficulty FROM failed) GROUP BY id")
def _(spark, d):
    p = rows(spark, d).where("not success").select(F.explode("persistent_ids").alias("id"), "difficulty")
    return p.groupBy("id").pivot("difficulty", src.DIFFICULTIES).count().na.fill(0)


@query("category_by_model", "SELECT model, CASE WHEN success THEN 'success' WHEN primary_reason IN ('no_code', 'syntax_error') THEN 'code' WHEN primary_reason = 'sast_tool_error' THEN 'tool' WHEN primary_reason LIKE 'unresolved%' THEN 'security' WHEN primary_reason = 'functionality_low' THEN 'function' ELSE 'judge' END AS category, count(*) AS n, round(100e0 * sum(total_issues) / count(*), 4) AS findings_per_100 FROM rows GROUP BY 1, 2")
def _(spark, d):
    r = F.col("primary_reason")
    category = F.when(F.col("success"), "success").when(r.isin("no_code", "syntax_error"), "code").when(r == "sast_tool_error", "tool").when(r.startswith("unresolved"), "security").when(r == "functionality_low", "function").otherwise("judge")
    return rows(spark, d).groupBy("model", category.alias("category")).agg(F.count("*").alias("n"), F.round(F.sum("total_issues") * 100.0 / F.count("*"), 4).alias("findings_per_100"))


_ = reports


@query("pattern_labels", "SELECT id, CASE r WHEN 'no_code' THEN 'No code returned' WHEN 'odd_reason' THEN 'Odd reason' WHEN 'unresolved_target_findings' THEN CASE t WHEN 'sast_test' THEN 'Persistent target findings on V' WHEN 'cwe' THEN 'Persistent target findings for V' ELSE 'Persistent target-CWE findings' END ELSE CASE t WHEN 'sast_test' THEN 'Off-target findings introduced via V' WHEN 'cwe' THEN 'Off-target findings for V' ELSE 'Off-target vulnerabilities introduced' END END AS label FROM x", "x AS (SELECT o_orderkey AS id, ['no_code','unresolved_target_findings','unresolved_off_target_findings','odd_reason'][o_orderkey % 4 + 1] AS r, ['sast_test','cwe','none'][o_orderkey % 3 + 1] AS t FROM orders)")
def _(spark, d):
    o = src.table(spark, d, "orders")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), X.pattern_label(pick("no_code", "unresolved_target_findings", "unresolved_off_target_findings", "odd_reason"), pick("sast_test", "cwe", "none"), F.lit("V")).alias("label"))


@query("analysis_overlay", "SELECT o_orderkey AS id, o_orderkey % 3 = 1 AS success, ['no_code','success_first_try','syntax_error'][o_orderkey % 3 + 1] AS reason, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'no_code_output|generation_failure' ELSE 'said' END AS tags, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM orders", "one AS (SELECT 1)")
def _(spark, d):
    o = src.table(spark, d, "orders")
    reason = F.element_at(F.array(*map(F.lit, ("no_code", "success_first_try", "syntax_error"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    code = F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("x = 1")
    rows = o.select(F.col("o_orderkey").alias("id"), reason.alias("reason"), code.alias("code"), F.lit("words").alias("summary"), F.array(F.lit("said")).alias("tags"), F.lit("LOW").alias("confidence"))
    return X.overlay(rows).select("id", "success", "reason", F.array_join("tags", "|").alias("tags"), "confidence")


_EVIDENCE = f"{src.RUNS}, {src.FINDINGS}, e AS (SELECT cwe, test_id, substr(sha256(cwe || '|' || test_id), 1, 16) AS pattern_id, count(DISTINCT run_id) AS frequency FROM findings GROUP BY 1, 2)"


@query("evidence_by_difficulty", "SELECT difficulty, count(*) AS patterns FROM (SELECT DISTINCT difficulty, cwe, test_id FROM findings JOIN runs USING (run_id)) GROUP BY 1", _EVIDENCE)
def _(spark, d):
    return X.evidence_by_difficulty(X.evidence_patterns(src.findings(spark, d), src.runs(spark, d)))


@query("evidence_totals", "SELECT count(*) AS patterns, count(DISTINCT cwe) AS cwes, round(avg(frequency), 6) AS avg_frequency, (SELECT string_agg(pattern_id, ',' ORDER BY frequency DESC, pattern_id) FROM (SELECT * FROM e ORDER BY frequency DESC, pattern_id LIMIT 10)) AS most_common FROM e", _EVIDENCE)
def _(spark, d):
    return X.evidence_totals(X.evidence_patterns(src.findings(spark, d), src.runs(spark, d)))


@query("weaknesses_in_order", "SELECT target_cwe, count(*) AS n, CAST(CASE target_cwe WHEN 'CWE-40' THEN 1 WHEN 'CWE-22' THEN 2 ELSE 2 + dense_rank() OVER (PARTITION BY target_cwe IN ('CWE-40', 'CWE-22') ORDER BY target_cwe) END AS INT) AS place FROM runs GROUP BY 1", src.RUNS)
def _(spark, d):
    counts = src.runs(spark, d).groupBy("target_cwe").agg(F.count("*").alias("n"))
    return X.in_order(counts, "target_cwe", ["CWE-40", "CWE-22"])
