"""Small literal cases and invariants."""

import pytest
from pyspark.sql import functions as F

from tracemill import catalog
from tracemill.functions import scores as S
from tracemill.functions import texts as T
from tracemill.operators import failures as X
from tracemill.operators import labels as B
from tracemill.operators import learned as L
from tracemill.operators import scenario_rules as Q
from tracemill.operators import summary as U
from tracemill.operators import triage as G
from tracemill.sources import surrogate as src

FOLDER = "/root/testdata/sf0.001"


def test_reasons_by_surface(spark):
    rows = spark.createDataFrame([(False, "syntax_error", "User Inputs & Data"), (False, "unresolved_target_findings", "Web Outputs & Rendering"), (True, "success_first_try", "Web Outputs & Rendering")], "success boolean, primary_reason string, surface string")
    found = {(r.surface, r.primary_reason): (r.n, r.rate) for r in X.reason_counts(rows, "surface").collect()}
    assert found["User Inputs & Data", "syntax_error"] == (1, 1.0) and found["Web Outputs & Rendering", "unresolved_target_findings"] == (1, 1.0) and found["User Inputs & Data", "unresolved_target_findings"] == (0, 0.0)


def test_attempt_sets(spark):
    rows = [(1, 1, "B301"), (1, 1, "B105"), (1, 3, "B301"), (1, 3, "B999"), (2, 2, "B1")]
    found = {r.run_id: r for r in X.attempt_sets(spark.createDataFrame(rows, "run_id bigint, attempt int, test_id string")).collect()}
    assert (found[1].persistent_ids, found[1].resolved_ids, found[1].introduced_ids) == (["B301"], ["B105"], ["B999"]) and found[2].persistent_ids == ["B1"]


def test_pattern_anchor_and_lift(spark):
    schema = "run_id bigint, success boolean, primary_reason string, persistent_ids array<string>, final_ids array<string>, surface string, target_cwe string, total_issues bigint"
    rows = spark.createDataFrame([(1, False, "unresolved_target_findings", ["B301"], ["B301"], "s", "CWE-502", 1), (2, False, "unresolved_target_findings", [], ["B301"], "s", "CWE-502", 3), (3, False, "syntax_error", [], [], "t", "CWE-79", 0)], schema)
    rows = rows.withColumn("anchor", X.anchor()).withColumn("pattern_id", F.when(F.col("anchor").isNull(), F.col("primary_reason")).otherwise(F.concat("primary_reason", F.lit("::sast_test:"), "anchor")))
    first = X.mine_patterns(rows).orderBy(F.desc("support")).first()
    assert (first.pattern_id, first.support, first.examples, first.avg_issues) == ("unresolved_target_findings::sast_test:B301", 2, [1, 2], 2.0)
    lifts = {(r.surface, r.pattern_id): r.lift for r in X.specificity(rows, "surface").collect()}
    assert lifts["s", "unresolved_target_findings::sast_test:B301"] == 1.5 and lifts["t", "syntax_error"] == 3.0


def test_duplicate_evidence_counts_once(spark):
    f = spark.createDataFrame([(1, "CWE-502", "B301")] * 2, "run_id bigint, cwe string, test_id string")
    row = X.evidence_patterns(f, spark.createDataFrame([(1, "easy")], "run_id bigint, difficulty string")).first()
    assert (row.frequency, row.occurrences, row.by_difficulty) == (1, 2, "easy=1") and len(row.pattern_id) == 16


def test_cross_tool_merge(spark):
    rows = [(1, "CWE-502", 2, "LOW", "LOW", "a", "a:B301"), (1, "CWE-502", 2, "HIGH", "HIGH", "b", "b:rule"), (1, "CWE-502", 3, "LOW", "LOW", "a", "a:B301")]
    found = {r.line: r for r in G.cross_tool(spark.createDataFrame(rows, "run_id bigint, cwe string, line int, severity string, confidence string, tool string, test_id string")).collect()}
    assert (found[2].severity, found[2].confidence, found[2].tools, found[2].removed) == ("HIGH", "HIGH", "a|b", 1) and found[3].removed == 0


def test_verdict_falls_back_to_test_id(spark):
    f = spark.createDataFrame([(1, "T1", 5), (1, "T1", 6), (1, "T2", 5)], "run_id bigint, test_id string, line int")
    v = spark.createDataFrame([(1, "T1", 5, 1, "FP"), (1, "T1", None, 2, "TP"), (1, "T1", 5, 3, "TP")], "run_id bigint, test_id string, line int, review_ord int, verdict string")
    assert {(r.test_id, r.line): r.verdict for r in G.with_verdicts(f, v).collect()} == {("T1", 5): "FP", ("T1", 6): "TP", ("T2", 5): None}


def test_ordered_collapse(spark):
    f = spark.createDataFrame([(1, 1, 4, "C", "LOW"), (1, 2, 4, "C", "HIGH"), (1, 3, 5, "C", "LOW")], "run_id bigint, ord bigint, line int, cwe string, severity string")
    assert sorted(tuple(r) for r in L.collapse_duplicates(f).collect()) == [(1, 1, 4, "C", "HIGH", 1), (1, 3, 5, "C", "LOW", 0)]


PROFILE = "Difficulty: hard\nSurface d’attaque: authentification et contrôle d'accès\n- Security-critical inputs: a\n- Sensitive sink: b\n- Security-critical branches: 2\n- State dependency: workflow\n- Cross-component interaction: service\n- Why this difficulty: c\nlogin session role token path\n"


def test_scenario_rules(spark):
    good = PROFILE + "### Security Requirements\nCWE-79 and cwe_22\n### CWE Coverage\n- CWE-79\n- CWE-22\n"
    bad = "short text\n### Security Requirements\nCWE-79"
    df = spark.createDataFrame([(1, good, "hard", "Authentication & Access Control", ["CWE-79", "CWE-22"]), (2, bad, "easy", "Storage & Filesystem", ["CWE-22"]), (3, None, None, None, [])], "id int, text string, difficulty string, surface string, expected array<string>")
    a, b, c = Q.validate(df).orderBy("id").collect()
    assert a.valid and a.reasons == [] and c.valid
    assert b.reasons == ["difficulty_mismatch", "surface_mismatch", "profile_incomplete", "under_specified", "no_files", "security_lacks_cwe", "no_coverage_section"]


def test_verdicts_that_are_no_objects(spark):
    df = spark.createDataFrame([(1, "none", ["CWE-1"]), (2, '```{"is_valid": "yes", "classification": "natural", "cwe_paths": []}```', [])], "id int, payload string, expected array<string>")
    a, b = Q.verdict_reasons(df).orderBy("id").collect()
    assert a.reasons == ["no_object"] and a.pair_classification == "unknown" and b.valid and b.pair_classification == "natural"


def test_intervals_bracket_and_scores_order(spark):
    df = spark.range(0, 50).select((F.col("id") % 3 == 0).alias("success"), (F.col("id") / 60.0).alias("risk"))
    low, high = S.wilson(F.count_if("success"), F.count("*"))
    a, b = S.mean_ci(F.col("risk"))
    row = df.agg(low.alias("lo"), high.alias("hi"), F.avg(F.col("success").cast("double")).alias("p"), a.alias("a"), b.alias("b"), F.avg("risk").alias("m")).first()
    assert 0 <= row.lo < row.p < row.hi <= 1 and row.a < row.m < row.b
    empty = df.where("risk > 9").agg(low.alias("lo"), high.alias("hi")).first()
    assert (empty.lo, empty.hi) == (0.0, 0.0)
    one = spark.range(1).select(S.adaptive_reward(F.lit(True), S.num(1), S.num(0)).alias("clean"), S.adaptive_reward(F.lit(False), S.num(3), S.num(0.9)).alias("open"), S.ucb1(S.num(0.5), F.lit(0), F.lit(3), F.lit(2)).alias("u"), S.combined_risk(S.num(0.2), F.lit(None).cast("double")).alias("silent")).first()
    assert one.clean > one.open and one.u == float("inf") and one.silent == 0.2


def test_difficulty_spellings(spark):
    df = spark.createDataFrame([(" VeryHard ",), ("very   easy",), ("?",), (None,)], "raw string")
    assert {r.raw: (r.difficulty, r.rank) for r in B.resolve_difficulty(df, "raw").collect()} == {" VeryHard ": ("very hard", 4), "very   easy": ("very easy", 0), "?": ("unknown", None), None: ("unknown", None)}


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 4.0)], "k string, x double")
    assert sorted(r.r for r in U.average_rank(df, "x", "r", "k").collect()) == [1.0, 2.5, 2.5, 4.0]


@pytest.mark.parametrize("text,first,every", [("x CWE-079 y cwe_22", "CWE-79", ["CWE-79", "CWE-22"]), ("CWE 0", None, ["CWE-0"]), ("none", None, [])])
def test_weakness_ids(spark, text, first, every):
    row = spark.createDataFrame([(text,)], "t string").select(T.cwe_of(F.col("t")).alias("a"), T.cwe_mentions(F.col("t")).alias("b")).first()
    assert (row.a, row.b) == (first, every)


@pytest.mark.parametrize("name", ["failure_patterns", "attempt_trajectory", "subset_parents", "scenario_exact_duplicates"])
def test_same_rows_for_any_partition_count(spark, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, catalog.QUERIES[name](spark, FOLDER).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]


def test_shares_sum_to_one(spark):
    rows = catalog.QUERIES["root_cause_share"](spark, FOLDER).groupBy("model").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-4 for r in rows)
    assert src.runs(spark, FOLDER).count() == src.table(spark, FOLDER, "orders").count()


def test_rules_search_a_text_once_for_each_field(spark):
    df = spark.createDataFrame([(1, "Difficulty: easy", "easy", None, ["CWE-1"])], "id int, text string, difficulty string, surface string, expected array<string>")
    plan = Q.validate(df)._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("regexp_extract_all(") <= len(Q.DIFFICULTY_FIELDS) + len(Q.SURFACE_FIELDS) + 2


def test_evidence_holds_no_set_of_runs(spark):
    f = spark.createDataFrame([(1, "CWE-1", "B1")] * 3 + [(2, "CWE-1", "B1"), (2, "CWE-2", "B1"), (None, "CWE-1", "B1")], "run_id bigint, cwe string, test_id string")
    found = X.evidence_patterns(f, spark.createDataFrame([(1, "easy"), (2, "hard")], "run_id bigint, difficulty string"))
    assert {(r.cwe, r.frequency, r.occurrences, r.by_difficulty) for r in found.collect()} == {("CWE-1", 2, 4, "easy=1,hard=1"), ("CWE-2", 1, 1, "hard=1")}
    assert "distinct run_id" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
