"""Steps that a query takes once for all that follows from them: plans, and results on null and repeated rows."""

from collections import Counter

from tracemill import catalog
from tracemill.operators import failures as X
from tracemill.operators import scenario_rules as Q

_FAILED = [("CWE-1", "a"), ("CWE-1", "a"), ("CWE-1", "b"), ("CWE-2", "a"), ("CWE-2", None), (None, "a"), (None, None), ("CWE-3", "c"), ("CWE-3", "b"), ("CWE-3", "b")]


def _lifts(failed):
    """(key, pattern) to support, overall and lift; null keys and patterns count in what others are held against, and have no rows."""
    group, overall, totals = Counter(failed), Counter(p for _, p in failed), Counter(k for k, _ in failed)
    return {(k, p): (n, overall[p], round(n / totals[k] / (overall[p] / len(failed)), 6)) for (k, p), n in group.items() if k is not None and p is not None}


def test_specificity_of_null_and_repeated_rows(spark):
    rows = [(k, p, False) for k, p in _FAILED] + [("CWE-1", "a", True), ("CWE-1", "b", None)]
    found = X.specificity(spark.createDataFrame(rows, "cwe string, pattern_id string, success boolean"), "cwe").collect()
    assert {(r.cwe, r.pattern_id): (r.support, r.overall, r.lift) for r in found} == _lifts(_FAILED)
    assert len(found) == len(_lifts(_FAILED))
    assert [r.pattern_id for r in sorted(found, key=lambda r: r.nth) if r.cwe == "CWE-3"] == ["c", "b"]
    best = X.specificity(spark.createDataFrame(rows, "cwe string, pattern_id string, success boolean"), "cwe", k=1).collect()
    assert {r.cwe: r.pattern_id for r in best} == {"CWE-1": "a", "CWE-2": "a", "CWE-3": "c"}
    assert not X.specificity(spark.createDataFrame([], "cwe string, pattern_id string, success boolean"), "cwe").collect()


def test_specificity_computes_rows_once(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that is known beforehand shows what is reused
    rows = own.range(100).selectExpr("concat('CWE-', id % 5) as cwe", "concat('p', id % 7) as pattern_id", "id % 2 = 0 as success")
    plan = X.specificity(rows, "cwe")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1, plan


_ASKED = "Difficulty: {}\n- Security-critical inputs: a\n- Sensitive sink: b\n- Security-critical branches: {}\n- State dependency: {}\n- Cross-component interaction: {}\n- Why this difficulty: c\n"
_SECTIONS = "### Security Requirements\nCWE-1\n### CWE Coverage\nCWE-1\n"
_ODD = [
    (_ASKED.format("very easy", "multiple", "workflow", "service"), "very easy", None, ["state", "cross_component", "branching"]),
    (_ASKED.format("easy", "1", "none", "multi"), None, None, ["cross_component"]),
    (_ASKED.format("medium", "zero", "stateful", "n/a"), "medium", "?", ["no_branching", "state"]),
    (_ASKED.format("hard", "1", "none", "none").replace("State dependency", "Sensitive sink: x\n- STATE\tdependency "), "hard", None, []),
    (_ASKED.format("very hard", "1", "multi-state", "none"), "very hard", None, ["no_context"]),
    (_ASKED.format("odd", "1", "none", "none"), "?", None, []),
    (_ASKED.format("hard", "1", "none", "none") + "- State dependency:\n", "hard", None, ["profile_incomplete"]),
    ("Attack surface: storage & filesystem\n- Entry points: form\nfile path\n", None, "Storage & Filesystem", ["surface_profile_incomplete", "security_lacks_cwe", "no_coverage_section"]),
    ("Attack surface: storage & filesystem\nfile path\n", None, "Web Outputs & Rendering", ["surface_mismatch", "security_lacks_cwe", "no_coverage_section"]),
    ("file page\n" + _SECTIONS, None, "User Inputs & Data", ["surface_mismatch", "under_specified"]),
    ("- Sensitive sink: - State dependency: x\r### Security Requirements\n" + _SECTIONS, "easy", None, ["difficulty_mismatch", "profile_incomplete"]),
    ("", "easy", "Storage & Filesystem", ["difficulty_mismatch", "surface_mismatch", "profile_incomplete", "under_specified", "no_files", "security_lacks_cwe", "no_coverage_section"]),
    (None, None, None, ["security_lacks_cwe", "no_coverage_section"]),
]


def test_rules_of_the_target_alone(spark):
    rows = [(i, text if text is None or "###" in text or "surface" in text or not text else text + _SECTIONS, difficulty, surface, ["CWE-1"]) for i, (text, difficulty, surface, _) in enumerate(_ODD)]
    df = spark.createDataFrame(rows + rows, "id int, text string, difficulty string, surface string, expected array<string>")
    found = Q.validate(df).collect()
    assert len(found) == 2 * len(rows) and all(r.valid == (not r.reasons) for r in found)
    lacking = {i: r for i, (*_, r) in enumerate(_ODD)}
    assert {r.id: r.reasons for r in found} == lacking


def test_rules_are_compiled(spark):
    """The JVM never compiles methods of more than 8,000 bytes: these stay interpreted for every row."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    plan = catalog.QUERIES["scenario_rules"](own, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    parts = getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution, "debug.package").codegenStringSeq(plan)
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.length())]
    assert sizes and max(sizes) < 8000, sizes
