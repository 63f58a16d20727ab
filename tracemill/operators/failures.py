"""Failure reasons, failure aggregates and recurring failure patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import texts as T

#: The names of reasons, in order of precedence.
REASONS = ("success_first_try", "success_after_fixer", "no_code", "syntax_error", "sast_tool_error", "unresolved_target_findings", "unresolved_off_target_findings", "judge_error", "functionality_low", "judge_insecure_no_sast", "unknown_failure")


def attempt_sets(findings: DataFrame) -> DataFrame:
    """Per run: sorted test ids of the first and the final attempt, and what persists, is resolved or introduced between them.

    A run without findings in its first attempt has none of the three.
    """
    first = findings.groupBy("run_id").agg(F.min("attempt").alias("__lo"), F.max("attempt").alias("__hi"))
    f = findings.join(first, "run_id")
    ids = lambda c: F.array_sort(F.collect_set(F.when(F.col("attempt") == F.col(c), F.col("test_id"))))
    sets = f.groupBy("run_id").agg(ids("__lo").alias("first_ids"), ids("__hi").alias("final_ids"))
    op = lambda g, a, b: F.when(F.size("first_ids") > 0, F.array_sort(g(a, b))).otherwise(F.array().cast("array<string>"))
    return sets.withColumns({"persistent_ids": op(F.array_intersect, "first_ids", "final_ids"), "resolved_ids": op(F.array_except, "first_ids", "final_ids"), "introduced_ids": op(F.array_except, "final_ids", "first_ids")})


def primary_reason(threshold: float = 0.7) -> Column:
    """The first reason that holds.

    Reads success, attempts, has_code, syntax_ok, tool_error, total_issues, target_issues, judge_error, judge_is_secure and functionality.
    """
    c = F.col
    return (
        F.when(c("success") & (c("attempts") <= 1), "success_first_try").when(c("success"), "success_after_fixer").when(~c("has_code"), "no_code").when(~c("syntax_ok"), "syntax_error").when(c("tool_error").isNotNull(), "sast_tool_error")
        .when((c("total_issues") > 0) & (c("target_issues") > 0), "unresolved_target_findings").when(c("total_issues") > 0, "unresolved_off_target_findings").when(c("judge_error").isNotNull(), "judge_error")
        .when(c("functionality") < threshold, "functionality_low").when(c("judge_is_secure").isNotNull(), "judge_insecure_no_sast").otherwise("unknown_failure")
    )


def top_issue(findings: DataFrame) -> DataFrame:
    """Per run the gravest finding: target first, then severity, confidence; ties: least test id, weakness, line."""
    rank = F.struct((F.col("cwe") == F.col("target_cwe")).cast("int").alias("t"), S.level_rank(F.col("severity")).alias("s"), S.level_rank(F.col("confidence")).alias("c"))
    best = Window.partitionBy("run_id").orderBy(F.desc(rank), "test_id", "cwe", "line", "part", "supp")
    return findings.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("run_id", F.concat_ws(":", "test_id", "cwe", "severity", "confidence").alias("top_issue"))


def failure_rows(recs: DataFrame, findings: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per run with its reason, id sets, pattern anchor and pattern id."""
    none = F.array().cast("array<string>")
    rows = recs.join(attempt_sets(findings), "run_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("first_ids", "final_ids", "persistent_ids", "resolved_ids", "introduced_ids")})
    rows = rows.withColumn("primary_reason", primary_reason(threshold))
    return rows.withColumn("anchor", anchor()).withColumn("pattern_id", F.when(F.col("anchor").isNull(), F.col("primary_reason")).otherwise(F.concat("primary_reason", F.lit("::sast_test:"), "anchor")))


#: What a reason is called; unresolved findings with the anchor that they have, if any.
LABELS = {
    "no_code": "No code returned",
    "syntax_error": "Syntax errors in generated code",
    "sast_tool_error": "SAST tool execution failures",
    "functionality_low": "Functionality regressions after generation/fixing",
    "judge_error": "Judge execution failures",
    "judge_insecure_no_sast": "Insecure behavior missed by SAST",
    "unknown_failure": "Unclassified failed runs",
    "success_first_try": "Secure success on the first try",
    "success_after_fixer": "Secure success after fixing",
}
ANCHORED = {
    "unresolved_target_findings": ("Persistent target findings on ", "Persistent target findings for ", "Persistent target-CWE findings"),
    "unresolved_off_target_findings": ("Off-target findings introduced via ", "Off-target findings for ", "Off-target vulnerabilities introduced"),
}


def pattern_label(reason: Column, anchor_type: Column, anchor_value: Column) -> Column:
    """What a failure pattern is called; anchor_type is `sast_test`, `cwe` or anything else."""
    words = F.regexp_replace(reason, "_", " ")
    out = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1000)))
    for name, label in LABELS.items():
        out = F.when(reason == name, label).otherwise(out)
    filled = F.coalesce(anchor_value != "", F.lit(False))
    for name, (test, cwe, plain) in ANCHORED.items():
        text = F.when((anchor_type == "sast_test") & filled, F.concat(F.lit(test), anchor_value)).when((anchor_type == "cwe") & filled, F.concat(F.lit(cwe), anchor_value)).otherwise(plain)
        out = F.when(reason == name, text).otherwise(out)
    return out


def overlay(analyses: DataFrame) -> DataFrame:
    """Analyses with what is computed in place of what a model said: no code has a fixed analysis, other rows keep summary and tags.

    analyses: (reason, code, persistent, resolved, introduced, summary, tags, confidence).
    """
    none = (F.col("reason") == "no_code") | (F.coalesce(F.trim("code"), F.lit("")) == "")
    return analyses.withColumns({
        "success": F.col("reason").startswith("success"), "reason": F.when(none & F.col("reason").isNull(), "no_code").otherwise(F.col("reason")), "tags": F.when(none, F.array(F.lit("no_code_output"), F.lit("generation_failure"))).otherwise(F.col("tags")),
        "summary": F.when(none, "No code was returned, so patterns were not analysed.").otherwise(F.col("summary")), "confidence": F.when(none, "HIGH").otherwise(F.col("confidence")),
    }).drop("code")


def anchor() -> Column:
    """For unresolved findings: the first persistent test id, else the first final one."""
    return F.when(F.col("primary_reason").startswith("unresolved"), F.coalesce(F.get("persistent_ids", F.lit(0)), F.get("final_ids", F.lit(0))))


def reason_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Failed runs and their share by reason (and key), with 0 for reasons that don't occur under a key."""
    failed = rows.where("not success")
    cells = failed.groupBy(*by, "primary_reason").agg(F.count("*").alias("n"))
    if by:
        grid = failed.select(*by).distinct().crossJoin(failed.select("primary_reason").distinct())
        cells = grid.join(cells, [*by, "primary_reason"], "left").na.fill(0, ["n"])
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return cells.withColumn("rate", F.round(S.ratio(F.col("n"), F.sum("n").over(total)), 6))


def surface_summary(rows: DataFrame) -> DataFrame:
    """Per surface: failed runs, top reason (most runs; ties: first in order of reasons) and its share."""
    failed = rows.where("not success")
    order = F.array_position(F.array(*map(F.lit, REASONS)), F.col("primary_reason"))
    cells = failed.groupBy("surface", "primary_reason").agg(F.count("*").alias("n")).withColumn("o", -order)
    best = F.max_by(F.struct("primary_reason", "n"), F.struct("n", "o"))
    return cells.groupBy("surface").agg(F.sum("n").alias("failed_runs"), best.alias("b")).select("surface", "failed_runs", F.col("b.primary_reason").alias("top_reason"), F.round(S.ratio(F.col("b.n"), F.col("failed_runs")), 6).alias("top_share"))


def top_tokens(rows: DataFrame, ids: str, k: int = 20) -> DataFrame:
    """Most frequent ids among failed runs; ties in order of id."""
    return rows.where("not success").select(F.explode(ids).alias("id")).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(k)


def fixer_totals(rows: DataFrame) -> DataFrame:
    """What the fixer could, did and didn't resolve, over all runs with more than one attempt."""
    many = rows.where("attempts > 1")
    return many.agg(F.count_if(F.size("first_ids") > 0).alias("eligible"), F.sum(F.size("resolved_ids")).alias("resolved"), F.sum(F.size("introduced_ids")).alias("introduced"), F.sum(F.size("persistent_ids")).alias("persistent"))


def mine_patterns(rows: DataFrame, k: int = 10, examples: int = 3) -> DataFrame:
    """Patterns (reason and anchor) by support: share of failures, dominant surface and weakness, least run ids as examples.

    Examples are kept as bounded lists: ranks within a pattern are cut before anything is collected.
    """
    failed = rows.where("not success")
    total = failed.agg(F.count("*").alias("all"))
    main = failed.groupBy("pattern_id", "primary_reason", "anchor").agg(F.count("*").alias("support"), F.mode("surface", True).alias("surface"), F.mode("target_cwe", True).alias("cwe"), F.round(F.avg("total_issues"), 6).alias("avg_issues"))
    first = Window.partitionBy("pattern_id").orderBy("run_id")
    some = failed.select("pattern_id", "run_id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= examples).groupBy("pattern_id").agg(F.array_sort(F.collect_list("run_id")).alias("examples"))
    share = F.round(S.ratio(F.col("support"), F.col("all")), 6)
    top = main.crossJoin(F.broadcast(total)).withColumn("share", share).drop("all").orderBy(F.desc("support"), "pattern_id").limit(k)
    return top.join(some, "pattern_id")


def specificity(rows: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Per key the patterns with the highest lift: share among the key's failures over share among all.

    Everything follows from the counts of (key, pattern), so rows are computed once. What is null is filtered
    after the windows: a filter below them would make two plans of the counts where one is reused.
    """
    group = rows.where("not success").groupBy(by, "pattern_id").agg(F.count("*").alias("support"))
    support_of = lambda key: F.sum("support").over(Window.partitionBy(key))
    x = group.withColumn("overall", support_of("pattern_id")).withColumn("in_group", support_of(by)).where(F.col(by).isNotNull() & F.col("pattern_id").isNotNull())
    everything = group.agg(F.sum("support").alias("all"))
    x = x.crossJoin(F.broadcast(everything))
    x = x.withColumn("lift", S.ratio(F.col("support"), F.col("in_group")) / S.ratio(F.col("overall"), F.col("all")))
    best = Window.partitionBy(by).orderBy(F.desc(F.round("lift", 9)), F.desc("support"), "pattern_id")
    return x.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select(by, "pattern_id", "support", "overall", F.round("lift", 6).alias("lift"), "nth")


def evidence_patterns(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Patterns of weakness and test: runs they occur in (each once), occurrences, runs by difficulty as a map.

    A run's rows are sorted once, for their numbers and for the join alike, and no task holds a set of runs. run_ids of runs are unique.
    """
    of_run = Window.partitionBy("run_id", "cwe", "test_id").orderBy("run_id")
    nth = findings.select("run_id", "cwe", "test_id").where("run_id is not null").repartition("run_id").withColumn("nth", F.row_number().over(of_run))
    each = nth.join(runs.select("run_id", "difficulty"), "run_id")
    cells = each.groupBy("cwe", "test_id", "difficulty").agg(F.count_if(F.col("nth") == 1).alias("runs"), F.count("*").alias("hits"))
    out = cells.groupBy("cwe", "test_id").agg(F.sum("runs").alias("frequency"), F.sum("hits").alias("occurrences"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "difficulty", F.col("runs").cast("string")))), ",").alias("by_difficulty"))
    return out.withColumn("pattern_id", T.sha16(F.concat_ws("|", "cwe", "test_id")))


def evidence_summary(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("cwe").agg(F.count("*").alias("patterns"), F.sum("frequency").alias("frequency"), F.round(F.avg("frequency"), 6).alias("avg_frequency"), F.max_by("test_id", F.struct("frequency", "test_id")).alias("top_test"))


def evidence_by_difficulty(patterns: DataFrame) -> DataFrame:
    """How many patterns occur at a difficulty, from their by_difficulty lists."""
    return patterns.select(F.explode(F.split("by_difficulty", ",")).alias("d")).select(F.split("d", "=")[0].alias("difficulty")).groupBy("difficulty").agg(F.count("*").alias("patterns"))


def evidence_totals(patterns: DataFrame, k: int = 10) -> DataFrame:
    """Patterns, weaknesses, mean frequency, and the k most frequent patterns, in one row."""
    top = patterns.orderBy(F.desc("frequency"), "pattern_id").limit(k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "pattern_id"))), lambda x: x["pattern_id"]), ",").alias("most_common"))
    return patterns.agg(F.count("*").alias("patterns"), F.count_distinct("cwe").alias("cwes"), F.round(F.avg("frequency"), 6).alias("avg_frequency")).crossJoin(top)


def in_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows with `place`: the given values in their order, then all others by name."""
    known = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    later = rows.where(known == 0).select(column).distinct()
    place = later.withColumn("__place", len(order) + F.row_number().over(Window.orderBy(column)))
    return rows.join(place, column, "left").withColumn("place", F.coalesce("__place", known.cast("int"))).drop("__place")


def top_or_other(df: DataFrame, column: str, k: int, *by: str) -> DataFrame:
    """Counts by the k most frequent values, all others as `other`; ties in order of value."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), column).limit(k).select(F.col(column).alias("__v"))
    named = df.join(F.broadcast(counts), F.col(column) == F.col("__v"), "left").withColumn("bucket", F.coalesce("__v", F.lit("other")))
    return named.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
