"""Run records and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def finding_sums(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Per run: counts by level, distinct weaknesses and tests, weight sums split by target. targets: (run_id, target_cwe).

    Findings are reduced by (run, weakness, test) before they meet the targets, so that distinct counts are
    of few rows and no finding is copied for them.
    """
    level = lambda c, k: F.count_if(F.col(c) == k).alias(f"{c}_{k.lower()}")
    plain = S.issue_weight(F.col("severity"), F.col("confidence"), F.lit(False))
    cells = findings.groupBy("run_id", "cwe", "test_id").agg(F.count("*").alias("n"), *[level(c, k) for c in ("severity", "confidence") for k in S.LEVELS], F.sum(plain).alias("w"))
    f = cells.join(targets.select("run_id", "target_cwe"), "run_id")
    hit = F.col("cwe") == F.col("target_cwe")
    target, other = F.coalesce(F.sum(F.when(hit, F.col("w") * S.TARGET_MULTIPLIER)), S.num(0)), F.coalesce(F.sum(F.when(~hit, F.col("w"))), S.num(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = f.groupBy("run_id").agg(
        F.sum("n").alias("total_issues"), total(F.when(hit, F.col("n"))).alias("target_issues"), total(F.when(~hit, F.col("n"))).alias("off_target_issues"), *[F.sum(f"{c}_{k.lower()}").alias(f"{c}_{k.lower()}") for c in ("severity", "confidence") for k in S.LEVELS],
        F.size(F.collect_set("cwe")).cast("bigint").alias("distinct_cwes"), F.size(F.collect_set("test_id")).cast("bigint").alias("distinct_tests"), target.alias("weight_target"), other.alias("weight_off_target"),
    )
    return sums.withColumn("weight", F.col("weight_target") + F.col("weight_off_target"))


def records(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One flat row per run: its own columns, finding sums and the combined risks."""
    sums = finding_sums(findings, runs)
    joined = runs.join(sums, "run_id", "left")
    counts = [c for c in sums.columns if c != "run_id"]
    filled = joined.na.fill(0, counts)
    return filled.withColumns({"risk_sast": S.risk(F.col("weight"))}).withColumns(
        {"risk": S.combined_risk(F.col("risk_sast"), F.col("judge_risk")), "risk_max": S.combined_risk(F.col("risk_sast"), F.col("judge_risk"), "max"), "total_issues_raw": F.col("total_issues") + F.col("false_positives")}
    )


def attempt_trajectory(findings: DataFrame) -> DataFrame:
    """Per run: risk of the first, the best (earliest least) and the final attempt with findings, and the change."""
    w = S.issue_weight(F.col("severity"), F.col("confidence"), F.lit(False))
    each = findings.groupBy("run_id", "attempt").agg(F.sum(w).alias("w"), F.count("*").alias("issues")).withColumn("risk", S.risk(F.col("w")))
    first, last = F.min_by("risk", "attempt"), F.max_by("risk", "attempt")
    return each.groupBy("run_id").agg(
        F.count("*").alias("attempts_executed"), first.alias("risk_first"), F.min("risk").alias("risk_best"), F.min_by("attempt", F.struct("risk", "attempt")).alias("best_attempt"), last.alias("risk_final"),
        (first - last).alias("risk_delta"), F.min_by("issues", "attempt").alias("issues_first"), F.max_by("issues", "attempt").alias("issues_final"),
    )


def measures() -> list[Column]:
    """The measures of a group of records."""
    r6 = lambda c, n: F.round(c, 6).alias(n)
    n, s = F.count("*"), F.count_if("success")
    low, high = S.wilson(s, n)
    risk_low, risk_high = S.mean_ci(F.col("risk"), clamp=True)
    share = lambda c: S.ratio(F.count_if(c), F.count("*"))
    judged = F.count("judge_is_secure")
    return [
        n.alias("runs"), r6(S.ratio(s, n), "success_rate"), r6(low, "success_low"), r6(high, "success_high"), r6(S.ratio(F.count_if(F.col("success") & (F.col("attempts") == 1)), n), "first_attempt_success_rate"),
        r6(F.avg("risk"), "avg_risk"), r6(risk_low, "avg_risk_low"), r6(risk_high, "avg_risk_high"), r6(F.median("risk"), "median_risk"), r6(F.avg("total_issues"), "avg_total_issues"), r6(F.median("total_issues"), "median_total_issues"),
        r6(F.avg("attempts"), "avg_attempts"), r6(share(F.col("used_fixer")), "fixer_rate"), r6(share(F.col("target_issues") > 0), "target_issue_rate"), r6(share(F.col("off_target_issues") > 0), "off_target_issue_rate"),
        r6(F.avg("off_target_issues"), "avg_off_target_issues"), r6(F.avg("functionality"), "avg_functionality"), r6(S.ratio(F.count_if("judge_is_secure"), judged), "judge_secure_rate"),
        r6(F.avg("total_issues_raw"), "avg_total_issues_raw"), r6(F.median("total_issues_raw"), "median_total_issues_raw"), r6(F.avg("false_positives"), "avg_false_positives"), r6(F.median("false_positives"), "median_false_positives"),
        r6(F.avg(S.ratio(F.col("false_positives"), F.col("total_issues_raw"))), "avg_false_positive_rate"), r6(share(F.col("scan_failed")), "scan_error_rate"), r6(F.avg("loc"), "avg_loc"),
        r6(F.avg(S.ratio(F.col("total_issues"), F.col("loc"))), "avg_issue_density"), r6(F.avg(F.when(F.col("parses"), F.col("cyclomatic"))), "avg_cyclomatic"), r6(F.avg("risk_delta"), "avg_risk_delta"),
        r6(S.ratio(F.count_if(F.col("risk_delta") > 0), F.count("risk_delta")), "improved_risk_rate"),
    ]


def group_summary(recs: DataFrame, *keys: str) -> DataFrame:
    """All measures by key, in one aggregation."""
    return recs.groupBy(*keys).agg(*measures())


def group_summary_sets(recs: DataFrame) -> DataFrame:
    """The main measures for all records, by phase, by phase and difficulty, by difficulty, by surface: one pass with grouping sets."""
    keys = ["phase", "difficulty", "surface"]
    return recs.groupingSets([[], ["phase"], ["phase", "difficulty"], ["difficulty"], ["surface"]], *keys).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("runs"), F.round(S.ratio(F.count_if("success"), F.count("*")), 6).alias("success_rate"), F.round(F.avg("risk"), 6).alias("avg_risk")
    )


def pearson(recs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlations of column pairs over rows where both are known; null below two rows or without variance."""
    out = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        ok = (F.count(x) >= 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
        out.append(F.round(F.when(ok, F.corr(x, y)), 6).alias(f"{a}__{b}"))
    return recs.agg(*out)


def average_rank(df: DataFrame, value: str, out: str, *by: str) -> DataFrame:
    """Rank with ties at their mean.

    Ranks are given to distinct values, counted beforehand, so that the ordered window sees one row
    for each value.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn(out, F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / F.lit(2.0)).drop("__n")
    return df.join(ranked, [*by, value])


def spearman(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Rank correlation of two columns by key; null below three rows."""
    ranked = average_rank(average_rank(df.select(by, a, b).dropna(), a, "__ra", by), b, "__rb", by)
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 3, F.corr("__ra", "__rb")), 6).alias("rho"))


def capability(recs: DataFrame, item: str, group: str, order: str) -> DataFrame:
    """Item x group: runs, success, failure and mean risk, null for empty cells; primary marks an item's group with most runs (ties: the harder)."""
    cells = recs.groupBy(item, group, order).agg(F.count("*").alias("runs"), F.count_if("success").alias("ok"), F.avg("risk").alias("risk"))
    grid = recs.select(item).distinct().crossJoin(recs.select(group, order).distinct())
    full = grid.join(cells, [item, group, order], "left")
    first = Window.partitionBy(item).orderBy(F.desc_nulls_last("runs"), F.desc(order))
    return full.withColumn("primary", (F.row_number().over(first) == 1) & F.col("runs").isNotNull()).select(
        item, group, F.coalesce("runs", F.lit(0)).alias("runs"), F.round(S.ratio(F.col("ok"), F.col("runs")), 6).alias("success_rate"), F.round(1 - S.ratio(F.col("ok"), F.col("runs")), 6).alias("failure_rate"), F.round("risk", 6).alias("avg_risk"), "primary"
    )


def coverage(recs: DataFrame, item: str) -> DataFrame:
    """How many items there are, have any success, have nothing but successes."""
    each = recs.groupBy(item).agg(F.bool_or("success").alias("some"), F.bool_and("success").alias("every"))
    return each.agg(F.count("*").alias("items"), F.count_if("some").alias("any_success"), F.count_if("every").alias("all_success"))


def hardest(summary: DataFrame, *keys: str, k: int = 20, least_runs: int = 2) -> DataFrame:
    """Top k by mean risk, then runs; groups below the least support don't count."""
    return summary.where(F.col("runs") >= least_runs).orderBy(F.desc("avg_risk"), F.desc("runs"), *keys).limit(k)


def lowest_success(summary: DataFrame, *keys: str, k: int = 20, least_runs: int = 2) -> DataFrame:
    return summary.where(F.col("runs") >= least_runs).orderBy("success_rate", F.desc("runs"), *keys).limit(k)


def level_counts(findings: DataFrame, column: str) -> DataFrame:
    """Counts of all levels, 0 for those that don't occur."""
    levels = findings.sparkSession.createDataFrame([(x,) for x in S.LEVELS], f"{column} string")
    return levels.join(findings.groupBy(column).agg(F.count("*").alias("n")), column, "left").na.fill(0)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins from 1 on; 0 and bins + 1 hold what lies outside."""
    return df.groupBy(F.width_bucket(column, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
