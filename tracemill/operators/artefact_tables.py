"""Judge payloads, generated answers, validation reports and run folders as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import python_code as P
from ..functions import scores as S
from ..functions import texts as T
from .rounds import numbered

REVIEW = "struct<verdict: string, classification: string, test_id: string, bandit_test_id: string, line_number: string, reason: string, rationale: string, fix: string, fix_suggestion: string, suggested_fix: string, duplicate_of: string>"
PAYLOAD = f"security_score string, functionality_score string, overall_risk string, target_cwe_risk string, is_secure string, findings array<string>, sast_review array<{REVIEW}>"


def judge_payloads(answers: DataFrame, targets: Column) -> DataFrame:
    """answers (..., payload: JSON text) with scores, risks, reviews and is_secure; what is missing gets its default.

    A risk by weakness counts as the largest of the targets, or of all if no target is named. Texts that
    aren't JSON are mended first, in Python; the others never leave the JVM.
    """
    fine = F.from_json("payload", PAYLOAD)
    parsed = F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise(P.repaired_json(F.col("payload")))
    rows = answers.withColumn("payload", parsed).withColumn("p", fine)
    number = lambda name: F.col(f"p.{name}").try_cast("double")
    security = F.coalesce(S.clamp01(number("security_score")), S.num(0.5))
    functionality = F.coalesce(S.clamp01(number("functionality_score")), S.num(1))
    overall = F.coalesce(S.clamp01(number("overall_risk")), 1 - security)
    by_cwe = F.from_json("p.target_cwe_risk", "map<string, string>")
    risks = lambda keep: F.array_max(F.transform(F.map_values(F.map_filter(by_cwe, lambda k, v: keep(k))), lambda v: v.try_cast("double")))
    mapped = F.coalesce(risks(lambda k: F.array_contains(targets, k)), risks(lambda k: F.lit(True)))
    target = F.coalesce(S.clamp01(F.coalesce(number("target_cwe_risk"), mapped)), overall)
    review = F.transform(
        F.coalesce(F.col("p.sast_review"), F.array().cast(f"array<{REVIEW}>")),
        lambda r: F.struct(
            F.coalesce(r["test_id"], r["bandit_test_id"]).alias("test_id"), T.safe_int(r["line_number"]).alias("line"), T.verdict(F.coalesce(r["verdict"], r["classification"])).alias("verdict"), F.coalesce(r["reason"], r["rationale"]).alias("reason"),
            F.coalesce(r["fix"], r["fix_suggestion"], r["suggested_fix"]).alias("fix"), T.duplicate_ref(r["duplicate_of"]).alias("duplicate_of"),
        ),
    )
    out = rows.withColumns({"security_score": security, "functionality_score": functionality, "overall_risk": overall, "target_risk": target, "reviews": review})
    by_scores = (F.col("functionality_score") >= 0.7) & (F.col("security_score") >= 0.8) & (F.col("overall_risk") <= 0.2) & (F.col("target_risk") <= 0.2)
    return out.withColumn("is_secure", F.coalesce(T.yes_no(F.col("p.is_secure")), by_scores)).drop("p")


def solution_patterns(runs: DataFrame, *keys: str) -> DataFrame:
    """How often each pattern (a run's main strategy, techniques and data structures) occurs by key, by category."""
    part = lambda name, items: F.struct(F.lit(name).alias("category"), items.alias("items"))
    named = F.array(part("main_strategy", F.array("main_strategy")), part("technique", F.col("techniques")), part("data_structure", F.col("structures")))
    each = runs.select(*keys, F.explode(named).alias("c")).select(*keys, F.col("c.category").alias("category"), F.explode("c.items").alias("pattern")).where("pattern is not null and pattern <> ''")
    return each.groupBy(*keys, "category", "pattern").agg(F.count("*").alias("n"))


#: Titles of the sections of a validation report.
SECTIONS = {"missing": "Missing Test Scenarios", "incorrect": "Incorrect Assertions", "coverage": "Suggestions for Improving Test Coverage", "edge": "Analysis of Edge Cases"}


def report_section(text: Column, title: str) -> Column:
    """The body of a numbered report's section: up to the next numbered line or the end."""
    return F.regexp_extract(text, rf"(?s){title}[:\n]+(.*?)(?=\n\d+\.|\z)", 1)


def validation_issues(reports: DataFrame, categories: dict[str, dict[str, str]], *keys: str) -> DataFrame:
    """Matches of each subcategory's expression (ignoring case) in its section, and suggestions, by key. categories: section -> subcategory -> expression."""
    counts = {f"{s}_{name}": F.regexp_count(report_section(F.col("text"), SECTIONS[s]), F.lit(f"(?i){pattern}")) for s, group in categories.items() for name, pattern in group.items()}
    counts["total_suggestions"] = F.regexp_count("text", F.lit(r"(?s)-\s*(.*?)(?=(?:-|\z))"))
    rows = reports.select(*keys, *[c.cast("bigint").alias(name) for name, c in counts.items()])
    return rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in counts]).unpivot(list(keys), list(counts), "issue", "n")


def is_run_result(columns: list[str]) -> Column:
    """Whether a result has what a security run has: a scan, targets or a number of issues."""
    present = [F.col(c).isNotNull() for c in ("sast", "target_cwes", "total_issues") if c in columns]
    out = F.lit(False)
    for c in present:
        out = out | c
    return out


def deep_concepts(cells: DataFrame, least: int = 2) -> DataFrame:
    """Concept x depth cells below the first level."""
    return cells.where(F.col("depth") >= least)


def without_prefixes(df: DataFrame, column: str, prefixes: tuple[str, ...] = ("fix_", "root_")) -> DataFrame:
    """Rows whose name doesn't begin with one of the prefixes."""
    return df.where(~F.col(column).rlike("^(?:" + "|".join(prefixes) + ")"))


def problem_index(nodes: DataFrame, length: int = 1_000) -> DataFrame:
    """Problems by concept, by difficulty and by combination: kind, key, chunk, number of problems in it, and their ids in order of title, then id.

    A key's list comes in numbered chunks (from 0 on) of `length` ids, so that no array grows with the data;
    places are counted by the titles' beginnings first, so no task sorts a whole key.
    """
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.concat(F.transform("concepts", lambda c: entry("concept", c)), F.array(entry("difficulty", F.col("difficulty")), entry("combination", F.array_join(F.array_sort("concepts"), "+"))))
    each = nodes.select("node_id", "title", F.explode(keys).alias("k")).select("k.kind", "k.key", "title", "node_id")
    placed = numbered(each, ["kind", "key"], F.struct(F.substring("title", 1, 3).alias("head"), F.when(F.length("title") <= 3, F.floor(F.col("node_id") / 10_000)).otherwise(F.lit(1 << 62)).alias("range")), ["title", "node_id"], "place")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"])
    return placed.withColumn("chunk", F.floor((F.col("place") - 1) / length)).groupBy("kind", "key", "chunk").agg(F.count("*").alias("problems"), ids.alias("node_ids"))


def shared_concepts(groups: DataFrame, by: str) -> DataFrame:
    """The union of the groups' concepts, with the groups that have each."""
    return groups.select(by, F.explode("concepts").alias("concept")).distinct().groupBy("concept").agg(T.pipe_join(F.collect_set(by)).alias("groups"))


def challenging(runs: DataFrame, k: int) -> DataFrame:
    """The k combinations of highest mean challenge score, then of most runs."""
    each = runs.groupBy(F.array_join(F.array_sort("concepts"), "+").alias("combo"), "difficulty").agg(F.round(F.avg("challenge"), 6).alias("score"), F.count("*").alias("count"))
    return each.orderBy(F.desc("score"), F.desc("count"), "combo", "difficulty").limit(k)


def run_chain(metas: DataFrame, results: DataFrame, patterns: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per run folder (run_path) with what its meta, result, pattern and failure documents say; a missing one gives nulls."""
    out = metas
    for name, df in (("result", results), ("pattern", patterns), ("failure", failures)):
        packed = df.select("run_path", F.struct(*[c for c in df.columns if c != "run_path"]).alias(name))
        out = out.join(packed, "run_path", "left")
    return out
