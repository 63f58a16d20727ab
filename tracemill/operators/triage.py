"""Finding triage: review verdicts, duplicates across tools, fallback joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import texts as T
from .nearest import neighbours, probes_for, vector_index


def with_verdicts(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the verdict for their exact key (run, test, line), else for their test in the run.

    Of several reviews for one key the first (least review_ord) counts; keys come from reduced
    tables, so no finding is multiplied.
    """
    first = F.min_by("verdict", "review_ord")
    exact = reviews.where("line is not null").groupBy("run_id", "test_id", "line").agg(first.alias("__exact"))
    loose = reviews.where("line is null").groupBy("run_id", "test_id").agg(first.alias("__loose"))
    out = findings.join(exact, ["run_id", "test_id", "line"], "left").join(loose, ["run_id", "test_id"], "left")
    return out.withColumn("verdict", F.coalesce("__exact", "__loose")).drop("__exact", "__loose")


def triaged(judged: DataFrame, guard: int = 6, review_only: bool = True) -> DataFrame:
    """What stays after review: a false positive is dropped; where only reviews decide, unless severity x confidence rank reaches the guard."""
    weight = S.level_rank(F.col("severity")) * S.level_rank(F.col("confidence"))
    false = F.coalesce("verdict", F.lit("")) == "FP"
    spared = false & (weight >= guard) & F.lit(review_only)
    return judged.withColumns({"kept": ~false | spared, "overridden": spared})


def cross_tool(findings: DataFrame) -> DataFrame:
    """One finding for each (run, weakness, line, source line): worst levels, tools and tests that agree, how many were removed.

    Findings without a weakness or a line have no key and stay as they are. `source`, the text of the
    line, counts with its white space collapsed where findings have it.
    """
    worst = lambda c: F.max_by(c, S.level_rank(F.col(c)))
    source = T.normal(F.col("source")) if "source" in findings.columns else F.lit("")
    keyed = F.col("cwe").isNotNull() & F.col("line").isNotNull()
    alone = F.when(~keyed, F.monotonically_increasing_id())
    return findings.withColumns({"source": F.coalesce(source, F.lit("")), "__alone": alone}).groupBy("run_id", "cwe", "line", "source", "__alone").agg(
        worst("severity").alias("severity"), worst("confidence").alias("confidence"), T.pipe_join(F.collect_set("tool")).alias("tools"), T.pipe_join(F.collect_set("test_id")).alias("tests"), (F.count("*") - 1).alias("removed")
    ).drop("__alone", *([] if "source" in findings.columns else ["source"]))


def collapse_references(reviews: DataFrame) -> DataFrame:
    """Reviews whose duplicate_of names a key that is there are dropped; references to what isn't there don't count."""
    keys = reviews.select("run_id", T.issue_key(F.col("test_id"), F.col("line")).alias("ref")).distinct()
    referring = reviews.withColumn("ref", T.duplicate_ref(F.col("duplicate_of"))).where("ref is not null").join(keys, ["run_id", "ref"], "left_semi")
    own = T.issue_key(F.col("test_id"), F.col("line"))
    away = referring.where(F.col("ref") != own).select("run_id", "review_ord").distinct()
    return reviews.join(away, ["run_id", "review_ord"], "left_anti")


def heuristic_pairs(findings: DataFrame) -> DataFrame:
    """Pairs of findings of different tools at one line of a run, with the same snippet where there is one, that share a weakness, a description or two of its tokens."""
    place = ["run_id", "line"] + [c for c in ("snippet",) if c in findings.columns]
    each = ["tool", "test_id", "cwe", "tokens"] + [c for c in ("description",) if c in findings.columns]
    x, y = (findings.select(*place, *[F.col(c).alias(f"{c}_{s}") for c in each]) for s in "ab")
    pairs = x.join(y, place).where("tool_a < tool_b")
    same = (F.col("cwe_a") == F.col("cwe_b")) | (F.size(F.array_intersect("tokens_a", "tokens_b")) >= 2)
    return pairs.where(same | (F.col("description_a") == F.col("description_b")) if "description" in findings.columns else same)


def restricted(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Reviews of findings that exist, by key or else by test."""
    with_line = reviews.where("line is not null").join(findings, ["run_id", "test_id", "line"], "left_semi")
    without = reviews.where("line is null").join(findings, ["run_id", "test_id"], "left_semi")
    return with_line.unionByName(without)


def rule_lookup(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with their rule's level, `warning` for unknown rules; Spark broadcasts the catalogue if its size allows."""
    return findings.join(rules, "test_id", "left").withColumn("level", F.coalesce("level", F.lit("warning")))


def knn_votes(train: DataFrame, test: DataFrame, k: int, metric: str = "cosine", lists: int = 1, recall: float = 0.95) -> DataFrame:
    """Label of each test vector: the majority among its k nearest train vectors other than itself (ties: higher mean similarity, then lesser label).

    Similarity is the cosine, or minus the distance for `l2`. Exact with one list; with more, each test vector asks as many of
    its nearest lists of an index over all train vectors as give the recall on a sample of them (see `nearest`). A test vector without a
    neighbour has no row.
    """
    index = vector_index(train, lists, metric)
    kept = neighbours(index, test, k, probes_for(index, test, k, recall))
    votes = kept.groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.round(F.avg("sim"), 6).alias("mean_sim"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("votes", "mean_sim", -F.col("label"))).alias("label"), F.max("votes").alias("votes"))
