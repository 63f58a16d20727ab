"""Concept, pattern and model queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import compare as C
from ..sources import surrogate as src
from .reports import RECORDS, recs

QUERIES, ORACLES = {}, {}
MODELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
OK = "CASE WHEN success THEN 1e0 ELSE 0e0 END"
CONCEPT = f"{src.RUNS}, c AS (SELECT *, unnest(concepts) AS concept FROM runs)"
PATTERNS = f"{src.RUNS}, {src.FINDINGS}, pats AS (SELECT DISTINCT run_id, test_id AS pattern FROM findings), p AS (SELECT r.*, pattern FROM runs r JOIN pats USING (run_id))"


def query(name, sql, prelude=src.RUNS):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = f"WITH {prelude} {sql}"
        return f

    return put


def pats(spark, d):
    found = src.findings(spark, d).select("run_id", F.col("test_id").alias("pattern")).distinct()
    return src.runs(spark, d).join(found, "run_id")


def concepts(spark, d):
    return C.by_concept(src.runs(spark, d))


_SA = f"round(avg({OK}), 6) AS success_rate, round(avg(coalesce(nullif(attempts, 0), 3)), 6) AS avg_attempts, count(*) FILTER (attempts = 3 AND used_fixer) AS fixer_interventions"


@query("concept_success", f"SELECT concept, {_SA} FROM c GROUP BY concept", CONCEPT)
def _(spark, d):
    return C.success_and_attempts(concepts(spark, d), "concept")


@query("difficulty_success", f"SELECT difficulty, {_SA} FROM runs GROUP BY difficulty")
def _(spark, d):
    return C.success_and_attempts(src.runs(spark, d), "difficulty")


@query("mastery", f"SELECT concept, difficulty, round(sum(rate * visits) / sum(visits), 6) AS mastery, sum(visits)::BIGINT AS visits FROM (SELECT concept, difficulty, node_id, avg({OK}) AS rate, count(*) AS visits FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2", CONCEPT)
def _(spark, d):
    cells = concepts(spark, d).groupBy("concept", "difficulty", "node_id").agg(F.avg(C.ok()).alias("rate"), F.count("*").alias("visits"))
    return C.mastery(cells)


@query(
    "challenge_ranking",
    f", p AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY run_id) AS place FROM c), s AS (SELECT concept, round(count(DISTINCT difficulty) / 5e0 * 0.4e0 + sum({OK} * place) / sum(place) * 0.6e0, 6) AS score FROM p GROUP BY 1) SELECT concept, score, CAST(row_number() OVER (ORDER BY score, concept) AS INT) AS rank FROM s",
    CONCEPT,
)
def _(spark, d):
    return C.challenge_ranking(concepts(spark, d), 5)


@query("degradation_curve", f", e AS (SELECT concept, len(concepts) AS size, avg({OK}) AS rate FROM c GROUP BY 1, 2) SELECT concept, CAST(size AS INT) AS size, round(rate, 6) AS success_rate, round(rate / nullif(first_value(rate) OVER (PARTITION BY concept ORDER BY size), 0e0), 6) AS relative FROM e", CONCEPT)
def _(spark, d):
    return C.degradation(concepts(spark, d))


@query("difficulty_scaling", ", q AS (SELECT *, count(*) OVER (PARTITION BY concept ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS av FROM c) SELECT concept, difficulty, arg_max(success, run_id) AS last_success, max(av) AS available FROM q GROUP BY 1, 2", CONCEPT)
def _(spark, d):
    return C.difficulty_scaling(concepts(spark, d))


@query("combination_stats", f"SELECT array_to_string(concepts, '+') AS combo, count(*) AS runs, round(avg({OK}), 6) AS success_rate, round(sum(value) / sum(attempts), 4) AS value_per_attempt FROM runs GROUP BY 1")
def _(spark, d):
    return C.combinations(src.runs(spark, d))


@query("last_run_by_node", f", l AS (SELECT arg_max(success, run_id) AS success, arg_max(attempts, run_id) AS attempts, arg_max(difficulty, run_id) AS difficulty, arg_max(array_to_string(concepts, '+'), run_id) AS combo FROM runs GROUP BY node_id) SELECT combo, difficulty, count(*) AS nodes, round(avg({OK}), 6) AS success_rate, round(avg(attempts), 6) AS avg_attempts FROM l GROUP BY 1, 2")
def _(spark, d):
    return C.last_run(src.runs(spark, d))


_LEAVES = ["attempts", "functionality", "judge_risk", "value"]


@query("nested_average", "SELECT model, phase, path, round(sum(v) / count(v), 6) AS mean, count(v) AS n FROM (" + " UNION ALL ".join(f"SELECT model, phase, '{x}' AS path, CAST({x} AS DOUBLE) AS v FROM runs" for x in _LEAVES) + ") GROUP BY 1, 2, 3")
def _(spark, d):
    return C.nested_average(C.flatten(src.runs(spark, d), ["model", "phase"], _LEAVES), "model", "phase", "path")


@query("model_summary", f"SELECT model, round(avg({OK}), 6) AS success_rate, round(avg(attempts), 6) AS avg_attempts, count(*) AS patterns, count(DISTINCT pattern) AS distinct_patterns FROM p GROUP BY model", PATTERNS)
def _(spark, d):
    return pats(spark, d).groupBy("model").agg(C.R(F.avg(C.ok()), "success_rate"), C.R(F.avg("attempts"), "avg_attempts"), F.count("*").alias("patterns"), F.count_distinct("pattern").alias("distinct_patterns"))


@query("pattern_effectiveness", f", e AS (SELECT pattern, count(*) AS usage, avg({OK}) AS rate FROM p GROUP BY 1 HAVING count(*) > 1), m AS (SELECT avg(rate) AS mean FROM e) SELECT pattern, usage, round(rate, 6) AS effectiveness, round(rate / mean, 6) AS relative FROM e, m", PATTERNS)
def _(spark, d):
    return C.pattern_effectiveness(pats(spark, d))


_PC = f", b AS (SELECT *, unnest(concepts) AS concept FROM p), k AS (SELECT pattern, concept, count(*) AS usage, avg({OK}) AS rate FROM b GROUP BY 1, 2), o AS (SELECT concept, avg({OK}) AS own FROM b GROUP BY 1), cells AS (SELECT pattern, concept, usage, round(rate, 6) AS success_rate, round(rate / nullif(own, 0e0), 6) AS ratio FROM k JOIN o USING (concept))"


@query("pattern_by_concept", f"{_PC} SELECT * FROM cells", PATTERNS)
def _(spark, d):
    return C.pattern_by_concept(pats(spark, d))


@query("worst_concepts", f"{_PC} SELECT concept, round(avg(ratio) * sum(usage), 6) AS score, sum(usage)::BIGINT AS usage FROM cells GROUP BY 1 ORDER BY score, concept LIMIT 4", PATTERNS)
def _(spark, d):
    return C.worst_concepts(C.pattern_by_concept(pats(spark, d)))


@query("pattern_top_by_difficulty", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY difficulty ORDER BY usage DESC, pattern) AS INT) AS nth FROM (SELECT difficulty, pattern, count(*) AS usage, round(avg({OK}), 6) AS success_rate FROM p GROUP BY 1, 2)) WHERE nth <= 5", PATTERNS)
def _(spark, d):
    return C.top_patterns(pats(spark, d), "difficulty")


@query("model_concept_ends", f", e AS (SELECT model, concept, round(avg({OK}), 6) AS success_rate FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY success_rate DESC, concept) AS t, row_number() OVER (PARTITION BY model ORDER BY success_rate, concept) AS b FROM e) SELECT model, concept, success_rate, CASE WHEN t <= 3 THEN 'top' ELSE 'bottom' END AS \"end\" FROM r WHERE t <= 3 OR b <= 3", CONCEPT)
def _(spark, d):
    each = concepts(spark, d).groupBy("model", "concept").agg(C.R(F.avg(C.ok()), "success_rate"))
    return C.both_ends(each, "success_rate", "concept", "model")


@query("root_cause_share", "SELECT model, cwe, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY model) AS DOUBLE), 6) AS share FROM findings JOIN runs USING (run_id) GROUP BY 1, 2", f"{src.RUNS}, {src.FINDINGS}")
def _(spark, d):
    f = src.findings(spark, d).select("run_id", "cwe").join(src.runs(spark, d).select("run_id", "model"), "run_id")
    return C.row_share(f, "model", "cwe")


@query("weighted_failure_rate", f"SELECT model, CASE WHEN difficulty_rank <= 1 THEN 'easy' WHEN difficulty_rank = 2 THEN 'medium' ELSE 'hard' END AS bucket, round(sum(len(concepts) * (1 - {OK})) / sum(len(concepts)), 6) AS failure_rate, sum(len(concepts))::BIGINT AS weight FROM runs GROUP BY 1, 2")
def _(spark, d):
    return C.weighted_failure(src.runs(spark, d))


@query(
    "inferred_capability",
    f", fine AS (SELECT *, array_to_string(concepts, '|') || '|' || node_id AS combo FROM runs), k AS (SELECT combo, difficulty_rank, count(*) AS runs, avg(1 - {OK}) AS f FROM fine GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT combo FROM k) CROSS JOIN (SELECT DISTINCT difficulty_rank FROM k)), x AS (SELECT combo, difficulty_rank, runs, CASE WHEN runs IS NULL THEN CASE WHEN difficulty_rank < max(CASE WHEN runs IS NOT NULL THEN difficulty_rank END) OVER (PARTITION BY combo) THEN 0e0 ELSE 1e0 END ELSE f END AS f FROM g LEFT JOIN k USING (combo, difficulty_rank)) SELECT combo, difficulty_rank, coalesce(runs, 0) AS runs, round(f, 6) AS failure_rate, f < 0.5e0 AS operational FROM x",
)
def _(spark, d):
    # Combinations by node, so that cells are missing at all: the operator is about those.
    cells = src.runs(spark, d).groupBy(F.concat_ws("|", F.array_join("concepts", "|"), F.col("node_id").cast("string")).alias("combo"), "difficulty_rank").agg(F.count("*").alias("runs"), F.avg(1 - C.ok()).alias("failure_rate"))
    return C.inferred_capability(cells, "combo")


@query("phase_share", "SELECT concept, phase, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY concept) AS DOUBLE), 6) AS share FROM c GROUP BY 1, 2", CONCEPT)
def _(spark, d):
    return C.share_within(concepts(spark, d), "concept", "phase")


@query("tier_summary", f"SELECT model, CAST(len(concepts) AS INT) AS tier, count(*) AS runs, round(avg({OK}), 6) AS success_rate, round(avg(attempts), 6) AS avg_attempts, round(stddev_samp(attempts), 6) AS sd_attempts FROM runs GROUP BY 1, 2")
def _(spark, d):
    return C.tiers(src.runs(spark, d))


@query("equal_weight_failure", f"SELECT target_cwe, round(avg(f), 6) AS failure_rate, count(*) AS groups FROM (SELECT target_cwe, model, avg(1 - {OK}) AS f FROM runs GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return C.equal_weight(src.runs(spark, d), "model", "target_cwe")


@query("support_order", "SELECT cwe, count(*) AS n FROM findings GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, cwe LIMIT 10", src.FINDINGS)
def _(spark, d):
    return C.by_support(src.findings(spark, d), "cwe")


_OV = f"count(*) AS runs, round(avg({OK}), 6) AS success_rate, round(avg(CASE WHEN success AND attempts = 1 THEN 1e0 ELSE 0e0 END), 6) AS first_attempt_success_rate, round(count(*) FILTER (success AND attempts > 1) / CAST(nullif(count(*) FILTER (attempts > 1 OR NOT success), 0) AS DOUBLE), 6) AS recovery_rate, round(avg(attempts), 6) AS avg_attempts, round(avg(risk), 6) AS avg_risk, round(avg(total_issues), 6) AS findings_per_run, round(count(*) FILTER (total_issues > 0) / CAST(count(*) AS DOUBLE), 6) AS residual_issue_rate, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) - avg(CASE WHEN success AND attempts = 1 THEN 1e0 ELSE 0e0 END), 6) AS feedback_gain, round(count(*) FILTER (target_issues > 0) / CAST(count(*) AS DOUBLE), 6) AS target_issue_rate, round(count(*) FILTER (off_target_issues > 0) / CAST(count(*) AS DOUBLE), 6) AS off_target_issue_rate, round(avg(CASE WHEN used_fixer THEN 1e0 ELSE 0e0 END), 6) AS fixer_rate"


@query("model_overview", f"SELECT model, {_OV} FROM recs GROUP BY model", RECORDS)
def _(spark, d):
    return C.overview(recs(spark, d), "model")


@query("surface_overview", f"SELECT model, surface, {_OV} FROM recs GROUP BY 1, 2", RECORDS)
def _(spark, d):
    return C.overview(recs(spark, d), "model", "surface")


@query("model_alignment", "SELECT array_to_string(concepts, '|') AS combo, difficulty, " + ", ".join(f"round(avg({OK}) FILTER (model = '{m}'), 6) AS \"{m}\"" for m in MODELS) + " FROM runs GROUP BY 1, 2")
def _(spark, d):
    return C.align_models(src.runs(spark, d).withColumn("combo", F.array_join("concepts", "|")), MODELS, "combo", "difficulty")


@query("concept_pair_matrix", f", q AS (SELECT {OK} AS ok, concept AS a, unnest(concepts) AS b FROM c) SELECT a, b, count(*) AS n, round(avg(ok), 6) AS success_rate FROM q WHERE a <> b GROUP BY 1, 2", CONCEPT)
def _(spark, d):
    return C.pair_matrix(src.runs(spark, d))


@query("designer_confusion", "SELECT difficulty, " + ", ".join(f"count(*) FILTER (g = '{x}') AS \"{x}\"" for x in src.DIFFICULTIES) + f" FROM (SELECT difficulty, {src.DIFFICULTIES}[(difficulty_rank + CASE WHEN run_id % 3 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS g FROM runs) GROUP BY difficulty")
def _(spark, d):
    return C.confusion(_guessed(spark, d), "difficulty", "guess", src.DIFFICULTIES)


def _guessed(spark, d):
    k = (F.col("difficulty_rank") + F.when(F.col("run_id") % 3 == 0, 1).otherwise(0)) % 5 + 1
    return src.runs(spark, d).withColumn("guess", F.element_at(F.array(*map(F.lit, src.DIFFICULTIES)), k.cast("int")))


@query(
    "designer_scores",
    f", z AS (SELECT difficulty AS t, {src.DIFFICULTIES}[(difficulty_rank + CASE WHEN run_id % 3 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS g FROM runs), a AS (SELECT t AS label, count(*) AS support, count(*) FILTER (t = g) AS tp FROM z GROUP BY 1), b AS (SELECT g AS label, count(*) AS guessed FROM z GROUP BY 1), s AS (SELECT label, support, tp, tp / CAST(guessed AS DOUBLE) AS p, tp / CAST(support AS DOUBLE) AS r FROM a JOIN b USING (label)), f AS (SELECT *, 2 * p * r / (p + r) AS f FROM s) SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round((SELECT avg(f) FROM f), 6) AS macro_f1, round((SELECT sum(tp) / CAST(sum(support) AS DOUBLE) FROM f), 6) AS accuracy FROM f",
)
def _(spark, d):
    return C.class_scores(_guessed(spark, d), "difficulty", "guess")


@query("archive_elites", "SELECT surface, CAST(len(concepts) AS INT) AS size, arg_max(run_id, row(value, -run_id)) AS elite, max(value) AS value, count(*) AS observations FROM runs GROUP BY 1, 2")
def _(spark, d):
    return C.archive(src.runs(spark, d))


@query(
    "archive_cell_scores",
    f", e AS (SELECT surface, CAST(len(concepts) AS INT) AS size, max(value) AS value, count(*) AS n FROM runs GROUP BY 1, 2), g AS (SELECT s.surface, z.size FROM (SELECT unnest({src.SURFACES}) AS surface) s CROSS JOIN (SELECT unnest([1, 2, 3]) AS size) z), q AS (SELECT g.surface, g.size, 0.5e0 / (1 + coalesce(n, 0)) + 0.4e0 * coalesce((value - (SELECT min(value) FROM e)) / ((SELECT max(value) FROM e) - (SELECT min(value) FROM e)), 0e0) + CASE WHEN n IS NULL THEN 0.3e0 ELSE 0e0 END AS score FROM g LEFT JOIN e USING (surface, size)) SELECT surface, size, round(score, 6) AS score, max(score) OVER () - score <= 1e-9 AS best FROM q",
)
def _(spark, d):
    return C.cell_scores(C.archive(src.runs(spark, d)), src.SURFACES, 3)


@query("running_mean_by_combo", f"SELECT array_to_string(concepts, '|') AS combo, difficulty, round(avg(greatest(0e0, least(1e0, ((1 - functionality) + (attempts - 1) * 0.5e0 + CASE WHEN used_fixer THEN 0.5e0 ELSE 0e0 END) / 3.5e0))), 6) AS score, count(*) AS n FROM runs GROUP BY 1, 2")
def _(spark, d):
    score = S.challenge_score(F.col("functionality"), F.col("attempts"), F.col("used_fixer"))
    return src.runs(spark, d).groupBy(F.array_join("concepts", "|").alias("combo"), "difficulty").agg(C.R(F.avg(score), "score"), F.count("*").alias("n"))


@query("pattern_strengths", f", e AS (SELECT model, pattern, count(*) AS usage, avg({OK}) AS rate FROM p GROUP BY 1, 2 HAVING count(*) > 1), s AS (SELECT model, pattern, round(rate / nullif(avg(rate) OVER (PARTITION BY model), 0e0), 6) AS score FROM e), u AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY score DESC, pattern) AS INT) AS nth, 'strength' AS side FROM s UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY score, pattern DESC) AS INT), 'weakness' FROM s) SELECT * FROM u WHERE nth <= 5", PATTERNS)
def _(spark, d):
    return C.strengths_and_weaknesses(pats(spark, d))


@query("pattern_specialties", f", o AS (SELECT model, pattern, avg({OK}) AS own FROM p GROUP BY 1, 2 HAVING count(*) > 1), k AS (SELECT model, pattern, concept, avg({OK}) AS rate FROM (SELECT *, unnest(concepts) AS concept FROM p) GROUP BY 1, 2, 3 HAVING count(*) > 1), s AS (SELECT model, concept, pattern, round(rate / nullif(own, 0e0), 6) AS ratio FROM k JOIN o USING (model, pattern)) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model, concept ORDER BY ratio DESC, pattern) AS INT) AS nth FROM s WHERE ratio > 1.2e0) WHERE nth <= 3", PATTERNS)
def _(spark, d):
    return C.specialties(pats(spark, d))


@query("model_progression", f", c AS (SELECT model, difficulty, concepts, avg({OK}) AS rate FROM runs GROUP BY 1, 2, 3), k AS (SELECT model, difficulty, count(*) AS combos, round(avg(rate), 6) AS success_rate, CAST(len(list_distinct(flatten(list(concepts)))) AS INT) AS concepts FROM c GROUP BY 1, 2) SELECT model, difficulty, combos, round(100 * combos / CAST(sum(combos) OVER (PARTITION BY model) AS DOUBLE), 6) AS percent, success_rate, concepts FROM k")
def _(spark, d):
    return C.progression(src.runs(spark, d))


@query("outcome_breakdown", f", f AS (SELECT run_id, ['syntax_error','no_code','unresolved_target_findings'][run_id % 3 + 1] AS reason, run_id % 5 AS n FROM runs WHERE NOT success AND run_id % 4 <> 0), x AS (SELECT model, CASE WHEN success THEN 'success' WHEN reason IS NULL THEN 'unknown' WHEN reason IN ('syntax_error', 'no_code') THEN 'syntax_no_code' ELSE reason END AS segment, n FROM runs LEFT JOIN f USING (run_id)), g AS (SELECT model, segment, count(*) AS runs, coalesce(sum(n), 0) AS n FROM x GROUP BY 1, 2) SELECT model, segment, runs, round(100 * n / CAST(sum(runs) OVER (PARTITION BY model) AS DOUBLE), 6) AS findings_per_100_runs FROM g")
def _(spark, d):
    r = src.runs(spark, d)
    reason = F.element_at(F.array(*map(F.lit, ("syntax_error", "no_code", "unresolved_target_findings"))), (F.col("run_id") % 3 + 1).cast("int"))
    failed = r.where("not success and run_id % 4 <> 0").select("run_id", reason.alias("reason"), (F.col("run_id") % 5).alias("findings"))
    return C.outcomes(r, failed)


@query("fold_scores", f", x AS (SELECT run_id % 5 AS fold, difficulty AS t, {src.DIFFICULTIES}[(difficulty_rank + CASE WHEN run_id % 3 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS g FROM runs), l AS (SELECT DISTINCT fold, t AS label FROM x UNION SELECT DISTINCT fold, g FROM x), s AS (SELECT l.fold, label, count(*) FILTER (t = label AND g = label) AS tp, count(*) FILTER (t = label) AS support, count(*) FILTER (g = label) AS guessed FROM l JOIN x USING (fold) GROUP BY 1, 2), e AS (SELECT fold, avg(2 * tp / CAST(support + guessed AS DOUBLE)) AS macro, sum(tp) / CAST(sum(support) AS DOUBLE) AS acc FROM s GROUP BY 1) SELECT count(*) AS folds, round(avg(acc), 6) AS acc_mean, round(stddev_samp(acc), 6) AS acc_std, round(avg(macro), 6) AS macro_mean, round(stddev_samp(macro), 6) AS macro_std FROM e")
def _(spark, d):
    return C.fold_scores(_guessed(spark, d).withColumn("fold", F.col("run_id") % 5), "difficulty", "guess", "fold")


_FAMILY = "SELECT model, surface, 'family ' || (node_id % 9) AS family FROM runs WHERE NOT success"


def families(spark, d):
    return src.runs(spark, d).where("not success").select("model", "surface", F.concat(F.lit("family "), (F.col("node_id") % 9).cast("string")).alias("family"))


@query("family_table", f", x AS ({_FAMILY}), e AS (SELECT model, family, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT DISTINCT family FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, family) AS nth FROM e) WHERE nth <= 3) SELECT m.model, t.family, coalesce(n, 0) AS n FROM (SELECT DISTINCT model FROM e) m CROSS JOIN t LEFT JOIN e ON e.model = m.model AND e.family = t.family")
def _(spark, d):
    return C.family_table(families(spark, d), 3)


@query("top_families", f", x AS ({_FAMILY}), e AS (SELECT *, row_number() OVER (PARTITION BY model, surface ORDER BY n DESC, family) AS nth FROM (SELECT model, surface, family, count(*) AS n FROM x GROUP BY 1, 2, 3)) SELECT model, surface, CAST(sum(n) AS BIGINT) AS findings, string_agg(family || ' (' || n || ')', '; ' ORDER BY nth) FILTER (nth <= 3) AS top FROM e GROUP BY 1, 2")
def _(spark, d):
    return C.top_families(families(spark, d))


@query("running_mean_prefixes", "SELECT array_to_string(concepts, '|') AS combo, run_id AS ord, floor(sum(functionality) OVER w / count(*) OVER w * 1e6 + 0.5e0) / 1e6 AS mean, count(*) OVER w AS n FROM runs WHERE functionality > 0.25e0 WINDOW w AS (PARTITION BY array_to_string(concepts, '|') ORDER BY run_id)")
def _(spark, d):
    r = src.runs(spark, d).where("functionality > 0.25")
    return C.running_means(r.select(F.array_join("concepts", "|").alias("combo"), F.col("run_id").alias("ord"), F.col("functionality").alias("value")), "combo").withColumn("mean", F.floor(F.col("mean") * 1e6 + 0.5) / 1e6)
