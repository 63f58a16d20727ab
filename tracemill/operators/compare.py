"""Concept, pattern and model analytics over runs, and tables that compare models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .rounds import numbered

#: Run ids of one stretch of a concept's runs.
STRETCH = 10_000
R = lambda c, n: F.round(c, 6).alias(n)


def ok() -> Column:
    return F.col("success").cast("double")


def by_concept(runs: DataFrame) -> DataFrame:
    return runs.withColumn("concept", F.explode("concepts"))


def success_and_attempts(df: DataFrame, *keys: str) -> DataFrame:
    """Mean success and attempts (missing or 0 count as 3), and how often the fixer came in at three attempts."""
    attempts = F.coalesce(F.nullif("attempts", F.lit(0)), F.lit(3))
    return df.groupBy(*keys).agg(R(F.avg(ok()), "success_rate"), R(F.avg(attempts), "avg_attempts"), F.count_if((F.col("attempts") == 3) & F.col("used_fixer")).alias("fixer_interventions"))


def mastery(cells: DataFrame) -> DataFrame:
    """Visit-weighted success of concept x difficulty."""
    return cells.groupBy("concept", "difficulty").agg(R(F.sum(F.col("rate") * F.col("visits")) / F.sum("visits"), "mastery"), F.sum("visits").alias("visits"))


def challenge_ranking(df: DataFrame, universe: int) -> DataFrame:
    """Concepts by 0.4 x share of available difficulties visited + 0.6 x success weighted by place in first-seen order, hardest first."""
    placed = numbered(df, ["concept"], F.floor(F.col("run_id") / STRETCH), ["run_id"], "place")
    weighted = F.sum(ok() * F.col("place")) / F.sum("place")
    score = F.count_distinct("difficulty") / F.lit(float(universe)) * 0.4 + weighted * 0.6
    return placed.groupBy("concept").agg(R(score, "score")).withColumn("rank", F.row_number().over(Window.orderBy("score", "concept")))


def degradation(df: DataFrame) -> DataFrame:
    """Per concept and combination size: success, and success relative to the smallest size."""
    each = df.groupBy("concept", F.size("concepts").alias("size")).agg(F.avg(ok()).alias("rate"))
    base = F.first("rate").over(Window.partitionBy("concept").orderBy("size"))
    return each.select("concept", "size", R(F.col("rate"), "success_rate"), R(S.ratio(F.col("rate"), base), "relative"))


def difficulty_scaling(df: DataFrame) -> DataFrame:
    """Per concept and difficulty: the last run's success, and how many runs of the concept there were up to it."""
    seen = numbered(df, ["concept"], F.floor(F.col("run_id") / STRETCH), ["run_id"], "available")
    return seen.groupBy("concept", "difficulty").agg(F.max_by("success", "run_id").alias("last_success"), F.max("available").alias("available"))


def combinations(df: DataFrame) -> DataFrame:
    """Per sorted combination of concepts: runs, success, mean value over attempts."""
    return df.groupBy(F.array_join(F.array_sort("concepts"), "+").alias("combo")).agg(F.count("*").alias("runs"), R(F.avg(ok()), "success_rate"), F.round(F.sum("value") / F.sum("attempts"), 4).alias("value_per_attempt"))


def last_run(df: DataFrame) -> DataFrame:
    """The last run of each node, averaged by its combination and difficulty."""
    last = df.groupBy("node_id").agg(F.max_by(F.struct("success", "attempts", "difficulty", F.array_join("concepts", "+").alias("combo")), "run_id").alias("r")).select("r.*")
    return last.groupBy("combo", "difficulty").agg(F.count("*").alias("nodes"), R(F.avg(ok()), "success_rate"), R(F.avg("attempts"), "avg_attempts"))


def nested_average(values: DataFrame, *path: str) -> DataFrame:
    """Nested metrics of many runs as (path, value) rows: the mean of every leaf over the runs that have it."""
    return values.groupBy(*path).agg(R(F.sum("value") / F.count("value"), "mean"), F.count("value").alias("n"))


def flatten(df: DataFrame, keys: list[str], leaves: list[str]) -> DataFrame:
    """Columns as (keys, path, value) rows."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in leaves]).unpivot(keys, leaves, "path", "value")


def pattern_effectiveness(pats: DataFrame) -> DataFrame:
    """Per pattern: usage, success, and success relative to the unweighted mean of all patterns; patterns of one use don't count."""
    each = pats.groupBy("pattern").agg(F.count("*").alias("usage"), F.avg(ok()).alias("rate")).where("usage > 1")
    mean = each.agg(F.avg("rate").alias("mean"))  # one row
    return each.crossJoin(F.broadcast(mean)).select("pattern", "usage", R(F.col("rate"), "effectiveness"), R(S.ratio(F.col("rate"), F.col("mean")), "relative"))


#: Fixed value: from this ratio on a pattern is a specialty of a concept.
SPECIALTY = 1.2


def strengths_and_weaknesses(pats: DataFrame, k: int = 5) -> DataFrame:
    """The k patterns of a model with the highest and the lowest success relative to its patterns' mean, marked by `side`."""
    each = pats.groupBy("model", "pattern").agg(F.count("*").alias("usage"), F.avg(ok()).alias("rate")).where("usage > 1")
    mean = each.groupBy("model").agg(F.avg("rate").alias("mean"))
    scored = each.join(mean, "model").select("model", "pattern", R(S.ratio(F.col("rate"), F.col("mean")), "score"))
    ends = [("strength", [F.desc("score"), "pattern"]), ("weakness", ["score", F.desc("pattern")])]
    parts = [scored.withColumn("nth", F.row_number().over(Window.partitionBy("model").orderBy(*o))).where(F.col("nth") <= k).withColumn("side", F.lit(side)) for side, o in ends]
    return parts[0].unionByName(parts[1])


def specialties(pats: DataFrame, k: int = 3) -> DataFrame:
    """Per model and concept its k patterns whose success with the concept is more than 1.2 times the pattern's own; patterns of one use don't count."""
    own = pats.groupBy("model", "pattern").agg(F.count("*").alias("all"), F.avg(ok()).alias("own")).where("all > 1")
    cells = by_concept(pats).groupBy("model", "pattern", "concept").agg(F.count("*").alias("usage"), F.avg(ok()).alias("rate")).where("usage > 1")
    ratio = R(S.ratio(F.col("rate"), F.col("own")), "ratio")
    scored = cells.join(own, ["model", "pattern"]).select("model", "concept", "pattern", ratio).where(F.col("ratio") > SPECIALTY)
    best = Window.partitionBy("model", "concept").orderBy(F.desc("ratio"), "pattern")
    return scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def progression(runs: DataFrame) -> DataFrame:
    """Per model and difficulty: combinations attempted, their share of the model's, mean success, and distinct concepts reached."""
    combos = runs.groupBy("model", "difficulty", "difficulty_rank", F.array_join(F.array_sort("concepts"), "-").alias("combo")).agg(F.avg(ok()).alias("rate"), F.first("concepts").alias("concepts"))
    cells = combos.groupBy("model", "difficulty", "difficulty_rank").agg(F.count("*").alias("combos"), R(F.avg("rate"), "success_rate"), F.size(F.array_distinct(F.flatten(F.collect_set("concepts")))).alias("concepts"))
    total = cells.groupBy("model").agg(F.sum("combos").alias("all"))
    return cells.join(total, "model").select("model", "difficulty", "combos", R(100 * S.ratio(F.col("combos"), F.col("all")), "percent"), "success_rate", "concepts")


def outcomes(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Per model: successes, failures by segment, and findings for each 100 runs. failures: (run_id, reason, findings)."""
    segment = F.when(F.col("reason").isin("syntax_error", "no_code"), "syntax_no_code").otherwise(F.col("reason"))
    joined = runs.select("model", "run_id", "success").join(failures.select("run_id", segment.alias("segment"), "findings"), "run_id", "left")
    named = joined.withColumn("segment", F.when(F.col("success"), "success").otherwise(F.coalesce("segment", F.lit("unknown"))))
    cells = named.groupBy("model", "segment").agg(F.count("*").alias("runs"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
    total = cells.groupBy("model").agg(F.sum("runs").alias("all"))
    return cells.join(total, "model").select("model", "segment", "runs", R(100 * S.ratio(F.col("findings"), F.col("all")), "findings_per_100_runs"))


def pattern_by_concept(pats: DataFrame, *extra: str) -> DataFrame:
    """Success of pattern x concept relative to the concept's own."""
    both = by_concept(pats)
    cells = both.groupBy("pattern", "concept", *extra).agg(F.count("*").alias("usage"), F.avg(ok()).alias("rate"))
    own = both.groupBy("concept", *extra).agg(F.avg(ok()).alias("own"))
    return cells.join(own, ["concept", *extra]).select("pattern", "concept", *extra, "usage", R(F.col("rate"), "success_rate"), R(S.ratio(F.col("rate"), F.col("own")), "ratio"))


def worst_concepts(cells: DataFrame, k: int = 4) -> DataFrame:
    """Concepts with the least mean ratio x total usage."""
    return cells.groupBy("concept").agg(R(F.avg("ratio") * F.sum("usage"), "score"), F.sum("usage").alias("usage")).orderBy("score", "concept").limit(k)


def top_patterns(pats: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Per key the k most used patterns."""
    each = pats.groupBy(by, "pattern").agg(F.count("*").alias("usage"), R(F.avg(ok()), "success_rate"))
    best = Window.partitionBy(by).orderBy(F.desc("usage"), "pattern")
    return each.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def both_ends(df: DataFrame, value: str, key: str, by: str, k: int = 3) -> DataFrame:
    """Per key the k highest and the k lowest, marked."""
    up, down = (Window.partitionBy(by).orderBy(F.desc(value), key), Window.partitionBy(by).orderBy(value, key))
    ranked = df.withColumns({"top": F.row_number().over(up), "bottom": F.row_number().over(down)})
    return ranked.where((F.col("top") <= k) | (F.col("bottom") <= k)).withColumn("end", F.when(F.col("top") <= k, "top").otherwise("bottom")).drop("top", "bottom")


def row_share(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of row x column and their share of the row."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.round(S.ratio(F.col("n"), F.sum("n").over(Window.partitionBy(row))), 6))


def weighted_failure(df: DataFrame) -> DataFrame:
    """Failure rate by three groups of difficulties, each run weighted by its number of concepts."""
    bucket = F.when(F.col("difficulty_rank") <= 1, "easy").when(F.col("difficulty_rank") == 2, "medium").otherwise("hard")
    w = F.size("concepts")
    return df.groupBy("model", bucket.alias("bucket")).agg(R(F.sum(w * (1 - ok())) / F.sum(w), "failure_rate"), F.sum(w).alias("weight"))


def inferred_capability(cells: DataFrame, item: str) -> DataFrame:
    """Item x difficulty with failure rates; unattempted cells count as mastered below the highest attempted group and as failed above it."""
    grid = cells.select(item).distinct().crossJoin(cells.select("difficulty_rank").distinct())
    full = grid.join(cells, [item, "difficulty_rank"], "left")
    highest = F.max(F.when(F.col("runs").isNotNull(), F.col("difficulty_rank"))).over(Window.partitionBy(item))
    filled = F.when(F.col("runs").isNull(), F.when(F.col("difficulty_rank") < highest, S.num(0)).otherwise(S.num(1))).otherwise(F.col("failure_rate"))
    return full.select(item, "difficulty_rank", F.coalesce("runs", F.lit(0)).alias("runs"), R(filled, "failure_rate"), (filled < 0.5).alias("operational"))


def share_within(df: DataFrame, key: str, part: str) -> DataFrame:
    """Rows of key x part and their share of the key."""
    return row_share(df, key, part)


def tiers(df: DataFrame) -> DataFrame:
    """By number of concepts and model: runs, success, attempts, spread of attempts."""
    return df.groupBy("model", F.size("concepts").alias("tier")).agg(F.count("*").alias("runs"), R(F.avg(ok()), "success_rate"), R(F.avg("attempts"), "avg_attempts"), R(F.stddev_samp("attempts"), "sd_attempts"))


def equal_weight(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """Mean over outer's inner groups of their failure rates: every inner group counts once."""
    each = df.groupBy(outer, inner).agg(F.avg(1 - ok()).alias("f"))
    return each.groupBy(outer).agg(R(F.avg("f"), "failure_rate"), F.count("*").alias("groups"))


def by_support(df: DataFrame, column: str, least: int = 5, k: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), column).limit(k)


def overview(df: DataFrame, *keys: str) -> DataFrame:
    """A model's headline measures."""
    recovered = F.count_if(F.col("success") & (F.col("attempts") > 1))
    later = F.count_if((F.col("attempts") > 1) | ~F.col("success"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("runs"), R(F.avg(ok()), "success_rate"), R(F.avg((F.col("success") & (F.col("attempts") == 1)).cast("double")), "first_attempt_success_rate"), R(S.ratio(recovered, later), "recovery_rate"),
        R(F.avg("attempts"), "avg_attempts"), R(F.avg("risk"), "avg_risk"), R(F.avg("total_issues"), "findings_per_run"), R(S.ratio(F.count_if(F.col("total_issues") > 0), F.count("*")), "residual_issue_rate"),
        R(F.avg(ok()) - F.avg((F.col("success") & (F.col("attempts") == 1)).cast("double")), "feedback_gain"), R(S.ratio(F.count_if(F.col("target_issues") > 0), F.count("*")), "target_issue_rate"), R(S.ratio(F.count_if(F.col("off_target_issues") > 0), F.count("*")), "off_target_issue_rate"),
        R(F.avg(F.col("used_fixer").cast("double")), "fixer_rate"),
    )


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """Counts of truth x guess, one column for each label."""
    return df.groupBy(truth).pivot(guess, labels).count().na.fill(0)


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of every class, and the macro means and accuracy in each row."""
    cells = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    hit = F.col(truth) == F.col(guess)
    rows = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    guessed = cells.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("guessed"))
    both = rows.join(guessed, "label", "full").na.fill(0)
    p, r = F.coalesce(S.ratio(F.col("tp"), F.col("guessed")), S.num(0)), F.coalesce(S.ratio(F.col("tp"), F.col("support")), S.num(0))
    scored = both.withColumns({"p": p, "r": r}).withColumn("f", F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), S.num(0)), S.num(0)))
    whole = scored.agg(F.avg("f").alias("macro"), (F.sum("tp") / F.sum("support")).alias("acc"))
    return scored.crossJoin(F.broadcast(whole)).select("label", "support", R(F.col("p"), "precision"), R(F.col("r"), "recall"), R(F.col("f"), "f1"), R(F.col("macro"), "macro_f1"), R(F.col("acc"), "accuracy"))


def fold_scores(df: DataFrame, truth: str, guess: str, fold: str) -> DataFrame:
    """Mean and sample deviation over folds of accuracy and macro F1 (the mean F1 of the classes of a fold)."""
    cells = df.groupBy(fold, truth, guess).agg(F.count("*").alias("n"))
    hit = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)
    told = cells.groupBy(fold, F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guessed = cells.groupBy(fold, F.col(guess).alias("label")).agg(F.sum("n").alias("guessed"))
    both = told.join(guessed, [fold, "label"], "full").na.fill(0)
    f1 = F.coalesce(S.ratio(2 * F.col("tp"), F.col("support") + F.col("guessed")), S.num(0))  # equal to 2 p r / (p + r)
    each = both.withColumn("f", f1).groupBy(fold).agg(F.avg("f").alias("macro"), S.ratio(F.sum("tp"), F.sum("support")).alias("acc"))
    spread = lambda c: R(F.coalesce(F.stddev_samp(c), S.num(0)), f"{c}_std")
    return each.agg(F.count("*").alias("folds"), R(F.avg("acc"), "acc_mean"), spread("acc"), R(F.avg("macro"), "macro_mean"), spread("macro"))


def family_table(rows: DataFrame, k: int) -> DataFrame:
    """Counts of (model, family) for the families that are among the k most frequent of any model, 0 where a model has none. rows: (model, family)."""
    each = rows.groupBy("model", "family").agg(F.count("*").alias("n"))
    best = Window.partitionBy("model").orderBy(F.desc("n"), "family")
    top = each.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("family").distinct()
    return each.select("model").distinct().crossJoin(top).join(each, ["model", "family"], "left").na.fill(0, ["n"])


def top_families(rows: DataFrame, k: int = 3) -> DataFrame:
    """Per model and surface its findings and its k most frequent families, as text. rows: (model, surface, family)."""
    each = rows.groupBy("model", "surface", "family").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("model", "surface").orderBy(F.desc("n"), "family"))
    named = each.withColumn("nth", best).withColumn("s", F.when(F.col("nth") <= k, F.struct("nth", F.concat("family", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))))
    return named.groupBy("model", "surface").agg(F.sum("n").alias("findings"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "; ").alias("top"))


def align_models(df: DataFrame, models: list[str], *keys: str) -> DataFrame:
    """One row per key with each model's success rate, null where a model has no run."""
    return df.groupBy(*keys).pivot("model", models).agg(F.round(F.avg(ok()), 6))


def pair_matrix(df: DataFrame) -> DataFrame:
    """Success of every ordered pair of different concepts that occur together."""
    two = df.where(F.size("concepts") >= 2)
    pairs = two.select(ok().alias("ok"), F.explode("concepts").alias("a"), "concepts").select("ok", "a", F.explode("concepts").alias("b")).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), R(F.avg("ok"), "success_rate"))


def archive(df: DataFrame) -> DataFrame:
    """Elites: per surface and combination size the run of highest value, the earliest of equals."""
    best = F.max_by(F.struct("run_id", "value"), F.struct("value", -F.col("run_id")))
    return df.groupBy("surface", F.size("concepts").alias("size")).agg(best.alias("b"), F.count("*").alias("observations")).select("surface", "size", F.col("b.run_id").alias("elite"), F.col("b.value").alias("value"), "observations")


def cell_scores(elites: DataFrame, surfaces: list[str], sizes: int, w_coverage: float = 0.5, w_promise: float = 0.4, bonus: float = 0.3) -> DataFrame:
    """Every surface x size cell: coverage need, min-max promise (all equal: 1), bonus for empty cells; best marks those within 1e-9 of the highest score."""
    spark = elites.sparkSession
    grid = spark.createDataFrame([(s, k) for s in surfaces for k in range(1, sizes + 1)], "surface string, size int")
    low, high = F.min("value").over(Window.partitionBy(F.lit(0))), F.max("value").over(Window.partitionBy(F.lit(0)))
    promise = F.when(high <= low, S.num(1)).otherwise((F.col("value") - low) / (high - low))
    full = grid.join(elites.withColumn("promise", promise), ["surface", "size"], "left")
    score = w_coverage / (1 + F.coalesce("observations", F.lit(0)).cast("double")) + w_promise * F.coalesce("promise", S.num(0)) + F.when(F.col("elite").isNull(), S.num(bonus)).otherwise(S.num(0))
    best: Column = F.max("score").over(Window.partitionBy(F.lit(0))) - F.col("score") <= 1e-9
    return full.withColumn("score", score).select("surface", "size", R(F.col("score"), "score"), best.alias("best"))


def running_means(rows: DataFrame, *by: str) -> DataFrame:
    """by, ord, mean, n: the mean of the values of a group up to each row in order of ord; the batch twin of the stream of that name.

    Rows without a value give none. Stretches of a group are added up first, so that no task holds a whole group.
    """
    known = rows.where("value is not null").withColumn("part", F.floor(F.col("ord") / 10_000))
    sums = known.groupBy(*by, "part").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("part").alias("__part"), F.coalesce(F.sum("s").over(before), S.num(0)).alias("s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"))
    inside = Window.partitionBy(*by, "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = known.withColumns({"t": F.sum("value").over(inside), "k": F.count("*").over(inside)})
    both = own.join(ahead, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "part")])
    return both.select(*by, "ord", ((F.col("t") + F.col("s")) / (F.col("k") + F.col("c"))).alias("mean"), (F.col("k") + F.col("c")).alias("n"))
