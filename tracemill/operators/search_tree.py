"""Measures of search trees and search values."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .rounds import checkpointed

R = lambda c, n: F.round(c, 6).alias(n)


def _joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _doubled(state: DataFrame, carry: dict, most: int | None = None) -> DataFrame:
    """Rounds of pointer doubling over (node_id, up, ...): each doubles the steps from a node to `up`, until every `up` is null.

    carry: column -> what it is after its node's and its ancestor's part (named with a leading __) are put
    together. Rows that have reached their root are set aside: only active ones, whose `up` is not null,
    are joined and written again, so no join has a null or finished key. A chain of n steps takes log2(n)
    rounds, each checkpointed, a star one; nodes of a cycle, or below a parent that isn't there, have no
    root and are left out (see `rootless`). most: how many nodes a chain may have, if that is known; else as many as there are.
    """
    active = checkpointed(state.where("up is not null"))
    done = [checkpointed(state.where("up is null"))]
    total, steps = most or active.count(), 1
    while steps <= 2 * total and not active.isEmpty():
        t = _joined([*done, active]).select(F.col("node_id").alias("up"), F.col("up").alias("__up"), *[F.col(c).alias(f"__{c}") for c in carry])
        moved = checkpointed(active.join(t, "up").select("node_id", F.col("__up").alias("up"), *[e.alias(c) for c, e in carry.items()]))
        done.append(moved.where("up is null"))
        active = moved.where("up is not null")
        steps *= 2
    return _joined(done).drop("up")


def rootless(nodes: DataFrame) -> DataFrame:
    """Nodes of a cycle, or that lead to one or to a parent that isn't there: those that other measures of trees leave out."""
    start = nodes.select("node_id", F.col("parent_id").alias("up"))
    return nodes.join(_doubled(start, {}), "node_id", "left_anti")


def with_depth(nodes: DataFrame) -> DataFrame:
    """Nodes with their depth (roots: 0)."""
    start = nodes.select("node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    return nodes.join(_doubled(start, {"depth": F.col("depth") + F.col("__depth")}), "node_id")


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Nodes, edges, leaves, depth, branching, and value and visit statistics of nodes with depths, in one row."""
    children = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    n = nodes.join(children, "node_id", "left")
    return n.agg(
        F.count("*").alias("nodes"), F.count("parent_id").alias("edges"), F.count_if(F.col("children").isNull()).alias("leaves"), F.max("depth").alias("max_depth"), R(F.avg("children"), "avg_branching"),
        R(F.avg("value"), "avg_value"), R(F.median("value"), "median_value"), R(F.max("value"), "max_value"), R(F.avg("visits"), "avg_visits"), R(F.median("visits"), "median_visits"), F.max("visits").alias("max_visits"),
    )


def growth(nodes: DataFrame, *by: str) -> DataFrame:
    """Nodes by depth, running total, share and running share; and a group's share of all groups at that depth."""
    cells = nodes.groupBy(*by, "depth").agg(F.count("*").alias("nodes"), R(F.avg("value"), "avg_value"))
    up = Window.partitionBy(*by).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0) if by else Window.partitionBy(F.lit(0)).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = F.sum("nodes").over(up)
    out = cells.withColumns({"cumulative": run, "percent": F.round(100.0 * F.col("nodes") / F.sum("nodes").over(whole), 6), "cumulative_percent": F.round(100.0 * run / F.sum("nodes").over(whole), 6)})
    return out.withColumn("share_at_depth", F.round(S.ratio(F.col("nodes"), F.sum("nodes").over(Window.partitionBy("depth"))), 6)) if by else out


def balance(nodes: DataFrame) -> DataFrame:
    """Depth against log2(nodes + 1), mean of per-depth mean values, visited share, variance of nodes by depth."""
    each = nodes.groupBy("depth").agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.count_if(F.col("visits") > 0).alias("used"))
    return each.agg(R(F.max("depth") / F.log2(F.sum("n") + S.num(1)), "depth_balance"), R(F.avg("v"), "value_balance"), R(F.sum("used") / F.sum("n"), "utilisation"), R(F.var_pop("n"), "breadth_variance"))


def root_paths(nodes: DataFrame) -> DataFrame:
    """Per node the way from its root: length, mean value along it, and the path as text.

    Values add up as decimals of six places, so that the order of additions doesn't matter.
    """
    start = nodes.select("node_id", F.col("parent_id").alias("up"), F.lit(1).alias("length"), F.col("value").cast("decimal(28,6)").alias("total"), F.col("node_id").cast("string").alias("path"))
    put = {"length": F.col("__length") + F.col("length"), "total": (F.col("__total") + F.col("total")).cast("decimal(28,6)"), "path": F.concat("__path", F.lit(">"), "path")}
    return _doubled(start, put).select("node_id", "length", F.round(F.col("total") / F.col("length"), 6).cast("double").alias("path_value"), "path")


#: Decimal places in which rewards add up.
PLACES = "decimal(28,16)"


def backpropagated(nodes: DataFrame, rewards: DataFrame, gamma: float = 0.9) -> DataFrame:
    """Every reward to all ancestors, times gamma for each step up: sum (a decimal) and number of rewards that reach a node.

    Doubling again: after a round a node holds what lies below it within twice as many steps, as its own
    sum and those of the nodes that are so many steps below. Only pointers that haven't passed their root
    are joined and kept. A parent without a row of its own is a root. Nodes of a cycle, or that lead to
    one, are left out: their rewards reach only each other.
    """
    own = rewards.groupBy("node_id").agg(F.sum(F.col("reward").cast(PLACES)).cast(PLACES).alias("total"), F.count("*").alias("n"))
    edges = checkpointed(nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("up")))
    ids = nodes.select("node_id").unionByName(edges.select(F.col("up").alias("node_id"))).unionByName(own.select("node_id")).distinct()
    state = checkpointed(ids.join(own, "node_id", "left").select("node_id", F.coalesce("total", F.lit(0).cast(PLACES)).alias("total"), F.coalesce("n", F.lit(0).cast("long")).alias("n")))
    active, total, steps = edges, edges.count(), 1
    while steps <= 2 * total and not active.isEmpty():
        factor = F.lit(str((Decimal(str(gamma)) ** steps).quantize(Decimal("1e-18")))).cast("decimal(19,18)")
        passed = active.join(state.where("n > 0"), "node_id").groupBy(F.col("up").alias("node_id")).agg(F.sum("total").cast(PLACES).alias("__total"), F.sum("n").alias("__n"))
        grown = state.join(passed, "node_id", "left")
        more = (F.coalesce("__total", F.lit(0).cast(PLACES)) * factor).cast(PLACES)
        state = checkpointed(grown.select("node_id", (F.col("total") + more).cast(PLACES).alias("total"), (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n")))
        active = checkpointed(active.join(active.select(F.col("node_id").alias("up"), F.col("up").alias("__up")), "up").select("node_id", F.col("__up").alias("up")))
        steps *= 2
    return state.where("n > 0").join(active.select("node_id"), "node_id", "left_anti").select("node_id", "total", F.col("n").alias("rewards"))


def td_values(rewards: DataFrame, rate: float = 0.9) -> DataFrame:
    """v += rate (r - v) over a node's rewards in order, from 0, in its closed form (a decimal): a reward counts rate x (1 - rate) to the power of those after it."""
    after = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("run_id"))) - 1
    part = (rate * F.col("reward") * F.pow(S.num(1 - rate), F.col("k"))).cast("decimal(24,15)")
    return rewards.withColumn("k", after).groupBy("node_id").agg(F.sum(part).alias("value"), F.count("*").alias("visits"))


def convergence(rewards: DataFrame, epsilon: float, k: int) -> DataFrame:
    """Per node the first run that ends k consecutive changes below epsilon."""
    order = Window.partitionBy("node_id").orderBy("run_id")
    delta = F.abs(F.col("reward") - F.lag("reward").over(order))
    flagged = rewards.withColumn("calm", F.coalesce(delta < epsilon, F.lit(False)))
    islands = flagged.withColumn("island", F.sum(F.when(F.col("calm"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.row_number().over(Window.partitionBy("node_id", "island", "calm").orderBy("run_id"))
    return islands.withColumn("length", length).where(F.col("calm") & (F.col("length") >= k)).groupBy("node_id").agg(F.min("run_id").alias("converged_at"))


def best_children(nodes: DataFrame, weight: float = 1.414) -> DataFrame:
    """Per parent its child of highest upper confidence bound (parent visits as exploration base; ties: least id)."""
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("visits").alias("parent_visits"))
    explore = F.sqrt(F.log(F.greatest(F.col("parent_visits").cast("double"), S.num(1))) / F.nullif(F.col("visits").cast("double"), S.num(0)))
    bound = F.when(F.col("visits") == 0, S.num(1e9)).otherwise(F.round(F.col("value") + explore * weight, 6))
    scored = nodes.where("parent_id is not null").join(parents, "parent_id").withColumn("ucb", bound)
    best = F.max_by(F.struct("node_id", "ucb"), F.struct("ucb", -F.col("node_id")))
    return scored.groupBy("parent_id").agg(best.alias("b"), F.count("*").alias("children")).select("parent_id", F.col("b.node_id").alias("node_id"), F.col("b.ucb").alias("ucb"), "children")


def surface_priorities(nodes: DataFrame) -> DataFrame:
    """Scheduling priority of every surface from its nodes' visit-weighted values and visits."""
    each = nodes.groupBy("surface").agg(F.sum(F.col("value") * F.col("visits")).alias("v"), F.sum("visits").alias("observations"))
    return each.select("surface", "observations", R(S.surface_priority(S.ratio(F.col("v"), F.col("observations")), F.col("observations")), "priority"))


def sampling_weights(nodes: DataFrame, damping: float = 0.35) -> DataFrame:
    """Inverse-value weights, damped by observations, as shares within a surface."""
    w = (1.1 - S.clamp01(F.col("value"))) / F.pow(F.col("visits") + S.num(1), S.num(damping))
    weighted = nodes.withColumn("w", w)
    return weighted.join(weighted.groupBy("surface").agg(F.sum("w").alias("all")), "surface").select("node_id", "surface", R(S.ratio(F.col("w"), F.col("all")), "share"))


def uniform(seed: int, key: str) -> Column:
    """A number in (0, 1) that follows from the seed and the key alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


#: Candidates that a task holds before it passes on the best of each group.
HELD = 200_000


def _least(k: int):
    """Keeps the k least (key, id) of each group; what it yields early is merged by the next step, which sees all."""

    def best(table: pa.Table) -> pa.Table:
        order = table.sort_by([("group", "ascending"), ("key", "ascending"), ("id", "ascending")])
        codes = np.asarray(order.column("group").combine_chunks().dictionary_encode(null_encoding="encode").indices)
        first = np.flatnonzero(np.diff(codes, prepend=-1)) if len(codes) else codes
        place = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
        return order.filter(pa.array(place < k))

    def run(batches):
        held = None
        for batch in batches:
            held = best(pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch]))
            if held.num_rows > HELD:
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def weighted_draws(items: DataFrame, group: str, key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """k items of each group without replacement, in order of the draw: group, key, place (from 1 on).

    An item's key is -ln(u) / weight, u a seeded hash of its id: the k least are such a draw, whatever the
    partitioning. Each task passes on the k least of a group, so a hot group costs k rows for each task.
    Rows of weight 0 or less, or null, are never drawn; a null group is a group; ids are distinct within a
    group, and of equal keys the lesser id comes first.
    """
    kind = dict(items.dtypes)
    rows = items.where(F.col(weight) > 0).select(F.col(group).alias("group"), F.col(key).alias("id"), (-F.log(uniform(seed, key)) / F.col(weight)).alias("key"))
    schema = f"`group` {kind[group]}, id {kind[key]}, key double"
    few = rows.mapInArrow(_least(k), schema)
    # the last step is exact: its rows are sorted, and of a group only the first k pass
    merged = few.groupBy("group").agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "id"))), 1, k).alias("best"))
    return merged.select("group", F.posexplode("best").alias("place", "b")).select(F.col("group").alias(group), F.col("b.id").alias(key), (F.col("place") + 1).alias("place"))


def subset_parents(sets: DataFrame) -> DataFrame:
    """For every set of a surface its largest proper subset there (ties: least key), found through shared elements.

    A subset shares its least element with the set, so candidates come from an equi-join on
    (surface, element) with the subset's least element, never from all pairs.
    """
    return subset_candidates(sets).groupBy("surface", "child").agg(F.min_by("parent", F.struct(-F.size("part"), "parent")).alias("parent"))


def subset_candidates(sets: DataFrame) -> DataFrame:
    """(surface, child, all, parent, part): every proper subset of every set of a surface."""
    big = sets.select("surface", F.col("key").alias("child"), F.col("items").alias("all"), F.explode("items").alias("e"))
    small = sets.select("surface", F.col("key").alias("parent"), F.col("items").alias("part"), F.array_min("items").alias("e"))
    return big.join(small, ["surface", "e"]).where((F.size("part") < F.size("all")) & (F.size(F.array_except("part", "all")) == 0)).drop("e")


def novel_partners(sets: DataFrame) -> DataFrame:
    """For every set of a surface the other set there that adds most elements (ties: least key)."""
    # Candidates are the distinct sets of a surface, whose number is that of combinations, not of runs.
    a, b = sets.select("surface", F.col("key").alias("a"), F.col("items").alias("x")), sets.select("surface", F.col("key").alias("b"), F.col("items").alias("y"))
    pairs = a.join(b, "surface").where("a <> b").withColumn("gain", F.size(F.array_except("y", "x")))
    return pairs.groupBy("surface", "a").agg(F.max("gain").alias("gain"), F.min_by("b", F.struct(-F.col("gain"), "b")).alias("partner"))


def closure(edges: DataFrame, every: int = 4) -> DataFrame:
    """Pairs (src, dst) that edges reach, each once, over chains of any length; a null joins nothing.

    A round extends the pairs that the last one found, until none is new; lineage is cut every few rounds.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    found = new = edges
    rounds = 0
    while not new.isEmpty():
        step = new.alias("a").join(edges.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst")).distinct()
        known = (F.col("s.src").eqNullSafe(F.col("f.src"))) & (F.col("s.dst").eqNullSafe(F.col("f.dst")))
        new = checkpointed(step.alias("s").join(found.alias("f"), known, "left_anti").select("src", "dst"))
        found = found.unionByName(new)
        rounds += 1
        if rounds % every == 0:
            found = checkpointed(found)
    return found


def parents_by_sets(sets: DataFrame) -> DataFrame:
    """Parents of every set of a surface among its proper subsets: the largest one, or, where two subsets together make up the set, the first such pair.

    Subsets come from subset_candidates; a pair's second part has to hold what the first one lacks, so
    pairs are joined on the set and on the least element that the first lacks.
    """
    c = subset_candidates(sets)
    left = c.select("surface", "child", "all", F.col("parent").alias("p"), F.col("part").alias("x"), F.array_min(F.array_except("all", "part")).alias("e"))
    right = c.select("surface", "child", F.col("parent").alias("q"), F.col("part").alias("y"), F.explode("part").alias("e"))
    whole = left.join(right, ["surface", "child", "e"]).where((F.col("p") < F.col("q")) & (F.size(F.array_except("all", F.concat("x", "y"))) == 0))
    pair = whole.groupBy("surface", "child").agg(F.min(F.struct("p", "q")).alias("pair"))
    single = c.groupBy("surface", "child").agg(F.min_by("parent", F.struct(-F.size("part"), "parent")).alias("largest"))
    chosen = F.when(F.col("pair").isNotNull(), F.array("pair.p", "pair.q")).otherwise(F.array("largest"))
    return single.join(pair, ["surface", "child"], "left").select("surface", "child", chosen.alias("parents"))


def least_covered(nodes: DataFrame, concepts: DataFrame, observed: DataFrame) -> DataFrame:
    """For every node the candidate concept least observed on its surface, then in fewest nodes there, then by a digest.

    nodes: (node_id, surface, signature, candidates); concepts: (surface, concept) once per node that has
    it; observed: (surface, concept) once per run.
    """
    count = lambda df, name: df.groupBy("surface", "concept").agg(F.count("*").alias(name))
    each = nodes.select("node_id", "surface", "signature", F.explode("candidates").alias("concept"))
    each = each.join(count(observed, "runs"), ["surface", "concept"], "left").join(count(concepts, "holders"), ["surface", "concept"], "left").na.fill(0, ["runs", "holders"])
    digest = F.conv(F.substring(F.sha1(F.concat_ws("|", "surface", "signature", "concept")), 1, 8), 16, 10).cast("bigint")
    return each.groupBy("node_id").agg(F.min_by("concept", F.struct("runs", "holders", digest, "concept")).alias("concept"))


def first_tree(concepts: DataFrame, difficulties: DataFrame, pairs: int | None = None) -> DataFrame:
    """Roots (difficulty x concept) and the pair nodes below them: of all pairs of concepts of a difficulty in order, or the first so many."""
    roots = concepts.crossJoin(F.broadcast(difficulties))  # difficulties are a fixed list of five
    a, b = (roots.select("difficulty", F.col("concept").alias(x)) for x in ("a", "b"))
    both = a.join(b, "difficulty").where("a < b")
    if pairs is not None:
        first = Window.partitionBy("difficulty").orderBy("a", "b")
        both = both.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= pairs)
    return roots.select("difficulty", F.array("concept").alias("concepts"), F.array().cast("array<string>").alias("parents")).unionByName(both.select("difficulty", F.array("a", "b").alias("concepts"), F.array("a", "b").alias("parents")))


def signature(nodes: DataFrame) -> DataFrame:
    """Nodes with their signature: phase, depth, difficulty and sorted concepts."""
    return nodes.withColumn("signature", F.format_string("p=%s|depth=%s|diff=%s|concepts=%s", F.col("phase").cast("string"), F.col("depth").cast("string"), "difficulty", F.array_join(F.array_sort("concepts"), "|")))


def first_of_signature(nodes: DataFrame) -> DataFrame:
    """The first node (least node_id) of every (surface, set of concepts)."""
    return nodes.groupBy("surface", F.array_join(F.array_sort(F.array_distinct("concepts")), "|").alias("key")).agg(F.min("node_id").alias("node_id"), F.count("*").alias("nodes"))


def path_success(nodes: DataFrame) -> DataFrame:
    """Nodes below a root (node_id, length, success): the share of nodes on their way to the root that ever succeeded. nodes: (node_id, parent_id, solved)."""
    start = nodes.select("node_id", F.col("parent_id").alias("up"), F.lit(1).alias("length"), F.col("solved").cast("double").alias("solved"))
    whole = _doubled(start, {c: F.col(c) + F.col(f"__{c}") for c in ("length", "solved")})
    return whole.where("length > 1").select("node_id", "length", R(F.col("solved") / F.col("length"), "success"))


def path_success_by(paths: DataFrame, *by: str) -> DataFrame:
    """Mean success of paths by key and length."""
    return paths.groupBy(*by, "length").agg(F.count("*").alias("paths"), R(F.avg("success"), "success"))


def path_ratio(paths: DataFrame) -> DataFrame:
    """Mean length of paths with more than half of their nodes solved, over that of the others; 1 without others. And the depths used of the deepest."""
    good = F.col("success") > 0.5
    ratio = F.coalesce(S.ratio(F.avg(F.when(good, F.col("length"))), F.avg(F.when(~good, F.col("length")))), S.num(1))
    return paths.agg(R(ratio, "path_length_ratio"), R(S.ratio(F.count_distinct("length") + 1, F.max("length") - 1), "depth_utilisation"))


def challenge_bounds(nodes: DataFrame, challenges: DataFrame, weight: float = 1.414) -> DataFrame:
    """(node_id, ucb): mean challenge plus exploration by the visits of its parent (1 without any); a node without visits has no bound but infinity."""
    mean = challenges.groupBy("node_id").agg(F.avg("challenge").alias("mean"))
    above = nodes.select(F.col("node_id").alias("parent_id"), F.col("visits").alias("above"))
    each = nodes.join(mean, "node_id", "left").join(above, "parent_id", "left")
    around = F.sqrt(F.log(F.greatest(F.coalesce("above", F.lit(1)), F.lit(1)).cast("double")) / F.nullif(F.col("visits").cast("double"), S.num(0)))
    return each.select("node_id", F.when(F.col("visits") == 0, S.num(float("inf"))).otherwise(F.round(F.coalesce("mean", S.num(0)) + weight * around, 6)).alias("ucb"))
