"""Deep and wide trees, cycles, null keys, and weighted draws."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.operators import rounds
from tracemill.operators import search_tree as T

MANY = 1_000_000


def test_a_star_of_a_million_nodes(spark):
    star = spark.range(MANY).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, 0).cast("long").alias("parent_id"))
    assert T.with_depth(star).groupBy("depth").count().collect() == [(0, 1), (1, MANY - 1)] or sorted(map(tuple, T.with_depth(star).groupBy("depth").count().collect())) == [(0, 1), (1, MANY - 1)]
    found = T.backpropagated(star, star.select("node_id", F.lit(1.0).alias("reward"))).where("node_id = 0").first()
    assert found.rewards == MANY and float(found.total) == pytest.approx(1 + 0.9 * (MANY - 1))


def test_a_chain_of_a_million_nodes(spark):
    chain = spark.range(MANY).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    found = T.with_depth(chain).agg(F.count("*").alias("n"), F.count_if(F.col("depth") == F.col("node_id")).alias("same")).first()
    assert (found.n, found.same) == (MANY, MANY)


def test_rewards_up_a_long_chain(spark):
    n = 20_000
    chain = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    found = {r.node_id: r for r in T.backpropagated(chain, spark.createDataFrame([(n - 1, 1.0), (0, 2.0), (100, 4.0)], "node_id bigint, reward double")).collect()}
    assert len(found) == n and found[0].rewards == 3 and float(found[0].total) == pytest.approx(2 + 4 * 0.9**100)
    assert float(found[n - 4].total) == pytest.approx(0.9**3) and found[n - 1].rewards == 1


def test_cycles_are_left_out_and_reported(spark):
    parent = {1: None, 2: 1, 10: 11, 11: 12, 12: 10, 13: 10, 20: 99, 21: 20}
    nodes = spark.createDataFrame([(k, v, 0.5) for k, v in parent.items()], "node_id bigint, parent_id bigint, value double")
    assert {r.node_id for r in T.rootless(nodes).collect()} == {10, 11, 12, 13, 20, 21}
    assert {r.node_id for r in T.with_depth(nodes).collect()} == {1, 2} == {r.node_id for r in T.root_paths(nodes).collect()}
    rewards = spark.createDataFrame([(k, 1.0) for k in parent], "node_id bigint, reward double")
    found = {r.node_id: (r.rewards, round(float(r.total), 6)) for r in T.backpropagated(nodes, rewards).collect()}
    assert found == {1: (2, 1.9), 2: (1, 1.0), 20: (2, 1.9), 21: (1, 1.0), 99: (2, 1.71)}


def test_order_of_additions_does_not_matter(spark):
    rows = [(0, None, 0.1), *((k, k - 1, 0.1) for k in range(1, 9))]
    nodes = spark.createDataFrame(rows, "node_id bigint, parent_id bigint, value double")
    assert {r.path_value for r in T.root_paths(nodes).collect()} == {0.1}


def test_numbers_of_null_keys(spark):
    rows = [(None, None, 1), (None, None, 2), (None, 5, 0), ("a", None, 3), ("a", 1, 4), ("a", 1, 5)]
    df = spark.createDataFrame(rows, "k string, x int, i int")
    found = {r.i: r.n for r in rounds.numbered(df, ["k"], F.col("x"), ["i"], "n").collect()}
    assert found == {1: 1, 2: 2, 0: 3, 3: 1, 4: 2, 5: 3}


def test_draws_are_the_same_for_any_partitioning(spark, monkeypatch):
    items = spark.range(3000).select(F.when(F.col("id") % 7 > 0, "hot").alias("g"), F.col("id"), (F.col("id") % 5).cast("double").alias("w"), F.lit(1).alias("place"))
    one = sorted(map(tuple, T.weighted_draws(items.coalesce(1), "g", "id", "w", 25, seed=3).collect()), key=str)
    monkeypatch.setattr(T, "HELD", 60)
    assert one == sorted(map(tuple, T.weighted_draws(items.repartition(13), "g", "id", "w", 25, seed=3).collect()), key=str)
    assert len(one) == 50 and all(i % 5 for _, i, _ in one) and sorted(p for g, _, p in one if g is None) == list(range(1, 26))
    assert one != sorted(map(tuple, T.weighted_draws(items, "g", "id", "w", 25, seed=4).collect()), key=str)


def test_frequencies_follow_the_weights(spark):
    """4,000 groups of four items with weights 1 to 4: the first drawn is item k in k tenths of them."""
    n = 4000
    items = spark.range(4 * n).select(F.floor(F.col("id") / 4).alias("g"), "id", (F.col("id") % 4 + 1).cast("double").alias("w"))
    rows = T.weighted_draws(items, "g", "id", "w", 3, seed=1).collect()
    assert len(rows) == 3 * n
    first = Counter(r.id % 4 + 1 for r in rows if r.place == 1)
    for k in range(1, 5):
        p = k / 10
        assert abs(first[k] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n)
    second = Counter(r.id % 4 + 1 for r in rows if r.place == 2)
    for k in range(1, 5):
        p = sum(j / 10 * k / (10 - j) for j in range(1, 5) if j != k)
        assert abs(second[k] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n)
