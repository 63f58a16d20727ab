"""The index of vectors against plain loops."""

import random

import numpy as np
import pytest

from tracemill import catalog
from tracemill.operators import nearest as N
from tracemill.operators import triage as G

SCHEMA = "vec_id bigint, label int, embedding array<double>, list string"


def clusters(n, seed, hot=0.4):
    """Vectors around twelve centres, one of which holds a large share."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(12)]
    own = [0 if rng.random() < hot else rng.randrange(12) for _ in range(n)]
    return [(i, own[i], [c + rng.gauss(0, 0.3) for c in centres[own[i]]], "x") for i in range(n)]


def plain(rows, queries, k, metric):
    found = set()
    for i, _, q, _ in queries:
        q = np.array(q)
        near = []
        for j, _, v, _ in rows:
            v = np.array(v)
            sim = q @ v / max(np.linalg.norm(q), 1e-300) / max(np.linalg.norm(v), 1e-300) if metric == "cosine" else -np.linalg.norm(q - v)
            near += [(-round(float(sim), 9), j)] if j != i else []
        found |= {(i, j) for _, j in sorted(near)[:k]}
    return found


def ids(df):
    found = [(r.query_id, r.vec_id) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_all_lists_are_exact_and_measured_probes_reach_the_recall(spark, monkeypatch, metric):
    monkeypatch.setattr(N, "SLICE", 50)  # the hot list has several slices, and the queries several blocks
    rows = clusters(900, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    expected = plain(rows, rows[::3], 5, metric)
    queries = df.where("vec_id % 3 = 0")
    assert ids(N.neighbours(N.vector_index(df, 1, metric), queries, 5)) == expected
    index = N.vector_index(df, 24, metric)
    assert index.rows.count() == len(rows) and len(index.centroids) == 24
    assert ids(N.neighbours(index, queries, 5, 24)) == expected
    probes = N.probes_for(index, queries, 5, 0.95)
    assert 1 <= probes < 12  # clustered vectors need few of the lists
    got = ids(N.neighbours(index, queries, 5, probes))
    assert len(got & expected) >= 0.9 * len(expected)  # the probes are measured on a part of these queries


def test_index_is_the_same_however_rows_are_partitioned(spark):
    df = spark.createDataFrame(clusters(300, 8), SCHEMA)
    kept = [{(r.vec_id, r.list) for r in N.vector_index(df.repartition(n), 9).rows.collect()} for n in (1, 5)]
    assert kept[0] == kept[1] and len({x for _, x in kept[0]}) > 4


@pytest.mark.parametrize("lists", [1, 4])
def test_odd_vectors(spark, lists):
    rows = [(1, 0, None, "x"), (2, 1, [1.0, 0.0], "x"), (3, 1, [1.0, 0.0], "x"), (3, 1, [1.0, 0.0], "x"), (4, 2, [0.0, 0.0], "x"), (5, 2, [None, 1.0], "x"), (6, 2, [], "x"), (7, None, [0.0, 1.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    index = N.vector_index(df, lists)
    assert sorted(r.vec_id for r in index.rows.collect()) == [2, 3, 3, 4, 7]
    found = [(r.query_id, r.vec_id, r.sim) for r in N.neighbours(index, df, 2, 4).collect()]
    assert sorted(found) == [(2, 3, 1.0), (2, 3, 1.0), (3, 2, 1.0), (3, 4, 0.0), (4, 2, 0.0), (4, 3, 0.0), (7, 2, 0.0), (7, 3, 0.0)]  # ties: the lesser id; repeated rows are rows
    empty = df.where("false")
    for train, test in ((empty, df), (df, empty), (empty, empty)):
        assert G.knn_votes(train, test, 3, lists=lists).count() == 0


def test_query_reaches_the_recall(spark):
    folder = "/root/testdata/sf0.001"
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0")
    index = N.vector_index(v, 64)
    true, got = ids(N.neighbours(N.vector_index(v), q, 5)), ids(N.neighbours(index, q, 5, N.probes_for(index, q, 5)))
    assert len(true & got) >= 0.9 * len(true)
    assert catalog.QUERIES["vector_knn_indexed"](spark, folder).count() == q.count()
