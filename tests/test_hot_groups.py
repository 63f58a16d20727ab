"""Operators that work in rounds or split hot groups, against plain loops."""

import random

import pytest

from tracemill.operators import nearest, rounds
from tracemill.operators import search_tree as T
from tracemill.operators import similar as D
from tracemill.operators import triage as G


def test_trees_of_any_depth(spark):
    rng = random.Random(3)
    parent = {0: None, 1: None} | {i: i - 1 for i in range(2, 60)} | {i: rng.randrange(2, 60) for i in range(60, 200)} | {900: 901, 901: 900, 950: 999}
    nodes = spark.createDataFrame([(i, p, i / 7.0) for i, p in parent.items()], "node_id bigint, parent_id bigint, value double")

    def way(i):
        out = []
        while i is not None and i in parent and len(out) < 300:
            out.append(i)
            i = parent[i]
        return out if i is None else None

    ways = {i: way(i) for i in parent if way(i)}
    assert {r.node_id: r.depth for r in T.with_depth(nodes).collect()} == {i: len(w) - 1 for i, w in ways.items()}
    paths = {r.node_id: r for r in T.root_paths(nodes).collect()}
    assert paths.keys() == ways.keys()
    for i, w in ways.items():
        assert paths[i].path == ">".join(map(str, reversed(w))) and paths[i].length == len(w) and paths[i].path_value == pytest.approx(sum(k / 7 for k in w) / len(w), abs=1e-5)
    rewards = [(rng.randrange(200), rng.random()) for _ in range(300)]
    total = {}
    for i, r in rewards:
        for step, k in enumerate(ways[i]):
            total[k] = total.get(k, 0) + r * 0.9**step
    found = T.backpropagated(nodes, spark.createDataFrame(rewards, "node_id bigint, reward double")).collect()
    assert {r.node_id for r in found} == total.keys() and all(float(r.total) == pytest.approx(total[r.node_id], abs=1e-5) for r in found)


def test_numbers_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "b", rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x int, i int")
    plain = {}
    for k in ("hot", "b"):
        plain |= {i: n for n, (_, i) in enumerate(sorted((x, i) for kk, x, i in rows if kk == k), 1)}
    found = rounds.numbered(df, ["k"], (df.x / 7).cast("int"), ["x", "i"], "n").collect()
    assert {r.i: r.n for r in found} == plain and found[0].asDict().keys() == {"k", "x", "i", "n"}


def test_pairs_of_the_last_k(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(40)], "doc_id bigint, bucket string")
    found = {(r.a, r.b, r.back) for r in D.last_k(docs, ["bucket"], 4).collect()}
    expected = set()
    for b in "ab":
        ids = [i for i in range(40) if "ab"[i % 3 == 0] == b]
        expected |= {(x, ids[j], n - j) for n, x in enumerate(ids) for j in range(max(0, n - 4), n)}
    assert found == expected


@pytest.mark.parametrize("method,expected", [("bow", "cosine"), ("unknown", "cosine"), ("minhash", "minhash"), ("semantic", "semantic")])
def test_stages_speak_in_order(spark, method, expected):
    base = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame([(1, "x", base), (2, "x", base.upper()), (3, "x", base + " more"), (4, "x", "nothing alike at all here"), (5, "y", base)], "doc_id bigint, bucket string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.99, 0.01]), (4, [0.0, 1.0]), (5, [1.0, 0.0])], "doc_id bigint, embedding array<double>")
    found = {r.doc_id: (r.method, r.matched) for r in D.staged_matches(docs, ["bucket"], 5, method, vectors=vectors).collect()}
    assert found == {2: ("hash", 1), 3: (expected, 1)}


def test_nearest_by_cosine_and_distance(spark, monkeypatch):  # exact, in slices and blocks of about three
    rng = random.Random(9)
    rows = [(i, i % 4, [rng.gauss(0, 1) for _ in range(5)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    monkeypatch.setattr(nearest, "SLICE", 3)
    for metric in ("cosine", "l2"):
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        near = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if metric == "cosine" else -(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5)  # noqa: B023, E731
        expected = {}
        for i, _, v in rows[:8]:
            best = sorted(((-round(near(v, w), 9), j, c) for j, c, w in rows if j != i))[:5]
            labels = {c: [-s for s, _, k in best if k == c] for _, _, c in best}
            expected[i] = max(labels, key=lambda c: (len(labels[c]), round(sum(labels[c]) / len(labels[c]), 6), -c))
        assert {r.query_id: r.label for r in G.knn_votes(df, df.where("vec_id < 8"), 5, metric).collect()} == expected


@pytest.mark.parametrize("method", ["bow", "minhash"])
def test_staged_matches_across_blocks(spark, monkeypatch, method):
    monkeypatch.setattr(D, "STRETCH", 2)
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(6)]
    texts = [rng.choice(base) + rng.choice(["", " more", f" tail{i}", " <b>"]) for i in range(90)] + [None, "", "?"]
    docs = spark.createDataFrame([(i, "a" if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id bigint, bucket string, text string")
    plain = {r.doc_id: r.norm for r in docs.select("doc_id", D.normal_text(docs.text).alias("norm")).collect()}
    vector = {i: dict(D._weights(t, 384)) for i, t in plain.items() if t}
    signature = {i: D._signature(t, 96, 3) for i, t in plain.items() if t}

    def near(a, b):
        if method == "bow":
            return round(sum(x * vector[b].get(t, 0) for t, x in vector[a].items()), 6) >= 0.92
        return signature[a] is not None and signature[b] is not None and (signature[a] == signature[b]).mean() >= 0.82

    expected = {}
    for bucket in (0, 1):
        ids = [i for i in plain if (i % 5 > 0) == bucket]
        for n, i in enumerate(ids):
            before = ids[max(0, n - 4) : n]
            same = [j for j in before if plain[i] is not None and plain[i] == plain[j]]
            close = [j for j in before if plain[i] and plain[j] and near(i, j)]
            if same or close:
                expected[i] = ("hash", same[0]) if same else ("cosine" if method == "bow" else "minhash", close[0])
    found = D.staged_matches(docs, ["bucket"], 4, method)
    assert {r.doc_id: (r.method, r.matched) for r in found.collect()} == expected and len(expected) > 20
    for made in (D.term_weights(docs), D.minhash(docs)):  # a text's terms and shingles stay where it is read
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
