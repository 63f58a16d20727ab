"""Principal components and the linear probe against dense linear algebra; running means on a stream."""

import random

import numpy as np

from tracemill.operators import compare as C
from tracemill.operators import learned as L
from tracemill.streaming import run_index as S


def vectors(spark, n=400, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 3
    label = (x[:, 0] > x[:, 0].mean()).astype(int) + 2 * (x[:, 1] > x[:, 1].mean())
    rows = [(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(label, x))]
    return x, label, spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")


def test_principal_components_equal_dense_ones(spark):
    x, _, df = vectors(spark)
    mean, cov, n = L.covariance(df.repartition(7))
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    value, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :4]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(4)])
    expected = (x - x.mean(0)) @ axes
    found = {r.vec_id: r.components for r in L.principal_components(df, 4).collect()}
    assert all(np.allclose(found[i], expected[i], atol=1e-8) for i in range(len(x)))
    own, v = L.jacobi(cov)
    assert np.allclose(own, value[::-1]) and np.allclose(v @ np.diag(own) @ v.T, cov) and np.allclose(v.T @ v, np.eye(12))


def test_principal_components_edges(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert sorted(((r.vec_id, r.components) for r in L.principal_components(df, 2).collect()), key=str) == [(1, None), (2, [0.0, 0.0]), (2, [0.0, 0.0])]
    assert L.principal_components(df.where("vec_id > 9"), 2).count() == 0


def test_probe_stands_at_the_optimum(spark):
    x, label, df = vectors(spark, seed=5)
    train, test = df.where("vec_id % 4 > 0"), df.where("vec_id % 4 = 0")
    on = np.arange(len(x)) % 4 > 0
    scale = lambda v: (v - x[on].mean(0)) / x[on].std(0, ddof=1)
    z = np.concatenate([scale(x[on]), np.ones((on.sum(), 1))], 1)
    y, w = np.eye(4)[label[on]], np.zeros((13, 4))
    fine = np.vstack([np.full((12, 4), 0.01), np.zeros((1, 4))])
    for _ in range(60):  # Newton's steps on the whole Hessian
        p = np.exp(z @ w - (z @ w).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = z.T @ (p - y) / len(z) + fine * w
        hess = np.einsum("ni,nj,nab->iajb", z, z, p[:, :, None] * (np.eye(4)[None] - p[:, None, :]), optimize=True).reshape(52, 52) / len(z) + np.diag(fine.ravel() + 1e-10)
        w -= np.linalg.solve(hess, grad.ravel()).reshape(13, 4)
    assert np.abs(grad).max() < 1e-9
    scores = np.concatenate([scale(x[~on]), np.ones(((~on).sum(), 1))], 1) @ w
    top = np.sort(scores, 1)
    sure = top[:, -1] - top[:, -2] > 1e-3
    expected = dict(zip(np.flatnonzero(~on)[sure].tolist(), scores.argmax(1)[sure].tolist()))
    found = {r.vec_id: r.predicted for r in L.linear_probe(train, test).collect()}
    assert {i: found[i] for i in expected} == expected and len(expected) > 90


def test_running_means_go_on_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, None if i % 9 == 4 else rng.randrange(64) / 8) for i in range(60)]
    schema = "key string, ord bigint, value double"
    folder = str(tmp_path / "in")
    stream = lambda: S.running_means(spark.readStream.schema(schema).parquet(folder))
    for lo in (0, 25, 40):  # each time a query that starts again
        spark.createDataFrame(rows[lo : {0: 25, 25: 40, 40: 60}[lo]], schema).coalesce(1).write.mode("append").parquet(folder)
        q = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(once=True).start()
        assert q.awaitTermination(60)
    found = {(r.key, r.ord): (r["mean"], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    twin = {(r.key, r.ord): (r["mean"], r.n) for r in C.running_means(spark.createDataFrame(rows, schema), "key").collect()}
    assert found == twin and len(twin) == sum(v is not None for _, _, v in rows)
    plain, seen = {}, {}
    for k, i, v in rows:
        if v is not None:
            seen.setdefault(k, []).append(v)
            plain[k, i] = (sum(seen[k]) / len(seen[k]), len(seen[k]))
    assert twin == plain
