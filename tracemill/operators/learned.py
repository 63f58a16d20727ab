"""Collapse of judged duplicates, linear probe, principal components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import checkpointed
from .search_tree import _doubled


def duplicate_roots(findings: DataFrame) -> DataFrame:
    """(run_id, ord, root): the finding that a chain of `duplicate_of` (ords of the same run) ends at, of any length.

    A finding without one, or whose target isn't there, is a root. Of a cycle, and of what leads to it, the
    root is the cycle's least ord. Chains are followed by doubling, on those that aren't at their end yet; since none
    leaves its run, the rounds are as many as the largest run needs, however many findings there are.
    """
    node = lambda o: F.struct("run_id", F.col(o).cast("bigint").alias("ord"))
    named = findings.select(node("ord").alias("node_id"), F.when(F.col("duplicate_of") != F.col("ord"), node("duplicate_of")).alias("up")).dropDuplicates(["node_id"])
    there = named.select(F.col("node_id").alias("up"), F.lit(True).alias("there"))
    linked = checkpointed(named.join(there, "up", "left").select("node_id", F.when(F.col("there"), F.col("up")).alias("up")))
    most = linked.groupBy("node_id.run_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    ends = _doubled(linked.withColumn("root", F.col("node_id")), {"root": F.col("__root")}, most)
    ring = checkpointed(linked.join(ends.select("node_id"), "node_id", "left_anti").withColumn("least", F.col("node_id")))
    steps = 1 if not ring.isEmpty() else most + 1
    while steps <= most:  # of n hops, the last is on the cycle, and n from there see all of it
        onward = ring.select(F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("least").alias("__least"))
        ring = checkpointed(ring.join(onward, "up").select("node_id", F.col("__up").alias("up"), F.least("least", "__least").alias("least")))
        steps *= 2
    cycles = ring.join(ring.select(F.col("node_id").alias("up"), F.col("least").alias("root")), "up").select("node_id", "root")
    return ends.select("node_id", "root").unionByName(cycles).select("node_id.run_id", "node_id.ord", F.col("root.ord").alias("root"))


#: Findings of a run that a task may hold; chains of larger runs are followed by joins.
RUN = 100_000


def _placed(findings: DataFrame) -> DataFrame:
    """(run_id, ord, severity, line, cwe): findings with the place of the one at the end of their chain; runs are followed whole, where they are read in order, but for those of more than RUN findings."""
    findings = findings.where("run_id is not null and ord is not null").select("run_id", F.col("ord").cast("bigint").alias("ord"), "severity", "line", "cwe", F.col("duplicate_of").cast("bigint").alias("duplicate_of"))
    large = checkpointed(findings.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > RUN).select("run_id"))
    if large.isEmpty():
        return _followed(findings)
    wide = findings.join(F.broadcast(large), "run_id", "left_semi")  # of a large run there is a row for each RUN findings at most
    there = wide.select("run_id", F.col("ord").alias("root"), "line", "cwe")
    led = wide.drop("line", "cwe").join(duplicate_roots(wide), ["run_id", "ord"]).join(there, ["run_id", "root"])
    return _followed(findings.join(F.broadcast(large), "run_id", "left_anti")).unionByName(led.select("run_id", "ord", "severity", "line", "cwe"))


def _followed(findings: DataFrame) -> DataFrame:
    """The same for runs that a task can hold: rows come by run and ord, chains are followed by doubling in arrays, and nothing is stored between."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            begins = np.flatnonzero(held.column("nth").to_numpy() == 1)
            if len(begins) and begins[-1]:
                yield from ends_of(held.slice(0, begins[-1]))
                held = held.slice(begins[-1])
        if held is not None and held.num_rows:
            yield from ends_of(held)

    def ends_of(t):
        t = t.combine_chunks()
        of_run = np.cumsum(t.column("nth").to_numpy() == 1)
        order = t.column("ord").to_numpy()
        first = np.flatnonzero(np.append(True, (of_run[1:] != of_run[:-1]) | (order[1:] != order[:-1])))  # an ord that is there twice is one place
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        runs, ords = of_run[first], order[first]
        named = t.column("duplicate_of").take(pa.array(first))
        target, told = named.fill_null(0).to_numpy(), named.is_valid().to_numpy()
        known, number = np.unique(ords, return_inverse=True)
        key = runs * len(known) + number
        spot = np.minimum(np.searchsorted(known, target), len(known) - 1)
        told = told & (known[spot] == target)
        found = np.minimum(np.searchsorted(key, runs * len(known) + spot), len(key) - 1)
        told &= key[found] == runs * len(known) + spot
        up = np.where(told, found, np.arange(len(key)))
        ends, least, hops, most = up, np.arange(len(key)), 1, np.bincount(runs).max()
        while hops <= most:
            ends, least, hops = ends[ends], np.minimum(least, least[ends]), 2 * hops
        root = least[ends] if len(ends) else ends  # of a root itself, of a cycle its least
        times = np.diff(np.append(first, len(order)))[root][place]
        start = first[root][place]
        at = np.repeat(start - np.cumsum(times) + times, times) + np.arange(times.sum())
        own = t.select(["run_id", "ord", "severity"]).take(pa.array(np.repeat(np.arange(len(place)), times)))
        led = t.select(["line", "cwe"]).take(pa.array(at))
        out = own.append_column("line", led.column("line")).append_column("cwe", led.column("cwe"))
        yield from out.to_batches(max_chunksize=10_000)

    kinds = dict(findings.dtypes)
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))
    return findings.withColumn("nth", nth).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("run_id", "ord", "severity", "line", "cwe")))


def collapse_duplicates(findings: DataFrame) -> DataFrame:
    """Findings of a run by weakness and line: the first (ord) stays, with the worst level, and how many joined it.

    Where findings have `duplicate_of`, the ord of another finding of the run, the place of the one at the
    end of that chain counts for them (see `duplicate_roots`).
    """
    rank = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
    by_rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("severity")), F.lit(0))
    place = _placed(findings) if "duplicate_of" in findings.columns else findings
    return place.groupBy("run_id", "line", "cwe").agg(F.min("ord").alias("ord"), F.max_by("severity", F.struct(by_rank, -F.col("ord"))).alias("severity"), (F.count("*") - 1).cast("int").alias("merged")).select("run_id", "ord", "line", "cwe", "severity", "merged")


def linear_probe(train: DataFrame, test: DataFrame) -> DataFrame:
    """Labels of test vectors by multinomial logistic regression on standardised train vectors.

    What is minimised is the mean log loss plus 0.005 times the sum of squared weights (not of intercepts), over
    vectors of mean 0 and unit sample deviation; that minimum is unique but for a shift of the intercepts.
    """
    vec = lambda df: df.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("x"))
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(vec(train))
    model = LogisticRegression(featuresCol="z", family="multinomial", regParam=0.01, maxIter=200, tol=1e-9).fit(scaler.transform(vec(train)))
    return model.transform(scaler.transform(vec(test))).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def covariance(vectors: DataFrame, column: str = "embedding") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (of the population) and number of a column of vectors.

    Every task sums its vectors and their products; Spark adds the tasks' sums place by place, and only those of
    one matrix come to the driver, whatever the rows. Null vectors don't count.
    """

    def run(batches):
        total = None
        for batch in batches:
            x = np.array([v for v in batch.column(0).to_pylist() if v is not None], np.float64)
            if len(x):
                own = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "x"])

    sums = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "place bigint, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow().sort_by("place")
    flat = sums.column("x").to_numpy()
    if not len(flat):
        return np.zeros(0), np.zeros((0, 0)), 0
    d = (math.isqrt(4 * len(flat) - 3) - 1) // 2
    mean = flat[1 : d + 1] / flat[0]
    return mean, flat[d + 1 :].reshape(d, d) / flat[0] - np.outer(mean, mean), int(flat[0])


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations; each vector's entry of largest size is positive."""
    a, v = a.copy(), np.eye(len(a))
    for _ in range(sweeps):
        off = np.abs(a - np.diag(np.diag(a)))
        if not off.size or off.max() <= 1e-15 * max(1e-300, np.abs(np.diag(a)).max()):
            break
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if a[p, q] == 0:
                    continue
                ratio = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if ratio >= 0 else -1) / (abs(ratio) + math.hypot(ratio, 1))
                c = 1 / math.hypot(t, 1)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q]] = turn.T @ a[[p, q]]
                v[:, [p, q]] = v[:, [p, q]] @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v * np.where(v[np.abs(v).argmax(0), np.arange(len(v))] < 0, -1.0, 1.0) if len(v) else v


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """Vectors on their first k principal components (centred): vec_id, components.

    The axes are those of the population covariance, by falling variance; an axis points where its entry of
    largest size is positive. A null vector has null components.
    """
    mean, cov, _ = covariance(vectors)
    axes = jacobi(cov)[1][:, :k]
    shared = vectors.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batches):
        mean, axes = shared.value
        for batch in batches:
            rows = batch.column(1).to_pylist()
            known = [i for i, v in enumerate(rows) if v is not None]
            out = [None] * len(rows)
            if known:
                for i, z in zip(known, ((np.array([rows[i] for i in known], np.float64) - mean) @ axes).tolist(), strict=True):
                    out[i] = z
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "components"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, components array<double>")
