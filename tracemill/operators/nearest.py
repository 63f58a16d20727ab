"""Nearest neighbours by an inverted index of vectors: every row lies in the list of its nearest centroid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import checkpointed

#: Vectors that centroids are fitted on: those whose ids have the least hashes.
SAMPLE = 20_000
#: Queries, those of least hash, that the number of probes is measured on.
QUERIES = 256
#: Lists at most: their centroids and sizes are what is broadcast.
LISTS = 4_096
#: Vectors of a slice of a list, and queries of a block, on average: one task holds one of each.
SLICE = 4_096


@dataclass
class VectorIndex:
    """Rows (list, nth, vec_id, label, embedding), nth being a number of its own for each row; centroids are None where there is one list only."""

    rows: DataFrame
    centroids: np.ndarray | None
    metric: str


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), len(flat) // max(len(whole), 1))


def _known(vectors: DataFrame, *columns: Column) -> DataFrame:
    """Rows that have a vector without nulls; others are nobody's neighbours."""
    v = F.col("embedding").cast("array<double>")
    whole = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    return whole.select(*columns, v.alias("embedding"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def _closest(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The lists of the `most` centroids that are nearest to each vector."""
    return np.argsort(0.5 * (centres**2).sum(1) - x @ centres.T, axis=1, kind="stable")[:, :most]


def centroids(vectors: DataFrame, lists: int, metric: str = "cosine", rounds: int = 15) -> np.ndarray:
    """Centroids of a sample of at most SAMPLE vectors: Lloyd's rounds from rows spread evenly over it, on unit vectors for `cosine`.

    The sample is in an exact order (hash of the id, id, vector), so the same rows give the same centroids however they are partitioned.
    """
    order = [F.xxhash64("vec_id"), F.col("vec_id"), F.col("embedding")]
    x = _matrix(_known(vectors, F.col("vec_id")).orderBy(*order).limit(SAMPLE).select("embedding").toArrow().column(0))
    x = np.unique(_unit(x) if metric == "cosine" else x, axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x), LISTS)).astype(int)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        own = np.concatenate([_closest(x[i : i + 1024], centres, 1)[:, 0] for i in range(0, len(x), 1024)])
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        moved = _unit(moved) if metric == "cosine" else moved
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _placed(rows: DataFrame, centres: np.ndarray | None, metric: str, most: int) -> DataFrame:
    """Rows, whose vector is the last column, with each of their `most` nearest lists."""
    if centres is None or not len(centres):
        return rows.select(F.lit(0).alias("list"), "*")
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(len(names) - 1))
                near = _closest(_unit(x) if metric == "cosine" else x, shared.value, most)
                again = part.take(pa.array(np.repeat(np.arange(part.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *again.columns], ["list", *names])

    return rows.mapInArrow(run, "list int, " + ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))


def vector_index(vectors: DataFrame, lists: int = 1, metric: str = "cosine") -> VectorIndex:
    """An index over every row of vectors (vec_id, label, embedding; all vectors of one length, else an error).

    With one list searches are exact and no centroid is fitted. A list may hold any share of the rows: searches cut it to slices.
    """
    centres = centroids(vectors, lists, metric) if lists > 1 else None
    rows = _placed(_known(vectors, F.col("vec_id"), F.col("label")), centres, metric, 1)
    return VectorIndex(checkpointed(rows.withColumn("nth", F.monotonically_increasing_id())), centres, metric)


def neighbours(index: VectorIndex, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
    """(query_id, vec_id, label, sim, list): the k nearest vectors other than itself of each query (vec_id, embedding) in its `probes` nearest lists.

    Nearer is the greater similarity (to nine places), then the lesser vec_id. Similarity is the cosine (0 for a zero vector) or, for `l2`,
    minus the distance. Of queries with one id the least vector counts; a query without a vector has no rows. Slices of lists and
    blocks of their queries meet by a shuffle join; a task holds one of each, and sends on k candidates for each query and ties of the last.
    """
    one = _known(queries, F.col("vec_id").alias("query_id")).groupBy("query_id").agg(F.min("embedding").alias("q"))
    asked = _placed(one, index.centroids, index.metric, probes)
    parts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias(name))
    sizes = F.broadcast(parts(index.rows, "slices").join(parts(asked, "blocks"), "list"))  # a row for each list: LISTS at most
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = index.rows.join(sizes, "list").select("list", own("nth", "slices").alias("slice"), numbers("blocks").alias("block"), "vec_id", "label", "embedding")
    right = asked.join(sizes, "list").select("list", numbers("slices").alias("slice"), own("query_id", "blocks").alias("block"), "query_id", "q")
    keys, types = ["list", "slice", "block"], dict(index.rows.dtypes)
    schema = f"query_id {dict(one.dtypes)['query_id']}, vec_id {types['vec_id']}, label {types['label']}, sim double, list int"
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_held_against(k, index.metric), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def probes_for(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The least number of probes with which at most QUERIES of the queries find the given share of their k true nearest vectors.

    The true ones come from a search of those queries in all lists; a neighbour is found as soon as its list is probed, so that one
    search tells the recall of every number of probes.
    """
    if index.centroids is None or not len(index.centroids):
        return 1
    some = checkpointed(_known(queries, F.col("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(QUERIES))
    true = neighbours(index, some, k, len(index.centroids)).select("query_id", "list").toArrow()  # at most QUERIES * k rows
    asked = some.groupBy("vec_id").agg(F.min("embedding").alias("q")).toArrow()
    if not true.num_rows:
        return 1
    q = _matrix(asked["q"])
    order = _closest(_unit(q) if index.metric == "cosine" else q, index.centroids, len(index.centroids))
    at = {v: n for n, v in enumerate(asked["vec_id"].to_pylist())}
    ranks = np.argsort(order, axis=1)[[at[v] for v in true["query_id"].to_pylist()], true["list"].to_numpy()]
    return int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) + 1


def _held_against(k: int, metric: str):
    """The k nearest vectors of a slice, and ties of the last, for each query of a block."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        x, rows, asked = _matrix(left["embedding"]), [], []
        q = _matrix(right["q"])
        ids, queries = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        if metric == "cosine":
            x, q = _unit(x), _unit(q)
        sims = []
        for at in range(0, len(q) if len(x) else 0, 256):
            some = q[at : at + 256]
            sim = some @ x.T if metric == "cosine" else -np.sqrt(np.maximum((some**2).sum(1)[:, None] + (x**2).sum(1) - 2 * some @ x.T, 0))
            sim = np.where(queries[at : at + 256, None] == ids, -np.inf, np.round(sim, 9))
            last = np.partition(sim, max(len(x) - k, 0), axis=1)[:, max(len(x) - k, 0)]
            own, row = np.nonzero((sim >= last[:, None]) & np.isfinite(sim))
            asked.append(own + at), rows.append(row), sims.append(sim[own, row])
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        taken = left.take(pa.array(whole(rows, np.int64)))
        return pa.table({"query_id": right["query_id"].take(pa.array(whole(asked, np.int64))), "vec_id": taken["vec_id"], "label": taken["label"], "sim": pa.array(whole(sims, np.float64)), "list": pa.array(np.full(taken.num_rows, key[0].as_py(), np.int32))})

    return run
