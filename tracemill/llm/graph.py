"""Connected components of a link table, and checkpoints in the folder that the session names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three longs up to which a table may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of spark.checkpoint.dir; where that is unset, a temporary one on a single machine and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tracemill-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager checkpoint() in the folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the checkpoint folder, read again: for tables that rounds of joins are made from.

    Of a checkpoint Spark keeps the estimated size of the plan that made it, and joins multiply estimates:
    after some rounds the number alone has millions of digits. Of files it takes their real size.
    """
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def released(spark: SparkSession) -> None:
    """Lets Spark remove what nothing refers to any more: shuffle files and broadcasts of plans that a checkpoint has cut off.

    Spark's cleaner does that when the driver's garbage is collected, which on its own may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table of ids, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def anew(key: str) -> Column:
    """A join key of equal meaning under which rows are dealt out anew, so that Spark may split a hot one."""
    return F.bitwise_not(F.col(key))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): component is the least id that links reach.

    Alternating large-star and small-star steps: every step moves links towards the least id of a
    neighbourhood and never adds any, and a component becomes one star in a number of steps that is
    logarithmic in its size. Each step is a few shuffles of the link table, which is then stored.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _to_least(large)
        step = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        edges = stored(step.where("u <> v").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Stored (id, component) after further links: only these, between the components known so far, are contracted."""
    if labels is None:
        return stored(components(links))
    label = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    roots = stored(components(between))
    fresh = roots.join(labels.select("id"), "id", "left_anti").select("id", "component")
    onward = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
    return stored(labels.join(onward, "component", "left").select("id", F.coalesce("root", "component").alias("component")).unionByName(fresh))


def _to_least(edges: DataFrame) -> DataFrame:
    """Edges with m, the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.withColumn("k", anew("u")).join(least.select(anew("u").alias("k"), "m"), "k").drop("k")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
