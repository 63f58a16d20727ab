"""Helpers of operators that work in rounds or number the rows of a hot group."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a side may have in Spark's estimate to be broadcast whatever its rows.
BROADCAST_BYTES = 32 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager checkpoint() in spark.checkpoint.dir; a temporary folder is set only on a single machine where that is unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tracemill-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def restarted(df: DataFrame) -> DataFrame:
    """checkpointed(), with its rows as a source of unknown size.

    A checkpoint keeps the estimated size of the plan that made it, and joins multiply estimates: after some rounds of joins
    of tables that earlier rounds made, that number alone fills the driver.
    """
    kept, session = checkpointed(df), df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), session)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner, which follows the driver's garbage collection, remove what plans that a checkpoint has cut off have left."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, by: list[str], stretch: Column, order: list, name: str) -> DataFrame:
    """df with the place of each row in its group, from 1 on, in the order of `stretch`, then `order`.

    stretch cuts a group to parts that follow each other: parts are counted first, and only one part is
    ever sorted in a task, so a group may hold a third of all rows. Rows whose keys or stretch are null are
    groups and parts like others, null stretches first.
    """
    cut = df.withColumn("__stretch", stretch)
    counts = cut.groupBy(*by, "__stretch").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*by, "__stretch", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy(*by, "__stretch").orderBy(*order))
    keys = {c: f"__of_{k}" for k, c in enumerate([*by, "__stretch"])}
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    both = cut.withColumn("__inside", inside).join(ahead.withColumnsRenamed(keys), same)
    return both.withColumn(name, F.col("__inside") + F.col("__ahead")).drop("__stretch", "__inside", "__ahead", *keys.values())


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): component is the least id that links reach.

    Large-star and small-star steps by turns (Kiveris et al., 2014): links move to the least id around until each component is one star,
    in a logarithmic number of steps that never add a link; one checkpoint a step.
    """
    edges = restarted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, state = None, _state(edges)
    while state != before:
        away = _around(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        home = _around(away.distinct())
        stars = home.select("u", F.col("m").alias("v")).unionByName(home.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = restarted(stars.where("u <> v").distinct())
        before, state = state, _state(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _around(edges: DataFrame) -> DataFrame:
    """Edges with m, the least of u and its neighbours."""
    return edges.join(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
