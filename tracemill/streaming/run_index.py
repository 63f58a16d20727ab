"""Streams of run index lines and scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

INDEX = "run_id bigint, model string, difficulty string, success boolean, attempts int, at timestamp"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A stream of appended JSON lines."""
    return spark.readStream.schema(INDEX).json(path)


def success_counts(stream: DataFrame) -> DataFrame:
    """Runs and successes by model and difficulty, updated as lines arrive."""
    return stream.groupBy("model", "difficulty").agg(F.count("*").alias("runs"), F.count_if("success").alias("ok"))


def windowed_counts(stream: DataFrame, at: str, late: str, length: str, slide: str, *keys: str) -> DataFrame:
    """Counts by sliding window; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length, slide), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, late: str, gap: str, *keys: str) -> DataFrame:
    """Sessions by key that end after a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), *keys).agg(F.count("*").alias("n"))


class Memory(StatefulProcessor):
    """Per bucket the hashes of the newest scenarios: each row is held against them, then joins them; the oldest goes."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getListState("hashes", StructType([StructField("hash", StringType()), StructField("doc_id", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = [(h, i) for h, i in self.hashes.get()] if self.hashes.exists() else []
        for frame in rows:
            out = []
            for doc_id, digest in zip(frame.sort_values("doc_id")["doc_id"], frame.sort_values("doc_id")["hash"], strict=True):
                first = next((i for h, i in kept if h == digest), None)
                out.append((key[0], int(doc_id), first is not None, first))
                if first is None:
                    kept = [*kept, (digest, int(doc_id))][-self.most :]
            yield pd.DataFrame(out, columns=["bucket", "doc_id", "duplicate", "of"]).astype({"of": "Int64"})
        self.hashes.put(kept)

    def close(self) -> None:
        pass


OUTPUT = StructType([StructField("bucket", StringType()), StructField("doc_id", LongType()), StructField("duplicate", BooleanType()), StructField("of", LongType())])


def remembered_duplicates(stream: DataFrame, most: int = 200) -> DataFrame:
    """(bucket, doc_id, duplicate, of) for a stream of (bucket, doc_id, hash), with a bounded memory in each bucket."""
    return stream.groupBy("bucket").transformWithStateInPandas(Memory(most), OUTPUT, "Append", "None")


MEANS = StructType([StructField("key", StringType()), StructField("ord", LongType()), StructField("mean", DoubleType()), StructField("n", LongType())])


class RunningMean(StatefulProcessor):
    """Per key the sum and number of the values so far; every row gets the mean up to itself, and a key that stays idle is forgotten."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.so_far = handle.getValueState("so_far", StructType([StructField("total", DoubleType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        total, n = self.so_far.get() if self.so_far.exists() else (0.0, 0)
        frame = pd.concat(list(rows)).sort_values("ord", kind="stable")
        values = frame["value"].to_numpy()
        count = n + np.arange(1, len(values) + 1)
        sums = total + np.cumsum(values)
        self.so_far.update((float(sums[-1]), int(count[-1])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"key": key[0], "ord": frame["ord"].to_numpy(), "mean": sums / count, "n": count})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.so_far.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "ord": pd.Series([], dtype="int64"), "mean": pd.Series([], dtype=float), "n": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def running_means(stream: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """(key, ord, mean, n) for a stream of (key, ord, value): the mean of a key's values up to each row.

    Rows of a micro-batch count in order of ord, micro-batches in order of arrival. What is kept is a sum
    and a number for each key that had a row within idle_ms; a query that starts again goes on from its
    checkpoint. Null values don't count and give no row; a null key is a key.
    """
    rows = stream.where("value is not null").select("key", F.col("ord").cast("bigint").alias("ord"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(RunningMean(idle_ms), MEANS, "Append", "ProcessingTime")


def with_failures(index: DataFrame, failures: DataFrame, late: str = "10 minutes", within: str = "5 minutes") -> DataFrame:
    """Index lines with the failure lines of their run that come within a span of time after them; both streams have run_id and `at`.

    Watermarks on both sides bound what is kept: a line waits no longer than its counterpart can come.
    """
    left = index.withWatermark("at", late).alias("i")
    right = failures.select(F.col("run_id").alias("failed_run"), F.col("at").alias("failed_at"), "reason").withWatermark("failed_at", late)
    near = F.expr(f"failed_run = run_id AND failed_at >= at AND failed_at <= at + interval {within}")
    return left.join(right, near, "leftOuter").drop("failed_run")


def snapshots(stream: DataFrame, path: str, checkpoint: str, every: int = 10):
    """A query that writes the counts so far under snapshot=<batch> after every so many batches."""

    def write(batch: DataFrame, number: int) -> None:
        if number % every == 0:
            batch.write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return success_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
