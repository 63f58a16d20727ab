import json

from pyspark.sql import functions as F

from tracemill.streaming import run_index as S


def run_once(stream, name, mode, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_success_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"run_id": i, "model": "ab"[i % 2], "difficulty": "easy", "success": i % 3 == 0, "attempts": 1, "at": "2024-01-01T00:00:00Z"} for i in range(9)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    found = run_once(S.success_counts(S.read_index(spark, str(tmp_path / "in"))), "counts", "complete", tmp_path / "c1").collect()
    assert {(r.model, r.runs, r.ok) for r in found} == {("a", 5, 2), ("b", 4, 1)}


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    (tmp_path / "ev").mkdir()
    batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))
    found = run_once(S.windowed_counts(stream, "at", "10 minutes", "1 day", "1 day", "event_type"), "windows", "complete", tmp_path / "c2")
    assert found.agg(F.sum("n")).first()[0] == batch.count()
    assert found.count() == batch.groupBy(F.window("at", "1 day"), "event_type").count().count()


def test_bounded_memory_of_scenarios(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 4, "x"), ("a", 5, "z"), ("a", 6, "x")]
    df = spark.createDataFrame(rows, "bucket string, doc_id bigint, hash string")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    found = {r.doc_id: (r.duplicate, r.of) for r in run_once(S.remembered_duplicates(stream, 2), "memory", "append", tmp_path / "c3").collect()}
    # Two hashes are remembered in each bucket: when z comes, x goes, so the last x is new again.
    assert found == {1: (False, None), 2: (False, None), 3: (True, 1), 4: (False, None), 5: (False, None), 6: (False, None)}


def test_failures_join_their_index_lines(spark, tmp_path):
    rows = [(1, "2026-01-01 10:00:00"), (2, "2026-01-01 10:01:00"), (3, "2026-01-01 12:00:00")]
    failed = [(1, "2026-01-01 10:02:00", "x"), (2, "2026-01-01 10:30:00", "y"), (9, "2026-01-01 12:30:00", "z")]
    spark.createDataFrame(rows, "run_id bigint, at string").selectExpr("run_id", "timestamp(at) as at").write.parquet(str(tmp_path / "i"))
    spark.createDataFrame(failed, "run_id bigint, at string, reason string").selectExpr("run_id", "timestamp(at) as at", "reason").write.parquet(str(tmp_path / "f"))
    index, failures = (spark.readStream.schema(x).parquet(str(tmp_path / n)) for n, x in (("i", "run_id bigint, at timestamp"), ("f", "run_id bigint, at timestamp, reason string")))
    q = S.with_failures(index, failures).writeStream.format("memory").queryName("joined").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    found = {r.run_id: r.reason for r in spark.table("joined").collect()}
    assert found[1] == "x" and found.get(2) is None and 9 not in found


def test_snapshots_of_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        spark.createDataFrame([(k, "m", "easy", True, 1)], "run_id bigint, model string, difficulty string, success boolean, attempts int").write.mode("append").json(str(tmp_path / "in"))
    q = S.snapshots(S.read_index(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.runs, row.ok, row.snapshot) == (2, 2, 0)
