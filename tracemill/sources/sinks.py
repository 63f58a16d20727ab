"""Writers of metrics and run artefacts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line, null fields kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, *more: DataFrame) -> None:
    """The rows of all frames under the union of their columns, in order of name, with a header; arrays and maps as JSON.

    Frames without rows give a file without lines, not even a header.
    """
    for other in more:
        df = df.unionByName(other, allowMissingColumns=True)
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in sorted(df.dtypes)]
    if df.isEmpty():
        df.sparkSession.range(0).select(F.lit("").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_artefacts(tables: dict[str, DataFrame], path: str, *partitions: str) -> None:
    """Each table under its name as Parquet, partitioned by those of the columns that it has."""
    for name, df in tables.items():
        by = [c for c in partitions if c in df.columns]
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")


def source_manifest(spark, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_digest(manifest: DataFrame, root: str) -> tuple[str, int]:
    """One digest over the files' names below the root and digests, in order of name, and their number; rows stream to the driver one by one."""
    digest, count = hashlib.sha256(), 0
    for r in manifest.orderBy("path").toLocalIterator():
        digest.update(f"{r.path.split(root.rstrip('/') + '/', 1)[-1]}\0{r.sha256}\n".encode())
        count += 1
    return digest.hexdigest(), count


def write_snapshot(nodes: DataFrame, path: str, iteration: int, every: int = 10) -> bool:
    """A tree's nodes under snapshot=<iteration>, every so many iterations; whether there was one to write."""
    if iteration % every:
        return False
    nodes.write.mode("overwrite").parquet(f"{path}/snapshot={iteration}")
    return True


def export_by_question(tables: dict[str, dict[str, DataFrame]], path: str, experiment: str) -> None:
    """Each research question's tables of an experiment under rq=<question>/experiment=<name>/<table>, as CSV."""
    for question, frames in tables.items():
        for name, df in frames.items():
            write_csv(df, f"{path}/rq={question}/experiment={experiment}/{name}")


def evidence_bundle(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a failure evidence report, by name. rows: (run_path, pattern_id, cwe, difficulty, category, reason, tags, persistent)."""
    by = lambda *keys: rows.groupBy(*keys).agg(F.count("*").alias("n"))
    exploded = lambda c, name: rows.select("difficulty", F.explode(c).alias(name)).groupBy(name, "difficulty").agg(F.count("*").alias("n"))
    patterns = rows.groupBy("pattern_id", "cwe").agg(F.count_distinct("run_path").alias("frequency"), F.count("*").alias("occurrences"))
    summary = rows.agg(F.count("*").alias("rows"), F.count_distinct("run_path").alias("runs"), F.count_distinct("pattern_id").alias("patterns"))
    return {
        "runs": rows.drop("tags", "persistent"), "patterns": patterns, "patterns_by_difficulty": by("pattern_id", "difficulty"), "by_cwe": by("cwe"), "by_difficulty": by("difficulty"), "by_category": by("category", "difficulty"), "by_reason": by("reason", "difficulty"),
        "by_tag": exploded("tags", "tag"), "by_persistent_test": exploded("persistent", "test_id"), "summary": summary, "top_patterns": patterns.orderBy(F.desc("frequency"), "pattern_id").limit(20),
    }


def write_bundle(tables: dict[str, DataFrame], path: str, documents: tuple[str, ...] = ("summary", "top_patterns")) -> None:
    """A bundle of tables as CSV, those named in `documents` as JSON."""
    for name, df in tables.items():
        (write_json if name in documents else write_csv)(df, f"{path}/{name}")


def latex_table(df: DataFrame, caption: str, most: int = 500) -> str:
    """A small frame as a LaTeX table; formatting happens on the driver, so rows are bounded."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else (f"{x:.2f}" if isinstance(x, float) else str(x).replace("&", r"\&").replace("_", r"\_").replace("%", r"\%"))
    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows)
    head = " & ".join(cell(c) for c in df.columns)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{head} \\\\ \\hline\n{body}\n\\end{{tabular}}\n\\end{{table}}"
