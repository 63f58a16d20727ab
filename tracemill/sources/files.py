"""Readers of run artefacts: tolerant JSON lines and CSV, whole documents, scanner reports, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as T


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines files found at any depth; lines that are no JSON object are left out."""
    reader = spark.read.schema(f"{schema}, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("recursiveFileLookup", "true")
    return reader.json(path).where("__bad is null").drop("__bad")


def read_documents(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """One row per whole JSON document, with the folder it lies in as run_path."""
    docs = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)
    return docs.withColumn("run_path", F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1))


def read_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """One row per text file: run_path and text."""
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return texts.select(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1).alias("run_path"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, **casts: str) -> DataFrame:
    """All columns as strings, then those named cast; a value that doesn't fit is null."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.withColumns({c: (T.safe_int(F.col(c)) if kind == "bigint" else F.col(c).try_cast(kind)) for c, kind in casts.items()})


def latest_snapshot(files: DataFrame) -> DataFrame:
    """Per experiment its final snapshot, else that of the highest number in its name. files: (experiment, path)."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    version = F.when(name.contains("final"), F.lit(1 << 62)).otherwise(F.coalesce(F.regexp_extract(name, r"(\d+)[^0-9/]*$", 1).try_cast("bigint"), F.lit(-1)))
    return files.groupBy("experiment").agg(F.max_by("path", F.struct(version.alias("v"), "path")).alias("path"))


_SARIF = "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string,properties:struct<tags:array<string>,precision:string,`security-severity`:string>,defaultConfiguration:struct<level:string>>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<region:struct<startLine:int,snippet:struct<text:string>>>>>>>>>"


def level_of(x: Column) -> Column:
    """Report levels as LOW, MEDIUM, HIGH."""
    x = F.upper(F.coalesce(x, F.lit("")))
    return F.when(x.isin("ERROR", "CRITICAL", "HIGH", "VERY-HIGH"), "HIGH").when(x.isin("WARNING", "MEDIUM"), "MEDIUM").when(x.isin("NOTE", "INFO", "LOW", "NONE"), "LOW").otherwise("MEDIUM")


def sarif_findings(reports: DataFrame) -> DataFrame:
    """Findings of SARIF texts (run_id, report): first run's results, joined to that report's rules, first location."""
    run = F.get(F.from_json("report", _SARIF)["runs"], F.lit(0))
    each = reports.select("run_id", run.alias("r")).select("run_id", "r", F.posexplode("r.results").alias("ord", "x"))
    rule = F.get(F.filter("r.tool.driver.rules", lambda q: q["id"] == F.col("x.ruleId")), F.lit(0))
    region = F.get("x.locations", F.lit(0))["physicalLocation"]["region"]
    tags = F.array_join(F.coalesce(rule["properties"]["tags"], F.array().cast("array<string>")), " ")
    return each.select(
        "run_id", "ord", F.col("r.tool.driver.name").alias("tool"), F.col("x.ruleId").alias("test_id"), rule["name"].alias("test_name"), T.cwe_of(F.concat_ws(" ", tags, "x.message.text")).alias("cwe"),
        level_of(F.coalesce("x.level", rule["defaultConfiguration"]["level"])).alias("severity"), level_of(rule["properties"]["precision"]).alias("confidence"), region["startLine"].alias("line"), F.coalesce(region["snippet"]["text"], F.lit("")).alias("code"), F.col("x.message.text").alias("description"),
    )


def scanner_a_findings(reports: DataFrame) -> DataFrame:
    """Findings of flat scanner reports: results with ids, levels and lines at the top."""
    schema = "results array<struct<test_id:string,test_name:string,issue_severity:string,issue_confidence:string,issue_text:string,line_number:int,code:string,issue_cwe:struct<id:int>>>"
    each = reports.select("run_id", F.posexplode(F.from_json("report", schema)["results"]).alias("ord", "x"))
    cwe = F.when(F.col("x.issue_cwe.id") > 0, F.concat(F.lit("CWE-"), F.col("x.issue_cwe.id").cast("string")))
    return each.select("run_id", "ord", F.col("x.test_id").alias("test_id"), F.col("x.test_name").alias("test_name"), cwe.alias("cwe"), F.upper("x.issue_severity").alias("severity"), F.upper("x.issue_confidence").alias("confidence"), F.col("x.line_number").alias("line"), F.col("x.code").alias("code"), F.col("x.issue_text").alias("description"))


def scanner_b_findings(reports: DataFrame, most: int = 800) -> DataFrame:
    """Findings of scanner reports that keep rule data under extra.metadata; code is cut at `most` characters."""
    schema = "results array<struct<check_id:string,start:struct<line:int>,extra:struct<message:string,severity:string,lines:string,metadata:struct<confidence:string,cwe:array<string>>>>>"
    each = reports.select("run_id", F.posexplode(F.from_json("report", schema)["results"]).alias("ord", "x"))
    meta = F.col("x.extra.metadata")
    return each.select("run_id", "ord", F.col("x.check_id").alias("test_id"), T.cwe_of(F.array_join(meta["cwe"], " ")).alias("cwe"), level_of(F.col("x.extra.severity")).alias("severity"), level_of(meta["confidence"]).alias("confidence"), F.col("x.start.line").alias("line"), F.substring(F.coalesce("x.extra.lines", F.lit("")), 1, most).alias("code"), F.col("x.extra.message").alias("description"))


def find_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Folders of experiments below a root, by what lies in them: kind (`phase`, `index`, `result`), folder and phase, from names only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    phase = F.regexp_extract("path", r"^(.*/PHASE_[^/]*)/", 1)
    entry = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("folder"))
    kinds = F.array(entry("phase", F.nullif(phase, F.lit(""))), entry("index", F.when(name == "runs_index.jsonl", folder)), entry("result", F.when(name == "result.json", folder)))
    return files.select(F.explode(kinds).alias("k")).where("k.folder is not null").select("k.kind", "k.folder", F.regexp_extract("k.folder", r"PHASE_([^/]*)", 1).alias("phase")).distinct()


def read_metric_grid(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric documents laid out as model=.../phase=.../run=.../*.json, with these three as columns; the layout prunes what a filter on them leaves out."""
    return spark.read.schema(f"{schema}, model string, phase string, run string").option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A small YAML (or JSON) configuration, read through Spark's file system and parsed on the driver; {} for an empty one."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect())
    try:
        import yaml
    except ModuleNotFoundError:  # JSON is the part of YAML that needs no parser of its own
        import json

        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def config_dimension(spark: SparkSession, config: dict, section: str) -> DataFrame:
    """A section of a configuration (name -> fields) as a table (name, fields: map of strings), to join facts with."""
    rows = [(str(k), {str(f): str(x) for f, x in v.items()} if isinstance(v, dict) else {"value": str(v)}) for k, v in (config.get(section) or {}).items()]
    return spark.createDataFrame(rows, "name string, fields map<string, string>")
