import hashlib
import json

from pyspark.sql import functions as F

from tracemill.functions import python_code as P
from tracemill.functions import texts as T
from tracemill.operators import artefact_tables as A
from tracemill.sources import files, sinks


def test_json_lines_skip_bad(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"run_id": 1, "model": "m"}\nnot json\n[1]\n{"run_id": 2}\n')
    rows = files.read_json_lines(spark, str(tmp_path), "run_id bigint, model string").orderBy("run_id").collect()
    assert [(r.run_id, r.model) for r in rows] == [(1, "m"), (2, None)]


def test_csv_casts_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", ["a"]), (2, None, [])], "b bigint, a string, c array<string>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), b="bigint")
    assert back.columns == ["a", "b", "c"] and sorted(r.b for r in back.collect()) == [1, 2]
    sinks.append_json_lines(df, str(tmp_path / "jl"))
    sinks.append_json_lines(df, str(tmp_path / "jl"))
    assert spark.read.json(str(tmp_path / "jl")).count() == 4
    sinks.write_artefacts({"runs": df}, str(tmp_path / "art"), "b")
    assert spark.read.parquet(str(tmp_path / "art" / "runs")).count() == 2
    assert sinks.source_manifest(spark, str(tmp_path / "jl"), "*.json").count() >= 2
    assert "tabular" in sinks.latex_table(df.select("a", "b"), "x")


def test_latest_snapshot(spark):
    rows = [("e", "/x/tree_2.parquet"), ("e", "/x/tree_10.parquet"), ("f", "/y/tree_99.parquet"), ("f", "/y/tree_final.parquet")]
    found = {r.experiment: r.path for r in files.latest_snapshot(spark.createDataFrame(rows, "experiment string, path string")).collect()}
    assert found == {"e": "/x/tree_10.parquet", "f": "/y/tree_final.parquet"}


def test_scanner_reports(spark):
    sarif = {"runs": [{"tool": {"driver": {"name": "q", "rules": [{"id": "r1", "name": "R", "properties": {"tags": ["external/cwe/cwe-079"], "precision": "high"}}]}}, "results": [{"ruleId": "r1", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"region": {"startLine": 4}}}]}, {"ruleId": "zz", "message": {"text": "CWE-22 here"}, "locations": []}]}]}
    rows = files.sarif_findings(spark.createDataFrame([(1, json.dumps(sarif))], "run_id bigint, report string")).orderBy("ord").collect()
    assert [(r.test_id, r.cwe, r.severity, r.confidence, r.line) for r in rows] == [("r1", "CWE-79", "HIGH", "HIGH", 4), ("zz", "CWE-22", "MEDIUM", "MEDIUM", None)]
    b = {"results": [{"check_id": "c", "start": {"line": 3}, "extra": {"message": "x", "severity": "WARNING", "lines": "z" * 900, "metadata": {"confidence": "LOW", "cwe": ["CWE-89: SQL"]}}}]}
    row = files.scanner_b_findings(spark.createDataFrame([(1, json.dumps(b))], "run_id bigint, report string")).first()
    assert (row.cwe, row.severity, row.confidence, len(row.code)) == ("CWE-89", "MEDIUM", "LOW", 800)
    a = {"results": [{"test_id": "B1", "issue_severity": "high", "issue_confidence": "low", "line_number": 7, "issue_cwe": {"id": 502}}]}
    row = files.scanner_a_findings(spark.createDataFrame([(1, json.dumps(a))], "run_id bigint, report string")).first()
    assert (row.cwe, row.severity, row.line) == ("CWE-502", "HIGH", 7)


def test_code_facts_and_repair(spark):
    code = "import os\ndef f(a, b):\n    if a and b or a:\n        return g(a)\nclass C: pass\n"
    df = spark.createDataFrame([(code,), ("def broken(:",), (None,)], "code string")
    x, y, z = [r.f for r in df.select(P.code_facts("code").alias("f")).collect()]
    assert (x.ok, x.functions, x.classes, x.imports, x.calls, x.cyclomatic) == (True, 1, 1, 1, 1, 4)
    assert not y.ok and y.error.startswith("SyntaxError") and (y.functions, y.cyclomatic, y.called) == (0, 0, []) and z.ok
    tries = "try:\n    with a() as b:\n        x = [i for i in b if i]\nexcept E:\n    assert x\n"
    f = spark.createDataFrame([(tries,)], "c string").select(P.code_facts("c").alias("f")).first().f
    assert (f.cyclomatic, f.control, f.called, f.complexity) == (4, ["Try", "With"], ["a"], 3)
    texts = ['```json\n{"a": 1,}\n```', 'so {"x\\_y": 2} there', "none", None]
    found = [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.repaired_json("t").alias("j")).collect()]
    assert found == ['{"a": 1}', '{"x_y": 2}', None, None]
    row = spark.createDataFrame([("x = eval(y)\npickle.loads(b)",)], "c string").select(P.code_signatures(F.col("c")).alias("s")).first()
    assert row.s == ["eval_exec", "pickle_load"]
    blocks = P.blocks("class A(B):\n    def f(self):\n        return 1\n\n    def test_g(self):\n        pass\nx = 1\ndef h(): pass")
    assert [(k, n) for k, n, _ in blocks] == [("class", "A"), ("function", "f"), ("function", "test_g"), ("function", "h"), ("test", "test_g")] and blocks[0][2].endswith("pass") and blocks[3][2] == "def h(): pass"
    loose = ["<json_payload>{&quot;a&quot;: [1, 2,]}</json_payload>", "{a: 1, b_c: 'x'}", "{'ok': True, 'none': None}", '{"a": 1} trailing }']
    assert [P.repaired(x) for x in loose] == ['{"a": [1, 2]}', '{"a": 1, "b_c": "x"}', '{"none": null, "ok": true}', '{"a": 1}']


def test_text_functions(spark):
    df = spark.createDataFrame([("a\nb\nc\nd", 2, " A#3 ", "x| y||x")], "code string, line int, ref string, p string")
    row = df.select(T.context_window(F.col("code"), F.col("line"), 1).alias("w"), T.duplicate_ref(F.col("ref")).alias("r"), T.pipe_join(T.pipe_split(F.col("p"))).alias("p")).first()
    assert row.w == "      1: a\n>>    2: b\n      3: c" and row.r == "A:3" and row.p == "x|y"


def test_experiments_grids_and_configurations(spark, tmp_path):
    for name, text in {"e1/PHASE_ONE_5/runs_index.jsonl": "{}", "e1/PHASE_ONE_5/r1/result.json": '{"a": 1}', "e2/notes.txt": "x"}.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    found = {(r.kind, r.folder.rsplit("/", 1)[1], r.phase) for r in files.find_experiments(spark, str(tmp_path / "t")).collect()}
    assert found == {("phase", "PHASE_ONE_5", "ONE_5"), ("index", "PHASE_ONE_5", "ONE_5"), ("result", "r1", "ONE_5")}
    for model, run, x in (("a", 1, 0.5), ("a", 2, 1.5), ("b", 1, 4.0)):
        folder = tmp_path / "grid" / f"model={model}" / "phase=1" / f"run={run}"
        folder.mkdir(parents=True)
        (folder / "m.json").write_text('{\n"x": %s}' % x)
    grid = files.read_metric_grid(spark, str(tmp_path / "grid"), "x double")
    assert {r.model: r.m for r in grid.groupBy("model").agg(F.avg("x").alias("m")).collect()} == {"a": 1.0, "b": 4.0}
    (tmp_path / "c.yml").write_text("weights:\n  CWE-79: {name: xss, w: 2}\n  other: 1\n")
    config = files.read_config(spark, str(tmp_path / "c.yml"))
    assert {r.name: r.fields for r in files.config_dimension(spark, config, "weights").collect()} == {"CWE-79": {"name": "xss", "w": "2"}, "other": {"value": "1"}}


def test_run_chains_and_bundles(spark, tmp_path):
    metas = spark.createDataFrame([("r1", "easy"), ("r2", "hard")], "run_path string, difficulty string")
    chain = A.run_chain(metas, spark.createDataFrame([("r1", True)], "run_path string, success boolean"), spark.createDataFrame([("r2", "p")], "run_path string, id string"), metas.where("difficulty = 'none'"))
    assert {r.run_path: (r.result and r.result.success, r.pattern and r.pattern.id, r.failure) for r in chain.collect()} == {"r1": (True, None, None), "r2": (None, "p", None)}
    rows = spark.createDataFrame([("r1", "p", "CWE-1", "easy", "c", "x", ["t", "u"], ["B1"]), ("r1", "p", "CWE-1", "easy", "c", "x", ["t"], []), ("r2", "q", "CWE-2", "hard", "c", "y", [], ["B1"])], "run_path string, pattern_id string, cwe string, difficulty string, category string, reason string, tags array<string>, persistent array<string>")
    bundle = sinks.evidence_bundle(rows)
    sinks.write_bundle(bundle, str(tmp_path / "b"))
    back = {n: spark.read.option("header", "true").csv(str(tmp_path / "b" / n)).count() for n in bundle if n not in ("summary", "top_patterns")}
    assert len(bundle) == 11 and back["runs"] == 3 and back["by_tag"] == 2 and bundle["patterns"].where("pattern_id = 'p'").first().frequency == 1
    sinks.export_by_question({"rq1": {"t": metas}}, str(tmp_path / "q"), "e1")
    assert spark.read.option("header", "true").csv(str(tmp_path / "q" / "rq=rq1" / "experiment=e1" / "t")).count() == 2
    sinks.write_csv(metas, str(tmp_path / "u"), spark.createDataFrame([("r3", 1)], "run_path string, a int"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "u")).columns == ["a", "difficulty", "run_path"]
    sinks.write_csv(metas.where("run_path = ''"), str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).count() == 0
    assert not sinks.write_snapshot(metas, str(tmp_path / "s"), 7) and sinks.write_snapshot(metas, str(tmp_path / "s"), 20) and spark.read.parquet(str(tmp_path / "s")).first().snapshot == 20
    (tmp_path / "src" / "d").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("a")
    (tmp_path / "src" / "d" / "b.py").write_text("b")
    digest, count = sinks.manifest_digest(sinks.source_manifest(spark, str(tmp_path / "src"), "*.py"), str(tmp_path / "src"))
    plain = hashlib.sha256("".join(f"{n}\0{hashlib.sha256(x.encode()).hexdigest()}\n" for n, x in (("a.py", "a"), ("d/b.py", "b"))).encode()).hexdigest()
    assert (digest, count) == (plain, 2)


def test_long_texts_go_to_python_a_few_at_a_time(spark):
    df = spark.createDataFrame([("load(a)",), (None,)], "c string")
    found = df.select(P.code_facts("c").alias("f"), P.code_blocks("c").alias("b")).where("size(f.called) > 0")
    assert [r.f.called for r in found.collect()] == [["load"]]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("facts(") <= 2 and "facts(" in plan
