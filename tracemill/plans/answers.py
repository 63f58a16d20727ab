"""Queries on generated code, judge payloads, validation reports and scenario texts, with their oracles."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import python_code as P
from ..functions import texts as T
from ..operators import artefact_tables as A
from ..operators import error_text as E
from ..operators import nested as N
from ..sources import surrogate as src

QUERIES, ORACLES = {}, {}


def query(name, sql=""):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


_WORDS = "w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[a-z]{2,}'), lambda w: 'f_' || w) AS w FROM documents)"


def programs(spark, d):
    """Documents as programs: every word of a text is one statement, whose kind follows from its length."""
    forms = [("f_", "(1)"), ("import f_", ""), ("if f_", ": pass"), ("def f_", "(): pass"), ("x = a and f_", " and c"), ("class f_", ": pass")]

    def statement(w):  # a choice, so that one of the six is made for a word
        made = [F.concat(F.lit(head), w, F.lit(tail)) for head, tail in forms]
        kind = F.length(w) % len(forms)
        return functools.reduce(lambda rest, k: F.when(kind == k, made[k]).otherwise(rest), range(len(forms) - 1), made[-1])

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{2,}"), F.lit(0))
    code = F.array_join(F.transform(words, statement), "\n")
    return src.table(spark, d, "documents").select("doc_id", code.alias("code"))


@query("code_facts_of_documents", f"WITH {_WORDS}, k AS (SELECT doc_id, list_transform(w, lambda x: (length(x) - 2) % 6) AS k, w FROM w) SELECT doc_id, true AS ok, CAST(len(list_filter(k, lambda x: x = 3)) AS INT) AS functions, CAST(len(list_filter(k, lambda x: x = 5)) AS INT) AS classes, CAST(len(list_filter(k, lambda x: x = 1)) AS INT) AS imports, CAST(len(list_filter(k, lambda x: x = 0)) AS INT) AS calls, CAST(1 + len(list_filter(k, lambda x: x = 2)) + 2 * len(list_filter(k, lambda x: x = 4)) AS INT) AS cyclomatic, CAST(len(list_distinct(list_filter(w, lambda x: (length(x) - 2) % 6 = 0))) + CASE WHEN list_contains(k, 2) THEN 1 ELSE 0 END AS INT) AS complexity FROM k")
def _(spark, d):
    f = programs(spark, d).select("doc_id", P.code_facts(F.col("code")).alias("f"))
    return f.select("doc_id", "f.ok", "f.functions", "f.classes", "f.imports", "f.calls", "f.cyclomatic", "f.complexity")


@query("code_pattern_ids", f"WITH {_WORDS}, c AS (SELECT doc_id, list_sort(list_distinct(list_concat(['load', 'system'], list_filter(w, lambda x: (length(x) - 2) % 6 = 0)))) AS c FROM w) SELECT doc_id, substr(sha256('CWE-' || (20 + doc_id % 25) || '_' || c[1] || '_' || c[2] || '_' || c[3] || '_os_system_pickle_load'), 1, 16) AS pattern_id FROM c WHERE len(c) >= 3")
def _(spark, d):
    code = F.concat(F.lit("import os, pickle\nos.system(a)\npickle.load(b)\n"), "code")
    facts = programs(spark, d).select("doc_id", P.code_facts(code)["called"].alias("called"), P.code_signatures(code).alias("signatures"))
    cwe = F.concat(F.lit("cwe-"), (20 + F.col("doc_id") % 25).cast("string"))
    return facts.where(F.size("called") >= 3).select("doc_id", P.pattern_id(cwe, F.col("called"), F.col("signatures")).alias("pattern_id"))


@query("code_blocks_of_documents", f"WITH {_WORDS} SELECT doc_id, len(list_filter(w, lambda x: (length(x) - 2) % 6 = 3)) AS functions, len(list_filter(w, lambda x: (length(x) - 2) % 6 = 5)) AS classes, coalesce(list_filter(w, lambda x: (length(x) - 2) % 6 = 3)[1], '') AS first FROM w")
def _(spark, d):
    b = programs(spark, d).select("doc_id", P.code_blocks(F.col("code")).alias("b"))
    of = lambda kind: F.filter("b", lambda x: x["kind"] == kind)
    return b.select("doc_id", F.size(of("function")).cast("bigint").alias("functions"), F.size(of("class")).cast("bigint").alias("classes"), F.coalesce(F.get(of("function"), F.lit(0))["name"], F.lit("")).alias("first"))


@query("answer_solutions", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'x = 1' WHEN 1 THEN 'y = ' || o_orderkey WHEN 2 THEN 'z = 2' WHEN 3 THEN 'w = ' || o_orderkey ELSE '' END AS solution FROM orders")
def _(spark, d):
    o = src.table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    kinds = F.array(
        F.lit("Here: <generated_solution>\nx = 1\n</generated_solution> ```python\nno\n```"), F.concat(F.lit("So\n```python\ny = "), key, F.lit("\n```")), F.lit("So\n```\nz = 2\n``` done"), F.concat(F.lit("w = "), key), F.lit("I can't do that")
    )
    return o.select(F.col("o_orderkey").alias("id"), P.solution(F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("solution"))


@query("prefixed_test_ids", f"WITH {src.FINDINGS} SELECT run_id, attempt, part, supp, tool || ':' || CASE WHEN part % 3 = 0 THEN test_id WHEN part % 3 = 1 THEN 'name' || supp ELSE 'issue-' || attempt END AS id FROM findings")
def _(spark, d):
    f = src.findings(spark, d)
    raw = F.when(F.col("part") % 6 == 0, F.concat("tool", F.lit(":"), "test_id")).when(F.col("part") % 3 == 0, F.concat(F.lit(" "), "test_id"))
    name = F.when(F.col("part") % 3 == 1, F.concat(F.lit("name"), F.col("supp").cast("string"))).otherwise(" ")
    return f.select("run_id", "attempt", "part", "supp", T.prefixed_id(F.col("tool"), raw, name, F.col("attempt")).alias("id"))


@query("focus_lines", f"WITH {src.FINDINGS} SELECT run_id, attempt, part, supp, CASE WHEN part % 2 = 0 THEN 'use( x, ' || line || ' )' ELSE 'last one' END AS focus FROM findings")
def _(spark, d):
    f = src.findings(spark, d)
    code = F.concat(F.lit("  "), (F.col("line") - 1).cast("string"), F.lit("  before\n\n "), F.col("line").cast("string"), F.lit("   use( x,   "), F.col("line").cast("string"), F.lit(" )\n"), F.lit("9999 last   one  \n"))
    asked = F.when(F.col("part") % 2 == 0, F.col("line")).otherwise(F.lit(-1))
    return f.select("run_id", "attempt", "part", "supp", T.focus_line(code, asked).alias("focus"))


@query("scenario_titles", f"WITH {src.RUNS} SELECT run_id, CASE WHEN run_id % 4 = 0 THEN '' ELSE 'Case ' || run_id END AS title, 'Text of ' || run_id || chr(10) || 'Level of care: high' AS bare, CASE WHEN run_id % 4 = 0 THEN '' ELSE '## Case ' || run_id || chr(10) END || 'Text of ' || run_id || chr(10) || 'Level of care: high' AS kept FROM runs")
def _(spark, d):
    r = src.runs(spark, d)
    key = F.col("run_id").cast("string")
    text = F.concat(F.lit("Attack surface: X\r\n"), F.when(F.col("run_id") % 4 == 0, "").otherwise(F.concat(F.lit("## Case "), key, F.lit("\n"))), F.lit("  difficulty: hard\nText of "), key, F.lit("\nLevel of care: high\nlevel: 3\n"))
    return r.select("run_id", T.title(text).alias("title"), T.unlabelled(text, True).alias("bare"), T.unlabelled(text).alias("kept"))


@query("word_normalisation", "SELECT o_orderkey AS id, ['TP','FP','UNCERTAIN',NULL][o_orderkey % 4 + 1] AS verdict, [true,false,NULL][o_orderkey % 3 + 1] AS flag, ['contextualized','natural','invalid','unknown','unknown'][o_orderkey % 5 + 1] AS kind FROM orders")
def _(spark, d):
    o = src.table(spark, d, "orders")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), T.verdict(pick(" true-positive", "False Positive", "maybe", "other")).alias("verdict"), T.yes_no(pick(" Yes", "NOT  credible", "perhaps")).alias("flag"), T.pair_kind(pick("Context_bound", "a direct one", "rejected", "  ", "else")).alias("kind"))


@query(
    "judge_payloads",
    f"WITH {src.RUNS}, x AS (SELECT run_id, CASE WHEN run_id % 7 = 0 THEN NULL ELSE (run_id % 11) / 8e0 END AS s, target_cwe, run_id % 3 AS k FROM runs), y AS (SELECT *, CASE WHEN s IS NULL THEN 0.5e0 ELSE least(s, 1e0) END AS sec FROM x), z AS (SELECT *, 1 - sec AS risk, CASE k WHEN 0 THEN 0.125e0 WHEN 1 THEN 0.75e0 ELSE 1 - sec END AS target FROM y) SELECT run_id, sec AS security_score, risk AS overall_risk, target AS target_risk, CASE WHEN run_id % 13 = 0 THEN true ELSE sec >= 0.8e0 AND risk <= 0.2e0 AND target <= 0.2e0 END AS is_secure, 'B1:7:FP' AS review FROM z",
)
def _(spark, d):
    r = src.runs(spark, d)
    k, score = F.col("run_id") % 3, ((F.col("run_id") % 11) / 8.0).cast("string")
    fields = [
        F.when(F.col("run_id") % 7 != 0, F.concat(F.lit('"security_score": '), score)), F.when(k == 0, F.concat(F.lit('"target_cwe_risk": {"'), "target_cwe", F.lit('": 0.125, "CWE-1": 0.875}'))).when(k == 1, F.lit('"target_cwe_risk": {"CWE-2": 0.75, "CWE-1": 0.5}')),
        F.when(F.col("run_id") % 13 == 0, F.lit('"is_secure": "yes"')), F.lit('"sast_review": [{"classification": "false positive", "bandit_test_id": "B1", "line_number": "7", "duplicate_of": "B2#3"}]'),
    ]
    strict = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    loose = F.concat(F.lit("Verdict:\n```json\n{"), F.concat_ws(", ", *fields), F.lit(",}\n```"))
    found = A.judge_payloads(r.select("run_id", "target_cwe", F.when(F.col("run_id") % 2 == 0, strict).otherwise(loose).alias("payload")), F.array("target_cwe"))
    first = F.get("reviews", F.lit(0))
    return found.select("run_id", "security_score", "overall_risk", "target_risk", "is_secure", F.concat_ws(":", first["test_id"], first["line"].cast("string"), first["verdict"]).alias("review"))


@query("solution_pattern_counts", f"WITH {src.RUNS}, t AS (SELECT difficulty, 'main_strategy' AS category, 'S' || (run_id % 4) AS pattern FROM runs WHERE run_id % 4 <> 3 UNION ALL SELECT difficulty, 'technique', unnest(concepts) FROM runs UNION ALL SELECT difficulty, 'data_structure', 'D' || (node_id % 3) FROM runs) SELECT difficulty, category, pattern, count(*) AS n FROM t GROUP BY ALL")
def _(spark, d):
    r = src.runs(spark, d)
    main = F.when(F.col("run_id") % 4 == 3, "").otherwise(F.concat(F.lit("S"), (F.col("run_id") % 4).cast("string")))
    return A.solution_patterns(r.select("difficulty", main.alias("main_strategy"), F.col("concepts").alias("techniques"), F.array(F.concat(F.lit("D"), (F.col("node_id") % 3).cast("string"))).alias("structures")), "difficulty")


@query("validation_issue_counts", f"WITH {src.RUNS}, x AS (SELECT difficulty, run_id % 3 AS a, run_id % 4 AS b, run_id % 2 AS c FROM runs) SELECT difficulty, unnest(['missing_boundary','incorrect_expected','total_suggestions']) AS issue, unnest([sum(a), sum(b), sum(c + 1)]::BIGINT[]) AS n FROM x GROUP BY 1")
def _(spark, d):
    r = src.runs(spark, d)
    times = lambda word, k: F.repeat(F.lit(word), (F.col("run_id") % k).cast("int"))
    text = F.concat(F.lit("1. Missing Test Scenarios:\n"), times("a Boundary case. ", 3), F.lit("\n2. Incorrect Assertions:\n"), times("wrong expected value. ", 4), F.lit("\n3. Suggestions for Improving Test Coverage:\nboundary "), times("- more ", 2), F.lit("- last"))
    return A.validation_issues(r.select("difficulty", text.alias("text")), {"missing": {"boundary": "boundary"}, "incorrect": {"expected": r"expected\s+value"}}, "difficulty")


@query("run_results", f"WITH {src.RUNS} SELECT run_id FROM runs WHERE run_id % 3 <> 0 OR run_id % 5 = 1")
def _(spark, d):
    r = src.runs(spark, d).select("run_id", F.when(F.col("run_id") % 3 != 0, "scan").alias("sast"), F.when(F.col("run_id") % 5 == 1, 4).alias("total_issues"))
    return r.where(A.is_run_result(r.columns)).select("run_id")


@query("deep_concepts", f"WITH {src.RUNS} SELECT concept, depth, count(*) AS n FROM (SELECT unnest(concepts) AS concept, CAST(attempts AS INT) AS depth FROM runs) WHERE depth > 1 GROUP BY 1, 2")
def _(spark, d):
    cells = src.runs(spark, d).select(F.explode("concepts").alias("concept"), F.col("attempts").alias("depth")).groupBy("concept", "depth").agg(F.count("*").alias("n"))
    return A.deep_concepts(cells)


@query("plain_error_kinds", f"WITH {src.RUNS} SELECT kind, count(*) AS n FROM (SELECT ['fix_a','root_b','logic','prefix_c','fixed'][run_id % 5 + 1] AS kind FROM runs) WHERE kind IN ('logic', 'prefix_c', 'fixed') GROUP BY 1")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("fix_a", "root_b", "logic", "prefix_c", "fixed"))), (F.col("run_id") % 5 + 1).cast("int"))
    return A.without_prefixes(src.runs(spark, d).select(kind.alias("kind")), "kind").groupBy("kind").agg(F.count("*").alias("n"))


@query("problem_index", f"WITH {src.RUNS}, x AS (SELECT DISTINCT node_id, 'N' || (node_id % 10) AS title, 'C' || (node_id % 7) AS a, ['easy','hard'][node_id % 2 + 1] AS difficulty FROM runs), k AS (SELECT node_id, title, 'concept' AS kind, a AS key FROM x UNION ALL SELECT node_id, title, 'concept', 'X' FROM x UNION ALL SELECT node_id, title, 'difficulty', difficulty FROM x UNION ALL SELECT node_id, title, 'combination', a || '+X' FROM x), p AS (SELECT *, (row_number() OVER (PARTITION BY kind, key ORDER BY title, node_id) - 1) // 100 AS chunk FROM k) SELECT kind, key, chunk, count(*) AS problems, list(node_id ORDER BY title, node_id) AS node_ids FROM p GROUP BY 1, 2, 3")
def _(spark, d):
    n = src.runs(spark, d).select("node_id").distinct()
    level = F.when(F.col("node_id") % 2 == 0, "easy").otherwise("hard")
    concepts = F.array(F.lit("X"), F.concat(F.lit("C"), (F.col("node_id") % 7).cast("string")))
    return A.problem_index(n.select("node_id", F.concat(F.lit("N"), (F.col("node_id") % 10).cast("string")).alias("title"), concepts.alias("concepts"), level.alias("difficulty")), 100)


@query("shared_concepts", f"WITH {src.RUNS} SELECT concept, array_to_string(list_sort(list_distinct(list(model))), '|') AS groups FROM (SELECT model, unnest(concepts) AS concept FROM runs) GROUP BY 1")
def _(spark, d):
    return A.shared_concepts(src.runs(spark, d), "model")


@query("challenging_combinations", f"WITH {src.RUNS} SELECT array_to_string(concepts, '+') AS combo, difficulty, round(avg(1 - functionality), 6) AS score, count(*) AS count FROM runs GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 15")
def _(spark, d):
    return A.challenging(src.runs(spark, d).withColumn("challenge", 1 - F.col("functionality")), 15)


_SAID = "CASE run_id % 7 WHEN 1 THEN 'calls \"' || target_cwe || '\", then \"run\" twice' WHEN 2 THEN 'it''s ' || model ELSE 'seen in ' || surface END"


@query("loose_payloads", f"WITH {src.RUNS} SELECT run_id, target_cwe AS verdict, attempts / 4e0 AS score, {_SAID} AS evidence, success AS secure, array_to_string(concepts, '+') AS tags FROM runs")
def _(spark, d):
    """Payloads in seven shapes: strict, with unescaped quotations, as Python, as block YAML, fenced with bare keys, tagged and escaped, and in prose."""
    k = F.col("run_id") % 7
    said = F.when(k == 1, F.concat(F.lit('calls "'), "target_cwe", F.lit('", then "run" twice'))).when(k == 2, F.concat(F.lit("it's "), "model")).otherwise(F.concat(F.lit("seen in "), "surface"))
    score, secure = (F.col("attempts") / 4.0).cast("string"), F.col("success").cast("string")
    listed = lambda q: F.concat(F.lit("["), F.array_join(F.transform("concepts", lambda c: F.concat(F.lit(q), c, F.lit(q))), ", "), F.lit("]"))
    put = lambda form, *xs: F.format_string(form, *xs)
    strict = put('{"verdict": "%s", "score": %s, "evidence": "%s", "secure": %s, "tags": %s}', "target_cwe", score, said, secure, listed('"'))
    python = put("{'verdict': '%s', 'score': %s, 'evidence': '%s', 'secure': %s, 'tags': %s,}", "target_cwe", score, F.replace(said, F.lit("'"), F.lit("''")), F.initcap(secure), listed("'"))
    block = put("verdict: %s\nscore: %s  # of one\nevidence: >-\n  %s\nsecure: %s\ntags:\n%s\n", "target_cwe", score, said, F.when(F.col("success"), "yes").otherwise("no"), F.array_join(F.transform("concepts", lambda c: F.concat(F.lit("- "), c)), "\n"))
    bare = put('```json\n{verdict: %s, score: %s, evidence: "%s", secure: %s, tags: %s, }\n```', "target_cwe", score, said, secure, listed(""))
    tagged = F.concat(F.lit("I think.\n<judge\\_result>"), F.replace(strict, F.lit('"'), F.lit("&quot;")), F.lit("</judge\\_result> So it is."))
    prose = F.concat(F.lit("The set {x; y} aside: "), strict, F.lit(" Done."))
    text = F.when(k == 2, python).when(k == 3, block).when(k == 4, bare).when(k == 5, tagged).when(k == 6, prose).otherwise(strict)
    found = src.runs(spark, d).select("run_id", F.from_json(P.repaired_json(text), "verdict string, score double, evidence string, secure boolean, tags array<string>").alias("j"))
    return found.select("run_id", "j.verdict", "j.score", "j.evidence", "j.secure", F.array_join("j.tags", "+").alias("tags"))


_NESTED = (
    "json_object('run', json_object('attempts', attempts, 'ok', success, 'risk', judge_risk, 'name', model, 'deep', json_object('a/b', json_object('x~', CAST(value AS DOUBLE) / 4, 'none', NULL))), "
    "'levels', json_array(json_object('difficulty', difficulty, 'rate', functionality, 'at', json_object('loc', loc)), json_object('rate', attempts)), "
    "'steps', json_array(json_object('k', loc, 'more', json_array(1, attempts, phase)), json_object('k', cyclomatic)), 'series', json_array(attempts, loc, functionality), 'words', json_array('a', 1), 'empty', json_array())"
)
_NUMERIC = "('UBIGINT', 'BIGINT', 'DOUBLE')"


@query(
    "nested_metrics",
    f"WITH RECURSIVE {src.RUNS}, t AS (SELECT model, '' AS path, {_NESTED}::JSON AS v FROM runs UNION ALL SELECT t.model, t.path || '/' || replace(replace(CASE WHEN json_type(t.v) = 'ARRAY' AND json_exists(t.v, '$[0].difficulty') THEN coalesce(e.value ->> 'difficulty', '_none_') ELSE e.key END, '~', '~0'), '/', '~1'), e.value FROM t, json_each(t.v) e"
    " WHERE json_type(t.v) = 'OBJECT' OR json_type(t.v) = 'ARRAY' AND json_type(t.v, '$[0]') = 'OBJECT' AND json_type(e.value) = 'OBJECT'), "
    f"n AS (SELECT model, path, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN CASE WHEN json_type(v, '$[0]') IN {_NUMERIC} THEN v::DOUBLE[] END WHEN json_type(v) = 'BOOLEAN' THEN [CASE WHEN v::BOOLEAN THEN 1e0 ELSE 0e0 END] WHEN json_type(v) IN {_NUMERIC} THEN [v::DOUBLE] END) AS x FROM t)"
    " SELECT model, path, round(sum(x) / count(x), 6) AS mean, round(sum(x), 6) AS total, count(x) AS n FROM n GROUP BY 1, 2",
)
def _(spark, d):
    r = src.runs(spark, d)
    c = F.col
    deep = F.struct(F.struct((c("value").cast("double") / 4).alias("x~"), F.lit(None).cast("int").alias("none")).alias("a/b"))
    run = F.struct("attempts", c("success").alias("ok"), c("judge_risk").alias("risk"), c("model").alias("name"), deep.alias("deep"))
    listed = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *map(F.to_json, xs)), F.lit("]"))
    levels = listed(F.struct("difficulty", c("functionality").alias("rate"), F.struct("loc").alias("at")), F.struct(c("attempts").alias("rate")))
    steps = listed(F.struct(c("loc").alias("k"), F.array(F.lit(1), "attempts", "phase").alias("more")), F.struct(c("cyclomatic").alias("k")))
    series = F.array(c("attempts").cast("double"), c("loc").cast("double"), "functionality")
    text = F.concat(F.lit('{"run":'), F.to_json(run), F.lit(',"levels":'), levels, F.lit(',"steps":'), steps, F.lit(',"series":'), F.to_json(series), F.lit(',"words":["a",1],"empty":[]}'))
    return N.nested_averages(r.select("model", text.alias("j")), "j", "model")


#: Kinds and keywords that stand for those of a table of error kinds.
_KINDS = [("naming", "identifier words"), ("naming", "called"), ("joint", "and the"), ("other", "contents"), ("other", "testing"), ("place", "in")]
_THIRDS = "SELECT lang, source, 'Test Failures:' || substr(text, 1, length(text) // 3) || ' Root Causes: ' || substr(text, length(text) // 3 + 1, length(text) // 3) || ' Suggested Areas to Investigate: ' || substr(text, 2 * (length(text) // 3) + 1) AS r FROM documents"
_BODIES = ", ".join(f"regexp_extract(r, '(?is){head}(.*?)(?:{'|'.join(ends)}|\\z)', 1)" for head, (_, ends) in E.SECTIONS.items())


@query(
    "error_sentences",
    f"WITH d AS ({_THIRDS}), s AS (SELECT lang, source, unnest(['', 'root_', 'fix_']) AS prefix, unnest([{_BODIES}]) AS body FROM d), "
    f"p AS (SELECT row_number() OVER () AS id, * FROM (SELECT lang, source, prefix, unnest(regexp_split_to_array(lower(body), '{E.SENTENCE_END}')) AS sentence FROM s) WHERE trim(sentence) <> ''), w AS (SELECT DISTINCT id, lang, source, prefix, unnest(regexp_extract_all(sentence, '[a-z]+')) AS w FROM p), "
    f"u AS (SELECT w, {E.lemma_sql('w')} AS lemma FROM (SELECT DISTINCT w FROM w)), k AS (SELECT DISTINCT kind, {E.lemma_sql('w')} AS lemma FROM (SELECT kind, unnest(regexp_extract_all(keyword, '[a-z]+')) AS w FROM (VALUES {', '.join(map(str, _KINDS))}) t(kind, keyword))), "
    "h AS (SELECT DISTINCT id, lang, source, prefix || kind AS error FROM w JOIN u USING (w) JOIN k USING (lemma)) "
    "SELECT 'lang' AS level, lang, NULL AS source, error, count(*) AS n FROM h GROUP BY lang, error UNION ALL SELECT 'source', NULL, source, error, count(*) FROM h GROUP BY source, error UNION ALL SELECT 'total', NULL, NULL, error, count(*) FROM h GROUP BY error",
)
def _(spark, d):
    third = F.floor(F.length("text") / 3).cast("int")
    text = F.concat(F.lit("Test Failures:"), F.substr("text", F.lit(1), third), F.lit(" Root Causes: "), F.substr("text", third + 1, third), F.lit(" Suggested Areas to Investigate: "), F.substr("text", 2 * third + 1, F.length("text")))
    reports = src.table(spark, d, "documents").select("lang", "source", text.alias("r"))
    return E.error_counts(reports, "r", spark.createDataFrame(_KINDS, "kind string, keyword string"), "lang", "source")
