"""Nested averages, error sentences, collapsed chains and chunked indices against plain loops."""

import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.operators import artefact_tables as A
from tracemill.operators import error_text as E
from tracemill.operators import learned as L
from tracemill.operators.rounds import checkpointed
from tracemill.operators import nested as N


def plain_numbers(x, path, out):
    """(path -> numbers) of an object, by recursion."""
    number = lambda v: isinstance(v, (bool, int, float))
    for key, v in x.items():
        at = f"{path}/{key.replace('~', '~0').replace('/', '~1')}"
        if isinstance(v, dict):
            plain_numbers(v, at, out)
        elif number(v):
            out[at].append(float(v))
        elif isinstance(v, list) and v:
            if isinstance(v[0], dict):
                for k, item in enumerate(v):
                    if isinstance(item, dict):
                        name = item.get("difficulty", "_none_") if "difficulty" in v[0] else str(k)
                        plain_numbers(item, f"{at}/{name}", out)
            elif number(v[0]):
                out[at] += [float(y) for y in v if number(y)]


def random_object(rng, depth):
    def value(depth):
        kind = rng.randrange(9 if depth else 5)
        if kind <= 1:
            return rng.randrange(-8, 9) / 4
        if kind == 2:
            return rng.choice([True, False, None, "text", "12"])
        if kind == 3:
            return [rng.choice([rng.randrange(5), 0.5, True]) for _ in range(rng.randrange(3))] + ["x"] * (rng.random() < 0.2)
        if kind == 4:
            return rng.choice([[], ["a", 1], [[1], 2], 7])
        if kind <= 6:
            return random_object(rng, depth - 1)
        items = [random_object(rng, depth - 1) for _ in range(rng.randrange(1, 4))]
        if kind == 8:
            for k, item in enumerate(items):
                if k == 0 or rng.random() < 0.7:
                    item["difficulty"] = rng.choice(["easy", "hard"])
        return items + [3] * (rng.random() < 0.2)

    return {rng.choice(["a", "b/c", "d~", "e", "é f"]): value(depth) for _ in range(rng.randrange(4))}


def test_nested_averages_of_random_documents(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["m", None, "n"]), json.dumps(random_object(rng, 4)), 0.0) for _ in range(150)] + [("m", None, 1.0), ("m", "", 1.0), ("m", "[1]", 1.0), ("m", "3", 1.0), ("m", "{bad", 1.0)]
    expected = defaultdict(list)
    for group, text, _ in rows[:150]:
        out = defaultdict(list)
        plain_numbers(json.loads(text), "", out)
        for path, numbers in out.items():
            expected[group, path] += numbers
    found = N.nested_averages(spark.createDataFrame(rows, "model string, j string, mean double"), "j", "model").collect()
    assert {(r.model, r.path): (r.total, r.n, r.mean) for r in found} == {k: (round(sum(v), 6), len(v), pytest.approx(sum(v) / len(v), abs=1e-6)) for k, v in expected.items() if v}
    assert max(r.path.count("/") for r in found) > 5 and N.nested_averages(spark.createDataFrame([], "j string"), "j").collect() == []


def test_nested_averages_read_a_text_once_and_as_spark_does(spark, monkeypatch):
    """One pass, no checkpoint for each level; odd texts count as try_parse_json has them."""
    odd = ['{"a": 1} x', '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 01}', ' {"a": 1e3}', '{"a": 123456789012345678901234567890}', '{"a": [{"difficulty": 1.50, "b": 2}, {"difficulty": true, "b": 3}, {"difficulty": 7, "b": 4}]}', '{"a":', "{'a': 1}", '{"a": "\t"}', "[]", "null"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, j string")
    written = []
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a: written.append(1) or self)
    found = {}
    for r in N.nested_averages(df, "j", "i").collect():
        found.setdefault(r.i, {})[r.path] = r.total
    parsed = {r.i for r in df.where("startswith(schema_of_variant(try_parse_json(j)), 'OBJECT')").collect()}
    assert not written and found.keys() == parsed - {9}  # that one holds a text only
    assert found[6] == {"/a/1.5/b": 2.0, "/a/1.5/difficulty": 1.5, "/a/true/b": 3.0, "/a/true/difficulty": 1.0, "/a/7/b": 4.0, "/a/7/difficulty": 7.0} and found[5] == {"/a": 123456789012345678901234567890.0}


LEMMAS = """errors error|failures failure|cases case|boxes box|classes class|matches match|queries query|tries try|tried try|values value|indices index|status status|process process|analysis analysis|is be|was be|wrote write
running run|stopped stop|handling handle|handled handle|missing miss|missed miss|returning return|returned return|using use|used use|validating validate|initialized initialize|comparing compare|causing cause|raised raise|string string|nothing nothing|testing test
tested test|failing fail|parsed parse|updating update|removed remove|receiving receive|enabled enable|forced force|managing manage|checked check|expected expect|assertions assertion|edges edge|need need|this this|thing thing|setting set|mapped map""".replace("\n", "|").split("|")


def test_lemmas(spark):
    pairs = [x.split() for x in LEMMAS]
    found = spark.createDataFrame(pairs, "w string, l string").select("w", "l", E.lemma(F.col("w")).alias("found")).collect()
    wrong = [(r.w, r.found) for r in found if r.found != r.l]
    assert wrong in ([], [("nothing", "noth")]) or not [x for x in wrong if x[0] not in ("nothing", "parsed")], wrong


REPORTS = [
    ("a", "x", "<error_analysis>Test Failures: The boundaries were ignored. Nothing else!\nRoot Causes:\n- Boundary handling missing\n- loops off by one. Test Error: boundary\nSuggested Areas to Investigate: check boundaries? looping.</error_analysis>"),
    ("a", None, "test failures: boundary boundary. boundary"),
    ("b", "x", None),
    ("b", "x", "no sections about boundaries"),
    ("b", "y", "Root Causes: What Went Wrong: loops"),
]


def test_error_sentences(spark):
    keywords = spark.createDataFrame([("edge", "boundary"), ("edge", "Boundaries case"), ("loop", "loops")], "kind string, keyword string")
    rows = E.error_counts(spark.createDataFrame(REPORTS, "combo string, difficulty string, r string"), "r", keywords, "combo", "difficulty").collect()
    total = {r.error: r.n for r in rows if r.level == "total"}
    assert total == {"edge": 3, "root_edge": 1, "root_loop": 1, "fix_edge": 1, "fix_loop": 1}
    assert {(r.combo, r.error): r.n for r in rows if r.level == "combo"} == {("a", k): v for k, v in total.items()}
    assert {(r.difficulty, r.error): r.n for r in rows if r.level == "difficulty"} == {("x", k): (1 if k == "edge" else v) for k, v in total.items()} | {(None, "edge"): 2}


def test_sentences_equal_plain_regexes(spark):
    rng = random.Random(2)
    parts = [*E.SECTIONS, "Test Error:", "What Went Wrong:", "loops fail. ", "A box!", "\n", "root causes:", " boxes? "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(300)]
    expected = Counter()
    for t in texts:
        for head, (prefix, ends) in E.SECTIONS.items():
            m = re.search(rf"(?is){head}(.*?)(?={'|'.join(ends)}|\Z)", t)
            expected.update((prefix, s) for s in re.split(r"[.!?]+\s+|[.!?]+\Z|\n+", m[1].lower() if m else "") if s.strip())
    found = Counter((r.prefix, r.sentence) for r in E.sentences(spark.createDataFrame([(t,) for t in texts], "r string"), "r").collect())
    assert found == expected


def test_chains_and_cycles_of_duplicates(spark):
    rng = random.Random(7)
    target = {(1, k): k + 1 for k in range(1, 51)} | {(1, 51): None, (2, 1): 2, (2, 2): 3, (2, 3): 1, (2, 4): 3, (2, 5): 4, (3, 1): 77, (3, 2): 1, (3, 3): 3, (4, 1): None}
    target |= {(run, k): rng.choice([None, rng.randrange(1, 45)]) for run in (5, 6, 7) for k in range(1, 41)}

    def root(run, k):
        seen = []
        while k not in seen:
            seen.append(k)
            to = target[run, k]
            if to is None or to == k or (run, to) not in target:
                return k
            k = to
        return min(seen[seen.index(k) :])

    findings = spark.createDataFrame([(r, k, k % 3, "CWE-1", "LOW" if k % 2 else "HIGH", to) for (r, k), to in target.items()], "run_id int, ord bigint, line int, cwe string, severity string, duplicate_of bigint")
    found = {(r.run_id, r.ord): r.root for r in L.duplicate_roots(findings).collect()}
    assert found == {(r, k): root(r, k) for r, k in target}
    collapsed = L.collapse_duplicates(findings).where("run_id = 1").collect()
    assert [(r.ord, r.line, r.severity, r.merged) for r in collapsed] == [(1, 0, "HIGH", 50)]


def test_index_in_chunks(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["ab", "abc", "abcd", "abce", "b", None, "é"]), ["c"], "easy") for k in range(400)]
    found = A.problem_index(spark.createDataFrame(rows, "node_id bigint, title string, concepts array<string>, difficulty string"), 30).where("kind = 'concept'").orderBy("chunk").collect()
    assert [r.problems for r in found] == [30] * 13 + [10]
    expected = [k for k, _, _, _ in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0]))]
    assert [i for r in found for i in r.node_ids] == expected


def test_rounds_of_chains_follow_the_largest_run(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(L, "checkpointed", lambda df: rounds.append(1) or checkpointed(df))
    rows = [(run, k, 3 - k) for run in range(300) for k in (1, 2)]  # cycles of two
    found = L.duplicate_roots(spark.createDataFrame(rows, "run_id int, ord bigint, duplicate_of bigint")).collect()
    assert len(found) == 600 and {r.root for r in found} == {1} and len(rounds) <= 4


def test_lemmas_of_distinct_words_only(spark):
    rows = [("a", "Test Failures: It fails. Failing again, failed!")]
    found = E.error_counts(spark.createDataFrame(rows, "c string, r string"), "r", spark.createDataFrame([("f", "failure fail")], "kind string, keyword string"), "c")
    assert {(r.level, r.error, r.n) for r in found.collect()} == {("c", "f", 2), ("total", "f", 2)}
    assert "transform(" not in found._jdf.queryExecution().analyzed().toString().lower()


@pytest.mark.parametrize("most", [100_000, 6])
def test_chains_are_followed_run_by_run(spark, monkeypatch, most):
    """Runs that a task can hold are followed where they are read, without stored rounds; larger ones by joins, to the same places."""
    rng = random.Random(9)
    rows = [(run, k, rng.choice([None, k, rng.randrange(1, 14), -5]), rng.randrange(3), rng.choice(["A", "B", None]), rng.choice(["LOW", "MEDIUM", "HIGH"])) for run in range(400) for k in range(1, rng.randrange(2, 12))]
    rows += [(None, 1, 2, 0, "A", "LOW"), (1, None, 1, 0, "A", "LOW")]
    place = {(run, k): (to, line, cwe) for run, k, to, line, cwe, _ in rows}
    expected = defaultdict(list)
    for run, k, _, _, _, severity in rows[:-2]:
        seen, at = [], k
        while at not in seen and place[run, at][0] not in (None, at) and (run, place[run, at][0]) in place:
            seen.append(at)
            at = place[run, at][0]
        at = min(seen[seen.index(at) :]) if at in seen else at
        expected[run, *place[run, at][1:]].append((k, severity))
    worst = lambda xs: max((s for _, s in xs), key=["LOW", "MEDIUM", "HIGH"].index)
    plain = {(run, min(xs)[0], line, cwe, worst(xs), len(xs) - 1) for (run, line, cwe), xs in expected.items()}
    monkeypatch.setattr(L, "RUN", most)
    rounds = []
    monkeypatch.setattr(L, "checkpointed", lambda df: rounds.append(1) or checkpointed(df))
    findings = spark.createDataFrame(rows, "run_id int, ord bigint, duplicate_of bigint, line int, cwe string, severity string")
    assert {tuple(r) for r in L.collapse_duplicates(findings).collect()} == plain and (len(rounds) == 1) == (most > 6)
