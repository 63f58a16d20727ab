"""Queries on generated code against their SQL, on words that end in keywords and on repeated and broken statements."""

import random
import re

import duckdb
import pytest

from pyspark.sql import functions as F

from tracemill import catalog
from tracemill.functions import python_code as P


def test_a_head_is_a_word_of_its_line():
    assert P.blocks("import f_aaaadef\nif f_x: pass\nimport f_aaclass\ndef f_y(): pass") == [("function", "f_y", "def f_y(): pass")]
    assert [b[:2] for b in P.blocks("async def f(): pass\n  class\tB:\n    x")] == [("class", "B"), ("function", "f")]
    assert P.blocks("class A:\n  def f(x):\n    y\n\n  z\nq")[0][2] == "class A:\n  def f(x):\n    y\n\n  z"


@pytest.mark.parametrize("name", ["code_blocks_of_documents", "code_facts_of_documents", "code_pattern_ids"])
def test_words_that_end_in_keywords(spark, tmp_path, name):
    rng = random.Random(3)
    words = ["aaaadef", "aaclass", "abcdefgh", "abc", "abcde", "abcd", "abcdef", "def", "class", "aaaaaaaaaadef", "subclass", "pass", "xdef"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(200)] + ["", None, "aaaadef abcdefgh", "aaaadef abc", "aaclass abcde"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(catalog.ORACLES[name])
    at = [[x[0] for x in cursor.description].index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in cursor.fetchall())


def test_facts_of_lines_are_the_facts_of_the_text(monkeypatch):
    """Repeated statements are parsed once; texts that a line can't stand for are parsed whole, with the same facts and errors."""
    rng = random.Random(8)
    lines = ["x = 1", "f(a)", "if x: pass", "else: pass", "  y", "try: pass", "except E: pass", "@dec", "def f(): pass", "x = (1,", "2)", "'''", "# c", "", "x = 1 \\", "from a import b", "import c.d, e", "while 1: q.r()", "with o() as p: s()", "x=1\relse: 1", "if a:\r  b", "\ufeffx", "\x00", "a and b and c", "\ud800", "match x:"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 5))) for _ in range(4000)]
    by_lines = [P.facts(t) for t in texts]
    monkeypatch.setattr(P, "_by_lines", lambda code: None)
    assert by_lines == [P.facts(t) for t in texts] and 500 < sum(f[0] for f in by_lines) < 3500
    monkeypatch.undo()
    seen, parse = [], P._parsed
    monkeypatch.setattr(P, "_parsed", lambda code: seen.append(code) or parse(code))
    assert [P.facts("\n".join(["one_call(1)", f"other_{k % 3}(2)"] * 9))[5] for k in range(50)] == [18] * 50 and len(seen) <= 4


def test_signatures_by_case_and_place(spark):
    texts = ["EVAL (x)", "Pickle.Loads (b)", "pickle . load(b)", "yaml.load(x)", "subprocess.run(\nshell = True)", "tarfile.open(x).extractall (", "zipfile.Z(y).EXTRACTALL(", "ET.fromstring(x) etree.fromstring(y)", "select a \\.format", "İnsert x \\x%", None, ""]
    found = [r.s for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", P.code_signatures(F.col("t")).alias("s")).sort("k").collect()]
    plain = [sorted(n for n, p in P.SIGNATURES.items() if P._compiles(p) and re.search(f"(?im){p}", t or "", re.ASCII)) for t in texts]
    assert found == plain and found[0] == ["eval_exec"] and found[8] == ["sql_string_format"]
