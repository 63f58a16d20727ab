"""The pipeline's stages against brute force on the smallest tables."""

import random
import re

import pyarrow as pa

import corpus_pipeline as P
from tracemill.llm import bpe, decontaminate, queries, secret_scan

from .test_corpus_operators import brute_components, shingle_set
from .test_map_operators import _digest

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    kept = {r.doc_id for r in queries.op6_quality_rules(spark, FOLDER).where("kept").collect()}
    texts = {i: t for i, t in docs.items() if i in kept}
    texts = {i: texts[i] for i, (_, c) in brute_components(texts, 80, 5).items() if i == c}
    plain = lambda t: re.sub(r"[^\w]+|_", " ", t.lower()).strip()
    passages = [plain(r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    exact = {i for i, t in texts.items() if any(p in plain(t) for p in passages)}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    rows = {r.doc_id: tuple(r) for r in P.run(spark, FOLDER).collect()}
    x = decontaminate.index([None] * len(passages), passages)
    held = {i for i, t in texts.items() if decontaminate.matches(pa.array([t or ""]), x)}
    assert exact and exact <= held and rows.keys() == set(texts) - held
    for i, row in rows.items():
        clean = secret_scan._without(texts[i], secret_scan.spans(texts[i]), "[secret]")
        assert row == _digest(library, i, clean)
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_near_duplicates_link_from_five_words_and_four_fifths_on(spark):
    rng = random.Random(11)
    texts = {}
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for changes in (0, 2, 3, 4, 6):
            w = list(base)
            for p in rng.sample(range(0, 150, 6), changes):
                w[p] = "new"
            texts[len(texts)] = " ".join(w)

    def kept(k, percent):
        sets = {i: shingle_set(t, k) for i, t in texts.items()}
        first = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in range(a // 5 * 5, a // 5 * 5 + 5):
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        first[a] = first[b] = min(first[a], first[b])
        return {i for i, c in first.items() if i == c}

    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    found = {r.doc_id for r in P.near_duplicates(spark, docs, FOLDER).collect()}
    assert found == kept(5, 80) and found < kept(3, 90)


def test_stages_keep_clashing_columns_and_null_rows(spark):
    docs = queries.table(spark, FOLDER, "documents").selectExpr("*", "-7 as n_words", "'mine' as kept", "doc_id as llr", "1 as n", "'x' as key")
    odd = spark.createDataFrame([(None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "-7 as n_words", "'mine' as kept", "doc_id as llr", "1 as n", "'x' as key")
    both = docs.unionByName(odd, True)
    before = {r.doc_id: tuple(r) for r in both.drop("text", "n_chars").collect()}
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, both, FOLDER)
        assert out.columns == both.columns
        rows = {r.doc_id: tuple(r) for r in out.drop("text", "n_chars").collect()}
        assert rows and all(before[k] == v for k, v in rows.items())
        assert stage(spark, both.where("doc_id < 0"), FOLDER).count() == 0
    assert P.tokens(spark, both.where("doc_id < 0"), FOLDER).count() == 0
