"""Operators that learn from or join the corpus: brute force, held-out accuracy and edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracemill.llm import graph, label_model, language_id, ngram_join, quality_model, quality_rules, queries, toxicity

from .test_map_operators import ODD, odd

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=3):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, percent=90, k=3):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def noisy_groups(seed):
    """Groups of near copies around the threshold, exact copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 5)))
    shared = [word() for _ in range(60)]
    texts = {}
    for _ in range(14):
        base = [word() for _ in range(rng.randrange(5, 160))] + shared * rng.randrange(2)
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                p = rng.randrange(len(w))
                w[p : p + 1] = [word()] * rng.randrange(3)
            texts[len(texts) * 7 % 1009] = " ".join(x.upper() if rng.random() < 0.1 else x for x in w)
    for t in ("", "one", "ONE", "one two", "one  two", None, " \t"):
        texts[len(texts) * 7 % 1009] = t
    return texts


@pytest.mark.parametrize("seed", [1])
def test_jaccard_components_equal_brute_force(spark, seed):
    texts = noisy_groups(seed)
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert found == brute_components(texts)


def test_blocks_of_one_token_lose_no_pair(spark, monkeypatch):
    texts = noisy_groups(3)
    for name, value in {"BLOCK": 3, "LEADERS": 1, "NEIGHBOURS": 2, "LONG_LIST": 9, "DEALT": 0, "ROUNDS": 2, "FINE": 8}.items():
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert found == brute_components(texts)


def test_join_edges(spark):
    rows = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd(spark)).collect())
    assert len(rows) == len(ODD) and [r for r in rows if r[0] == "None"] == [("None", 1, None)]
    assert {r[2] for r in rows if r[0] == "3"} == {3}
    kept = ngram_join.keep_one_each(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == ["1", "2", "3", "4", "5", "None"]
    assert ngram_join.jaccard_components(odd(spark).where("doc_id > 100")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}


def base_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 5000 else set(windows)
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_equal_brute_force(spark):
    docs, labels = queries.table(spark, FOLDER, "documents"), queries.table(spark, FOLDER, "labels")
    rows = {r.doc_id: r for r in queries.op6_quality_rules(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    counts = np.zeros((2, quality_rules.BUCKETS))
    grams = {}
    pack = lambda x: x.to_bytes(8, "little")
    for i, t in texts.items():
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(t)]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        two = [xxhash.xxh64_intdigest(pack(b), xxhash.xxh64_intdigest(pack(a), 42)) for a, b in zip(h, h[1:])]
        grams[i] = [signed(x) % quality_rules.BUCKETS for x in h + two]
        for b in grams[i]:
            counts[0, b] += 1
            counts[1, b] += i in good
    p = (counts + 1) / (counts.sum(1, keepdims=True) + quality_rules.BUCKETS)
    weight = np.log(p[1] / p[0])
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(t)
        if grams[i]:
            llr = weight[grams[i]].mean()
            assert abs(r.llr - llr) < 1e-9 and r.kept == (not r.base_failed and llr >= quality_rules.THRESHOLD)


def test_quality_rules_edges_and_plan(spark):
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = odd(spark).withColumn("kept", F.lit("clash"))
    rows = quality_rules.rate_documents(docs, labels).collect()
    assert len(rows) == len(ODD) and {r.kept for r in rows if r.text is None or not r.text.strip()} == {False}
    assert quality_rules.rate_documents(docs.where("doc_id > 100"), labels).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    alone = quality_rules.rate_documents(spark.createDataFrame([(9, text)], "doc_id bigint, text string"), labels).first()
    assert alone.llr == 0 and alone.kept
    plan = quality_rules.rate_documents(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_language_of_held_out_documents(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") == 3, "xx"))
    rows = language_id.identify_documents(docs).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"und"}
    unlabelled = language_id.identify_documents(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    assert language_id.identify_documents(docs.where("doc_id > 100")).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([5, 1, 7])
    scores, move = rng.normal(size=(13, 3)), rng.normal(size=(3, 3))
    post = language_id.marginals(scores, counts, move, block=2)[0]
    for start, n in ((0, 5), (5, 1), (6, 7)):
        total, mass = np.zeros((n, 3)), 0.0
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(scores[start + t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))) * np.exp(move[:, path[0]]).sum()
            mass += w
            for t, s in enumerate(path):
                total[t, s] += w
        assert np.allclose(post[start : start + n], total / mass)


def test_code_switched_words_are_told_apart(spark):
    docs = {r.lang: r.text for r in queries.table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 600 and doc_id % 50 = 1").collect()}
    model = language_id.learn(queries.table(spark, "/root/testdata/sf0.01", "documents"))
    import pyarrow as pa

    a, b = "en", next(x for x in docs if x != "en")
    left, right = docs[a][:300], docs[b][:300]
    n = len(language_id.label_words(model, pa.array([left]))[0])
    post = language_id.label_words(model, pa.array([left + " " + right]))[1].argmax(1)
    assert np.mean(post[:n] == model.langs.index(a)) > 0.9 and np.mean(post[n:] == model.langs.index(b)) > 0.9


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.3
    right = np.array([0.9, 0.8, 0.75, 0.85, 0.6])
    votes = np.where(rng.random((6000, 5)) < right, y[:, None], ~y[:, None]) * 2 - 1
    votes[rng.random((6000, 5)) < 0.3] = 0
    votes = np.concatenate([votes, votes[:, :1]], 1)  # a copy of the first voter
    m = label_model.fit_label_model(votes, prior=0.5)
    assert np.abs(m.accuracy[:5] - right).max() < 0.08 and (m.parent[5] == 0 or m.parent[0] == 5) and m.information[0, 5] > 0.3
    assert np.mean((label_model.posteriors(votes, m) > 0.5) == y) > 0.88
    codes, counts = np.unique(label_model.encode(votes), return_counts=True)
    assert np.allclose(label_model.fit_label_model(label_model.decode(codes, 6), counts, prior=0.5).accuracy, m.accuracy)


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(5)
    votes = rng.integers(-1, 2, (300, 4))
    m = label_model.fit_label_model(votes, groups=np.array([0, 0, 1, -1]), start=np.array([9.0, 8.0, 7.0, 1.0]), prior=0.2, rounds=5)
    m.parent = np.array([-1, 0, 1, -1])
    m.table = rng.dirichlet([1, 1, 1], (4, 3, 3)).transpose(0, 1, 3, 2)
    for v, p in zip(votes[:40], label_model.posteriors(votes[:40], m), strict=True):
        mass = [0.0, 0.0]
        for c, side in enumerate(m.side):
            one = m.weight[c]
            for j, up in enumerate(m.parent):
                one *= m.table[j, v[up] + 1 if up >= 0 else 0, v[j] + 1, c]
            mass[side] += one
        assert abs(p - mass[1] / sum(mass)) < 1e-9


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, folder).join(queries.table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    hit = [r.predicted == r.toxic for r in rows]
    found = [r.predicted for r in rows if r.toxic]
    assert len(rows) > 500 and np.mean(hit) > 0.97 and np.mean(found) > 0.85 and all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_scorer_reads_no_label_once_voters_are_mined(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    voters = toxicity.mine(docs, labels)
    assert {"idiot", "stupi"} & {s[:5] for texts in voters.texts for s in texts} and toxicity.mine(docs, labels.withColumn("toxic", 1 - F.col("toxic"))).texts != voters.texts
    with_labels = docs.join(labels.withColumn("toxic", 1 - F.col("toxic")), "doc_id", "left")
    one, other = (toxicity.fit(d, voters).scorer for d in (docs, with_labels))
    assert one.bias == pytest.approx(other.bias, abs=1e-6) and np.allclose(one.weights, other.weights, atol=1e-5)


def test_votes_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = queries.table(spark, folder, "documents")
    voters = toxicity.mine(docs, queries.table(spark, folder, "labels"))
    import pyarrow as pa

    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(300).collect()]
    votes = voters.votes(pa.array(texts))
    for t, v in zip(texts, votes, strict=True):
        words = {w.encode() for w in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.lower())}
        for k, stems in enumerate(voters.texts):
            if not any("\ufffd" in s for s in stems):
                found = any(w.startswith(s.encode()) for s in stems for w in words)
                assert found or not v[k]  # a stem may ask for two or three words, so that it isn't always a vote


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score_documents(odd(spark), labels).count() == len(ODD)
    none = toxicity.score_documents(odd(spark), labels.where("doc_id > 100")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.score_documents(odd(spark).where("doc_id > 100"), labels).count() == 0


def test_quality_classifier_against_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op9_quality_classifier(spark, folder).join(queries.table(spark, folder, "labels"), "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([r.kept for r in good]) > 0.99 and np.mean([r.kept for r in bad]) < 0.5
    ranks = np.argsort(np.argsort([r.score for r in rows]))
    q = np.array([r.quality for r in rows])
    auc = (ranks[q == 1].sum() - (q == 1).sum() * ((q == 1).sum() - 1) / 2) / ((q == 1).sum() * (q == 0).sum())
    assert auc > 0.95


def test_quality_classifier_edges(spark):
    rows = quality_model.score_documents(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r.score == 0 for r in rows if r.doc_id in (1, 2))
    assert quality_model.score_documents(odd(spark).where("doc_id > 100")).count() == 0
    assert {r.score for r in quality_model.score_documents(odd(spark).where("text is null")).collect()} == {0.0}


def test_languages_without_letters_or_with_many_names(spark):
    rows = [(i, "12 345 !", "xx") for i in range(30)]
    found = language_id.identify_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)} and len(found) == 30
    # 90 languages, each with words of its own; every one is learned and found again
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x430, 0x450)] + [chr(c) for c in range(0x3B1, 0x3C9) if c != 0x3C2]
    rng = random.Random(5)
    words = {k: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] for k in range(90)}
    many = [(i, " ".join(rng.choice(words[i % 90]) for _ in range(30)) * (1 if i < 1797 else 400), f"l{i % 90}") for i in range(1800)]
    found = language_id.identify_documents(spark.createDataFrame(many, "doc_id bigint, text string, lang string")).collect()
    out = [r.lang_pred == f"l{r.doc_id % 90}" for r in found if r.held_out]
    assert len({r.lang_pred for r in found}) == 90 and sum(out) / len(out) > 0.95


def test_a_language_of_long_texts_alone_is_learned(spark):
    rows = [(i, ("kurz und gut " if i % 5 else "alabama ") * (20 if i % 5 else 30_000), "de" if i % 5 else "xx") for i in range(60)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 20_000)
    assert model.langs == ["de", "xx"]


def test_languages_equal_plain_forward_backward(spark):
    docs = queries.table(spark, FOLDER, "documents").unionByName(odd(spark).select("doc_id", "text"), True)
    found = {(r.doc_id, r.n_words): r for r in language_id.identify_documents(docs).collect()}
    model = language_id.learn(docs)
    import pyarrow as pa

    step = np.exp(model.move)
    for r in docs.where("length(text) < 3000").limit(60).collect():
        w = language_id._cut(pa.array([r.text]))
        if not len(w.row):
            assert found[r.doc_id, 0].lang_pred == "und"
            continue
        emit = np.exp(language_id._emissions(w, model))
        ahead, back = [emit[0] * step.sum(0)], [np.ones(len(model.langs))]
        for e in emit[1:]:
            ahead.append(ahead[-1] @ step * e)
            ahead[-1] /= ahead[-1].sum()
        for e in emit[:0:-1]:
            back.append(step @ (e * back[-1]))
            back[-1] /= back[-1].sum()
        post = np.array(ahead) * np.array(back[::-1])
        post /= post.sum(1, keepdims=True)
        row = found[r.doc_id, len(emit)]
        assert row.lang_pred == model.langs[post.sum(0).argmax()] and abs(row.score - post.sum(0).max() / len(emit)) < 1e-6
        assert row.n_switches == (np.diff(post.argmax(1)) != 0).sum()


def test_quality_votes_equal_counts_of_patterns(spark):
    docs = queries.table(spark, FOLDER, "documents").where("text is not null")
    codes, counts = label_model.pattern_counts(docs, quality_model.labeller_votes)
    import pyarrow as pa

    plain = label_model.encode(quality_model.labeller_votes(pa.array([r.text for r in docs.select("text").collect()])))
    value, n = np.unique(plain, return_counts=True)
    assert (codes == value).all() and (counts == n).all()


def test_quality_classifier_ties_and_clashing_columns(spark):
    docs = queries.table(spark, FOLDER, "documents").select("doc_id", "text")
    twice = docs.unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "text")).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(5))
    rows = {r.doc_id: r for r in quality_model.score_documents(twice).collect()}
    assert len(rows) == 400 and all(rows[i].score == rows[i + 100000].score and rows[i].kept == (rows[i].score >= 0.5) for i in rows if i < 100000)


def test_one_large_group_of_near_copies_gives_few_pairs_to_verify(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(120)]
    texts = {}
    for i in range(400):
        w = list(base)
        for p in rng.sample(range(0, 120, 5), rng.randrange(2, 6)):
            w[p] = word()
        texts[i] = " ".join(w)
    pairs, verified = [], ngram_join.verified

    def counted(docs, candidates, k, percent):
        pairs.append(candidates.count())
        return verified(docs, candidates, k, percent)

    monkeypatch.setattr(ngram_join, "verified", counted)
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 80, 5).collect()}
    assert found == brute_components(texts, 80, 5)
    assert sum(pairs) <= 8 * len(texts), pairs
