"""Triage, text and vector queries, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import texts as T
from ..operators import similar as D
from ..operators import triage as G
from ..sources import surrogate as src

QUERIES, ORACLES = {}, {}

REVIEWS = f"{src.FINDINGS}, reviews AS (SELECT DISTINCT run_id, test_id, CASE WHEN part % 3 = 0 THEN NULL ELSE line END AS line, part * 1000 + supp AS review_ord, CASE part % 4 WHEN 0 THEN 'TP' WHEN 1 THEN 'UNCERTAIN' ELSE 'FP' END AS verdict FROM findings WHERE part % 2 = 0)"
JUDGED = f"{REVIEWS}, ex AS (SELECT run_id, test_id, line, arg_min(verdict, row(review_ord, verdict)) AS v FROM reviews WHERE line IS NOT NULL GROUP BY 1, 2, 3), lo AS (SELECT run_id, test_id, arg_min(verdict, row(review_ord, verdict)) AS v FROM reviews WHERE line IS NULL GROUP BY 1, 2), judged AS (SELECT f.*, coalesce(ex.v, lo.v) AS verdict FROM findings f LEFT JOIN ex USING (run_id, test_id, line) LEFT JOIN lo ON lo.run_id = f.run_id AND lo.test_id = f.test_id)"
DOCS = "docs AS (SELECT doc_id, lang, source, text, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\r\\n?', chr(10), 'g')), '\\s+', ' ', 'g')) AS norm FROM documents)"


def query(name, sql, prelude=""):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {prelude} " if prelude else "") + sql
        return f

    return put


def reviews(spark, d):
    f = src.findings(spark, d).where("part % 2 = 0")
    verdict = F.element_at(F.array(*map(F.lit, ("TP", "UNCERTAIN", "FP", "FP"))), (F.col("part") % 4 + 1).cast("int"))
    return f.select("run_id", "test_id", F.when(F.col("part") % 3 != 0, F.col("line")).alias("line"), (F.col("part") * 1000 + F.col("supp")).alias("review_ord"), verdict.alias("verdict")).distinct()


def judged(spark, d):
    return G.with_verdicts(src.findings(spark, d), reviews(spark, d).withColumn("review_ord", F.struct("review_ord", "verdict")))


def documents(spark, d):
    return src.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("review_verdicts", "SELECT coalesce(verdict, 'none') AS verdict, severity, count(*) AS n FROM judged GROUP BY 1, 2", JUDGED)
def _(spark, d):
    return judged(spark, d).groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict"), "severity").agg(F.count("*").alias("n"))


@query("triage_by_run", ", t AS (SELECT *, coalesce(verdict, '') = 'FP' AS fp, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END * CASE confidence WHEN 'LOW' THEN 1 ELSE 3 END AS w FROM judged) SELECT run_id, count(*) FILTER (NOT (fp AND w < 6)) AS kept, count(*) FILTER (fp AND w < 6) AS dropped, count(*) FILTER (fp AND w >= 6) AS overridden, round(count(*) FILTER (fp AND w < 6) / CAST(count(*) AS DOUBLE), 6) AS fp_rate FROM t GROUP BY 1", JUDGED)
def _(spark, d):
    t = G.triaged(judged(spark, d))
    return t.groupBy("run_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.count_if("overridden").alias("overridden"), F.round(S.ratio(F.count_if(~F.col("kept")), F.count("*")), 6).alias("fp_rate"))


@query("cross_tool_findings", "SELECT run_id, cwe, line, ['LOW','MEDIUM','HIGH'][max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END)] AS severity, ['LOW','MEDIUM','HIGH'][max(CASE confidence WHEN 'LOW' THEN 1 ELSE 3 END)] AS confidence, array_to_string(list_sort(list_distinct(list(tool))), '|') AS tools, array_to_string(list_sort(list_distinct(list(test_id))), '|') AS tests, count(*) - 1 AS removed FROM findings GROUP BY 1, 2, 3", src.FINDINGS)
def _(spark, d):
    return G.cross_tool(src.findings(spark, d))


@query("reviews_of_findings", "SELECT run_id, test_id, line, review_ord, verdict FROM reviews r WHERE line IS NOT NULL AND EXISTS (SELECT 1 FROM findings f WHERE f.severity = 'HIGH' AND f.run_id = r.run_id AND f.test_id = r.test_id AND f.line = r.line) OR line IS NULL AND EXISTS (SELECT 1 FROM findings f WHERE f.severity = 'HIGH' AND f.run_id = r.run_id AND f.test_id = r.test_id)", REVIEWS)
def _(spark, d):
    return G.restricted(reviews(spark, d), src.findings(spark, d).where("severity = 'HIGH'"))


@query("review_references", "SELECT run_id, test_id, line, review_ord FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.run_id = x.run_id AND x.ref = y.test_id || ':' || y.line AND x.ref <> x.test_id || ':' || x.line)", f"{REVIEWS}, x AS (SELECT *, CASE WHEN part % 5 = 0 THEN 'T' || (part % 20) || ':' || line END AS ref FROM (SELECT DISTINCT run_id, test_id, line, part, part * 1000 + supp AS review_ord FROM findings))")
def _(spark, d):
    f = src.findings(spark, d).select("run_id", "test_id", "line", "part", (F.col("part") * 1000 + F.col("supp")).alias("review_ord")).distinct()
    ref = F.when(F.col("part") % 5 == 0, F.concat(F.lit("T"), (F.col("part") % 20).cast("string"), F.lit("#"), F.col("line").cast("string")))
    keyed = f.withColumn("duplicate_of", ref).withColumn("review_ord", F.struct("review_ord", "test_id", "line"))
    return G.collapse_references(keyed).select("run_id", "test_id", "line", F.col("review_ord.review_ord").alias("review_ord"))


@query("heuristic_duplicates", ", x AS (SELECT DISTINCT run_id, line, tool, test_id, cwe, [severity, confidence] AS t FROM findings) SELECT a.run_id, a.line, a.tool AS tool_a, a.test_id AS test_id_a, b.tool AS tool_b, b.test_id AS test_id_b, count(*) AS n FROM x a JOIN x b ON a.run_id = b.run_id AND a.line = b.line AND a.tool < b.tool WHERE a.cwe = b.cwe OR len(list_intersect(a.t, b.t)) >= 2 GROUP BY ALL", src.FINDINGS)
def _(spark, d):
    f = src.findings(spark, d).select("run_id", "line", "tool", "test_id", "cwe", F.array("severity", "confidence").alias("tokens")).distinct()
    return G.heuristic_pairs(f).groupBy("run_id", "line", "tool_a", "test_id_a", "tool_b", "test_id_b").agg(F.count("*").alias("n"))


@query("rule_levels", ", rules AS (SELECT 'T' || range AS test_id, CASE range % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'note' ELSE 'warning' END AS level FROM range(15)) SELECT coalesce(level, 'warning') AS level, count(*) AS n FROM findings LEFT JOIN rules USING (test_id) GROUP BY 1", src.FINDINGS)
def _(spark, d):
    rules = spark.range(15).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("test_id"), F.element_at(F.array(*map(F.lit, ("error", "note", "warning"))), (F.col("id") % 3 + 1).cast("int")).alias("level"))
    return G.rule_lookup(src.findings(spark, d), rules).groupBy("level").agg(F.count("*").alias("n"))


@query("scenario_exact_duplicates", "SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, source, norm) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY lang, source, norm) AS is_first FROM docs", DOCS)
def _(spark, d):
    return D.exact_duplicates(documents(spark, d), "lang", "source")


@query("scenario_newest", "SELECT doc_id, lang, source, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS nth FROM documents) WHERE nth <= 5")
def _(spark, d):
    return D.newest(documents(spark, d), ["lang", "source"], "doc_id", 5).select("doc_id", "lang", "source", "nth")


_GRAMS = f"""{DOCS}, w AS (SELECT doc_id, lang, source, regexp_extract_all(norm, '[a-z0-9_]{{2,}}') AS w FROM docs), t AS (SELECT doc_id, unnest(w) AS term, 1e0 AS x FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 0.25e0 FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])), 0.15e0 FROM w),
top AS (SELECT doc_id, term, x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, term) AS r FROM (SELECT doc_id, term, round(sum(x), 6) AS x FROM t GROUP BY 1, 2)) WHERE r <= 384)"""


@query("scenario_top_terms", ", u AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM top) SELECT doc_id, count(*) AS terms, round(sum(x), 4) AS mass, arg_max(term, row(round(x, 9), term)) AS top FROM u GROUP BY 1", _GRAMS)
def _(spark, d):
    top = D.term_weights(documents(spark, d))
    return top.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("x"), 4).alias("mass"), F.max_by("term", F.struct(F.round("x", 9).alias("x"), "term")).alias("top"))


_PERMS = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(map(D.permutation, range(96))))
_SH = f"{DOCS}, w AS (SELECT doc_id, regexp_extract_all(norm, '[a-z0-9_]{{2,}}') AS w FROM docs), sh AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2]) ELSE [array_to_string(w, '_')] END) AS s FROM w WHERE len(w) > 0)), perms AS (SELECT * FROM (VALUES {_PERMS}) t(i, a, b)), sig AS (SELECT doc_id, list(v ORDER BY i) AS sig FROM (SELECT doc_id, i, min((a * h + b) % {D.PRIME}) AS v FROM sh, perms GROUP BY 1, 2) GROUP BY 1)"


@query("scenario_minhash", "SELECT doc_id, substr(sha256(array_to_string(sig, ',')), 1, 16) AS sig FROM sig", _SH)
def _(spark, d):
    return D.minhash(documents(spark, d)).select("doc_id", T.sha16(F.concat_ws(",", F.col("sig").cast("array<string>"))).alias("sig"))


@query("scenario_minhash_pairs", ", cls AS (SELECT min(doc_id) AS doc_id, sig FROM sig GROUP BY sig), pl AS (SELECT doc_id, i, sig[i] AS v FROM cls, range(1, 97) r(i)) SELECT a.doc_id AS a, b.doc_id AS b, count(*) / 96e0 AS similarity FROM pl a JOIN pl b USING (i, v) WHERE a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 79", _SH)
def _(spark, d):
    return D.minhash_pairs(D.minhash(documents(spark, d)), 96, 0.82)


@query("scenario_minhash_classes", None)
def _(spark, d):
    return D.minhash_classes(D.minhash(documents(spark, d)), 96, 0.82)


ORACLES["scenario_minhash_classes"] = f"WITH RECURSIVE {_SH}, cls AS (SELECT min(doc_id) AS doc_id, sig, count(*) AS copies FROM sig GROUP BY sig), pl AS (SELECT doc_id, i, sig[i] AS v FROM cls, range(1, 97) r(i)), pr AS (SELECT a.doc_id AS a, b.doc_id AS b FROM pl a JOIN pl b USING (i, v) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) >= 79), reach AS (SELECT doc_id AS a, doc_id AS b FROM cls UNION SELECT r.a, p.b FROM reach r JOIN pr p ON p.a = r.b), least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1) SELECT d.doc_id, coalesce(l.class_id, d.doc_id) AS class_id, coalesce(c.copies, 1) AS copies FROM sig d JOIN cls c USING (sig) JOIN least l ON l.a = c.doc_id"


_LAST = "placed AS (SELECT doc_id, lang, source, norm, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS o FROM docs), pr AS (SELECT x.doc_id AS a, y.doc_id AS b, x.o - y.o AS back, x.norm = y.norm AS eq FROM placed x JOIN placed y ON x.lang IS NOT DISTINCT FROM y.lang AND x.source IS NOT DISTINCT FROM y.source AND x.o - y.o BETWEEN 1 AND 50)"


@query("scenario_staged_bow", f", {_LAST}, u AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM top), c AS (SELECT a, b, back, round(sum(u.x * v.x), 6) AS s FROM pr JOIN u ON u.doc_id = a JOIN u v ON v.doc_id = b AND v.term = u.term GROUP BY 1, 2, 3), m AS (SELECT a, b, back, 0 AS stage, 'hash' AS method, 1e0 AS s FROM pr WHERE eq UNION ALL SELECT a, b, back, 1, 'cosine', s FROM c WHERE s >= 0.92e0) SELECT a AS doc_id, arg_min(method, row(stage, -back)) AS method, arg_min(s, row(stage, -back)) AS similarity, arg_min(b, row(stage, -back)) AS matched FROM m GROUP BY 1", _GRAMS)
def _(spark, d):
    return D.staged_matches(documents(spark, d), ["lang", "source"])


@query("scenario_staged_minhash", f", {_LAST}, c AS (SELECT a, b, back, len(list_filter(list_zip(u.sig, v.sig), lambda e: e[1] = e[2])) / 96e0 AS s FROM pr JOIN sig u ON u.doc_id = a JOIN sig v ON v.doc_id = b), m AS (SELECT a, b, back, 0 AS stage, 'hash' AS method, 1e0 AS s FROM pr WHERE eq UNION ALL SELECT a, b, back, 1, 'minhash', s FROM c WHERE s >= 0.82e0) SELECT a AS doc_id, arg_min(method, row(stage, -back)) AS method, arg_min(s, row(stage, -back)) AS similarity, arg_min(b, row(stage, -back)) AS matched FROM m GROUP BY 1", _SH)
def _(spark, d):
    return D.staged_matches(documents(spark, d), ["lang", "source"], method="minhash")


@query("tfidf_vocabulary", ", t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), e AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY 1), m AS (SELECT term, tf, df, ln((n + 1) / (df + 1e0)) + 1 AS idf FROM e, n) SELECT term, tf, df, round(idf, 6) AS idf, round(tf * idf, 4) AS mass FROM m ORDER BY round(tf * idf, 4) DESC, term LIMIT 50".replace(", t AS", "WITH t AS", 1))
def _(spark, d):
    return D.tfidf_vocabulary(documents(spark, d), 50)


@query("vector_cosine_to_centroid", "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2) SELECT e.vec_id, e.label, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) + 0e0 AS cosine FROM e JOIN c USING (label, i) GROUP BY 1, 2")
def _(spark, d):
    v = src.table(spark, d, "embeddings")
    long = v.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centre = long.groupBy("label", "i").agg(F.avg("x").alias("m"))
    both = long.join(centre, ["label", "i"])
    cosine = F.sum(F.col("x") * F.col("m")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("m") * F.col("m")))
    return both.groupBy("vec_id", "label").agg((F.round(cosine, 6) + S.num(0)).alias("cosine"))


_KNN = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, t.vec_id, t.label, round(list_dot_product(q.e, t.e) / (sqrt(list_dot_product(t.e, t.e)) * sqrt(list_dot_product(q.e, q.e))), 9) AS sim FROM v q JOIN v t ON q.vec_id % 50 = 0 AND t.vec_id <> q.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS r FROM s) WHERE r <= 5), c AS (SELECT query_id, label, count(*) AS votes, round(avg(sim), 6) AS mean_sim FROM k GROUP BY 1, 2) SELECT query_id, arg_max(label, row(votes, mean_sim, -label)) AS label, max(votes) AS votes FROM c GROUP BY 1"


@query("vector_knn", _KNN)
def _(spark, d):
    v = src.table(spark, d, "embeddings")
    return G.knn_votes(v, v.where("vec_id % 50 = 0"), 5)


@query("vector_knn_indexed", None)
def _(spark, d):
    v = src.table(spark, d, "embeddings")
    return G.knn_votes(v, v.where("vec_id % 50 = 0"), 5, lists=64)


@query("vector_standardised", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY 1) SELECT vec_id, round(sum(abs((x - m) / s)), 4) AS total, round(max((x - m) / s), 5) AS most FROM e JOIN s USING (i) GROUP BY 1")
def _(spark, d):
    v = src.table(spark, d, "embeddings")
    z = D.standardised(v, D.fit_scaling(v))
    return z.groupBy("vec_id").agg(F.round(F.sum(F.abs("z")), 4).alias("total"), F.round(F.max("z"), 5).alias("most"))


@query("vector_folds", "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS INT) AS fold FROM embeddings")
def _(spark, d):
    return D.folds(src.table(spark, d, "embeddings"), 5)


@query("scalar_hashes", "SELECT o_orderkey AS id, substr(sha256(o_orderpriority || '|' || o_orderkey), 1, 16) AS sha16, CAST(('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 6 AS bucket, lower(trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g'), '-')) AS slug, CASE WHEN o_totalprice < 1000 THEN 0e0 ELSE greatest(0e0, least(1e0, o_totalprice / 300000e0)) END AS clamped FROM orders")
def _(spark, d):
    o = src.table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    clamped = F.when(F.col("o_totalprice") < 1000, 0.0).otherwise(S.clamp01(F.col("o_totalprice") / S.num(300000)))
    return o.select(F.col("o_orderkey").alias("id"), T.sha16(F.concat_ws("|", "o_orderpriority", key)).alias("sha16"), T.bucket_of(key, 6).alias("bucket"), T.slug(F.col("o_orderpriority")).alias("slug"), clamped.alias("clamped"))


@query("cwe_parsing", "SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 'CWE-' || (p_size % 10) END AS first_cwe, array_to_string(list_distinct(['CWE-' || (p_size % 7 + 1)]), ',') AS mentions, CAST(p_size % 10 AS BIGINT) AS key FROM part")
def _(spark, d):
    text = F.concat(F.lit("see cwe_"), F.lpad((F.col("p_size") % 10).cast("string"), 4, "0"))
    twice = F.concat(F.lit("CWE-"), (F.col("p_size") % 7 + 1).cast("string"), F.lit(" and cwe "), (F.col("p_size") % 7 + 1).cast("string"))
    return src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.cwe_of(text).alias("first_cwe"), F.array_join(T.cwe_mentions(twice), ",").alias("mentions"), T.cwe_key(text).alias("key"))


@query("safe_casts", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS plain, CAST(p_size AS BIGINT) AS decimal_text, CAST(NULL AS BIGINT) AS bad FROM part")
def _(spark, d):
    size = F.col("p_size").cast("string")
    return src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.safe_int(size).alias("plain"), T.safe_int(F.concat(size, F.lit(".0"))).alias("decimal_text"), T.safe_int(F.col("p_name")).alias("bad"))


@query("code_stats", "SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS nonempty, length(text) AS chars, substr(sha256(text), 1, 16) AS hash FROM documents")
def _(spark, d):
    lines = F.split("text", "\n")
    return documents(spark, d).select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("bigint").alias("nonempty"), F.length("text").cast("bigint").alias("chars"), T.sha16(F.col("text")).alias("hash"))


@query("page_titles", "SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def _(spark, d):
    p = src.table(spark, d, "pages")
    return p.select("page_id", T.tagged(F.col("html"), "title").alias("title"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"))


@query("context_windows", "SELECT doc_id, array_to_string(list_transform(range(greatest(ln - 1, 1), least(ln + 1, len(l)) + 1), lambda i: CASE WHEN i = ln THEN '>> ' ELSE '   ' END || lpad(CAST(i AS VARCHAR), 4, ' ') || ': ' || l[i]), chr(10)) AS context FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l, 1 + doc_id % 2 AS ln FROM documents) WHERE ln <= len(l)")
def _(spark, d):
    line = (1 + F.col("doc_id") % 2).cast("int")
    return documents(spark, d).select("doc_id", T.context_window(F.col("text"), line, 1).alias("context")).where("context is not null")


@query("event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'none' WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 50 THEN 'low' ELSE 'high' END AS band FROM events")
def _(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return src.table(spark, d, "events").select("event_id", k.alias("k"), F.when(k.isNull(), "none").when(k < 50, "low").otherwise("high").alias("band"))


@query("transcripts", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, substr(sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)), 1, 16) AS hash FROM conversations GROUP BY 1")
def _(spark, d):
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("s")))), lambda x: x["s"]), "\n")
    return src.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), T.sha16(said).alias("hash"))


@query("error_keywords", "WITH k AS (SELECT unnest(['the','that','ing','tion','que','der','las']) AS word), t AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t SEMI JOIN k USING (word) GROUP BY 1, 2")
def _(spark, d):
    words = ["the", "that", "ing", "tion", "que", "der", "las"]
    hits = documents(spark, d).select("doc_id", "lang", F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(words))).alias("word"))
    return hits.groupBy("doc_id", "lang", "word").agg(F.count("*").alias("c")).groupBy("lang", "word").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query("windowed_events", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    e = src.table(spark, d, "events")
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("event_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, sid")
def _(spark, d):
    e = src.table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")
