"""Quality rules with native expressions only: base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials over the buckets, one
of a trusted target and one of the raw corpus, give each bucket a weight log(p_target / p_raw) with
add-one smoothing. A document's ratio is the mean weight of its n-grams, and every document is kept
or not by a fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the multinomials: the only size of the model, whatever the corpus.
BUCKETS = 1 << 16
#: The mean log-likelihood ratio from which a document is kept.
THRESHOLD = -0.1
_BLANKS = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANKS), "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _runs(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    ahead = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), ahead)).otherwise(F.array().cast("array<bigint>"))


def _buckets(hashes: Column) -> Column:
    return F.transform(F.concat(hashes, _runs(hashes, 2)), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def _repeated(windows: Column) -> Column:
    """Words inside 3-word windows found twice or more: covered places, counted once each."""
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(none)

    def covered(s: Column) -> Column:
        equal = lambda e, i: ((i > 0) & F.get(s, i - 1)["h"].eqNullSafe(e["h"])) | F.get(s, i + 1)["h"].eqNullSafe(e["h"])
        places = F.sort_array(F.transform(F.filter(s, equal), lambda e: e["i"]))
        reach = lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return _let(places, reach)

    return _let(ordered, covered).cast("long")


def weights(docs: DataFrame, trusted: Column) -> DataFrame:
    """One row, one array: the weight of every bucket, all 0 if no row is trusted. trusted: a condition on rows of docs."""
    grams = docs.select(trusted.alias("t"), _hashes(_words(F.col("text"))).alias("wh")).select("t", F.explode(_buckets(F.col("wh"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("t").alias("target"))
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    rows = F.sort_array(F.collect_list(F.struct("bucket", "raw", "target")))
    one = dense.agg(rows.alias("rows"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    share = lambda n, total: (n + 1) / (F.col(total) + BUCKETS)
    ratio = lambda r: F.when(F.col("all_target") > 0, F.log(share(r["target"], "all_target") / share(r["raw"], "all_raw"))).otherwise(F.lit(0.0))
    return one.select(F.transform("rows", ratio).alias("w"))


def measured(docs: DataFrame, weight: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    A null or empty text has no words and fails the base rules; its llr is null. Rows are
    independent of each other but for the weights: null ids, repeated rows and an empty table need
    no care, and columns of docs with the name of a result give way to it. Windows are compared by
    64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def verdict(n: Column, repeat: Column, llr: Column) -> list[Column]:
        failed = (n < 50) | (100 * repeat > 50 * n)
        return [failed.alias("base_failed"), (~failed & F.coalesce(llr >= threshold, F.lit(False))).alias("kept")]

    def hashed(words: Column, wh: Column) -> Column:
        ratio = _let(_buckets(wh), lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(F.col("__w"), x)) / F.nullif(F.size(b), F.lit(0)))
        n, repeat = F.size(words).cast("long"), _let(_runs(wh, 3), _repeated)
        both = F.struct(repeat.alias("r"), ratio.alias("llr"))
        return _let(both, lambda q: F.struct(n.alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), q["r"].alias("n_repeat_words"), q["llr"].alias("llr"), *verdict(n, q["r"], q["llr"])))

    duplicate = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    found = docs.withColumn("__w", weight.scalar()).withColumn("__q", _let(_words(F.col("text")), lambda w: _let(_hashes(w), lambda h: hashed(w, h))))
    own = {f: F.col("__q")[f] for f in ("n_words", "word_chars")}
    own |= {"n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"), "n_dup_lines": duplicate} | {f: F.col("__q")[f] for f in ("n_repeat_words", "base_failed", "llr", "kept")}
    return found.withColumns(own).drop("__q", "__w")


def rate_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs measured against the target of documents with a label of quality 1.

    Where none of docs has one, every ratio is 0 and the base rules decide alone.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct()
    good = F.broadcast(good) if good.count() <= 1_000_000 else good
    marked = docs.join(good, F.col("doc_id") == F.col("__good"), "left")
    return measured(docs, weights(marked, F.col("__good").isNotNull()), threshold)


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that rate_documents keeps, with their own columns, whatever these are called."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "text")
    return rate_documents(whole, labels, threshold).where("kept").select("__doc.*")
