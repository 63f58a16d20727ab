"""Kinds of errors in written analyses: sections, sentences, and keywords matched by lemma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heads of sections, the prefix that their matches get, and the heads that end them.
SECTIONS = {
    "Test Failures:": ("", ("Test Error:", "Root Causes:", "Suggested Areas to Investigate:", "What Went Wrong:")),
    "Root Causes:": ("root_", ("Test Error:", "Suggested Areas to Investigate:", "What Went Wrong:")),
    "Suggested Areas to Investigate:": ("fix_", ("Test Error:", "What Went Wrong:")),
}
#: Ends of a sentence; line breaks end one too.
SENTENCE_END = r"[.!?]+\s+|[.!?]+\z|\n+"

#: Irregular forms, and words that only look inflected, with their lemmas.
IRREGULAR = {
    "am": "be", "are": "be", "is": "be", "was": "be", "were": "be", "been": "be", "being": "be", "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do", "goes": "go", "went": "go", "gone": "go",
    "ran": "run", "wrote": "write", "written": "write", "took": "take", "taken": "take", "gave": "give", "given": "give", "got": "get", "made": "make", "found": "find", "left": "leave", "lost": "lose", "threw": "throw", "thrown": "throw",
    "broke": "break", "broken": "break", "chose": "choose", "chosen": "choose", "hidden": "hide", "held": "hold", "kept": "keep", "led": "lead", "meant": "mean", "sent": "send", "built": "build", "bound": "bind", "forgot": "forget", "forgotten": "forget",
    "indices": "index", "vertices": "vertex", "matrices": "matrix", "analyses": "analysis", "criteria": "criterion", "children": "child", "people": "person", "men": "man", "women": "woman", "queries": "query",
    "this": "this", "its": "its", "thus": "thus", "always": "always", "perhaps": "perhaps", "during": "during", "ceiling": "ceiling", "need": "need", "exceed": "exceed", "succeed": "succeed", "proceed": "proceed", "feed": "feed", "indeed": "indeed", "speed": "speed", "seed": "seed", "embed": "embed",
}
#: Suffix rules, of which the first that fits holds: what is matched, and what it becomes.
RULES = [
    (r"^([a-z]+[^aeiou])ies$", r"\1y"),
    (r"^([a-z]+(?:ss|sh|ch|x|zz))es$", r"\1"),
    (r"^([a-z]+[^sui])s$", r"\1"),
    (r"^([a-z]+[^aeiou])ied$", r"\1y"),
    *((rf"^([a-z]*[aeiou]{c}){c}(?:ing|ed)$", r"\1") for c in "bdgmnprt"),
    # stems that end so have lost an e
    (r"^([a-z]*[aeiouy][a-z]*(?:[^aeiou][aiou]t|[aiu]s|[^aeiou][aiou]z|[iu]c|nc|rc|ag|dg|rg|[aeiou]v|[lr]v|[bcdfgkptz]l|[iu]r|[^e]ar|[iu]m|[^aeiou]ak|[^aeiou]id))(?:ing|ed)$", r"\1e"),
    (r"^((?:us|tak|mak|giv|writ|defin|tim|nam|sav|cod|not|chang|mov|typ|assum|requir|rais|caus))(?:ing|ed)$", r"\1e"),
    (r"^([a-z]*[aeiouy][a-z]*)(?:ing|ed)$", r"\1"),
]


def lemma(word: Column) -> Column:
    """The lemma of a lower-case English word: that of an irregular form, else by suffix rules."""
    named = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    out = word
    for found, put in reversed(RULES):
        out = F.when(word.rlike(found), F.regexp_replace(word, found, put.replace("\\", "$"))).otherwise(out)
    return F.coalesce(F.try_element_at(named, word), out)


def lemma_sql(word: str) -> str:
    """The same in DuckDB's SQL."""
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    rules = " ".join(f"WHEN regexp_matches({word}, '{f}') THEN regexp_replace({word}, '{f}', '{p}')" for f, p in RULES)
    return f"CASE {word} {named} ELSE CASE {rules} ELSE {word} END END"


def sentences(reports: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, prefix, sentence: every sentence, in lower case, of the sections of each report (the first of each kind; null: none)."""
    plain = F.regexp_replace(F.col(text), "(?i)</?error_analysis>", "")
    heads = [F.struct(F.lit(prefix).alias("prefix"), F.regexp_extract(plain, f"(?is){head}(.*?)(?:{'|'.join(ends)}|\\z)", 1).alias("body")) for head, (prefix, ends) in SECTIONS.items()]
    each = reports.select(*keep, F.explode(F.array(*heads)).alias("s"))
    return each.select(*keep, "s.prefix", F.explode(F.split(F.lower("s.body"), SENTENCE_END)).alias("sentence")).where(F.trim("sentence") != "")


def error_counts(reports: DataFrame, text: str, keywords: DataFrame, *by: str) -> DataFrame:
    """by, error, n: sentences that share a lemma with a keyword (kind, keyword) of a kind of error, by each of `by` and in total.

    error is the kind with its section's prefix. A sentence counts once for each kind; a keyword of several
    words counts with each. Rows carry the value of one column of `by` and null in the others, or null in all
    for the total, and `level` names that column (`total`). Words are runs of a-z. Equal sentences and
    reports count again; a null value of a column is a value. Lemmas are found once for each distinct word; what is
    broadcast are the keywords' lemmas and the words that have one of these, which are few whatever the reports.
    """
    number = F.monotonically_increasing_id()
    said = sentences(reports, text, *by).withColumn("words", F.array_distinct(F.regexp_extract_all("sentence", F.lit("[a-z]+"), F.lit(0)))).select(*by, "prefix", "words")
    wanted = keywords.select("kind", F.explode(F.regexp_extract_all(F.lower("keyword"), F.lit("[a-z]+"), F.lit(0))).alias("w")).select("kind", lemma(F.col("w")).alias("lemma")).distinct()
    known = said.select(F.explode("words").alias("w")).distinct().select("w", lemma(F.col("w")).alias("lemma")).join(F.broadcast(wanted), "lemma").select("w", "kind")
    each = said.withColumn("sentence", number).select(*by, "prefix", "sentence", F.explode("words").alias("w"))
    hits = each.join(F.broadcast(known), "w").select(*by, "sentence", F.concat("prefix", "kind").alias("error")).distinct()
    counted = hits.groupBy(*by, "error").agg(F.count("*").alias("n"))
    sets = [F.struct(F.lit(c).alias("level"), *[(F.col(x) if x == c else F.lit(None).cast(dict(counted.dtypes)[x])).alias(x) for x in by]) for c in (*by, "total")]
    return counted.select("error", "n", F.explode(F.array(*sets)).alias("g")).groupBy("g.level", *[f"g.{x}" for x in by], "error").agg(F.sum("n").alias("n"))
