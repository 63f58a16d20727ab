"""Text, hash and parsing helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(x: Column) -> Column:
    """White space as single spaces, trimmed, lower case."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def sha16(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def safe_int(x: Column) -> Column:
    """Integer of a text that may be written as a decimal; null if it is no number."""
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


def bucket_of(x: Column, n: int) -> Column:
    """A stable choice among n from the first 32 bits of SHA-1."""
    return F.pmod(F.conv(F.substring(F.sha1(x), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def cwe_of(x: Column) -> Column:
    """Canonical id of the first weakness named in a text; null for none or number zero."""
    number = F.regexp_extract(F.upper(x), r"CWE[-_ ]?(\d{1,6})", 1).try_cast("bigint")
    return F.when(number > 0, F.concat(F.lit("CWE-"), number.cast("string")))


def cwe_mentions(x: Column) -> Column:
    """Canonical ids of all weaknesses named, in order of first mention."""
    found = F.regexp_extract_all(F.upper(x), F.lit(r"CWE[-_ ]?(\d{1,6})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("CWE-"), n.cast("bigint").cast("string"))))


def cwe_key(x: Column) -> Column:
    """Sort key of an id: its number, last if it has none."""
    return F.coalesce(F.regexp_extract(x, r"(\d+)", 1).try_cast("bigint"), F.lit(10**9))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), F.lit("-"))


def pipe_join(items: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(items)), "|")


def pipe_split(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def tokens(x: Column) -> Column:
    """Words of letters, digits and underscores of two characters or more, lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by underscores."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), "_"))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def issue_key(test_id: Column, line: Column) -> Column:
    return F.concat_ws(":", test_id, line.cast("string"))


def duplicate_ref(x: Column) -> Column:
    """`id#line` as `id:line`."""
    return F.regexp_replace(F.trim(x), r"^(.*)#(\d+)$", "$1:$2")


def context_window(code: Column, line: Column, radius: int = 2) -> Column:
    """Numbered lines around a line, which `>>` marks."""
    lines = F.split(code, r"\r?\n")
    low, high = F.greatest(line - radius, F.lit(1)), F.least(line + radius, F.size(lines))
    show = lambda i: F.concat(F.when(i == line, ">> ").otherwise("   "), F.lpad(i.cast("string"), 4, " "), F.lit(": "), F.get(lines, i - 1))
    return F.when((line >= 1) & (line <= F.size(lines)), F.array_join(F.transform(F.sequence(low, high), show), "\n"))


def stripped(x: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def tagged(x: Column, tag: str) -> Column:
    """Trimmed text of the first <tag>...</tag>; empty if there is none."""
    return stripped(F.regexp_extract(x, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def two_places(x: Column) -> Column:
    """A double from 0 to 1 with two decimals, rounded as exactly as C and Python do: by its binary value, ties to even."""
    scale = F.lit(1 << 60).cast("decimal(20,0)")
    n = ((x * float(1 << 60)).cast("bigint").cast("decimal(20,0)") * 100).cast("decimal(26,0)")
    rest = F.pmod(n, scale)
    q = ((n - rest) / scale).cast("bigint")
    up = (rest * 2 > scale) | ((rest * 2 == scale) & (q % 2 == 1))
    return F.format_string("%.2f", (q + up.cast("int")) / 100.0)


def annotate(rate: Column, primary: Column) -> Column:
    """A cell of a capability table: a check for 0, a cross for 1, else two decimals; a dagger if primary."""
    text = F.when(rate.isNull(), "").when(rate == 0, "✓").when(rate == 1, "✗").otherwise(two_places(rate))
    return F.concat(text, F.when(primary & rate.isNotNull(), "†").otherwise(""))


def prefixed_id(tool: Column, test_id: Column, test_name: Column, nth: Column) -> Column:
    """`tool:id` of a finding, by its test's id, else its name, else its place; an id that has the prefix keeps it."""
    filled = lambda x: F.when(F.trim(x) != "", F.trim(x))
    base = F.coalesce(filled(test_id), filled(test_name), F.concat(F.lit("issue-"), nth.cast("string")))
    return F.when(base.startswith(F.concat(tool, F.lit(":"))), base).otherwise(F.concat(tool, F.lit(":"), base))


def focus_line(code: Column, line: Column) -> Column:
    """The line of a numbered snippet that has the given number, else its last one; number dropped, white space collapsed."""
    lines = F.filter(F.split(F.coalesce(code, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    parts = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)\s+", 1).try_cast("bigint").alias("n"), F.regexp_replace(x, r"^\s*\d+\s+", "").alias("s")))
    own = F.get(F.filter(parts, lambda p: p["n"] == line), F.lit(0))["s"]
    chosen = F.coalesce(own, F.get(parts, F.size(parts) - 1)["s"], F.lit(""))
    return F.trim(F.regexp_replace(chosen, r"\s+", " "))


def title(text: Column) -> Column:
    """The first `## ` line's text; empty if there is none."""
    return F.trim(F.regexp_extract(text, r"(?m)^[ \t]*## (.*)$", 1))


#: Beginnings of lines that tell a scenario's label.
LABEL_LINES = ("attack surface:", "attack surface group:", "difficulty:", "difficulty group:", "level:", "testing condition:", "condition axis:")


def unlabelled(text: Column, titles: bool = False) -> Column:
    """A scenario without the lines that tell its label and, if asked, without its title lines."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    label = lambda x: F.lower(F.trim(x)).rlike("^(?:" + "|".join(LABEL_LINES) + ")")
    keep = F.filter(lines, lambda x: ~(label(x) | (F.trim(x).startswith("## ") if titles else F.lit(False))))
    return stripped(F.array_join(keep, "\n"))


#: Spellings of review verdicts and of yes and no.
VERDICTS = {"TP": ("TP", "TRUE_POSITIVE", "TRUE-POSITIVE", "TRUE POSITIVE"), "FP": ("FP", "FALSE_POSITIVE", "FALSE-POSITIVE", "FALSE POSITIVE"), "UNCERTAIN": ("UNCERTAIN", "UNKNOWN", "MAYBE")}
YES, NO = ("true", "yes", "y", "1", "valid", "accepted", "credible"), ("false", "no", "n", "0", "invalid", "rejected", "not credible")


def verdict(x: Column) -> Column:
    """TP, FP or UNCERTAIN of a review's wording; null for anything else."""
    word = F.upper(F.trim(x))
    return F.coalesce(*[F.when(word.isin(*words), name) for name, words in VERDICTS.items()])


def yes_no(x: Column) -> Column:
    word = normal(x)
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def pair_kind(x: Column) -> Column:
    """contextualized, natural or invalid, by the words of a classification; unknown otherwise."""
    word = F.coalesce(F.regexp_replace(normal(x), "_", "-"), F.lit(""))
    return F.when(word.contains("context"), "contextualized").when(word.rlike("natural|direct"), "natural").when(word.rlike("invalid|reject|unsupported"), "invalid").otherwise("unknown")


def fenced(x: Column) -> Column:
    """The first fenced code block's text that isn't empty, python ones first; null if there is none."""
    found = lambda p: stripped(F.regexp_extract(x, p, 1))
    first, second = found(r"(?is)```python\s*(.*?)```"), found(r"(?is)```\s*(.*?)```")
    return F.when(first != "", first).when(second != "", second)


#: Keys that may name a repeat, and keys whose paths may.
RUN_KEYS = ("run_id", "trial_id", "replicate", "repeat", "seed", "rng_seed", "run", "fold")
PATH_KEYS = ("output_dir", "log_dir", "save_dir", "path", "file", "fname")


def run_name(columns: list[str]) -> Column:
    """What a record calls its repeat: its first filled key, else `run_3` or the like in its first path that has it, else `run_0`."""
    filled = lambda x: F.when(F.trim(x) != "", F.trim(x))
    keys = [filled(F.col(c).cast("string")) for c in RUN_KEYS if c in columns]
    paths = [filled(F.regexp_extract(F.col(c).cast("string"), r"(?i)((?:run|seed|trial)[_\-][0-9]+)", 1)) for c in PATH_KEYS if c in columns]
    return F.coalesce(*keys, *paths, F.lit("run_0"))
