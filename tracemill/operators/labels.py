"""Labels, ordered domains, selections and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import texts as T

#: Difficulties in order, their spellings and their groups.
DIFFICULTIES = ["very easy", "easy", "medium", "hard", "very hard"]
SPELLINGS = {"veryeasy": "very easy", "very easy": "very easy", "easy": "easy", "medium": "medium", "hard": "hard", "veryhard": "very hard", "very hard": "very hard"}
GROUPS = {"very easy": "Very Easy/Easy", "easy": "Very Easy/Easy", "medium": "Medium", "hard": "Hard/Very Hard", "very hard": "Hard/Very Hard"}


#: Attack surfaces in order, with their weights, and their further names (accents dropped, `et` as `&`).
SURFACES = {
    "User Inputs & Data": 1.0,
    "Web Outputs & Rendering": 1.4,
    "Storage & Filesystem": 1.8,
    "Authentication & Access Control": 2.2,
    "Data Exchange & External Services": 2.6,
    "Execution Environment & Infrastructure": 3.0,
}
SURFACE_NAMES = {
    "user input & data": "User Inputs & Data",
    "entrees & donnees utilisateur": "User Inputs & Data",
    "web output & rendering": "Web Outputs & Rendering",
    "sorties web & affichage": "Web Outputs & Rendering",
    "stockage & systeme de fichiers": "Storage & Filesystem",
    "authentification & controle d'acces": "Authentication & Access Control",
    "echanges de donnees & services externes": "Data Exchange & External Services",
    "environnement d'execution & infrastructure": "Execution Environment & Infrastructure",
}


def plain_name(x: Column) -> Column:
    """A label's spelling: one case, single spaces, no accents, a straight apostrophe, `et` as `&`."""
    return F.regexp_replace(F.translate(T.normal(x), "éèêëàâôîïûç’", "eeeeaaoiiuc'"), " et ", " & ")


def difficulty_dimension(spark) -> DataFrame:
    """spelling, difficulty, rank, group label, weight and the next harder label (the hardest keeps itself)."""
    rows = [(s, d, DIFFICULTIES.index(d), GROUPS[d], S.DIFFICULTY_WEIGHT[d], DIFFICULTIES[min(4, DIFFICULTIES.index(d) + 1)]) for s, d in SPELLINGS.items()]
    return spark.createDataFrame(rows, "spelling string, difficulty string, rank int, axis string, weight double, harder string")


def surface_dimension(spark) -> DataFrame:
    """spelling, surface, rank from 1 on, weight and the next surface (the last keeps itself)."""
    names = list(SURFACES)
    rows = [(s, x, names.index(x) + 1, SURFACES[x], names[min(names.index(x) + 1, len(names) - 1)]) for s, x in ({n.lower(): n for n in names} | SURFACE_NAMES).items()]
    return spark.createDataFrame(rows, "spelling string, surface string, rank int, weight double, next string")


def resolve_difficulty(df: DataFrame, column: str) -> DataFrame:
    """Rows with the difficulty that a free spelling means, `unknown` for none; the dimension has seven rows."""
    dim = F.broadcast(difficulty_dimension(df.sparkSession))
    return df.withColumn("spelling", T.normal(F.col(column))).join(dim, "spelling", "left").withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown"))).drop("spelling")


def resolve_surface(df: DataFrame, column: str) -> DataFrame:
    """Rows with the attack surface that a free spelling means: `unknown`, rank 0, weight 1 and the first surface next for none; the dimension has fourteen rows."""
    dim = F.broadcast(surface_dimension(df.sparkSession))
    out = df.withColumn("spelling", plain_name(F.col(column))).join(dim, "spelling", "left").drop("spelling")
    return out.withColumns({"surface": F.coalesce("surface", F.lit("unknown")), "rank": F.coalesce("rank", F.lit(0)), "weight": F.coalesce("weight", S.num(1)), "next": F.coalesce("next", F.lit(next(iter(SURFACES))))})


def by_name(x: Column, names: dict[str, str]) -> Column:
    """What a spelling stands for; null for none."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x)


def succeeded(definition: str) -> Column:
    """What counts as success: `final`, `sast_clean` (no finding left) or `one_shot` (at the first attempt)."""
    return {"final": F.col("success"), "sast_clean": F.col("total_issues") == 0, "one_shot": F.col("success") & (F.col("attempts") == 1)}[definition]


def threshold_or_top(df: DataFrame, value: str, least: float, k: int, key: str) -> DataFrame:
    """Rows that reach the threshold, or the k best where none does."""
    best = Window.orderBy(F.desc(value), key)
    top = df.orderBy(F.desc(value), key).limit(k).withColumn("nth", F.row_number().over(best))
    reached = df.where(F.col(value) >= least)
    some = reached.agg((F.count("*") > 0).alias("some"))
    return reached.unionByName(top.crossJoin(F.broadcast(some)).where("not some").drop("some", "nth"))


def duplicate_tokens(text: Column, stop: list[str]) -> Column:
    """Words by which two findings' descriptions are compared: three letters or more, no digits, no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9]") & ~w.startswith("cwe") & ~w.isin(stop)))


def test_counters(output: Column) -> tuple[Column, Column, Column]:
    """Passed, failed and erroneous tests of a unit test run's output."""
    n = lambda p: F.coalesce(F.regexp_extract(output, p, 1).try_cast("int"), F.lit(0))
    ran, failed, errors = n(r"Ran (\d+) tests?"), n(r"failures=(\d+)"), n(r"errors=(\d+)")
    return F.greatest(ran - failed - errors, F.lit(0)), failed, errors


def cut(text: Column, most: int, mark: str = "...[cut]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def steering(rows: DataFrame, most: int = 6) -> DataFrame:
    """A short record of each failed run: reason, first ids of the final scan, what persists, one sentence."""
    ids = F.slice("final_ids", 1, most)
    sentence = F.concat(F.lit("Run failed with "), "primary_reason", F.when(F.size("persistent_ids") > 0, F.concat(F.lit("; still open: "), F.array_join(F.slice("persistent_ids", 1, 3), ", "))).otherwise(F.lit("")), F.lit("."))
    return rows.where("not success").select("run_id", "primary_reason", F.array_join(ids, "|").alias("ids"), sentence.alias("summary"))


def family(column: str, names: dict[str, str]) -> Column:
    """A family label, the value itself where none is known."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(column)), F.col(column))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlations as rows (a, b, r), in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def unused(universe: DataFrame, used: DataFrame, *keys: str) -> DataFrame:
    return universe.join(used.select(*keys).distinct(), list(keys), "left_anti")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")
