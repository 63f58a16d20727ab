"""Scores as column expressions: intervals, risk, rewards and search values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def num(x: float) -> Column:
    return F.lit(float(x))


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(num(0), F.least(num(1), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), num(0))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The Wilson interval at 95 %; (0, 0) without observations."""
    n = n.cast("double")
    p = successes.cast("double") / F.nullif(n, num(0))
    denominator = 1 + Z * Z / F.nullif(n, num(0))
    centre = (p + Z * Z / (2 * F.nullif(n, num(0)))) / denominator
    half = Z * F.sqrt(p * (1 - p) / F.nullif(n, num(0)) + Z * Z / (4 * F.nullif(n * n, num(0)))) / denominator
    return tuple(F.coalesce(clamp01(x), num(0)) for x in (centre - half, centre + half))


def mean_ci(x: Column, clamp: bool = False) -> tuple[Column, Column]:
    """Aggregates: mean -+ 1.96 standard errors; a single value is its own interval."""
    half = F.coalesce(Z * F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")), num(0))
    low, high = F.avg(x) - half, F.avg(x) + half
    return (clamp01(low), clamp01(high)) if clamp else (low, high)


#: Weights of severity and confidence levels.
SEVERITY_WEIGHT = {"LOW": 1.0, "MEDIUM": 3.0, "HIGH": 6.0}
CONFIDENCE_WEIGHT = {"LOW": 1.0, "MEDIUM": 1.5, "HIGH": 2.0}
LEVELS = ("LOW", "MEDIUM", "HIGH")
TARGET_MULTIPLIER = 2.0


def by_level(level: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    out = num(default)
    for k, v in weights.items():
        out = F.when(level == k, num(v)).otherwise(out)
    return out


def level_rank(level: Column) -> Column:
    """1, 2, 3 for LOW, MEDIUM, HIGH; 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)).cast("int")


def issue_weight(severity: Column, confidence: Column, is_target: Column, multiplier: float = TARGET_MULTIPLIER) -> Column:
    w = by_level(severity, SEVERITY_WEIGHT) * by_level(confidence, CONFIDENCE_WEIGHT)
    return F.when(is_target, w * multiplier).otherwise(w)


def risk(weight_sum: Column, normalizer: float = 10.0) -> Column:
    """W / (W + N); 0 without weight."""
    w = F.coalesce(weight_sum, num(0))
    return F.when(w > 0, clamp01(w / (w + normalizer))).otherwise(num(0))


def judge_risk(overall: Column, target: Column, security: Column) -> Column:
    """The larger of overall and target risk; a missing overall risk is one minus the security score."""
    return clamp01(F.greatest(F.coalesce(overall, 1 - security), target))


def combined_risk(sast: Column, judge: Column, mode: str = "weighted", judge_weight: float = 0.4) -> Column:
    """Modes: `review_only` (scanner alone), `max`, `weighted`; the scanner's risk where the judge is silent."""
    if mode == "review_only":
        return clamp01(sast)
    both = F.greatest(sast, judge) if mode == "max" else sast * (1 - judge_weight) + judge * judge_weight
    return clamp01(F.when(judge.isNull(), sast).otherwise(both))


#: Reward weights of difficulties.
DIFFICULTY_WEIGHT = {"very easy": 1.0, "easy": 1.5, "medium": 2.0, "hard": 2.5, "very hard": 3.0}


def one_shot_reward(success: Column, weight: Column, max_weight: float = 3.0) -> Column:
    return clamp01((F.when(success, weight).otherwise(num(-1)) + 1) / (max_weight + 1))


def adaptive_reward(clean: Column, weight: Column, risk_: Column, gamma: float = 2.0, max_weight: float = 3.0) -> Column:
    """One attempt: weight if clean, else minus risk ** gamma; scaled to 0..1."""
    return clamp01((F.when(clean, weight).otherwise(-F.pow(risk_, num(gamma))) + 1) / (max_weight + 1))


def multi_attempt_reward(success: Column, weight: Column, failed: Column, error: Column, attempts: Column, fixer: Column, *, p_failed: float = 0.5, p_error: float = 0.5, p_attempt: float = 0.2, p_fixer: float = 0.3, max_attempts: int = 3, max_weight: float = 3.0) -> Column:
    """Weight of a success minus penalties for failed and erroneous shares, further attempts and the fixer; scaled to 0..1."""
    penalty = failed * p_failed + error * p_error + F.greatest(attempts - 1, F.lit(0)) * num(p_attempt) + F.when(fixer, num(p_fixer)).otherwise(num(0))
    most = p_failed + p_error + max(0, max_attempts - 1) * p_attempt + p_fixer
    return clamp01((F.when(success, weight).otherwise(num(0)) - penalty + most) / (max_weight + most))


def challenge_score(success_share: Column, attempts: Column, fixer: Column, *, lam: float = 1.0, gamma: float = 0.5, beta: float = 0.5, max_attempts: int = 5) -> Column:
    raw = (1 - success_share) * lam + F.greatest(attempts - 1, F.lit(0)) * num(gamma) + F.when(fixer, num(beta)).otherwise(num(0))
    return clamp01(raw / (lam + gamma * max(0, max_attempts - 1) + beta))


def performance_score(rate: Column, attempts: Column, fixed: Column) -> Column:
    """Blend of success rate, attempts and fixer use; attempts null or 0 means none succeeded."""
    penalty = F.when(attempts > 0, (attempts - 1) * 0.2).otherwise(num(0.6))
    return rate * 0.6 + (1 - penalty) * 0.25 + (1 - F.when(fixed, num(0.3)).otherwise(num(0))) * 0.15


def ucb1(value: Column, visits: Column, parent_visits: Column, parents: Column, weight: float = 1.414) -> Column:
    """Exploration counts only below several parents; an unvisited node is infinitely attractive."""
    total = F.when(parents > 1, parent_visits).otherwise(F.lit(1)).cast("double")
    explore = F.sqrt(F.log(F.greatest(total, num(1))) / F.nullif(visits.cast("double"), num(0)))
    return F.when(visits == 0, num(float("inf"))).otherwise(value + explore * weight)


def surface_priority(weighted_mean: Column, observations: Column, w_difficulty: float = 0.5, w_coverage: float = 0.3, w_uncertainty: float = 0.2) -> Column:
    signal = F.coalesce(1 - clamp01(weighted_mean), num(0.5))
    n = observations.cast("double")
    return signal * w_difficulty + w_coverage / (n + 1) + w_uncertainty / F.sqrt(n + 1)
