"""Transparent weighted scoring: category breakdown, score, calibration, confidence, gates and recommendation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """A demand counts as much as its kind says; adjacent evidence counts in part."""

    required: float = 1.0
    preferred: float = 0.5
    direct: float = 1.0
    adjacent: float = 0.6


def match_strength(direct: Column, adjacent: Column, weights: Weights = Weights()) -> Column:
    return F.when(direct, weights.direct).when(adjacent, weights.adjacent).otherwise(0.0)


def breakdown(demands: DataFrame, key: str, weights: Weights = Weights()) -> DataFrame:
    """(key, category, possible, earned, demands): earned points of each category with any demand.

    demands: (key, category, points, demand, strength) with a row per demanded keyword. Sums are of hundredths, so that
    their order does not matter."""
    weight = F.when(F.col("demand") == "required", weights.required).otherwise(weights.preferred)
    cents = lambda c: F.bround(c * 100, 0).cast("long")
    sums = demands.groupBy(key, "category", "points").agg(F.sum(cents(weight)).alias("w"), F.sum(cents(weight * F.col("strength"))).alias("s"), F.count("*").alias("demands"))
    return sums.select(key, "category", F.col("points").alias("possible"), F.bround(F.col("points") * F.col("s") / F.col("w"), 1).alias("earned"), "demands")


def coverage(parts: DataFrame, key: str) -> DataFrame:
    """(key, coverage, active): 100 times earned over possible points of the active categories, half-even."""
    tenths = F.sum(F.bround(F.col("earned") * 10, 0).cast("long"))
    return parts.groupBy(key).agg(F.bround(F.least(F.greatest(10.0 * tenths / F.sum("possible"), F.lit(0.0)), F.lit(100.0)), 0).cast("int").alias("coverage"), F.sum("demands").alias("evidence"), F.count("*").alias("active"))


def focused(score: Column, alignment: Column) -> Column:
    """At most a blend of three quarters score and one quarter alignment; without alignment the score stays."""
    return F.when(alignment.isNull(), score).otherwise(F.least(score, F.bround(0.75 * score + 0.25 * alignment, 0).cast("int")))


def calibrated(score: Column, demands: Column, role: Column | None = None, incomplete: Column | None = None, full: int = 4) -> Column:
    """Scores above 50 shrink toward it while fewer than `full` signals back them, half-even: 1 of 1 gives 62.

    Signals are the demands and, if a role is known (1), one more; an incomplete posting has 3 at most."""
    signals = demands + (F.lit(0) if role is None else role)
    if incomplete is not None:
        signals = F.when(incomplete, F.least(signals, F.lit(3))).otherwise(signals)
    share = F.least(signals / float(full), F.lit(1.0))
    return F.when((score > 50) & (share < 1), F.least(score, F.bround(50 + (score - 50) * share, 0).cast("int"))).otherwise(score)


def confidence(words: Column, demands: Column) -> Column:
    """low below 20 words or 4 demands, high from 8 demands."""
    return F.when((words < 20) | (demands < 4), "low").when(demands >= 8, "high").otherwise("medium")


#: Least score of each recommendation, best first.
BANDS = ((80, "Apply"), (65, "Apply / Maybe Apply"), (50, "Maybe Apply"))


def band(score: Column, bands=BANDS, other: str = "Skip or Low Priority") -> Column:
    out = F.lit(other)
    for least, name in reversed(bands):
        out = F.when(score >= least, name).otherwise(out)
    return out


def recommendation(score: Column, eligibility: Column, level: Column) -> Column:
    """Eligibility first, then confidence, then the band."""
    return F.when(eligibility == "failed", "Skip / Not Eligible").when((eligibility == "manual_review") | (level == "low"), "Manual Review").otherwise(band(score))


def eligibility(*rules: tuple[str, Column, str]) -> tuple[Column, Column]:
    """(status, reasons) of rules (code, condition, outcome): failed beats manual_review beats passed."""
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond, _ in rules]))
    any_of = lambda outcome: F.exists(F.array(*[F.coalesce(c, F.lit(False)) for _, c, o in rules if o == outcome] or [F.lit(False)]), lambda x: x)
    return F.when(any_of("failed"), "failed").when(any_of("manual_review"), "manual_review").otherwise("passed"), reasons


def hidden_if_collapsed(rows: DataFrame, batch: str, score: str, least_rows: int = 5, ceiling: float = 0.02, least_range: float = 0.01) -> DataFrame:
    """rows with .collapsed: the batch is large enough, and its scores are all tiny and nearly equal."""
    stats = rows.groupBy(batch).agg(F.count(score).alias("n"), F.max(score).alias("most"), F.min(score).alias("least"))
    flag = (F.col("n") >= least_rows) & (F.col("most") < ceiling) & (F.col("most") - F.col("least") < least_range)
    return rows.join(stats.select(batch, flag.alias("collapsed")), batch)
