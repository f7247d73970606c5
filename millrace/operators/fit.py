"""Fit of a candidate's text to a posting's text: demands, coverage, eligibility, confidence and a recommendation.

Every pair is scored in its own row, in Python batches (fit_scorer); nothing is shuffled. Vocabularies are parameters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text, vocabulary
from millrace.operators.extract import bound
from millrace.operators.fit_scorer import Scorer


@dataclass(frozen=True)
class FitRules:
    keywords: Mapping[str, Sequence[str]] = field(default_factory=lambda: vocabulary.KEYWORDS)
    categories: Mapping[str, tuple[int, Sequence[str]]] = field(default_factory=lambda: vocabulary.CATEGORIES)
    adjacent: Mapping[str, Sequence[str]] = field(default_factory=lambda: vocabulary.ADJACENT)
    preferred: Sequence[str] = vocabulary.PREFERRED
    level_category: str = "Experience level fit"
    level_coverage: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: vocabulary.LEVEL_COVERAGE)
    focus: Mapping[str, tuple[Sequence[str], Sequence[str]]] = field(default_factory=lambda: vocabulary.ROLE_FOCUS)
    #: (pattern over the normalised posting, points)
    penalties: Sequence[tuple[str, int]] = ()
    required_weight: float = 1.0
    preferred_weight: float = 0.5
    partial: float = 0.6


def candidate_profile(c: Column) -> Column:
    """(level, years, degree, n_evidence) that a candidate's text states."""
    return bound(F.struct(text.fit_text(c).alias("norm"), F.lower(F.coalesce(c, F.lit(""))).alias("low")), lambda x: _profile(x["norm"], x["low"]))


def _profile(norm: Column, low: Column) -> Column:
    level = F.lit(None).cast("string")
    for name, pattern in reversed(vocabulary.CAREER_LEVELS.items()):
        level = F.when(norm.rlike(pattern), F.lit(name)).otherwise(level)
    level = F.coalesce(level, F.when(norm.rlike(r"\b(?:intern|internship)\b"), F.lit("student")))
    stated = F.regexp_extract_all(low, F.lit(r"\b(\d+(?:\.\d+)?)\+?\s*(?:years|yrs)\s+(?:of\s+)?(?:professional\s+|work\s+)?experience\b"), F.lit(1))
    years = F.array_max(F.transform(stated, lambda x: x.cast("double")))
    degree = F.lit("unknown")
    for name, pattern in reversed(vocabulary.DEGREES.items()):
        degree = F.when(norm.rlike(pattern), F.lit(name)).otherwise(degree)
    made = F.struct(level.alias("level"), years.alias("years"), degree.alias("degree"))
    by_years = lambda p: F.when(p["years"] >= 5, "senior").when(p["years"] >= 3, "mid").when(p["years"].isNotNull(), "junior").otherwise("unknown")
    count = lambda p: p["level"].isNotNull().cast("int") + p["years"].isNotNull().cast("int") + (p["degree"] != "unknown").cast("int")
    return bound(made, lambda p: F.struct(F.coalesce(p["level"], by_years(p)).alias("level"), p["years"].alias("years"), p["degree"].alias("degree"), count(p).alias("n_evidence")))


_TEXTS = pa.list_(pa.string())


def _struct(**members: pa.DataType) -> pa.DataType:
    return pa.struct(members)


#: Members of the result.
FIT = {
    "score": pa.int32(),
    "coverage_score": pa.int32(),
    "observed_score": pa.int32(),
    "focus": _struct(title=pa.string(), focus=pa.string(), score=pa.int32(), matched=_TEXTS),
    "eligibility": pa.string(),
    "codes": _TEXTS,
    "confidence": pa.string(),
    "doubts": _TEXTS,
    "active": pa.int32(),
    "evidence": pa.int32(),
    "profile": _struct(level=pa.string(), years=pa.float64(), degree=pa.string(), n_evidence=pa.int32()),
    "quality": _struct(
        label=pa.string(), score=pa.int32(), n_words=pa.int64(), sections=_TEXTS, requirements=pa.int64(), responsibilities=pa.int64(), boilerplate=pa.float64(),
        **dict.fromkeys(("truncated", "saved", "full", "snippet", "ready", "incomplete", "provisional"), pa.bool_()), sure=pa.string(), reasons=_TEXTS,
    ),
    "breakdown": pa.list_(_struct(category=pa.string(), possible=pa.int32(), earned=pa.float64(), matched=_TEXTS, partial=_TEXTS, missing=_TEXTS)),
    "required": _TEXTS,
    "preferred": _TEXTS,
    "recommendation": pa.string(),
    "flags": _TEXTS,
}


def _shaped(value, kind: pa.DataType):
    """Tuples as the dicts that Arrow takes for structs."""
    if value is not None and pa.types.is_struct(kind):
        return {x.name: _shaped(part, x.type) for x, part in zip(kind, value, strict=True)}
    return [_shaped(x, kind.value_type) for x in value] if value is not None and pa.types.is_list(kind) else value


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """values as an Arrow array; equal ones among nested values are put in shape once."""
    if not pa.types.is_nested(kind):
        return pa.array(values, kind)
    places: dict = {}
    at = [places.setdefault(x, len(places)) for x in values]
    return pa.array([_shaped(x, kind) for x in places], kind).take(pa.array(at, pa.int32()))


def _sql(kind: pa.DataType) -> str:
    if pa.types.is_struct(kind):
        return f"struct<{','.join(f'{x.name}:{_sql(x.type)}' for x in kind)}>"
    if pa.types.is_list(kind):
        return f"array<{_sql(kind.value_type)}>"
    return {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string"}[kind]


def scored(rows: DataFrame, job: str, candidate: str, rules: FitRules = FitRules(), members: Sequence[str] = tuple(FIT)) -> DataFrame:
    """rows with a struct column `fit`: scores, role focus, eligibility, confidence, quality, recommendation, breakdown, demands and flags.

    members: those of FIT that are wanted; fewer cost less. Patterns of rules are Python's."""
    kinds = {x: FIT[x] for x in members}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = Scorer(rules)
        for jobs, candidates in batches:
            found = [scorer.score(*pair) for pair in zip(jobs.to_pylist(), candidates.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([_column([x[name] for x in found], kind) for name, kind in kinds.items()], fields=[pa.field(*x) for x in kinds.items()])

    fit = F.arrow_udf(run, _sql(pa.struct(kinds)))
    return rows.withColumn("fit", fit(F.col(job), F.col(candidate)))
