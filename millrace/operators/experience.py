"""Years, degrees and seniority that a text asks for or shows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.extract import stated_years

#: Degrees by rank.
DEGREES = {"bachelor": 1, "master": 2, "doctor": 3, "phd": 3}
#: Levels by the least years that they mean.
LEVELS = ((5, "senior"), (3, "mid"), (0, "entry"))


def most_years(c: Column) -> Column:
    return F.array_max(stated_years(c))


def required_years(c: Column, wishes: Sequence[str] = ("preferred", "plus", "nice to have")) -> Column:
    """The most years on lines without a wish word; null without any."""
    lines = F.split(F.lower(F.coalesce(c, F.lit(""))), "\n")
    for wish in wishes:
        lines = F.filter(lines, _lacks(wish))
    return F.array_max(F.flatten(F.transform(lines, stated_years)))


def _lacks(part: str):
    return lambda line: ~line.contains(part)


def level(years: Column, levels: Sequence[tuple[int, str]] = LEVELS) -> Column:
    out = F.lit(None).cast("string")
    for least, name in reversed(levels):
        out = F.when(years >= least, F.lit(name)).otherwise(out)
    return out


def degree(c: Column, degrees: Mapping[str, int] = DEGREES) -> Column:
    """The highest rank named, 0 without one."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.greatest(F.lit(0), *[F.when(low.rlike(rf"(^|[^a-z]){name}"), rank).otherwise(0) for name, rank in degrees.items()])


def unmet(required: Column, shown: Column) -> Column:
    """Something is required and less, or nothing, is shown."""
    return F.coalesce(required > F.coalesce(shown, F.lit(0)), F.lit(False))
