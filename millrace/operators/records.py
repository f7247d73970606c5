"""Raw records to the canonical shape: nested fields flattened, ranges and lists rendered, gaps filled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text, urls


def first_filled(*columns: Column, default: str = "") -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], F.lit(default))


def salary_range(low: Column, high: Column, zero_is_missing: bool = True) -> Column:
    """`low - high`, `from low` or `up to high`; '' without both."""
    have = lambda c: c.isNotNull() & ((c != 0) | F.lit(not zero_is_missing))
    whole = lambda c: F.bround(c, 0).cast("bigint").cast("string")
    return (
        F.when(have(low) & have(high), F.concat(whole(low), F.lit(" - "), whole(high)))
        .when(have(low), F.concat(F.lit("from "), whole(low)))
        .when(have(high), F.concat(F.lit("up to "), whole(high)))
        .otherwise("")
    )


def salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """The range with currency before and period behind it; zeros count."""
    span = salary_range(low, high, zero_is_missing=False)
    return F.when(span == "", "").otherwise(F.concat_ws(" ", F.nullif(first_filled(currency), F.lit("")), span, F.nullif(F.lower(first_filled(period)), F.lit(""))))


def place(city: Column, state: Column, country: Column, remote: Column | None = None) -> Column:
    """City, state and country joined; Remote instead where nothing else is known."""
    parts = F.concat_ws(", ", *[F.nullif(first_filled(c), F.lit("")) for c in (city, state, country)])
    return parts if remote is None else F.when((parts == "") & F.coalesce(remote, F.lit(False)), "Remote").otherwise(parts)


def requirements_tail(description: Column, headings: Sequence[str] = ("requirements", "qualifications", "skills"), limit: int = 1200) -> Column:
    """The description from the first heading word on, cut to limit."""
    found = F.regexp_extract(F.coalesce(description, F.lit("")), rf"(?is)\b((?:{'|'.join(headings)})\b.*)$", 1)
    return F.substring(F.trim(found), 1, limit)


def canonical(raw: DataFrame, fields: Mapping[str, Sequence[Column]], source: str) -> DataFrame:
    """Records with every field the first filled of its columns, clean text and a sanitised URL. Limits come after normalisation."""
    made = {name: first_filled(*columns) for name, columns in fields.items()}
    for name in ("title", "company", "location", "description", "requirements"):
        if name in made:
            made[name] = text.clean_html(made[name])
    if "url" in made:
        made["url"] = urls.sanitized(made["url"])
    return raw.select(F.lit(source).alias("source"), *[c.alias(n) for n, c in made.items()])


def labelled(parts: Mapping[str, Column]) -> Column:
    """`Label: value` lines of the filled parts."""
    lines = F.array(*[F.concat(F.lit(f"{name}: "), first_filled(c)) for name, c in parts.items()])
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(r":\s*$")), "\n")


def list_text(values: Column) -> Column:
    """Array elements, trimmed and distinct, joined to sentences."""
    return F.array_join(F.array_distinct(F.filter(F.transform(values, lambda x: F.btrim(x, F.lit(" ."))), lambda x: x != "")), ". ")


def distinct_union(*arrays: Column, limit: int | None = None) -> Column:
    """Elements of all arrays in order, the first of those equal without case, blanks out."""
    every = F.filter(F.transform(F.concat(*arrays), lambda x: F.trim(x)), lambda x: x != "")

    def unlike(xs: Column) -> Column:
        low = F.transform(xs, lambda x: F.lower(x))
        return F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    out = F.transform(F.array(every), unlike)[0]
    return F.slice(out, 1, limit) if limit else out


def as_bool(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("1", "true", "yes", "y")


def as_int(c: Column) -> Column:
    """A whole number, 0 where there is none."""
    return F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*(-?[0-9]{1,9})\s*$", 1), F.lit("S999999999")).cast("int"), F.lit(0))
