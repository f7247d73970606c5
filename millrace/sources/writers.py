"""Sinks: JSONL, Parquet and Markdown rows. Replacements are written beside and swapped in by Spark's committer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def markdown(title: Column, fields: Mapping[str, Column], body: Column, heading: str = "Job Description") -> Column:
    """A record as Markdown: title, header lines, body under its heading. Empty values read `Not provided`."""
    clean = lambda c: F.coalesce(F.nullif(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")), F.lit("")), F.lit("Not provided"))
    lines = [F.concat(F.lit("# "), clean(title)), F.lit("")]
    lines += [F.concat(F.lit(f"{name}: "), clean(value)) for name, value in fields.items()]
    return F.concat_ws("\n", *lines, F.lit(""), F.lit(f"## {heading}"), F.lit(""), F.coalesce(body, F.lit("")))


def with_fields(text: Column, fields: Mapping[str, Column]) -> Column:
    """Markdown with header fields set: an existing line is replaced, a new one goes in behind the title."""
    out = text
    for name, value in fields.items():
        line = F.concat(F.lit(f"{name}: "), value)
        known = out.rlike(rf"(?mi)^{name}:.*$")
        replaced = F.regexp_replace(out, F.lit(rf"(?mi)^{name}:.*$"), F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))
        first, rest = F.element_at(F.split(out, "\n", 2), 1), F.coalesce(F.get(F.split(out, "\n", 2), F.lit(1)), F.lit(""))
        out = F.when(known, replaced).otherwise(F.concat(first, F.lit("\n"), line, F.lit("\n"), rest))
    return out
