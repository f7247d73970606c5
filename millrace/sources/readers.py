"""Readers of records in Markdown, JSON, JSONL and Parquet, with explicit schemas. Paths go through Spark, so any store works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a missing header value.
NOT_PROVIDED = "not provided"

#: The canonical record: text fields, all nullable.
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "source_id", "title", "company", "location", "url", "salary", "description", "requirements", "posted_at", "employment_type", "fetched_at")])
EVENT = T.StructType([T.StructField("sequence", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("task_id", "action", "selected_id", "label", "note", "created_at")]])


def text_files(spark: SparkSession, path: str, pattern: str = "*.md", search: str | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """(path, text) of files below path; search is a substring of the path, skip are path segments that exclude a file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    rows = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if search:
        rows = rows.where(F.lower("path").contains(search.lower()))
    for segment in skip:
        rows = rows.where(~F.array_contains(F.split("path", "/"), segment))
    return rows


def header(text: Column, name: str, mode: str = "first", default: str = "") -> Column:
    """The value of a `Name: value` line before the first `##` heading.

    first: the first value that is neither empty nor `not provided`; strict: the first line's value, whatever it is;
    last: the last line's value; blank: the first line's value, `not provided` as ''."""
    top = F.element_at(F.split(F.coalesce(text, F.lit("")), r"\n##\s"), 1)
    values = F.transform(F.regexp_extract_all(top, F.lit(rf"(?mi)^{name}:[ \t]*(.*)$"), F.lit(1)), lambda x: F.trim(x))
    if mode == "first":
        values = F.filter(values, lambda v: (v != "") & (F.lower(v) != NOT_PROVIDED))
    found = F.get(values, F.size(values) - 1) if mode == "last" else F.get(values, F.lit(0))
    if mode == "blank":
        found = F.when(F.lower(found) == NOT_PROVIDED, "").otherwise(found)
    return F.coalesce(found, F.lit(default))


def body(text: Column, heading: str = "Job Description") -> Column:
    """What follows the heading, or the whole text without it."""
    after = F.regexp_extract(text, rf"(?is)\n##\s*{heading}\s*\n(.*)$", 1)
    return F.when(after == "", text).otherwise(F.trim(after))


def markdown_records(files: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(path, a column per header field, body)."""
    return files.select("path", *[header(F.col("text"), f).alias(f.lower().replace(" ", "_")) for f in fields], body(F.col("text")).alias("body"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSONL file; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def enveloped(rows: DataFrame, array: Column) -> DataFrame:
    """The elements of an envelope's array as rows, limited by nothing: limits are the caller's."""
    return rows.select(F.explode(array).alias("r")).select("r.*")


def capped(limit: int, least: int = 1, most: int = 20) -> int:
    """A row limit within the providers' bounds."""
    if limit < least:
        raise ValueError(f"at least {least} rows must be asked for")
    return min(limit, most)
