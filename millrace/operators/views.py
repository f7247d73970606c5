"""Review views: filters, orders, merged candidates, recent keys and facet options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked(c: Column, ranks: Sequence[str]) -> Column:
    """The place of a label from the end of an ordered list, best first; 0 for others."""
    out = F.lit(0)
    for i, name in enumerate(reversed(ranks), 1):
        out = F.when(c == name, i).otherwise(out)
    return out


def filtered(df: DataFrame, equal: Mapping[str, str | None] | None = None, least: Mapping[str, int] | None = None, hidden: Sequence[str] = (), search: str = "", columns: Sequence[str] = ()) -> DataFrame:
    """Optional filters together: equality without case, least values (null passes only at 0 and below), flags to hide, search words."""
    out = df
    for name, value in (equal or {}).items():
        if value:
            out = out.where(F.lower(name) == value.lower())
    for name, value in (least or {}).items():
        out = out.where(F.coalesce(F.col(name) >= value, F.lit(value <= 0)))
    for name in hidden:
        out = out.where(~F.coalesce(F.col(name), F.lit(False)))
    for word in search.lower().split():
        out = out.where(F.lower(F.concat_ws(" ", *columns)).contains(word))
    return out


def merged_candidates(rows: DataFrame, key: Column, levels: Sequence[str], group: Sequence[str]) -> DataFrame:
    """(group.., key, name, confidence, evidence, sources): candidates of one key with their strongest level and all distinct evidence.
    rows: (group.., pos, name, confidence, evidence). Evidence comes in order of first position."""
    strength = ranked(F.col("confidence"), levels)
    each = rows.withColumn("_key", key).groupBy(*group, "_key", "evidence").agg(F.min("pos").alias("pos"), F.max(F.struct(strength.alias("s"), (-F.col("pos")).alias("minus"), "name", "confidence")).alias("best"), F.count("*").alias("n"))
    out = each.groupBy(*group, "_key").agg(F.max("best").alias("best"), F.sort_array(F.collect_list(F.struct("pos", "evidence"))).alias("e"), F.sum("n").alias("sources"))
    return out.select(*group, F.col("_key").alias("key"), "best.name", "best.confidence", F.transform("e", lambda x: x["evidence"]).alias("evidence"), "sources")


def pushed(recent: Column, value: Column, limit: int = 10) -> Column:
    """A most-recently-used list with value moved to the front."""
    return F.slice(F.concat(F.array(value), F.array_remove(recent, value)), 1, limit)


def option_order(options: DataFrame, first: Sequence[str], top: int = 5) -> DataFrame:
    """(value, n, place): named values first, in their order, then the largest by count and name."""
    from pyspark.sql.window import Window

    named = F.coalesce(F.nullif(F.array_position(F.lit(list(first)), F.col("value")), F.lit(0)), F.lit(len(first) + 1))
    rest = options.withColumn("named", named).withColumn("by_size", F.row_number().over(Window.partitionBy((named > len(first)).alias("r")).orderBy(F.desc("n"), "value")))
    kept = rest.where((F.col("named") <= len(first)) | (F.col("by_size") <= top))
    return kept.select("value", "n", F.when(F.col("named") <= len(first), F.col("named")).otherwise(len(first) + F.col("by_size")).cast("int").alias("place"))
