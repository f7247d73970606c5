"""Tracker tables: filter and sort, keyed insert, update, delete, follow-up, facets. A table is a DataFrame; changes give a new one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.graph import staged

#: Sort modes: the column that sorts, with what stands for null.
SORTS = {"score": ("match_score", -1), "created": ("created_at", None), "status": ("status", None)}


def rows(tracker: DataFrame, statuses: Sequence[str] | None = None, least_score: int | None = None, company: str | None = None, sort: str = "created", descending: bool = True) -> DataFrame:
    """Filtered and sorted rows; a null score counts as 0 in the filter and -1 in the sort. % and _ in company are wildcards."""
    out = tracker
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if least_score is not None:
        out = out.where(F.coalesce("match_score", F.lit(0)) >= least_score)
    if company:
        out = out.where(F.lower("company").like(f"%{company.lower()}%"))
    column, null = SORTS[sort]
    by = F.col(column) if null is None else F.coalesce(column, F.lit(null))
    return out.orderBy(by.desc() if descending else by.asc(), F.desc("id"))


def inserted(tracker: DataFrame, batch: DataFrame) -> DataFrame:
    """tracker and the batch rows whose URL it lacks, the first of each URL; rows without URL all go in. New ids follow the largest."""
    known = tracker.where("job_url <> ''").select("job_url").distinct()
    fresh = batch.join(known, "job_url", "left_anti")
    first = fresh.withColumn("_n", F.when(F.coalesce("job_url", F.lit("")) == "", 1).otherwise(F.row_number().over(Window.partitionBy("job_url").orderBy("batch_order")))).where("_n = 1").drop("_n")
    top = tracker.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    # numbered range by range: each range of batch_order counts on from the ranges before it
    spark = tracker.sparkSession
    ranged = staged(first.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch_order").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy("batch_order")))
    numbered = own.join(F.broadcast(before), "_range").join(F.broadcast(top)).withColumn("id", (F.col("_own") + F.col("_before") + F.col("_top")).cast("bigint"))
    return tracker.unionByName(numbered.select(*tracker.columns))


def with_status(tracker: DataFrame, ids: Column, status: str, now: Column) -> DataFrame:
    """Status set where ids holds; the first time it is `applied`, the date too."""
    date = F.when(ids & (F.lit(status) == "applied"), F.coalesce("applied_date", now)).otherwise(F.col("applied_date"))
    return tracker.withColumns({"status": F.when(ids, status).otherwise(F.col("status")), "applied_date": date})


def without(tracker: DataFrame, ids: Column) -> DataFrame:
    return tracker.where(~F.coalesce(ids, F.lit(False)))


def two_tier(left: DataFrame, right: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """left with .match: right's key by the first column, else the least by the second. Empty values match nothing."""
    exact = right.where(F.col(first) != "").groupBy(first).agg(F.min(key).alias("by_first"))
    loose = right.where(F.col(second) != "").groupBy(second).agg(F.min(key).alias("by_second"))
    return left.join(exact, first, "left").join(loose, second, "left").withColumn("match", F.coalesce("by_first", "by_second")).drop("by_first", "by_second")


def facets(df: DataFrame, coarse: str, fine: str) -> DataFrame:
    """(level, value, n): counts by coarse, by fine and of all, in one pass of grouping sets."""
    sets = df.groupingSets([[coarse], [fine], []], coarse, fine).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 1, coarse).when(F.col("_g") == 2, fine).otherwise("all")
    return sets.select(level.alias("level"), F.when(F.col("_g") == 1, F.col(coarse)).when(F.col("_g") == 2, F.col(fine)).alias("value"), "n")


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def upsert_seen(known: DataFrame, batch: DataFrame, key: Sequence[str], seen: str) -> DataFrame:
    """(key.., first_seen, last_seen, times): known rows of that shape brought up to date with a batch of (key.., seen)."""
    new = batch.groupBy(*key).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count("*").alias("times"))
    both = known.select(*key, "first_seen", "last_seen", "times").unionByName(new)
    return both.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times").alias("times"))


def latest_states(events: DataFrame, key: str, order: Sequence[str], action: str, clear: str) -> DataFrame:
    """The last event of each key, unless it clears the state. Found by aggregation, before any shuffle."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return last.select(key, "e.*").where(F.col(action) != clear)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows that break each rule; null counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    return counts.select(F.explode(pairs).alias("p")).select("p.rule", "p.violations")
