"""What the operators share: the shared folder, written tables and split points."""

from __future__ import annotations

import bisect
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the operators' contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only on one machine, where the session names none (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: it cuts lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table that stays for the session's other plans."""
    return stored(df, tag)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_points(df: DataFrame, key: str, n: int) -> list[int]:
    """About n - 1 ascending values that part the rows evenly by key. One pass over the key column; n numbers reach the driver."""
    if n < 2:
        return []
    cuts = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)
    return sorted({int(c) for c in cuts})


def bucket_of(key: Column, cuts: Sequence[int]) -> Column:
    """How many of the ascending cuts are <= key, in about 2 * sqrt(len(cuts)) comparisons. Null keys fall in bucket 0."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [list(cuts[i : i + step]) for i in range(0, len(cuts), step)]
    heads = F.lit([int(g[0]) for g in groups])
    # the group that holds the answer is the last whose head is <= key
    at = F.size(F.filter(heads, lambda c: c <= key))
    longs = F.array(*[F.lit([int(x) for x in g]) for g in groups])
    inside = F.size(F.filter(F.element_at(longs, F.greatest(at, F.lit(1))), lambda c: c <= key))
    return F.when(key.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * step + inside).cast("int")


def bucket_index(cuts: Sequence[int], key: int) -> int:
    """bucket_of in Python, for code that already runs there."""
    return bisect.bisect_right(cuts, key)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of an id written as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m
