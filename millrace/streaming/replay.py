"""Event log replay as a stream: the last event by sequence decides a key's state; late events need no watermark for that."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.tracker import latest_states

STATE = T.StructType([T.StructField("sequence", T.LongType()), T.StructField("action", T.StringType()), T.StructField("label", T.StringType())])
OUT = T.StructType([T.StructField("task_id", T.StringType()), *STATE.fields])


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get if state.exists else None
    for events in batches:
        row = events.loc[events["sequence"].idxmax()]
        if best is None or row["sequence"] > best[0]:
            best = (int(row["sequence"]), row["action"], row["label"])
    state.update(best)
    yield pd.DataFrame([(key[0], *best)], columns=[f.name for f in OUT.fields])


def states(events: DataFrame) -> DataFrame:
    """A row per key and trigger with the state so far; use outputMode update. `clear` stays as a row, for readers to drop."""
    rows = events.select("task_id", "sequence", "action", "label")
    return rows.groupBy("task_id").applyInPandasWithState(_latest, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n) with a watermark that drops later events' windows from the state."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n")


def into_table(events: DataFrame, path: str, checkpoint: str):
    """A foreachBatch sink: every trigger's events are merged with the table written before, as one new version of it."""

    def merge(batch: DataFrame, version: int) -> None:
        spark, new = batch.sparkSession, batch.select("task_id", "sequence", "action", "label")
        if version:
            new = new.unionByName(spark.read.schema(new.schema).parquet(f"{path}/version={version - 1}"))
        latest_states(new, "task_id", ["sequence"], "action", "").write.mode("overwrite").parquet(f"{path}/version={version}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
