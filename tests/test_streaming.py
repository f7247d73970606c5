"""A replayed stream ends in the batch result."""

from millrace.operators.tracker import latest_states
from millrace.sources.readers import EVENT
from millrace.streaming import replay


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"t{i % 5}", "clear" if i % 7 == 0 else "label", None, str(i), None, None) for i in range(40)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = replay.states(replay.read_events(spark, str(tmp_path / "in"), EVENT, 1))
    run = stream.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    seen = latest_states(spark.table("states"), "task_id", ["sequence"], "action", "clear")
    batch = latest_states(spark.createDataFrame(rows, EVENT).select("task_id", "sequence", "action", "label"), "task_id", ["sequence"], "action", "clear")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, batch.collect()))


def test_table_sink(spark, tmp_path):
    rows = [(i, f"t{i % 3}", "label", None, str(i), None, None) for i in range(9)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run = replay.into_table(replay.read_events(spark, str(tmp_path / "in"), EVENT, 1), str(tmp_path / "out"), str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    last = spark.read.parquet(str(tmp_path / "out" / "version=1"))
    assert sorted(r.sequence for r in last.collect()) == [6, 7, 8]
