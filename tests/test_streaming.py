"""The queue's machine as keyed streaming state, and windows over a stream."""

import json
import os

from lexloom.streaming import jobs

LOG = "jobid string, event_time double, op string, channel string, priority int, serial long, timeout_s double, ttl_s double, error string, info string"


def test_job_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    source.mkdir()
    events = [("a", 0, "push"), ("a", 1, "pop"), ("a", 2, "finish"), ("b", 0, "push"), ("b", 500, "setinfo"), ("c", 0, "push"), ("c", 1, "kill")]
    (source / "1.json").write_text("\n".join(json.dumps({"jobid": j, "event_time": 1000.0 + at, "op": op, "channel": "x"}) for j, at, op in events))
    late = source / "2.json"
    late.write_text("\n".join(json.dumps({"jobid": j, "event_time": at, "op": "push", "channel": "x"}) for j, at in (("d", 1501.0), ("e", 9000.0))))
    os.utime(late, (late.stat().st_mtime + 60,) * 2)
    stream = jobs.job_stream(jobs.oldest_first(spark, str(source), LOG))
    q = stream.writeStream.format("memory").queryName("job_states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    got = {}
    for r in spark.sql("SELECT * FROM job_states").collect():
        got.setdefault(r.jobid, []).append(r.state)
    assert got["a"] == ["waiting", "running", "success", "gone"] and got["c"] == ["waiting", "killed", "gone"] and got["b"][0] == "waiting" and got["b"][-1] in ("timeout", "gone")
    # job d has no second event: the watermark, which job e moves, passes its deadline
    assert got["d"] == ["waiting", "timeout"]


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "v", 1.0), ("2024-01-01 00:50:00", "v", 2.0), ("2024-01-01 03:00:00", "v", 4.0)], "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = jobs.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.format("memory").queryName("window_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.sql("SELECT n FROM window_counts").collect()) == [1, 2]
