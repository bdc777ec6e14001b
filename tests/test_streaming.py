"""Stateful stream: last writer wins, deletes, expiry by watermark."""

import datetime as dt

from lodestrata.streaming.ttl import live_changes

SCHEMA = "key string, seq bigint, is_delete boolean, value string, expires_at bigint, ts timestamp"


def test_live_changes(spark, tmp_path):
    def at(s):
        return dt.datetime.fromtimestamp(s)

    batches = [
        [("a", 1, False, "a1", 0, at(1000)), ("b", 2, False, "b2", 1500, at(1000)), ("c", 3, False, "c3", 0, at(1000)), (None, 4, False, "x", 0, at(1000))],
        [("a", 9, False, "a9", 0, at(1100)), ("a", 5, False, "a5", 0, at(1050)), ("c", 6, True, None, 0, at(1100)), ("b", 2, False, "b2", 1500, at(1000))],
        [("d", 10, False, "d10", 0, at(9000))],  # moves the watermark past 1500
        [("c", 2, False, "late", 0, at(9000)), ("b", 1, False, "late", 0, at(9000))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "b[0-9]"))
    seen = []

    def collect(df, number):
        seen.extend(tuple(r) for r in df.collect())

    q = live_changes(stream, "ts", "0 seconds").writeStream.outputMode("update").foreachBatch(collect)
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for key, seq, value, status in seen:
        last[key] = (seq, value, status)
    assert last == {"a": (9, "a9", "live"), "b": (2, None, "expired"), "c": (6, None, "deleted"), "d": (10, "d10", "live")}


def test_tombstones_are_forgotten_after_their_retention(spark, tmp_path):
    def at(s):
        return dt.datetime.fromtimestamp(s)

    batches = [
        [("a", 5, True, None, 0, at(1000)), ("b", 5, True, None, 0, at(1000))],
        [("a", 4, False, "a4", 0, at(1010))],  # older than the delete
        [("z", 1, False, "z", 0, at(5000))],  # past the retention of both
        [("z", 2, False, "z", 0, at(5001))],
        [("a", 4, False, "a4", 0, at(5002))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b[0-9]"))
    seen = []
    q = live_changes(stream, "ts", "0 seconds", retention_seconds=600).writeStream.outputMode("update")
    q = q.foreachBatch(lambda df, number: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert [r for r in seen if r[0] == "a"] == [("a", 5, None, "deleted"), ("a", 4, "a4", "live")]
