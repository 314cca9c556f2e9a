from __future__ import annotations

from pyspark.sql import functions as F

from tessella.streaming.batches import TableSink, apply_changes, windowed_counts

TABLE = "_id string, seq long, n long"


def test_changes_are_folded_once(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = lambda *r: spark.createDataFrame(list(r), f"op string, {TABLE}").coalesce(1).write.mode("append").parquet(src)
    sink = TableSink(spark, f"{tmp_path}/out", TABLE)
    go = lambda: apply_changes(spark.readStream.schema(f"op string, {TABLE}").parquet(src), sink, f"{tmp_path}/ck").awaitTermination()
    rows(("put", "a", 1, 10), ("put", "b", 2, 20), ("put", "a", 3, 11))
    go()
    assert sorted(tuple(r) for r in sink.read().collect()) == [("a", 3, 11), ("b", 2, 20)]
    rows(("delete", "b", 4, None), ("put", "c", 5, 30))
    go()
    want = [("a", 3, 11), ("c", 5, 30)]
    assert sorted(tuple(r) for r in sink.read().collect()) == want
    last = sink.versions()[-1]
    sink.fold(spark.createDataFrame([("delete", "b", 4, None), ("put", "c", 5, 30)], f"op string, {TABLE}"), last)  # tried again
    assert sorted(tuple(r) for r in sink.read().collect()) == want


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y"), ("2024-01-01 09:00:00", "z")], "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").coalesce(1).write.parquet(f"{tmp_path}/e")
    q = windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/e"), "ts", "k").writeStream.outputMode("append").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r["count"]) for r in spark.table("wc").collect()} == {("x", 2), ("y", 1)}
