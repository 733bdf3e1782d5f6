from pyspark.sql import functions as F

from finloom.operators import store
from finloom.streaming import events


def test_window_counts_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 50:02d}:00", i % 3) for i in range(200)] + [(999, "2024-01-03 00:00:00", 9)]
    batch = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    at = str(tmp_path / "in")
    batch.write.parquet(at)
    stream = events.window_counts(events.read_events(spark, at, batch.schema), "user_id", "10 minutes")
    events.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.start, r.user_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.principal, r.n) for r in store.rate_limited(batch.withColumnRenamed("user_id", "principal"), 0, "10 minutes").collect()}
    assert got == {w for w in want if w[1] != 9}  # the last window is still open


def test_deduplicated(spark, tmp_path):
    batch = spark.createDataFrame([("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:00:05"), ("k2", "2024-01-01 00:00:06")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    events.run_to_end(events.deduplicated(events.read_events(spark, str(tmp_path / "in"), batch.schema), ["k"]), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k1", "k2"]
