"""The run store as a stream against the batch report at each watermark."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.operators import grid
from lodestone.streaming import runs

START = dt.datetime(2024, 1, 1)


def test_live_runs_at_each_point_in_time(spark, tmp_path):
    rng = random.Random(3)
    rows, at = [], 0
    for i in range(60):
        at += rng.choice([1, 5, 30, 400])
        rows.append((rng.choice("ab"), f"r{i:02d}", START + dt.timedelta(seconds=at)))
    folder, done = str(tmp_path / "in"), []
    schema = "owner string, run_id string, ts timestamp"
    for k in range(0, 60, 20):  # three micro-batches, one after another, on one checkpoint
        done += rows[k : k + 20]
        spark.createDataFrame(rows[k : k + 20], schema).coalesce(1).write.mode("append").parquet(folder)
        events = runs.replay(spark, spark.readStream.schema(schema).parquet(folder), 5, 600, str(tmp_path / "store"))
        now = max(t for *_, t in done)
        for owner in "ab":
            table = spark.createDataFrame(done, schema).where(F.col("owner") == owner)
            want = [r.run_id for r in grid.live_runs(table, F.lit(now), 600, 5).collect()]
            got = [r.run_id for r in runs.live(events).where(F.col("owner") == owner).orderBy("place").collect()]
            assert got == want, (k, owner)
    kinds = {r.event for r in events.select("event").distinct().collect()}
    assert kinds == {"opened", "evicted", "expired"}
