"""A run store as keyed state: each owner's newest runs, which expire by event time.

Every owner's runs stand in a map state (run -> time) with one timer each. A run that comes is kept and announced as
`opened`; what exceeds `most` by time (ties: the larger id goes first) leaves as `evicted`, and when the watermark passes a
run's time to live it leaves as `expired`. Newer runs live longer than older ones, so what was evicted would not come back,
and the live runs at a watermark are those that grid.live_runs gives for that time. State holds `most` runs an owner, on the
state store's machines (RocksDB), however many come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "owner string, run_id string, ts timestamp, event string"


class RunStore(StatefulProcessor):
    def __init__(self, most: int, ttl_seconds: float):
        self.most, self.ttl = most, int(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run_id string", "us bigint")

    def _live(self) -> dict[str, int]:
        """Runs and their times in microseconds."""
        return {k[0]: v[0] for k, v in self.runs.iterator()}

    @staticmethod
    def _rows(owner: str, found: list[tuple[int, str, str]]) -> pd.DataFrame:
        return pd.DataFrame({"owner": [owner] * len(found), "run_id": [r for _, r, _ in found], "ts": pd.to_datetime([t for t, _, _ in found], unit="us"), "event": [e for _, _, e in found]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """An owner's runs are read once, what comes is placed among them a batch at a time, and the differences are written."""
        found, passed, before = [], timerValues.getCurrentWatermarkInMs() * 1000, self._live()
        now = dict(before)
        for part in rows:
            for run, us in zip(part["run_id"], part["ts"].astype("datetime64[us]").astype("int64").tolist(), strict=True):
                if us + self.ttl >= passed and run not in now:
                    now[run] = us
                    found.append((us, run, "opened"))
            for run in sorted(now, key=lambda r: (-now[r], r))[self.most :]:
                found.append((now.pop(run), run, "evicted"))
        for run in before.keys() - now.keys():
            self.runs.removeKey((run,))
        for run in now.keys() - before.keys():
            self.runs.updateValue((run,), (now[run],))
            self.handle.registerTimer((now[run] + self.ttl) // 1000 + 1)
        if found:
            yield self._rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        found = [(us, run, "expired") for run, us in self._live().items() if us + self.ttl < passed]
        for _, run, _ in found:
            self.runs.removeKey((run,))
        if found:
            yield self._rows(key[0], found)

    def close(self) -> None:
        pass


def run_events(runs: DataFrame, most: int, ttl_seconds: float, late: str = "0 seconds") -> DataFrame:
    """owner, run_id, ts, event of a stream of runs (owner, run_id, ts)."""
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = runs.select(F.col("owner").cast("string"), F.col("run_id").cast("string"), "ts").withWatermark("ts", late)
    return rows.groupBy("owner").transformWithStateInPandas(RunStore(most, ttl_seconds), OUT, "Append", "eventTime")


def live(events: DataFrame) -> DataFrame:
    """The runs that were opened and have not left, newest first an owner, with their place."""
    w = Window.partitionBy("owner").orderBy(F.desc("ts"), "run_id")
    state = events.groupBy("owner", "run_id").agg(F.max("ts").alias("ts"), F.count_if(F.col("event") == "opened").alias("a"), F.count_if(F.col("event") != "opened").alias("b"))
    return state.where("a > b").select("owner", "run_id", "ts", F.row_number().over(w).cast("bigint").alias("place"))


def replay(spark: SparkSession, stream: DataFrame, most: int, ttl_seconds: float, folder: str, late: str = "0 seconds") -> DataFrame:
    """All events of what the stream holds now, written to a table below the folder and read back."""
    query = run_events(stream, most, ttl_seconds, late).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/events")
