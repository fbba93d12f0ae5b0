"""Structured Streaming forms of the operational steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import time as T
from ..operators.grid import keep_last
from ..operators.lags import cutoff
from ..sources.files import existing, shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, one file a trigger."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")


def run_to_end(stream: DataFrame, mode: str, each) -> list[dict]:
    """Process what is there and stop; state and progress live in the shared folder. Returns the progress of each batch."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", shared_folder(stream.sparkSession))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return [dict(p) for p in query.recentProgress]


class DayTable:
    """Rows by key in versioned day partitions of the shared folder.

    A batch reads and rewrites the days that it touches, as its own version, and then names
    them in a manifest; a day's valid version is the last that the manifest names. A batch that runs
    again builds on the versions before it and overwrites its own, so it changes nothing.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: str, base: str | None = None):
        self.spark, self.keys, self.order = spark, keys, order
        self.base = base or shared_folder(spark)

    def versions(self, before: int | None = None) -> dict[str, int]:
        """The valid version of each day; ``before`` leaves out batches from that one on."""
        named = existing(self.spark, f"{self.base}/manifest")
        if named is None:
            return {}
        rows = named if before is None else named.where(F.col("batch") < before)
        return {r["day"]: r["v"] for r in rows.groupBy("day").agg(F.max("batch").alias("v")).collect()}  # one row a day

    def _days(self, versions: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.base}/data/batch={v}/_day={d}" for d, v in sorted(versions.items())]
        return self.spark.read.option("basePath", f"{self.base}/data").parquet(*paths).drop("batch", "_day") if paths else None

    def upsert(self, rows: DataFrame, day, batch: int) -> None:
        """Keep each key's row with the largest ``order`` of the stored ones and these; ``day`` is a date column of ``rows`` that the key decides."""
        new = rows.withColumn("_day", F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("none"))).persist()
        touched = [r["_day"] for r in new.select("_day").distinct().collect()]  # the days of one batch
        if touched:
            known = self.versions(batch)
            old = self._days({d: known[d] for d in touched if d in known})
            both = new if old is None else new.unionByName(old.withColumn("_day", F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("none"))))
            keep_last(both, self.keys, self.order).write.partitionBy("_day").mode("overwrite").parquet(f"{self.base}/data/batch={batch}")
            self.spark.createDataFrame([(d,) for d in touched], "day string").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/batch={batch}")
        new.unpersist()

    def read(self, schema) -> DataFrame:
        """All valid rows; without any, an empty table of ``schema``."""
        found = self._days(self.versions())
        return self.spark.createDataFrame([], schema) if found is None else found


def upsert_stream(stream: DataFrame, keys: list[str], order: str, day: str = "day") -> DataFrame:
    """Ingest with revisions: per key and ``day`` the row with the largest ``order`` over all batches."""
    table = DayTable(stream.sparkSession, [*keys, day], order)
    run_to_end(stream, "append", lambda batch, number: table.upsert(batch, F.col(day), number))
    return table.read(stream.schema)


def window_updates(stream: DataFrame, key: str, value: str, minutes: int = 15, late: str = "2 hours") -> DataFrame:
    """key, ts, v, n: tumbling sums by event time, in update mode. A row more than ``late`` behind the newest of earlier batches is dropped, and a window that old leaves the state."""
    own = stream.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    sums = own.groupBy(F.window("_at", f"{minutes} minutes"), key).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    return sums.select(key, F.col("window.start").cast("timestamp_ntz").alias("ts"), "v", "n")


def windowed_sums(stream: DataFrame, key: str, value: str, minutes: int = 15, late: str = "2 hours", progress: list | None = None) -> DataFrame:
    """The last sums of every window: each batch replaces the days of the windows it changed. ``progress`` gets what Spark reports of each batch."""
    sums = window_updates(stream, key, value, minutes, late)
    table = DayTable(stream.sparkSession, [key, "ts"], "_batch")
    found = run_to_end(sums, "update", lambda batch, number: table.upsert(batch.withColumn("_batch", F.lit(number)), F.to_date("ts"), number))
    if progress is not None:
        progress.extend(found)
    return table.read(sums.withColumn("_batch", F.lit(0)).schema).drop("_batch")


def before_cutoff(stream: DataFrame, lag_days: int = 1, hour: int = 10) -> DataFrame:
    """Rows that delivery day D = local day + lag may use: those at or before D's cutoff."""
    day = F.date_add(T.local_day(F.col("ts")), lag_days)
    return stream.withColumn("delivery_day", day).where(F.col("ts") <= cutoff(F.col("delivery_day"), lag_days, hour))


def collect_stream(stream: DataFrame) -> DataFrame:
    """Append a stream to a table of the shared folder and return it."""
    folder = shared_folder(stream.sparkSession)
    run_to_end(stream, "append", lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batch=*")


def completeness_updates(stream: DataFrame, zone: str = T.ZONE, late: str = "1 day") -> DataFrame:
    """day, n, complete, closed: a row whenever a day's quarter-hours change, and a last one when the day closes.

    A day's state is which of its slots came, as a string of at most 100 signs. A timer closes a day, and
    removes its state, when the newest row is ``late`` past the day's end; later rows are dropped.
    """
    day = T.local_day(F.col("ts"), zone)
    end = F.unix_millis(T.next_day_start(day, zone).cast("timestamp"))
    own = stream.select(day.alias("day"), T.mtu(F.col("ts"), zone).alias("mtu"), T.slots(day, zone).cast("int").alias("slots"), end.alias("end"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)

    def walk(key, frames, state):
        if state.hasTimedOut:
            seen, slots = state.get
            state.remove()
            yield pd.DataFrame({"day": [key[0]], "n": [seen.count("1")], "complete": [seen.count("1") >= slots], "closed": [True]})
            return
        seen, end, slots = set(), 0, 0
        for f in frames:
            seen |= set(f["mtu"].tolist())
            end, slots = int(f["end"].iloc[0]), int(f["slots"].iloc[0])
        if end <= state.getCurrentWatermarkMs():
            return  # the day is closed, or will be by its timer
        if state.exists:
            seen |= {i for i, c in enumerate(state.get[0]) if c == "1"}
        state.update(("".join("1" if i in seen else "0" for i in range(100)), slots))
        state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"day": [key[0]], "n": [len(seen)], "complete": [len(seen) >= slots], "closed": [False]})

    return own.groupBy("day").applyInPandasWithState(walk, "day date, n int, complete boolean, closed boolean", "seen string, slots int", "update", GroupStateTimeout.EventTimeTimeout)


def day_completeness(stream: DataFrame, zone: str = T.ZONE, late: str = "1 day", progress: list | None = None) -> DataFrame:
    """day, n, complete, closed: the last state of every local day."""
    changes = completeness_updates(stream, zone, late)
    table = DayTable(stream.sparkSession, ["day"], "_batch")
    found = run_to_end(changes, "update", lambda batch, number: table.upsert(batch.withColumn("_batch", F.lit(number)), F.col("day"), number))
    if progress is not None:
        progress.extend(found)
    return table.read(changes.withColumn("_batch", F.lit(0)).schema).drop("_batch")
