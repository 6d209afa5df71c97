"""Structured Streaming forms: duplicate suppression, volume over time, sessions, latest decision state, bounded history.

Each run takes what is there (available now) and stops; a service would pass another trigger. State and progress are kept in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import fresh_dir

LATE = "10 minutes"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events below a folder as a stream; ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name if not name.endswith("/") else "*").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there, and give what it wrote: in complete mode the last table, else all rows in order of their batch (column batch)."""
    spark = stream.sparkSession
    out = fresh_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its own folder again: exactly once
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/run={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", fresh_dir(spark, f"{name}-progress")).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("run")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def volume(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events of each type in each window of time."""
    counted = events.withWatermark("ts", LATE).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A user's runs of events, less than `gap` apart."""
    counted = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """Each user's last decision by (ts, event_id) and how many there were."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("decisions"))


def history(events: DataFrame, keep: int = 20) -> DataFrame:
    """Each user's last `keep` events by (ts, event_id), as ids in order, updated with every batch: a state that stays bounded, which no built-in aggregate is."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(map(int, x.split(":"))) for x in state.get[0].split(",")] if state.exists else []
        for frame in frames:
            held += zip(frame["ts"].astype("datetime64[us]").astype("int64").tolist(), frame["event_id"].tolist(), strict=True)
            held = sorted(held)[-keep:]
        state.update((",".join(f"{at}:{ident}" for at, ident in held),))
        yield pd.DataFrame({"user_id": [key[0]], "history": [",".join(str(ident) for _, ident in held)]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, history string", "items string", "update", GroupStateTimeout.NoTimeout)
