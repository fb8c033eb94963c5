"""Streams with state: latest observation, hourly demand, failure streaks, alerts once.

Each has a batch twin among the operators that gives the same rows for the same input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all there is, into a Parquet table of micro-batches under ``folder``; the table, with ``batch``.

    Writing a batch again replaces it, so a retry after a failure leaves no row twice.
    """
    path = f"{folder}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").option("basePath", f"{path}/out").parquet(f"{path}/out")


def last_batch(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of its last batch: what an update-mode stream stands at."""
    row = F.struct("batch", *(c for c in table.columns if c not in (*keys, "batch")))
    return table.groupBy(*keys).agg(F.max_by(row, "batch").alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in table.columns if c not in (*keys, "batch")))


def latest_stream(observations: DataFrame) -> DataFrame:
    """The latest observation of each listing, in update mode: later evidence replaces, late evidence does not."""
    order = F.struct("observed_at", "observation_id")
    return observations.groupBy("listing_id").agg(F.max_by(F.struct("observation_id", "price", "negative"), order).alias("last")).select("listing_id", "last.observation_id", "last.price", "last.negative")


def demand_stream(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Searches of each hour and key, in update mode under a watermark."""
    stamped = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return stamped.groupBy(F.window("__at", "1 hour").alias("w"), *keys).agg(F.count("*").alias("searches")).select(F.col("w.start").alias("hour"), *keys, "searches")


def session_stream(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    stamped = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return stamped.groupBy(F.session_window("__at", gap).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), *keys, "events")


def breaker_stream(observations: DataFrame, threshold: int = 3) -> DataFrame:
    """Failures in a row, circuit and cooldown of each listing after each batch. Rows of a batch are taken in time order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["observed_at", "observation_id"])
        failed = rows["negative"].eq(True).to_numpy()
        good = np.flatnonzero(~failed)
        # Failures since the last success, or all of them on top of what the state holds.
        streak = int(len(failed) - 1 - good[-1]) if len(good) else len(failed) + (state.get[0] if state.exists else 0)
        state.update((streak,))
        open_ = streak >= threshold
        cooldown = min(360, 15 * 2 ** min(5, streak - threshold)) if open_ else None
        yield pd.DataFrame({"listing_id": [key[0]], "streak": [streak], "circuit": ["open" if open_ else "closed"], "cooldown": pd.array([cooldown], "Int32")})

    return observations.groupBy("listing_id").applyInPandasWithState(step, "listing_id long, streak long, circuit string, cooldown int", "streak long", "update", GroupStateTimeout.NoTimeout)


def alert_once(events: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(keys).drop("__at")


def outbox_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends only alerts that no earlier batch wrote; a batch written again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            earlier = spark.read.option("basePath", path).schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema.fields)}, batch int").parquet(path)
            new = new.join(earlier.filter(F.col("batch") < number).select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
