"""Structured Streaming twins of the state operators (T01–T05, T12) and of interval counts.

All take and return streaming DataFrames; late rows beyond the watermark are dropped by Spark, and state is
kept only as long as the watermark needs it. Reserve-once claims keep their keys for the given time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def late_dedup(stream: DataFrame, keys: list[str], at: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key within the lateness."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def claims(stream: DataFrame, keys: list[str], at: str, hold: str = "1 day") -> DataFrame:
    """Requests that obtain their key; later requests within ``hold`` do not pass."""
    return late_dedup(stream, keys, at, hold)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Rows per key and tumbling window, emitted when the watermark closes the window."""
    counted = stream.withWatermark(at, lateness).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


LEASE_OUT = "key string, epoch int, holder string, held boolean"
LEASE_STATE = "epoch int, holder string, held boolean, until_us long"


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    epoch, holder, held, until = state.get if state.exists else (0, None, False, 0)
    rows = pd.concat(list(batches)).sort_values(["at_us", "kind", "owner"])
    for row in rows.itertuples(index=False):
        if held and row.at_us > until:
            held = False
        if row.kind == "claim" and not held:
            epoch, holder, held, until = epoch + 1, row.owner, True, row.at_us + row.ttl_us
        elif held and row.owner == holder:
            if row.kind == "renew":
                until = row.at_us + row.ttl_us
            elif row.kind == "release":
                held = False
    state.update((epoch, holder, held, int(until)))
    yield pd.DataFrame({"key": [key[0]], "epoch": [epoch], "holder": [holder], "held": [held]})


def leases(stream: DataFrame) -> DataFrame:
    """Lease of each key after its events (key, kind claim|renew|release, owner, at_us, ttl_us), with fencing epochs."""
    return stream.groupBy("key").applyInPandasWithState(_lease, LEASE_OUT, LEASE_STATE, "update", GroupStateTimeout.NoTimeout)


def on_each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``action`` on every micro-batch, for instance to recompute readiness; ends when the input is read."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
