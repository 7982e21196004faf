"""State of runs (T01–T15) in batch form; the streaming twins are in ``lodestrand.streaming``."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import durable, release

# fixed values, in seconds
LOOKBACK, FULL_SCAN, LEASE_TTL, HEARTBEAT, STALE_HEARTBEAT, ACTIVE_WINDOW, RETRY_WINDOW = 3600, 86_400, 90, 15, 60, 120, 300


def watermark_scan(df: DataFrame, at: str, watermark: Column, lookback: int = LOOKBACK) -> DataFrame:
    """Rows at or after the watermark less the lookback; rows without a time count as inside."""
    return df.where(F.col(at).isNull() | (F.col(at) >= watermark - F.expr(f"interval {lookback} seconds")))


def claims(df: DataFrame, keys: list[str], owner: str, order: list[str]) -> DataFrame:
    """The first request of a key by ``order`` holds it; one aggregation, no window."""
    return df.groupBy(*keys).agg(F.min_by(owner, F.struct(*order)).alias("holder"), F.count("*").alias("requests"))


def lease_state(events: DataFrame, keys: list[str], at: str, kind: str) -> DataFrame:
    """Last claim, its epoch (number of claims) and whether it still holds (no later release)."""
    is_claim, is_release = F.col(kind) == "claim", F.col(kind) == "release"
    return events.groupBy(*keys).agg(
        F.count_if(is_claim).alias("epoch"), F.max(F.when(is_claim, F.col(at))).alias("claimed_at"), F.max(F.when(is_release, F.col(at))).alias("released_at"),
    ).withColumn("held", F.col("claimed_at").isNotNull() & (F.col("released_at").isNull() | (F.col("released_at") < F.col("claimed_at"))))


def orphan_reason(owner: Column, lease_until: Column, heartbeat: Column, now: Column) -> Column:
    """Why a running task has nobody; NULL if it has."""
    late = heartbeat < now - F.expr(f"interval {STALE_HEARTBEAT} seconds")
    return F.when(owner.isNull() | (owner == ""), "missing_owner").when(lease_until.isNull() | (lease_until < now), "expired_lease").when(late, "stale_heartbeat")


def idle(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """A queue is idle when all that was put into it is done."""
    counts = df.groupBy(*keys).agg(F.count_if(F.col(kind) == "put").alias("puts"), F.count_if(F.col(kind) == "done").alias("dones"))
    return counts.withColumn("idle", F.col("puts") <= F.col("dones"))


_LOG = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("accepted", pa.bool_()), ("epoch", pa.int64()), ("holder", pa.string())])


def _log_batches(ttl: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, holder, epoch, until = None, None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for key, at, seq, kind, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    last, holder, epoch, until = key, None, 0, 0
                free = holder is None or (ttl is not None and until < at)
                mine = holder is not None and holder == owner and not free
                if kind == "claim" and free and owner is not None:
                    ok, holder, epoch = True, owner, epoch + 1
                elif kind == "renew" or kind == "release":
                    ok = mine
                    holder = None if kind == "release" and mine else holder
                else:
                    ok = False
                if ok and kind != "release" and ttl is not None:
                    until = at + ttl * 1_000_000
                out.append((key, seq, ok, epoch, holder))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LOG, strict=True)] if out else [pa.array([], f.type) for f in _LOG], schema=_LOG)

    return run


def lease_log(events: DataFrame, key: str, at: str, seq: str, kind: str, owner: str, ttl: int | None) -> DataFrame:
    """(key, seq, accepted, epoch, holder) of each event in the order of (at, seq).

    A claim holds if the lease is free or has run out (``ttl`` seconds after the last claim or renewal; None: never) and
    raises the epoch; renewals and releases hold for the present owner only. Events without key or time do not count;
    an unknown kind and a claim without owner never hold; repeated events are judged again.

    A key's events pass one task in sorted order as a stream: only the state of one key is held, however many it has.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind"), F.col(owner).cast("string").alias("owner"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "seq", "kind", "owner")
    return ordered.mapInArrow(_log_batches(ttl), "key string, seq long, accepted boolean, epoch long, holder string")


class Snapshot:
    """A table made by ``make`` and kept for ``ttl`` seconds in the shared folder; read again after that."""

    def __init__(self, make: Callable[[], DataFrame], ttl: float = 2.5):
        self.make, self.ttl, self._at, self._table = make, ttl, 0.0, None

    def get(self) -> DataFrame:
        if self._table is None or time.monotonic() - self._at > self.ttl:
            fresh = durable(self.make())
            release(self._table)
            self._table, self._at = fresh, time.monotonic()
        return self._table
