"""Problem 4: references to records that are missing, deleted or not yet there.

Skew-aware split. References are first pre-aggregated per (field, key, month), so that a key named by a
third of all rows is one row per month. Keys with at least 1/HEAVY of the references of all fields are heavy: by
that definition there are at most HEAVY of them, which is the size check for broadcasting them. The
remaining keys are anti-joined by shuffle; both orphan sets are united. When the orphan references are
listed, rows of heavy keys meet the broadcast only; the shuffled join gets the other rows, none of whose
keys has more than 1/HEAVY of them. The tables are parsed once, into a table of keys and names.

Defined results: NULL and blank keys refer to nothing; a target exists if its table has a row with the
key, unless a deletion later than the loaded_at of all its rows is recorded (rows with NULL loaded_at are
earliest); repeated rows count once in ``found``; an empty target makes every reference an orphan.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import durable

HEAVY = 500


@dataclass(frozen=True)
class Reference:
    """One referring field: ``key`` is the comparable key in ``rows``, ``ref_key`` names the row,
    ``missing_key`` is the key as it is reported, ``live`` the comparable keys that exist (column ``_key``)."""

    ref_table: str
    ref_field: str
    rows: DataFrame
    key: Column
    ref_key: Column
    missing_key: Column
    live: DataFrame


def live_keys(target: DataFrame, key: Column, deletions: DataFrame | None = None, record_key: Column | None = None) -> DataFrame:
    """Distinct ``_key`` of the records that exist once everything has arrived."""
    if deletions is None:
        return target.select(key.alias("_key")).where("_key is not null").distinct()
    rows = target.select(key.alias("_key"), F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**62))).alias("_t"), F.lit(0).alias("_d"))
    gone = deletions.select(record_key.alias("_key"), F.unix_micros("deleted_at").alias("_t"), F.lit(1).alias("_d"))
    both = rows.unionAll(gone).where("_key is not null").groupBy("_key")
    return (
        both.agg(
            F.max(F.when(F.col("_d") == 0, F.col("_t"))).alias("_loaded"), F.max(F.when(F.col("_d") == 1, F.col("_t"))).alias("_deleted")
        )
        .where("_loaded is not null and (_deleted is null or _deleted <= _loaded)")
        .select("_key")
    )


def _united(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, frames)


def _rows(refs: list[Reference]) -> DataFrame:
    return _united(
        [
            r.rows.select(
                F.lit(k).alias("_f"), r.key.alias("_key"), r.ref_key.alias("ref_key"), r.missing_key.alias("missing_key"),
                F.trunc("loaded_at", "month").alias("_month"),
            ).where("_key is not null")
            for k, r in enumerate(refs)
        ]
    )


def _named(df: DataFrame, refs: list[Reference]) -> DataFrame:
    pick = lambda attr: F.element_at(F.array(*[F.lit(getattr(r, attr)) for r in refs]), F.col("_f") + 1)
    return df.withColumns({"ref_table": pick("ref_table"), "ref_field": pick("ref_field")})


@dataclass(frozen=True)
class _Split:
    rows: DataFrame  # every reference with a key, parsed once
    per_key: DataFrame  # (_f, _key, _month, _n): references pre-aggregated
    hot: DataFrame  # the heavy keys, at most `heavy`, with _orphan
    rest: DataFrame  # orphan keys among the others


def _split(refs: list[Reference], heavy: int) -> _Split:
    rows = durable(_rows(refs))
    per_key = durable(rows.groupBy("_f", "_key", "_month").agg(F.count("*").alias("_n")))
    counts = per_key.groupBy("_f", "_key").agg(F.sum("_n").alias("_n"))
    # At most `heavy` rows reach the driver: each stands for 1/heavy of all references.
    total = per_key.agg(F.sum("_n")).first()[0] or 0
    named = [(r["_f"], r["_key"]) for r in counts.where(F.col("_n") >= max(2, -(-total // heavy))).collect()]
    live = _united([r.live.select(F.lit(k).alias("_f"), "_key") for k, r in enumerate(refs)])
    hot = F.broadcast(counts.sparkSession.createDataFrame(named, "_f int, _key string"))
    hot_live = live.join(hot, ["_f", "_key"], "left_semi").withColumn("_live", F.lit(True))
    rest = counts.select("_f", "_key").join(hot, ["_f", "_key"], "left_anti")
    judged = hot.join(hot_live, ["_f", "_key"], "left").select("_f", "_key", F.col("_live").isNull().alias("_orphan"))
    return _Split(rows, per_key, judged, durable(rest.join(live, ["_f", "_key"], "left_anti")))


def found(refs: list[Reference], heavy: int = HEAVY) -> DataFrame:
    """(ref_table, ref_field, ref_key, missing_key) of every orphan reference."""
    s = _split(refs, heavy)
    # one pass: the broadcast tells heavy rows (with their verdict) from the others, which alone are shuffled
    told = s.rows.select("_f", "_key", "ref_key", "missing_key").join(F.broadcast(s.hot), ["_f", "_key"], "left")
    heavy_rows = told.where("_orphan").drop("_orphan")
    light_rows = told.where("_orphan is null").drop("_orphan").join(s.rest, ["_f", "_key"], "left_semi")
    return _named(heavy_rows.unionByName(light_rows), refs).select("ref_table", "ref_field", "ref_key", "missing_key").distinct()


def counted(refs: list[Reference], heavy: int = HEAVY) -> DataFrame:
    """(ref_table, ref_field, loaded_month, orphan_refs, orphan_keys): orphans per field and month of loaded_at."""
    s = _split(refs, heavy)
    told = s.per_key.join(F.broadcast(s.hot), ["_f", "_key"], "left")
    keys = [told.where("_orphan").drop("_orphan"), told.where("_orphan is null").drop("_orphan").join(s.rest, ["_f", "_key"], "left_semi")]
    return (
        _named(_united(keys), refs)
        .groupBy("ref_table", "ref_field", F.date_format("_month", "yyyy-MM").alias("loaded_month"))
        .agg(F.sum("_n").alias("orphan_refs"), F.count("*").alias("orphan_keys"))
    )
