"""Problem 2: overlapping, nested and gapped intervals per entity as continuous periods and gaps.

The aggregate state is a sorted list of disjoint intervals. Partial lists are merged by a linear merge
in a reduction tree: rows are merged per (entity, time chunk) inside their input partition, before any
shuffle, then per (entity, chunk, slice of partitions), then per (entity, chunk). Each list is bounded: the
first by LEAF_ROWS, the later ones by what stays disjoint inside one chunk of time. Chunks of one entity are then stitched through one
summary row per chunk (latest end so far), so a hot entity is never brought together in one task.

Defined results: intervals with a NULL entity or bound, or that end before they start, do not count;
an interval of length 0 counts as a point; intervals that touch are one period; repeated rows change
nothing; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.session import durable

CHUNK_MICROS = 86_400_000_000
FAN_IN = 32
LEAF_ROWS = 200_000
_LISTS = T.StructType([T.StructField("s", T.ArrayType(T.LongType())), T.StructField("e", T.ArrayType(T.LongType()))])


def _linear_merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint sorted intervals of several sorted runs; a stable sort merges presorted runs linearly."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    reach = np.maximum.accumulate(ends)
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], reach[last]


@F.pandas_udf(_LISTS)
def merge_lists(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Merged list of the concatenated lists of starts and ends of each row."""
    for starts, ends in parts:
        s, e = [], []
        for a, b in zip(starts, ends, strict=True):
            if len(a) > 1:
                a, b = _linear_merge(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64))
            s.append(a)
            e.append(b)
        yield pd.DataFrame({"s": s, "e": e})


_LIST = pa.list_(pa.int64())
_LEAF = pa.schema([("_k", pa.string()), ("_c", pa.int64()), ("_l", pa.struct([("s", _LIST), ("e", _LIST)]))])


def _merge_rows(rows: pa.Table, chunk: int) -> pa.RecordBatch:
    """One row per (entity, chunk) of ``rows`` (_k, _a, _b) with its merged list; no loop over groups."""
    keys = rows.column("_k").combine_chunks().dictionary_encode()
    code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ends = (rows.column(c).to_numpy() for c in ("_a", "_b"))
    at = np.floor_divide(starts, chunk)
    order = np.lexsort((starts, at, code))
    code, at, starts, ends = code[order], at[order], starts[order], ends[order]
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
    group = np.cumsum(fresh) - 1
    # latest end so far inside the group: ends as ranks, so that a group's number outweighs them
    levels, rank = np.unique(ends, return_inverse=True)
    reach = levels[np.maximum.accumulate(group * len(levels) + rank) - group * len(levels)]
    opens = fresh.copy()
    opens[1:] |= starts[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(starts)) - 1
    heads = np.flatnonzero(fresh)
    offsets = pa.array(np.append(np.searchsorted(first, heads), len(first)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (starts[first], reach[last])]
    return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code[heads])), pa.array(at[heads]), pa.StructArray.from_arrays(lists, fields=list(_LEAF.field("_l").type))], schema=_LEAF)


def _leaves(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= LEAF_ROWS:
                yield _merge_rows(pa.Table.from_batches(held), chunk)
                held, rows = [], 0
        if rows:
            yield _merge_rows(pa.Table.from_batches(held), chunk)

    return run


def _combine(df: DataFrame, keys: list[str]) -> DataFrame:
    """One level of the tree: the lists of equal ``keys`` merged into one."""
    both = df.groupBy(*keys).agg(F.flatten(F.collect_list("_l.s")).alias("_s"), F.flatten(F.collect_list("_l.e")).alias("_e"))
    return both.select(*keys, merge_lists("_s", "_e").alias("_l"))


def periods(df: DataFrame, entity: str, start: str, end: str, chunk: int = CHUNK_MICROS, fan_in: int = FAN_IN) -> DataFrame:
    """Maximal covered periods: (entity, start_micros, end_micros). ``start``, ``end``: long columns."""
    base = (
        df.select(F.col(entity).cast("string").alias("_k"), F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b"))
        .where("_k is not null and _a is not null and _b is not null and _b >= _a")
    )
    leaves = base.mapInArrow(_leaves(chunk), "_k string, _c long, _l struct<s:array<bigint>,e:array<bigint>>")
    inner = _combine(leaves.withColumn("_i", F.spark_partition_id() % fan_in), ["_k", "_c", "_i"])
    chunks = durable(_combine(inner, ["_k", "_c"]))  # read several times below

    # Latest end before each chunk: one row per chunk of an entity.
    past = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_k").orderBy("_c").rowsBetween(1, Window.unboundedFollowing)
    heads = chunks.select("_k", "_c", F.element_at("_l.e", -1).alias("_last"))
    carried = heads.select("_k", "_c", F.max("_last").over(past).alias("_carry"), F.count("*").over(Window.partitionBy("_k")).alias("_n"))
    joined = chunks.join(carried.where("_n > 1").select("_k", "_c", "_carry"), ["_k", "_c"], "left")
    pieces = joined.select(
        "_k", "_c", "_carry",
        F.filter(
            F.arrays_zip(F.col("_l.s").alias("s"), F.col("_l.e").alias("e")),
            lambda x: F.col("_carry").isNull() | (x["e"] > F.col("_carry")),
        ).alias("_p"),
    ).withColumn(
        "_head", F.coalesce((F.size("_p") > 0) & (F.try_element_at("_p", F.lit(1))["s"] <= F.col("_carry")), F.lit(False))
    )
    # The first start inside a chunk that opens a period also closes the one that was carried in, at _close.
    opens = F.when(F.col("_head"), F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0)))).otherwise(F.col("_p"))
    pieces = pieces.withColumn("_o", opens).withColumn(
        "_reach", F.when(F.col("_head"), F.try_element_at("_p", F.lit(1))["e"]).otherwise(F.col("_carry"))
    )
    summary = pieces.select(
        "_k", "_c",
        F.when(F.size("_o") > 0, F.col("_reach")).alias("_close"),
        F.coalesce(F.try_element_at("_p", F.lit(-1))["e"], F.col("_carry")).alias("_sofar"),
    )
    ends = summary.select(
        "_k", "_c",
        F.coalesce(F.first("_close", ignorenulls=True).over(later), F.max("_sofar").over(Window.partitionBy("_k"))).alias("_end"),
        F.count("*").over(Window.partitionBy("_k")).alias("_n"),
    ).where("_n > 1").select("_k", "_c", "_end")
    whole = pieces.where(F.size("_o") > 0).join(ends, ["_k", "_c"], "left")
    rows = whole.select("_k", F.size("_o").alias("_z"), "_end", F.posexplode("_o").alias("_at", "_x"))
    return rows.select(
        F.col("_k").alias(entity),
        F.col("_x.s").alias("start_micros"),
        F.when((F.col("_at") == F.col("_z") - 1) & F.col("_end").isNotNull(), F.col("_end")).otherwise(F.col("_x.e")).alias("end_micros"),
    )


def gaps(found: DataFrame, entity: str, chunk: int = CHUNK_MICROS) -> DataFrame:
    """Stretches between neighbouring ``periods`` of an entity: (entity, start_micros, end_micros).

    The next period is looked up inside the chunk of the period's start, and for the last period of a
    chunk in the summary of later chunks, so that no task sorts all periods of one entity.
    """
    rows = found.select(F.col(entity).alias("_k"), F.col("start_micros").alias("_a"), F.col("end_micros").alias("_b")).withColumn(
        "_c", F.floor(F.col("_a") / F.lit(chunk))
    )
    inside = Window.partitionBy("_k", "_c").orderBy("_a")
    rows = rows.withColumn("_next", F.lead("_a").over(inside))
    firsts = rows.groupBy("_k", "_c").agg(F.min("_a").alias("_first"))
    after = firsts.select("_k", "_c", F.lead("_first").over(Window.partitionBy("_k").orderBy("_c")).alias("_later"))
    known = rows.where("_next is not null").select("_k", F.col("_b"), F.col("_next"))
    open_ = rows.where("_next is null").select("_k", "_c", "_b").join(after, ["_k", "_c"]).where("_later is not null")
    return known.unionAll(open_.select("_k", "_b", "_later")).select(
        F.col("_k").alias(entity), F.col("_b").alias("start_micros"), F.col("_next").alias("end_micros")
    )


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, chunk: int = CHUNK_MICROS) -> DataFrame:
    """(entity, span_kind, start_micros, end_micros) with span_kind ``period`` or ``gap``."""
    found = durable(periods(df, entity, start, end, chunk))
    kind = lambda x, name: x.select(entity, F.lit(name).alias("span_kind"), "start_micros", "end_micros")
    return kind(found, "period").unionAll(kind(gaps(found, entity, chunk), "gap"))
