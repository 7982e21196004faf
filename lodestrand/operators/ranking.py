"""Ordered operators (R01–R09), paging (L01–L07) and exact histogram quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: upper bounds of the request-duration histogram, in seconds
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the largest by ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("_r"))
    return packed.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_by(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of each key with their place (_place) and the number of rows of the key (_count). Ranks are cut
    before the shuffle's sort holds a group: Spark keeps ``count`` rows of a key per input partition."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    totals = df.groupBy(*keys).agg(F.count("*").alias("_count"))
    top = df.withColumn("_place", place).where(F.col("_place") <= count)
    return top.join(totals, [top[k].eqNullSafe(totals[k]) for k in keys]).select(*[top[c] for c in df.columns], "_place", "_count")


def adjacent(df: DataFrame, group: str, item: str, order: list[str]) -> DataFrame:
    """Pairs of neighbouring items in a group."""
    nxt = F.lead(item).over(Window.partitionBy(group).orderBy(*order))
    return df.select(group, F.col(item).alias("from_item"), nxt.alias("to_item")).where("to_item is not null")


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def sorted_page(df: DataFrame, sort: str, descending: bool, key: str, allowed: set[str], offset: int, size: int) -> DataFrame:
    """A page in the order of a column the caller may choose, with the number of all rows as ``total``. A column that
    is not allowed is not sorted by; equal rows stand by descending key."""
    order = [F.desc(sort) if descending else F.asc(sort)] if sort in allowed else []
    total = df.agg(F.count("*").alias("total")).scalar()
    return df.orderBy(*order, F.desc(key)).offset(offset).limit(size).withColumn("total", total)


def cumulative_buckets(df: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Rows per (keys, le): values at most each bound, and +Inf for all; one aggregation pass."""
    v = F.col(value)
    counted = df.where(v.isNotNull()).groupBy(*keys).agg(
        *[F.count_if(v <= b).alias(f"_b{k}") for k, b in enumerate(bounds)], F.count("*").alias("_inf")
    )
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{k}").alias("n")) for k, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_inf").alias("n")))
    return counted.select(*keys, F.inline(F.array(*cells)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, out: str) -> DataFrame:
    """Exact quantile of cumulative buckets (keys, le, n) by linear interpolation.

    In the +Inf bucket the previous bound is the result, in a bucket of zero width or count its bound;
    an empty histogram gives NULL. The few buckets of a key are folded in one array, without a window.
    """
    packed = buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("_h"))
    total = F.element_at("_h", -1)["n"]
    at = F.expr("array_position(transform(_h, b -> b.n >= _t), true)").cast("int")
    packed = packed.withColumn("_t", total * F.lit(q)).withColumn("_at", at)
    hit = F.element_at("_h", F.col("_at"))
    before = F.when(F.col("_at") > 1, F.element_at("_h", F.greatest(F.col("_at") - 1, F.lit(1))))
    low, below = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["n"], F.lit(0))
    flat = (hit["n"] == below) | (hit["le"] == low)
    value = F.when(hit["le"] == float("inf"), low).when(flat, hit["le"]).otherwise(
        low + (hit["le"] - low) * (F.col("_t") - below) / F.nullif((hit["n"] - below).cast("double"), F.lit(0.0))
    )
    return packed.select(*keys, F.when(total > 0, value).alias(out))
