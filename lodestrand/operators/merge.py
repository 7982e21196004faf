"""Writes as merges (W01–W18): latest wins, first wins, partial columns, tiers, replacement and append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.ranking import latest


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of their key; one aggregation, no join."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in old.columns if c not in keys]
    return latest(both, keys, [F.col("_v"), *rest]).drop("_v")


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of known keys are ignored; of several new rows the first by ``order``."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti"))


def partial(old: DataFrame, new: DataFrame, keys: list[str], mutable: list[str], blank_is_old: bool = False) -> DataFrame:
    """Only ``mutable`` columns change, and only to values that are there; unknown keys are added."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(n, keys, "full")
    given = lambda c: F.nullif(F.trim(F.col(f"_n_{c}")), F.lit("")) if blank_is_old else F.col(f"_n_{c}")

    def value(c: str) -> Column:
        if f"_n_{c}" not in joined.columns:
            return F.col(c)
        if c in mutable:
            return F.coalesce(given(c), F.col(c))
        return F.when(F.col("_old").isNull(), F.col(f"_n_{c}")).otherwise(F.col(c))

    return joined.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def tiered_update(rows: DataFrame, updates: DataFrame, key: str, scope: str, value: str) -> DataFrame:
    """An update reaches the row of its own scope, else the row with a blank scope, else any row of the key."""
    u = updates.groupBy(key, F.col(scope).alias("_us")).agg(F.max(value).alias("_uv"))
    hit = rows.join(u, key, "left").withColumn("_tier", F.when(F.col(scope) == F.col("_us"), 1).when(F.col(scope) == "", 2).when(F.col("_us").isNotNull(), 3))
    best = hit.groupBy(key, "_us").agg(F.min("_tier").alias("_best"))
    reached = hit.join(best, [key, "_us"]).where("_tier = _best").groupBy(key, scope).agg(F.max("_uv").alias("_new"))
    return rows.join(reached, [key, scope], "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def cleared(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows without those of the keys in ``gone``."""
    return rows.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def replaced(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``new`` give way to ``new``."""
    return rows.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows and new rows, nothing replaced; columns the new rows lack are NULL."""
    return rows.unionByName(new, allowMissingColumns=True)
