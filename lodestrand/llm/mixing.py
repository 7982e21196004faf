"""Problem 8: sources combined to target weights, by weighted fair queueing.

Documents of a source stand in a queue in shuffled order (a seeded hash, the same on every run) and the
queue is repeated up to ``max_repeats`` times. A use of a document has the virtual finish time
"tokens of its source up to and with it, divided by the source's weight". All uses are ranged by finish
time and cut where the mix's token budget is spent. A source that runs dry leaves its place to the others;
the shares actually reached are reported.

Running sums over a source or a mix are two-level: the order is divided into many small ranges, sums of
ranges are accumulated (one row per range), and the rest is summed inside a range. No task holds a source or
a mix: their number of ranges grows with their rows. In a mix, a stretch of virtual time of length t holds at
most t tokens and a document, as the shares of the sources still running add up to 1 at most; so ranges of
equal length are bounded alike, and about RANGE_ROWS mean documents long.

Defined results: documents without source belong to none; empty and NULL texts have no tokens and are not
used; sources with no documents, NULL, zero or negative weights or repeats get nothing but are reported;
the budget is total_share of the tokens of all documents, with and without source; the last use is the
last one that still fits below the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import durable

RANGE_ROWS = 20_000


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, amount: str, out: str) -> DataFrame:
    """``out``: sum of ``amount`` up to and with the row, per ``keys``, in the order (bucket, *order)."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_sum"))
    past = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(before, [*keys, bucket]).withColumn(out, F.col("_before") + F.sum(amount).over(inside)).drop("_before")


def queue_positions(sized: DataFrame, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(source, doc_id, tokens, upto, source_tokens): each document's place in the queue of its source."""
    docs = sized.where("source is not null and tokens > 0").select("source", "doc_id", "tokens").withColumn(
        "_h", F.xxhash64("doc_id", F.lit(seed))
    )
    total = docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("_n"))
    docs = docs.join(F.broadcast(total) if total.count() <= 10_000 else total, "source")
    # ranges of the hash: about range_rows rows each, whatever the size of the source
    width = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(range_rows)))
    docs = docs.withColumn("_b", F.floor((F.shiftrightunsigned("_h", 32).cast("double") / F.lit(2.0**32)) * width).cast("long"))
    # in the order of the unsigned hash, which the ranges divide: the same whatever their number
    docs = docs.withColumn("_u", F.shiftrightunsigned("_h", 1))
    return _running(docs, ["source"], "_b", ["_u", "_h", "doc_id"], "tokens", "upto").select("source", "doc_id", "tokens", "upto", "source_tokens")


def _plan(targets: DataFrame, total: Column) -> DataFrame:
    targets = targets.select("mix_id", "source", "weight", "max_repeats", "total_share")
    usable = targets.withColumn("weight", F.when((F.col("weight") > 0) & (F.col("max_repeats") > 0), F.col("weight")))
    whole = Window.partitionBy("mix_id")
    return usable.withColumn("share", F.col("weight") / F.sum("weight").over(whole)).withColumn(
        "budget", F.floor(F.col("total_share") * total)
    )


def mix(sized: DataFrame, targets: DataFrame, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(mix_id, source, doc_id, repeat_no, tokens, mix_upto): the uses of each mix; mix_upto is the running
    sum of tokens in the order of virtual finish times, at most the budget.

    ``sized``: doc_id, source, tokens. ``targets``: mix_id, source, weight, max_repeats, total_share.
    """
    total, docs = sized.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    plan = _plan(targets, F.lit(total or 0))
    queue = durable(queue_positions(sized, seed))
    length = F.lit((total or 0) / max(docs, 1) * range_rows)  # virtual time of a range
    # No finish time beyond the budget divided by the share of the only source left can be reached.
    uses = (
        queue.join(plan.where("share is not null"), "source")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
        .withColumn("_cum", (F.col("repeat_no") - 1) * F.col("source_tokens") + F.col("upto"))
        .where("_cum <= budget")
        .withColumn("finish", F.col("_cum") / F.col("share"))
        .withColumn("_b", F.floor(F.col("finish") / length).cast("long"))
        .select("mix_id", "source", "doc_id", "repeat_no", "tokens", "finish", "_b", "budget")
    )
    # Ranges that begin beyond the budget are left out before any row of theirs is ordered.
    uses = durable(uses)
    sums = uses.groupBy("mix_id", "_b").agg(F.sum("tokens").alias("_sum"), F.first("budget").alias("_budget"))
    past = Window.partitionBy("mix_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    open_ = sums.withColumn("_past", F.coalesce(F.sum("_sum").over(past), F.lit(0))).where("_past < _budget").select("mix_id", "_b")
    placed = _running(uses.join(open_, ["mix_id", "_b"], "left_semi"), ["mix_id"], "_b", ["finish", "source", "doc_id", "repeat_no"], "tokens", "mix_upto")
    return placed.where("mix_upto <= budget").select("mix_id", "source", "doc_id", "repeat_no", "tokens", "mix_upto")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, used_tokens, used_docs, most_repeats) of every target."""
    got = mixed.groupBy("mix_id", "source").agg(
        F.sum("tokens").alias("used_tokens"), F.countDistinct("doc_id").alias("used_docs"), F.max("repeat_no").alias("most_repeats")
    )
    plan = _plan(targets, F.lit(0)).select("mix_id", "source", F.coalesce("share", F.lit(0.0)).alias("target_share"))
    both = plan.join(got, ["mix_id", "source"], "left").fillna(0, ["used_tokens", "used_docs", "most_repeats"])
    whole = F.sum("used_tokens").over(Window.partitionBy("mix_id"))
    return both.select(
        "mix_id", "source", "target_share", F.coalesce(F.col("used_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        "used_tokens", "used_docs", "most_repeats",
    )
