"""Claims about calls checked against what is known, each check passing, failing or skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _verdict(known: Column, holds: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), "skipped").when(F.coalesce(holds, F.lit(False)), "pass").otherwise("fail")


def verdicts(claims: DataFrame, file_lines: DataFrame, calls: DataFrame, bodies: DataFrame, hops: DataFrame, reads: DataFrame) -> DataFrame:
    """(claim_id, v1..v5, passed) of ``claims`` (claim_id, caller, file, line, callee, behaviour, task_id).

    v1 the line is inside the file (``file_lines``: file, line); v2 the caller calls the callee (``calls``: caller,
    callee); v3 the callee shows the behaviour claimed of it (``bodies``: callee, behaviour, shown); v4 all further
    hops of the chain are calls (``hops``: claim_id, caller, callee); v5 the callee was read in the task
    (``reads``: task_id, callee). A check whose facts are missing is skipped; a claim passes if none fails.

    Every table is reduced to one row per join key first: no join multiplies claims. Rows with NULL keys
    match nothing; claims keep their repeated rows.
    """
    keyed = lambda df, *keys: df.where(" and ".join(f"{k} is not null" for k in keys))
    length = keyed(file_lines, "file", "line").groupBy("file").agg(F.max("line").alias("_last"))
    pairs = keyed(calls, "caller", "callee").select("caller", "callee").distinct()
    callers = pairs.select("caller").distinct()
    shown = keyed(bodies, "callee", "behaviour").groupBy("callee", "behaviour").agg(F.bool_or("shown").alias("_shown"))
    heard = keyed(reads, "task_id", "callee").select("task_id", "callee").distinct()
    audited = heard.select("task_id").distinct()
    yes = F.lit(True)
    links = (
        hops.join(callers.withColumn("_known", yes), "caller", "left").join(pairs.withColumn("_called", yes), ["caller", "callee"], "left")
        .groupBy("claim_id").agg(F.bool_or(F.col("_known").isNotNull()).alias("_known4"), F.bool_and(F.col("_known").isNull() | F.col("_called").isNotNull()).alias("_ok4"))
    )
    all_ = (
        claims.join(length, "file", "left").join(callers.withColumn("_caller", yes), "caller", "left").join(pairs.withColumn("_call", yes), ["caller", "callee"], "left")
        .join(shown, ["callee", "behaviour"], "left").join(audited.withColumn("_audit", yes), "task_id", "left").join(heard.withColumn("_read", yes), ["task_id", "callee"], "left")
        .join(links, "claim_id", "left")
    )
    named = F.col("callee").isNotNull()
    checks = {
        "v1": _verdict(F.col("_last").isNotNull() & F.col("line").isNotNull(), F.col("line") <= F.col("_last")),
        "v2": _verdict(named & F.col("_caller").isNotNull(), F.col("_call")),
        "v3": _verdict(named & F.col("behaviour").isNotNull() & F.col("_shown").isNotNull(), F.col("_shown")),
        "v4": _verdict(F.col("_known4"), F.col("_ok4")),
        "v5": _verdict(named & F.col("_audit").isNotNull(), F.col("_read")),
    }
    out = all_.select("claim_id", *[c.alias(k) for k, c in checks.items()])
    return out.withColumn("passed", ~F.greatest(*[(F.col(k) == "fail").cast("int") for k in checks]).cast("boolean"))
