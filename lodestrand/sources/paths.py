"""Which of several candidate files holds a run's result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_epoch(names: list[str]) -> str | None:
    """The run folder with the largest number; ties and names without number go by name."""
    return max(names, key=lambda n: (int(m.group()) if (m := re.search(r"\d+", n)) else -1, n), default=None)


def first_existing(candidates: list[str], exists: Callable[[str], bool]) -> str | None:
    """The first candidate that exists."""
    return next((c for c in candidates if exists(c)), None)


def result_candidates(root: str, epochs: list[str], run_first: bool, name: str = "graph.sqlite") -> list[str]:
    """Candidate files in order of precedence: output before runs, or runs before output; newest run first."""
    left, runs = list(epochs), []
    while left:
        top = latest_epoch(left)
        runs.append(f"{root}/run/{top}/{name}")
        left.remove(top)
    output = [f"{root}/output/{name}"]
    return runs + output if run_first else output + runs


def latest_runs(runs: DataFrame, key: str, epoch: str, root: str) -> DataFrame:
    """(key, by_number, by_name): the root of each key's latest run, by the first number in its epoch (none is lowest) and by the
    epoch's text. Rows with a NULL key do not count; of equal epochs the greatest root counts."""
    number = F.coalesce(F.nullif(F.regexp_extract(epoch, "\\d+", 0), F.lit("")).try_cast("int"), F.lit(-1))
    return runs.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(root, F.struct(number.alias("n"), F.col(epoch).alias("e"), F.col(root).alias("r"))).alias("by_number"), F.max_by(root, F.struct(F.col(epoch).alias("e"), F.col(root).alias("r"))).alias("by_name"))
