"""Lookups and joins of the symbol and graph tables.

Sizes decide joins at run time: nothing is hinted as broadcast unless its size is bounded by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import scalar as X


def layered_lookup(probes: DataFrame, probe: str, index: DataFrame, name: str, tail: str, key: str, underscore: bool = True) -> DataFrame:
    """All matches of the first layer that has any: exact name, exact tail of a qualified
    name, tail index, then the name with or without a leading underscore.

    Each probe and each index row is expanded to its few keyed spellings, so all layers are one equi-join;
    the layers are then compared per probe. Returns probe, ``key``, ``layer``; probes without match are absent.
    """
    p = F.col(probe)
    option = lambda layer, kind, text: F.struct(F.lit(layer).alias("layer"), F.concat(F.lit(kind), text).alias("_k"))
    options = [option(1, "n:", p), option(2, "q:", X.name_tail(p)), option(3, "t:", p)]
    if underscore:
        other = F.when(F.startswith(p, F.lit("_")), F.expr(f"substring(`{probe}`, 2)")).otherwise(F.concat(F.lit("_"), p))
        options.append(option(4, "n:", other))
    asked = probes.select(probe).where(p.isNotNull() & (F.trim(p) != "")).distinct().select(probe, F.inline(F.array(*options)))
    n, t = F.col(name), F.col(tail)
    spelled = index.select(F.col(key), F.explode(F.array_distinct(F.array_compact(F.array(
        F.concat(F.lit("n:"), n), F.when(~F.contains(n, F.lit("::")), F.concat(F.lit("q:"), n)), F.concat(F.lit("t:"), t))))).alias("_k"))
    hits = asked.join(spelled, "_k").groupBy(probe, key).agg(F.min("layer").alias("layer"))
    first = F.min("layer").over(Window.partitionBy(probe))
    return hits.withColumn("_first", first).where("layer = _first").drop("_first")


def name_candidates(index: DataFrame, name: str, text: str, limit: int = 20) -> DataFrame:
    """names that contain ``text``, shortest first; a top-k report."""
    return index.where(F.contains(name, F.lit(text))).orderBy(F.length(name), name).limit(limit)


def two_tier_left(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str) -> DataFrame:
    """``value`` of the match by the first key pair, else by the second; unmatched rows keep NULL.

    The right side is reduced to one row per key before each join, so no left row is multiplied.
    """
    one = lambda k, out: right.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(out)).agg(F.min(value).alias(f"_{out}"))
    a, b = one(first[1], "_k1"), one(second[1], "_k2")
    out = left.join(a, left[first[0]] == a["_k1"], "left").join(b, left[second[0]] == b["_k2"], "left")
    return out.withColumn(value, F.coalesce("__k1", "__k2")).drop("_k1", "_k2", "__k1", "__k2")


def interval_join(points: DataFrame, ranges: DataFrame, file: str, line: str, start: str, end: str, key: str, width: int = 256) -> DataFrame:
    """``key`` of the first range of the same file that holds the line, else ``<global:file:line>``.

    Ranges are listed under each block of ``width`` lines they touch, so the join is on (file, block).
    """
    blocks = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width)))
    r = ranges.select(F.col(file).alias("_f"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(key).alias("_key"), blocks.alias("_b"))
    p = points.withColumn("_b", F.floor(F.col(line) / width))
    hit = p.join(r, (p[file] == r["_f"]) & (p["_b"] == r["_b"]) & p[line].between(r["_s"], r["_e"]), "left")
    keys = points.columns
    found = hit.groupBy(*keys).agg(F.min_by("_key", F.struct("_s", "_e", "_key")).alias(key))
    none = F.concat(F.lit("<global:"), F.col(file), F.lit(":"), F.col(line), F.lit(">"))
    return found.withColumn(key, F.coalesce(key, none))


def ancestors_of_path(path: Column) -> Column:
    """All prefixes of a path that end at a separator, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def best_root(items: DataFrame, path: str, roots: DataFrame, root: str, rank: list[Column]) -> DataFrame:
    """Per item the root that is an ancestor of its path, longest first, then by ``rank``.

    The ancestor test is an equi-join on the prefixes of the path instead of a comparison of all pairs.
    """
    keys = items.columns
    pairs = items.withColumn("_root", F.explode(ancestors_of_path(F.col(path)))).join(roots.withColumnRenamed(root, "_root"), "_root")
    order = F.struct(F.length("_root").alias("a"), *[c.alias(f"r{k}") for k, c in enumerate(rank)])
    return pairs.groupBy(*keys).agg(F.max_by("_root", order).alias(root))


def matched_root(procs: DataFrame, key: str, paths: list[tuple[str, str, int]], command: str, roots: DataFrame, root: str, owner: str, rank: list[Column]) -> DataFrame:
    """(key, owner, source, root): the best root of each process over several path columns and its command.

    ``paths``: (column, source, source rank); a root matches a path if it is the path or one of its folders. A root
    matches the command, with rank 1, if it is a word of it or a folder of one. Of all matches the largest (source
    rank, length of the root, *``rank`` of the root's row, owner) counts. All tests are equi-joins on the folders of paths.
    """
    legs = [procs.select(key, F.lit(n).alias("_n"), F.lit(source).alias("source"), F.explode(ancestors_of_path(F.col(c))).alias("_root")) for c, source, n in paths]
    words = procs.select(key, F.explode(F.split(command, "[\\s=:,;\"']+")).alias("_w"))
    legs.append(words.select(key, F.lit(1).alias("_n"), F.lit("command").alias("source"), F.explode(ancestors_of_path(F.col("_w"))).alias("_root")))
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    known = roots.select(F.col(root).alias("_root"), F.col(owner).alias("owner"), *[c.alias(f"_r{k}") for k, c in enumerate(rank)]).where("_root <> ''")
    hits = every.where("_root <> ''").distinct().join(known, "_root")
    order = F.struct("_n", F.length("_root").alias("_l"), *[f"_r{k}" for k in range(len(rank))], "owner", "source", "_root")
    best = hits.groupBy(key).agg(F.max(order).alias("_b"))
    return best.select(key, "_b.owner", "_b.source", F.col("_b._root").alias("root"))


def siblings(arms: DataFrame, group: str, arm: str) -> DataFrame:
    """(group, arm, arms): the arms that exclude each other, by membership; every other arm of the same group is a sibling.
    Groups of one arm give none; no group is sorted or built as a list, and there are no pairs."""
    once = arms.where(F.col(group).isNotNull() & F.col(arm).isNotNull()).select(group, arm).distinct()
    sizes = once.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("arms")).where("arms > 1")
    return once.join(sizes, once[group] == sizes["_g"]).select(group, arm, "arms")


def ready(units: DataFrame, unit: str, needs: DataFrame, need: str, done: DataFrame, done_key: str) -> DataFrame:
    """Units none of whose needs is still open."""
    open_ = needs.select(F.col(unit), F.col(need)).distinct().join(done.select(F.col(done_key).alias(need)).distinct(), need, "left_anti")
    return units.select(unit).distinct().join(open_.select(unit).distinct(), unit, "left_anti")


def with_unmatched(slots: DataFrame, owners: DataFrame, key: str, stale: str) -> DataFrame:
    """Full outer join; owners without a slot come out as ``stale`` rows in column state."""
    left = slots.withColumn("_s", F.lit(1))
    right = owners.withColumn("_o", F.lit(1))
    state = F.when(F.col("_s").isNull(), stale).when(F.col("_o").isNull(), "idle").otherwise("busy")
    return left.join(right, key, "full").withColumn("state", state).drop("_s", "_o")
