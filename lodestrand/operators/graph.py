"""Graph operators (G01–G25): closures, path expansion, folds and merges over edge tables.

Loops keep one table per round in the shared folder and join only the new frontier, so a round costs what
it adds. Path-shaped results carry the path and cut cycles on it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import durable, release


LOCAL_LINKS = 20_000
_VISIT = "scope string, node string, depth int, parent string"


def _visit_batches(max_depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for scope, links, roots in zip(*(batch.column(n).to_pylist() for n in ("scope", "links", "roots")), strict=True):
                below = defaultdict(set)
                for link in links or ():
                    below[link["src"]].add(link["dst"])
                seen, front, depth = {r: None for r in roots or ()}, sorted(roots or ()), 0
                while front:
                    for node in front:
                        for col, x in zip(cols, (scope, node, depth, seen[node]), strict=True):
                            col.append(x)
                    depth += 1
                    fresh: dict[str, str] = {}
                    for node in front if depth <= max_depth else ():
                        for x in below[node]:
                            if x not in seen:
                                fresh[x] = min(node, fresh.get(x, node))
                    seen |= fresh
                    front = sorted(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["scope", "node", "depth", "parent"])

    return run


def first_visit(edges: DataFrame, roots: DataFrame, max_depth: int = 2**31 - 1, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(scope, node, depth, parent) of every node some root of its scope reaches.

    ``edges``: scope, src, dst. ``roots``: scope, node. A node is visited once, at its least depth; of
    several parents at that depth the smallest counts. Scopes with at most ``local_links`` links and roots are walked
    one per row after one shuffle; larger ones round by round over the cluster.
    """
    edges = durable(edges.select("scope", "src", "dst").where("scope is not null and src is not null and dst is not null").distinct())
    roots = roots.select("scope", "node").where("scope is not null and node is not null").distinct()
    large = edges.select("scope").unionAll(roots.select("scope")).groupBy("scope").count().where(F.col("count") > local_links).select("scope")
    hot = not large.isEmpty()
    small = edges.join(large, "scope", "left_anti") if hot else edges
    small_roots = roots.join(large, "scope", "left_anti") if hot else roots
    packed = small_roots.groupBy("scope").agg(F.collect_list("node").alias("roots")).join(
        small.groupBy("scope").agg(F.collect_list(F.struct("src", "dst")).alias("links")), "scope", "left")
    out = packed.mapInArrow(_visit_batches(max_depth), _VISIT)
    if not hot:
        return out
    return out.unionAll(_visit_rounds(edges.join(large, "scope", "left_semi"), roots.join(large, "scope", "left_semi"), max_depth))


def _visit_rounds(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    front = durable(roots.select("scope", "node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    seen, parts, depth = front, [front], 0
    while depth < max_depth:
        depth += 1
        step = front.select("scope", F.col("node").alias("src")).join(edges, ["scope", "src"])
        fresh = step.groupBy("scope", F.col("dst").alias("node")).agg(F.lit(depth).alias("depth"), F.min("src").alias("parent"))
        front = durable(fresh.join(seen.select("scope", "node"), ["scope", "node"], "left_anti"))
        if front.isEmpty():
            break
        parts.append(front)
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = durable(seen)
            release(*parts[:-1])
            parts = [seen, front]
    return seen


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"scope": pa.string(), "node": pa.string(), "depth": pa.int32(), "path": pa.list_(pa.string()), "cycle": pa.bool_()}
    pack = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        held = 0
        for scope, links, roots in zip(*(batch.column(n).to_pylist() for n in ("scope", "links", "roots")), strict=True):
            below = defaultdict(list)
            for link in links or ():
                below[link["src"]].append(link["dst"])
            for root in roots or ():
                path: list[str] = []
                todo = [(root, 0)]  # depth first: one open path is held at a time
                while todo:
                    node, depth = todo.pop()
                    del path[depth:]
                    cycle = node in path
                    path.append(node)
                    for col, x in zip(cols, (scope, node, depth, list(path), cycle), strict=True):
                        col.append(x)
                    held += depth + 1
                    if not cycle:
                        todo += [(x, depth + 1) for x in below.get(node, ())]
                    if held > 50_000:
                        yield pack(cols)
                        cols, held = [[], [], [], [], []], 0
        yield pack(cols)


def all_paths(edges: DataFrame, roots: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(scope, node, depth, path, cycle): every path from a root, until no open path is left; cut
    where a node repeats on its own path (that row has cycle = true and is not followed).

    Scopes with at most ``local_links`` links and roots are expanded one per row after one shuffle; larger ones round by
    round over the cluster.
    """
    edges = durable(edges.select("scope", "src", "dst").where("scope is not null and src is not null and dst is not null").distinct())
    roots = roots.select("scope", "node").where("scope is not null and node is not null").distinct()
    large = edges.select("scope").unionAll(roots.select("scope")).groupBy("scope").count().where(F.col("count") > local_links).select("scope")
    hot = not large.isEmpty()
    small = edges.join(large, "scope", "left_anti") if hot else edges
    small_roots = roots.join(large, "scope", "left_anti") if hot else roots
    packed = small_roots.groupBy("scope").agg(F.collect_list("node").alias("roots")).join(
        small.groupBy("scope").agg(F.collect_list(F.struct("src", "dst")).alias("links")), "scope", "left")
    out = packed.mapInArrow(_path_batches, "scope string, node string, depth int, path array<string>, cycle boolean")
    if not hot:
        return out
    return out.unionAll(_path_rounds(edges.join(large, "scope", "left_semi"), roots.join(large, "scope", "left_semi")))


def _path_rounds(edges: DataFrame, roots: DataFrame) -> DataFrame:
    edges = durable(edges)
    front = durable(roots.select("scope", "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("cycle")))
    whole, parts = None, []  # parts: the levels since the last table of several
    while not front.isEmpty():
        parts.append(front)
        open_ = front.where("not cycle").select("scope", F.col("node").alias("src"), "depth", "path")
        front = durable(open_.join(edges, ["scope", "src"]).select(
            "scope", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("cycle")))
        if len(parts) == 16:  # keep the plan short
            some = durable(reduce(DataFrame.unionAll, parts))
            release(*parts)
            whole, parts = some if whole is None else whole.unionAll(some), []
    return reduce(DataFrame.unionAll, [*([] if whole is None else [whole]), *parts])


def all_path_facts(paths: DataFrame, facts: DataFrame, fact: str) -> DataFrame:
    """(path, facts): distinct facts that hold along a path, root to end, sorted. ``facts``: node, ``fact``. Nodes are joined
    under the path's number instead of the whole path."""
    numbered = durable(paths.select("path").distinct().withColumn("_id", F.monotonically_increasing_id()))
    along = numbered.select("_id", F.explode("path").alias("node"))
    held = along.join(facts.where(F.col(fact).isNotNull()).select("node", fact).distinct(), "node")
    found = held.groupBy("_id").agg(F.array_sort(F.collect_set(fact)).alias("facts"))
    return numbered.join(found, "_id").select("path", "facts")


def fold_state(steps: DataFrame, keys: list[str], order: list[str], clears: Column, starts: Column) -> DataFrame:
    """The ordered steps of a chain with their taint state.

    A clearing step makes the state clean from itself on, a starting step tainted; chains begin tainted. The state is
    that of the last step before that clears or starts: one running window, linear in the steps.
    """
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(clears, F.lit(False)).when(starts, F.lit(True))
    tainted = F.coalesce(F.last(change, ignorenulls=True).over(along), F.lit(True))
    step = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return steps.select(*keys, step.alias("step"), *order, F.when(tainted, "tainted").otherwise("clean").alias("state"))


def callee_effect(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Effect of a function's graph on its taint: sanitized, return, propagate or unchanged, the first that holds.

    ``nodes`` has a boolean ``sanitized``, ``edges`` a column ``kind``; functions without nodes are absent (unknown).
    """
    a = nodes.groupBy(*keys).agg(F.bool_or("sanitized").alias("s"))
    b = edges.groupBy(*keys).agg(F.bool_or(F.col("kind") == "return").alias("r"), F.bool_or(F.col("kind") == "callee").alias("p"))
    effect = F.when(F.col("s"), "sanitized").when(F.col("r"), "return").when(F.col("p"), "propagate").otherwise("unchanged")
    return a.join(b, keys, "left").select(*keys, effect.alias("effect"))


def merge_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Steps of equal keys as one: united names and positions, smallest positive line."""
    return steps.groupBy(*keys).agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("position")).alias("positions"),
        F.min(F.when(F.col("line") > 0, F.col("line"))).alias("line"), F.count("*").alias("merged"),
    )
