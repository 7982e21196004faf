"""Problem 6: parent links of unknown depth as distances to roots, paths, descendants and cycles.

Every scope (a task, a function's graph) is one link graph in which a node may have several parents. The
method is that of hash splitters. A deterministic hash chooses splitters among the nodes, and every root
and every node with several parents is one, so that no walk branches and all walks together are about
SPLIT_EVERY times the links. Each node is walked upwards to its next splitters; the reduced graph of splitters is solved for
the distances to roots and for its strongly connected components; the walks are then expanded. Cycles
without any splitter show as walks that come back to their own node and are handled there.

Scopes with at most ``LOCAL_LINKS`` links are solved one per row, in Arrow batches, after one shuffle by
scope. Larger scopes are solved by joins over the whole cluster (``solve_distributed``), so that a scope
with a third of all links is never held by one task.

Defined results: links with a NULL scope do not count; a link with one NULL end only names its other end
as a node; repeated links count once; a node without links is its own root only if it is named; nodes
that no root reaches give no root row; an empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import durable, release

LOCAL_LINKS = 20_000
SPLIT_EVERY = 8
OUT_SCHEMA = "scope_key string, node_key string, root_key string, link_depth long"
PATH_SCHEMA = OUT_SCHEMA + ", path array<string>"
BELOW_SCHEMA = "scope_key string, node_key string, descendant_key string, link_depth long"


# ---------------------------------------------------------------- one scope in memory


def _is_splitter(node: str, every: int) -> bool:
    return zlib.crc32(node.encode()) % every == 0


def _walks(nodes: list[str], parents: dict[str, list[str]], stop: set[str]) -> tuple[dict, dict, set[str]]:
    """Per node the splitters met first on the way up with the fewest links, the non-splitters passed, and
    the nodes whose walk came back to themselves."""
    met, passed, loops = {}, {}, set()
    for node in nodes:
        seen, frontier, depth = set(), [node], 0
        found: dict[str, int] = {}
        while frontier:
            depth += 1
            following = []
            for at in frontier:
                for up in parents.get(at, ()):
                    if up == node:
                        loops.add(node)
                    if up in stop:
                        found.setdefault(up, depth)
                    elif up not in seen:
                        seen.add(up)
                        following.append(up)
            frontier = following
        met[node], passed[node] = found, seen
    return met, passed, loops


def _components(nodes: list[str], edges: dict[str, dict[str, int]]) -> dict[str, int]:
    """Strongly connected components, by an iterative depth-first search in both directions."""
    order, seen = [], set()
    for start in nodes:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(edges[start]))]
        while stack:
            at, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                order.append(stack.pop()[0])
            else:
                seen.add(nxt)
                stack.append((nxt, iter(edges[nxt])))
    back = defaultdict(list)
    for a in nodes:
        for b in edges[a]:
            back[b].append(a)
    label: dict[str, int] = {}
    for start in reversed(order):
        if start not in label:
            name, todo = len(label), [start]
            label[start] = name
            while todo:
                for x in back[todo.pop()]:
                    if x not in label:
                        label[x] = name
                        todo.append(x)
    return label


def solve_scope(named: set[str], links: set[tuple[str, str]], every: int = SPLIT_EVERY) -> list[tuple[str, str, int]]:
    """(node, root, fewest links) of one scope, and (node, "", -1) of each node on a cycle."""
    parents: dict[str, list[str]] = defaultdict(list)
    for child, parent in links:
        parents[child].append(parent)
    nodes = sorted(named)
    roots = [x for x in nodes if x not in parents]
    stop = {x for x in nodes if len(parents.get(x, ())) != 1 or _is_splitter(x, every)}
    met, passed, on_cycle = _walks(nodes, parents, stop)

    # Reduced graph: distances of splitters to roots by relaxation from the roots outwards.
    below = defaultdict(list)
    for s in stop:
        for t, d in met[s].items():
            below[t].append((s, d))
    to_root: dict[str, dict[str, int]] = {s: {} for s in stop}
    for root in roots:
        rings, depth = {0: [root]}, 0
        while rings:
            depth = min(rings)
            for s in rings.pop(depth):
                if root not in to_root[s]:
                    to_root[s][root] = depth
                    for x, d in below[s]:
                        if root not in to_root[x]:
                            rings.setdefault(depth + d, []).append(x)
    out = []
    for node in nodes:
        best: dict[str, int] = dict(to_root[node]) if node in stop else {}
        if node not in stop:
            for s, d in met[node].items():
                for root, far in to_root[s].items():
                    if d + far < best.get(root, d + far + 1):
                        best[root] = d + far
        out += [(node, root, d) for root, d in best.items()]

    # Cycles: splitters by component, other nodes by a passing walk between splitters of one component.
    label = _components(sorted(stop), {s: met[s] for s in stop})
    size = defaultdict(int)
    for s in stop:
        size[label[s]] += 1
    for s in stop:
        if size[label[s]] > 1 or s in met[s]:
            on_cycle.add(s)
        for node in passed[s]:
            if any(label[t] == label[s] for t in met[node]):
                on_cycle.add(node)
    return out + [(node, "", -1) for node in sorted(on_cycle)]


def scope_paths(named: set[str], links: set[tuple[str, str]], every: int = SPLIT_EVERY) -> Iterator[tuple[str, str, int, list[str]]]:
    """(node, root, fewest links, path from the root to the node) of one scope.

    Of several shortest paths the one counts whose last step, then the step before and so on, comes from
    the smallest name. Only the predecessors are held; each path is expanded as it is given out.
    """
    parents: dict[str, list[str]] = defaultdict(list)
    for child, parent in links:
        parents[child].append(parent)
    far = {(node, root): d for node, root, d in solve_scope(named, links, every) if d >= 0}
    above = {(node, root): min(p for p in parents[node] if far.get((p, root)) == d - 1) for (node, root), d in far.items() if d}
    for (node, root), d in far.items():
        path = [node]
        while len(path) <= d:
            path.append(above[path[-1], root])
        yield node, root, d, path[::-1]


def scope_descendants(named: set[str], links: set[tuple[str, str]], every: int = SPLIT_EVERY) -> Iterator[tuple[str, str, int]]:
    """(node, descendant, fewest links, at least one) of one scope; a node on a cycle is its own descendant."""
    below: dict[str, list[str]] = defaultdict(list)
    for child, parent in links:
        below[parent].append(child)
    for node in sorted(below):
        seen, frontier, depth = set(), [node], 0
        while frontier:
            depth += 1
            following = []
            for at in frontier:
                for down in below.get(at, ()):
                    if down not in seen:
                        seen.add(down)
                        following.append(down)
                        yield node, down, depth
            frontier = following


def _solve_batches(every: int, solver=solve_scope, schema: str = OUT_SCHEMA):
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            held = 0
            for scope, links in zip(batch.column("scope").to_pylist(), batch.column("links").to_pylist(), strict=True):
                named, pairs = set(), set()
                for link in links:
                    child, parent = link["child"], link["parent"]
                    named.update(x for x in (child, parent) if x is not None)
                    if child is not None and parent is not None:
                        pairs.add((child, parent))
                for row in solver(named, pairs, every):
                    for col, x in zip(cols, (scope, *row), strict=True):
                        col.append(x)
                    held += len(row[-1]) if isinstance(row[-1], list) else 1
                    if held > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                        cols, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


# ---------------------------------------------------------------- a scope larger than one task


def _splits(node: Column, every: int) -> Column:
    return F.pmod(F.crc32(node.cast("binary")), F.lit(every)) == 0


def _grow(start: DataFrame, step, keys: list[str], best: list[Column]) -> DataFrame:
    """Fixed point of ``step`` on frames with ``keys``: new keys only, each round cut off as a table."""
    done = frontier = durable(start)
    parts, rounds = [frontier], 0
    while not frontier.isEmpty():
        fresh = step(frontier).groupBy(*keys).agg(*best).join(done.select(*keys), keys, "left_anti")
        frontier = durable(fresh)
        parts.append(frontier)
        joined = done.unionByName(frontier)
        rounds += 1
        if rounds % 8 == 0:  # keep the plan short
            done = durable(joined)
            release(*parts[:-1])  # the frontier is read again
            parts = [done, frontier]
        else:
            done = joined
    return done


class _Reduced:
    """The walks and the reduced graph of all scopes. ``links``: scope, child, parent (ends may be NULL)."""

    def __init__(self, links: DataFrame, every: int):
        links = durable(links.distinct())
        self.pairs = links.where("child is not null and parent is not null")
        named = durable(
            links.select("scope", F.col("child").alias("node")).unionAll(links.select("scope", F.col("parent").alias("node")))
            .where("node is not null").distinct()
        )
        has_parent = self.pairs.select("scope", F.col("child").alias("node")).distinct()
        self.roots = durable(named.join(has_parent, ["scope", "node"], "left_anti"))
        joins = self.pairs.groupBy("scope", F.col("child").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("scope", "node")
        self.stop = stop = durable(named.where(_splits(F.col("node"), every)).unionAll(self.roots).unionAll(joins).distinct())
        flagged = durable(
            self.pairs.join(stop.select("scope", F.col("node").alias("parent"), F.lit(True).alias("stops")), ["scope", "parent"], "left")
            .select("scope", F.col("child").alias("at"), F.col("parent").alias("up"), F.coalesce("stops", F.lit(False)).alias("stops"))
        )

        # Walks: (scope, node, at, stops, d); a walk goes on from non-splitters only. Rings of equal length come
        # one after the other, so the first d of a pair is its fewest links.
        first = flagged.select("scope", F.col("at").alias("node"), F.col("up").alias("at"), "stops", F.lit(1).alias("d"))

        def climb(front: DataFrame) -> DataFrame:
            on = front.where("not stops").select("scope", "node", "at", "d")
            return on.join(flagged, ["scope", "at"]).select("scope", "node", F.col("up").alias("at"), flagged["stops"], (F.col("d") + 1).alias("d"))

        self.walks = durable(_grow(first, climb, ["scope", "node", "at"], [F.first("stops").alias("stops"), F.min("d").alias("d")]))
        self.met = self.walks.where("stops").select("scope", "node", F.col("at").alias("s"), "d")
        self.edges = durable(self.met.join(stop, ["scope", "node"], "left_semi").select("scope", F.col("node").alias("a"), F.col("s").alias("b"), "d"))

    def distances(self, ends: DataFrame) -> DataFrame:
        """(scope, a, root, far) of splitters to ``ends`` (scope, node) above them, relaxed until nothing improves."""
        dist = durable(ends.select("scope", F.col("node").alias("a"), F.col("node").alias("root"), F.lit(0).alias("far")))
        changed = dist
        while not changed.isEmpty():
            offer = (
                changed.withColumnRenamed("a", "b").join(self.edges, ["scope", "b"])
                .groupBy("scope", "a", "root").agg(F.min(F.col("far") + F.col("d")).alias("far"))
            )
            merged = durable(
                dist.withColumn("new", F.lit(0)).unionByName(offer.withColumn("new", F.lit(1))).groupBy("scope", "a", "root")
                .agg(F.min("far").alias("far"), F.min(F.when(F.col("new") == 0, F.col("far"))).alias("was"))
            )
            changed = merged.where("was is null or far < was").select("scope", "a", "root", "far")
            dist, before = merged.select("scope", "a", "root", "far"), dist
            release(before)
        return dist

    def through(self) -> DataFrame:
        """(scope, node, root, far) of every node to every root above it."""
        dist = self.distances(self.roots)
        others = self.met.join(self.stop, ["scope", "node"], "left_anti").withColumnRenamed("s", "a")
        return (
            others.join(dist, ["scope", "a"]).groupBy("scope", "node", "root").agg(F.min(F.col("d") + F.col("far")).alias("far"))
            .unionByName(dist.withColumnRenamed("a", "node"))
        )


def solve_distributed(links: DataFrame, every: int = SPLIT_EVERY) -> DataFrame:
    """As ``solve_scope`` for all scopes at once, by joins. ``links``: scope, child, parent (ends may be NULL)."""
    g = _Reduced(links, every)
    walks, met, reduced, through = g.walks, g.met, g.edges, g.through()

    # Cycles: components of the reduced graph, then the non-splitters that walks between them pass.
    label = _labels(reduced)
    looped = walks.where("node = at").select("scope", "node")
    big = label.groupBy("scope", "label").agg(F.count("*").alias("n")).where("n > 1").select("scope", "label")
    on_splitters = label.join(big, ["scope", "label"], "left_semi").select("scope", F.col("a").alias("node"))
    from_s = walks.where("not stops").join(label.withColumnRenamed("a", "node"), ["scope", "node"]).select(
        "scope", F.col("at").alias("node"), "label")
    to_t = met.join(label.withColumnRenamed("a", "s"), ["scope", "s"]).select("scope", "node", "label")
    passing = from_s.distinct().join(to_t.distinct(), ["scope", "node", "label"], "left_semi").select("scope", "node")
    cycles = looped.unionAll(on_splitters).unionAll(passing).distinct()
    return through.select(
        F.col("scope").alias("scope_key"), F.col("node").alias("node_key"), F.col("root").alias("root_key"), F.col("far").cast("long").alias("link_depth")
    ).unionAll(cycles.select("scope", "node", F.lit(""), F.lit(-1).cast("long")))


def paths_distributed(links: DataFrame, every: int = SPLIT_EVERY) -> DataFrame:
    """As ``scope_paths`` for all scopes at once: the pieces of a path double each round, along predecessors."""
    g = _Reduced(links, every)
    far = durable(g.through().select("scope", "node", "root", F.col("far").cast("long").alias("far")))
    above = (
        far.join(g.pairs.withColumnRenamed("child", "node"), ["scope", "node"])
        .join(far.select("scope", F.col("node").alias("parent"), "root", (F.col("far") + 1).alias("far")), ["scope", "parent", "root", "far"])
        .groupBy("scope", "node", "root").agg(F.min("parent").alias("up"))
    )
    piece = durable(far.join(above, ["scope", "node", "root"], "left").select("scope", "node", "root", "far", "up", F.array("node").alias("path")))
    whole, unfinished = piece.where("up is null"), piece.where("up is not null")
    while not unfinished.isEmpty():
        upper = whole.unionByName(unfinished).select("scope", "root", F.col("node").alias("up"), F.col("up").alias("upper"), F.col("path").alias("head"))
        step = durable(unfinished.join(upper, ["scope", "root", "up"]).select(
            "scope", "node", "root", "far", F.col("upper").alias("up"), F.concat("head", "path").alias("path")))
        whole, unfinished = whole.unionByName(step.where("up is null")), step.where("up is not null")
    return whole.select(F.col("scope").alias("scope_key"), F.col("node").alias("node_key"), F.col("root").alias("root_key"), F.col("far").alias("link_depth"), "path")


def descendants_distributed(links: DataFrame, every: int = SPLIT_EVERY) -> DataFrame:
    """As ``scope_descendants`` for all scopes at once: walk to a splitter, splitter to splitter, walk from there."""
    g = _Reduced(links, every)
    between = g.met.withColumnRenamed("s", "a").join(g.distances(g.stop), ["scope", "a"])
    reached = between.groupBy("scope", "node", "root").agg(F.min(F.col("d") + F.col("far")).alias("far"))
    beyond = reached.withColumnRenamed("root", "s").join(g.walks.select("scope", F.col("node").alias("s"), "at", "d"), ["scope", "s"])
    pairs = g.walks.select("scope", "node", "at", "d").unionAll(beyond.select("scope", "node", "at", F.col("far") + F.col("d")))
    return pairs.groupBy(F.col("scope").alias("scope_key"), F.col("at").alias("node_key"), F.col("node").alias("descendant_key")).agg(
        F.min("d").cast("long").alias("link_depth"))


def _labels(edges: DataFrame) -> DataFrame:
    """Component label (scope, a, label) of each vertex on a directed path between vertices of ``edges``.

    Colouring: nodes without an in- or out-link are trimmed until none is left; the largest name that
    reaches a vertex colours it; the vertices of a colour that reach its namesake are its component and
    leave; the rest starts anew.
    """
    left = durable(edges.select("scope", "a", "b").distinct())
    found = None
    while True:
        while True:  # trim
            ins = left.select("scope", F.col("b").alias("v")).distinct()
            outs = left.select("scope", F.col("a").alias("v")).distinct()
            both = ins.join(outs, ["scope", "v"], "left_semi")
            kept = durable(
                left.join(both.withColumnRenamed("v", "a"), ["scope", "a"], "left_semi").join(both.withColumnRenamed("v", "b"), ["scope", "b"], "left_semi")
            )
            same = kept.count() == left.count()
            release(left)
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = durable(left.select("scope", F.col("a").alias("v"), F.col("a").alias("c")).distinct())
        while True:  # the largest name that reaches a vertex
            sent = left.join(colour.withColumnRenamed("v", "a"), ["scope", "a"]).select("scope", F.col("b").alias("v"), "c")
            wider = durable(colour.unionByName(sent).groupBy("scope", "v").agg(F.max("c").alias("c")))
            moved = wider.join(colour, ["scope", "v", "c"], "left_anti").isEmpty()
            release(colour)
            colour = wider
            if moved:
                break
        inside = durable(
            left.join(colour.select("scope", F.col("v").alias("a"), F.col("c").alias("ca")), ["scope", "a"])
            .join(colour.select("scope", F.col("v").alias("b"), F.col("c").alias("cb")), ["scope", "b"]).where("ca = cb").select("scope", "a", "b")
        )
        seeds = colour.where("v = c")
        group = _reach(seeds, inside)
        found = group if found is None else durable(found.unionByName(group))
        gone = group.select("scope", F.col("v").alias("a"))
        rest = durable(
            left.join(gone, ["scope", "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), ["scope", "b"], "left_anti")
        )
        release(left, inside, colour)
        left = rest
    vertices = edges.select("scope", "a").unionAll(edges.select("scope", F.col("b").alias("a"))).distinct()
    if found is None:
        return vertices.withColumn("label", F.col("a"))
    return durable(vertices.join(found.select("scope", F.col("v").alias("a"), "c"), ["scope", "a"], "left").select("scope", "a", F.coalesce("c", "a").alias("label")))


def _reach(seeds: DataFrame, inside: DataFrame) -> DataFrame:
    """Vertices from which a seed of their colour is reached: (scope, v, c)."""
    done = frontier = durable(seeds.select("scope", "v", "c"))
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("v", "b").join(inside, ["scope", "b"]).select("scope", F.col("a").alias("v"), "c").distinct()
        frontier = durable(step.join(done, ["scope", "v"], "left_anti"))
        done = durable(done.unionByName(frontier))
    return done


# ---------------------------------------------------------------- both together


def _both(links: DataFrame, local_links: int, every: int, solver, schema: str, distributed) -> DataFrame:
    links = links.select("scope", "child", "parent").where("scope is not null and (child is not null or parent is not null)")
    large = links.groupBy("scope").count().where(F.col("count") > local_links).select("scope")
    hot = not large.isEmpty()
    small = links.join(large, "scope", "left_anti") if hot else links
    packed = small.groupBy("scope").agg(F.collect_list(F.struct("child", "parent")).alias("links"))
    out = packed.mapInArrow(_solve_batches(every, solver, schema), schema)
    return out.unionAll(distributed(links.join(large, "scope", "left_semi"), every)) if hot else out


def solve(links: DataFrame, local_links: int = LOCAL_LINKS, every: int = SPLIT_EVERY) -> DataFrame:
    """(scope_key, node_key, root_key, link_depth) of ``links``: scope, child, parent (an end may be NULL).

    Fewest links from each node to each root it is reached from; root_key '' and -1 for nodes on a cycle.
    """
    return _both(links, local_links, every, solve_scope, OUT_SCHEMA, solve_distributed)


def paths(links: DataFrame, local_links: int = LOCAL_LINKS, every: int = SPLIT_EVERY) -> DataFrame:
    """(scope_key, node_key, root_key, link_depth, path): a shortest path from each root to each node it reaches."""
    return _both(links, local_links, every, scope_paths, PATH_SCHEMA, paths_distributed)


def descendants(links: DataFrame, local_links: int = LOCAL_LINKS, every: int = SPLIT_EVERY) -> DataFrame:
    """(scope_key, node_key, descendant_key, link_depth): every node below each node, by the fewest links."""
    return _both(links, local_links, every, scope_descendants, BELOW_SCHEMA, descendants_distributed)
