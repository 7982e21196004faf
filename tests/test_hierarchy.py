"""Problem 6."""

import os
import random

import pytest

from lodestrand.operators import hierarchy as H


def brute(named, links):
    up, down = {}, {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
        down.setdefault(p, set()).add(c)
    out = set()
    for root in (n for n in named if n not in up):
        dist, queue = {root: 0}, [root]
        for x in queue:
            for y in down.get(x, ()):
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        out |= {(n, root, d) for n, d in dist.items()}
    for n in named:
        seen, todo = set(), list(up.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        if n in seen:
            out.add((n, "", -1))
    return out


def sample(rnd, n):
    links = {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(int(n * rnd.choice([0.8, 1, 1.3])))}
    return {(a, b) for a, b in links if a > b or rnd.random() < 0.1} if rnd.random() < 0.5 else links


def test_scope_in_memory():
    rnd = random.Random(5)
    for _ in range(1500):
        links = sample(rnd, rnd.randint(1, 25))
        named = {x for link in links for x in link} | {"z"}
        got = H.solve_scope(named, links, rnd.choice([2, 4, 8]))
        assert len(got) == len(set(got)) and set(got) == brute(named, links)


def test_long_chain_in_memory():
    links = {(f"{k:06}", f"{k - 1:06}") for k in range(1, 30_000)}
    got = H.solve_scope({x for link in links for x in link}, links)
    assert len(got) == 30_000 and max(d for _, _, d in got) == 29_999


def test_distributed_equals_local(spark):
    rnd = random.Random(7)
    rows, want = [], set()
    for s in range(3):
        links = sample(rnd, 30) | ({("q1", "q2"), ("q2", "q1"), ("n1", "q1")} if s == 2 else set())
        rows += [(f"s{s}", a, b, 1) for a, b in links] + [(f"s{s}", "lonely", None, 1)]
        want |= {(f"s{s}", *x) for x in brute({x for link in links for x in link} | {"lonely"}, links)}
    df = spark.createDataFrame(rows + [(None, "a", "b", 1), ("s0", None, None, 1)], "scope string, child string, parent string, links int")
    local = [tuple(r) for r in H.solve(df).collect()]
    assert set(local) == want and len(local) == len(want)
    big = [tuple(r) for r in H.solve(df, local_links=0, every=4).collect()]
    assert set(big) == want and len(big) == len(want)


def unsplit(mark, n):
    """n names of which none is a splitter."""
    return [x for x in (f"{mark}{k:03}" for k in range(3 * n)) if not H._is_splitter(x, H.SPLIT_EVERY)][:n]


def test_distributed_long_walks_without_splitters(spark):
    chain, ring = unsplit("c", 36), unsplit("r", 28)
    links = set(zip(chain[1:], chain[:-1], strict=True)) | set(zip(ring, ring[1:] + ring[:1], strict=True))
    df = spark.createDataFrame([("s", a, b) for a, b in links], "scope string, child string, parent string")
    got = [tuple(r) for r in H.solve(df, local_links=0).collect()]
    want = {("s", *x) for x in brute({x for link in links for x in link}, links)}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="minutes; set SLOW_TESTS")
def test_distributed_on_a_large_cyclic_graph(spark):
    rnd = random.Random(3)
    links = {(f"c{k:04}", f"c{k - 1:04}") for k in range(1, 200)} | {(f"n{rnd.randrange(5000)}", f"n{rnd.randrange(5000)}") for _ in range(4000)}
    links |= {(f"n{k}", f"n{(k + 1) % 61}") for k in range(61)}
    df = spark.createDataFrame([("s", a, b) for a, b in links], "scope string, child string, parent string")
    want = {("s", *x) for x in H.solve_scope({x for link in links for x in link}, links)}
    got = [tuple(r) for r in H.solve(df, local_links=0, every=8).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="minutes; set SLOW_TESTS")
def test_a_scope_above_the_switch(spark):
    rnd = random.Random(4)
    links = {(f"n{k}", f"n{rnd.randrange(k)}") for k in range(1, 11_000) for _ in range(2)} | {(f"n{k}", f"n{k - 1}") for k in range(1, 40)}
    assert len(links) > H.LOCAL_LINKS
    df = spark.createDataFrame([("hot", a, b) for a, b in links] + [("cold", "x", "y")], "scope string, child string, parent string")
    want = {("hot", *x) for x in H.solve_scope({x for link in links for x in link}, links)} | {("cold", "x", "y", 1), ("cold", "y", "y", 0)}
    got = [tuple(r) for r in H.solve(df).collect()]
    assert set(got) == want and len(got) == len(want)


def brute_paths(named, links):
    """(node, root, depth, path): shortest paths, of equal ones the smallest when read from the node up."""
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    best = {}
    for node, root, d in brute(named, links):
        if d >= 0:
            level = [(node,)]
            for _ in range(d):
                level = [(*path, p) for path in level for p in up.get(path[-1], ())]
            best[node, root] = (node, root, d, min(path for path in level if path[-1] == root)[::-1])
    return set(best.values())


def brute_descendants(links):
    out = {}
    for start in {p for _, p in links}:
        level, depth = {start}, 0
        while level:
            depth += 1
            level = {c for c, p in links if p in level and (start, c) not in out}
            out |= {(start, c): depth for c in level}
    return {(a, b, d) for (a, b), d in out.items()}


def test_paths_and_descendants_in_memory():
    rnd = random.Random(11)
    for _ in range(300):
        links = sample(rnd, rnd.randint(1, 12))
        named = {x for link in links for x in link} | {"z"}
        got = [(n, r, d, tuple(p)) for n, r, d, p in H.scope_paths(named, links, rnd.choice([2, 4, 8]))]
        assert set(got) == brute_paths(named, links) and len(got) == len(set(got))
        got = list(H.scope_descendants(named, links))
        assert set(got) == brute_descendants(links) and len(got) == len(set(got))


def test_paths_and_descendants_distributed(spark):
    rnd = random.Random(13)
    chain, ring = unsplit("c", 12), unsplit("r", 5)
    links = [sample(rnd, 14), set(zip(chain[1:], chain[:-1], strict=True)) | set(zip(ring, ring[1:] + ring[:1], strict=True)) | {("r9", chain[3]), (ring[0], chain[5])}]
    rows = [(f"s{k}", a, b) for k, some in enumerate(links) for a, b in some] + [("s0", "lonely", None), (None, "a", "b")]
    df = spark.createDataFrame(rows, "scope string, child string, parent string")
    paths = {("s0", "lonely", "lonely", 0, ("lonely",))} | {(f"s{k}", *x) for k, some in enumerate(links) for x in brute_paths({n for link in some for n in link}, some)}
    below = {(f"s{k}", *x) for k, some in enumerate(links) for x in brute_descendants(some)}
    for local_links in (H.LOCAL_LINKS, 0):
        got = [(r.scope_key, r.node_key, r.root_key, r.link_depth, tuple(r.path)) for r in H.paths(df, local_links, 4).collect()]
        assert set(got) == paths and len(got) == len(paths)
        got = [tuple(r) for r in H.descendants(df, local_links, 4).collect()]
        assert set(got) == below and len(got) == len(below)


def test_paths_and_descendants_are_queries():
    import __spark_entry__ as entry

    assert {"p6_paths", "p6_descendants"} <= set(entry.queries())


def test_empty(spark):
    assert H.solve(spark.createDataFrame([], "scope string, child string, parent string")).count() == 0
