"""G04, G17, G18, G25 without a bound on the length of paths."""

from collections import Counter

import __spark_entry__ as entry
from lodestrand.operators import graph

CHAIN = [f"c{k:02}" for k in range(20)]
LINKS = {
    "a": set(zip(CHAIN, CHAIN[1:], strict=False)) | {("c19", "c17"), ("c03", "x"), ("x", "c05"), ("c05", "c05"), ("c18", "x")},
    "b": set(zip(CHAIN[:7], CHAIN[1:7], strict=False)) | {("p", "q"), ("q", "p")},
}
ROOTS = {("a", "c00"), ("b", "c00")}


def brute():
    out = []

    def follow(scope, path):
        cycle = path[-1] in path[:-1]
        out.append((scope, path[-1], len(path) - 1, path, cycle))
        for src, dst in LINKS[scope] if not cycle else ():
            if src == path[-1]:
                follow(scope, (*path, dst))

    for scope, root in ROOTS:
        follow(scope, (root,))
    return out


def frames(spark):
    edges = [(s, a, b) for s, links in LINKS.items() for a, b in links]
    return spark.createDataFrame(edges * 2, "scope string, src string, dst string"), spark.createDataFrame(sorted(ROOTS), "scope string, node string")


def test_all_paths(spark):
    for local_links in (graph.LOCAL_LINKS, 10, 0):
        got = [(r.scope, r.node, r.depth, tuple(r.path), r.cycle) for r in graph.all_paths(*frames(spark), local_links).collect()]
        assert sorted(got) == sorted(brute())
    assert max(d for _, _, d, _, _ in got) == 20


def test_all_path_facts(spark):
    facts = {"c01": {"v1"}, "c12": {"v2", "v1"}, "x": {"v0"}}
    df = spark.createDataFrame([(n, v) for n, vs in facts.items() for v in vs] + [("c00", None)], "node string, summary string")
    got = {tuple(r.path): r.facts for r in graph.all_path_facts(graph.all_paths(*frames(spark)), df, "summary").collect()}
    want = {path: sorted({v for n in path for v in facts.get(n, ())}) for _, _, _, path, _ in brute()}
    assert got == {k: v for k, v in want.items() if v}


def test_queries_over_a_table(spark, tmp_path):
    rows = [(f"t{s}", a, b, b.upper(), 1, None, f'[{{"summary": "at {a}"}}]') for s, links in LINKS.items() for a, b in links]
    spark.createDataFrame(rows, "task_id string, source_node_id string, target_node_id string, target_function_resolved string, visible_in_tree int, reason_code string, validations_json string").write.parquet(
        f"{tmp_path}/dvs_task_graph_edges.parquet")
    spark.createDataFrame([("c01",), ("c01",), (None,)], "node_id string").write.parquet(f"{tmp_path}/dvs_task_graph_nodes.parquet")
    run = lambda name: [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    tree = [(f"t{s}", n, d, ">".join(p), c) for s, n, d, p, c in brute()]
    assert sorted(run("g04_path_tree")) == sorted((*x, x[1] != "c01") for x in tree)
    fork = Counter((s, ">".join(n.upper() for n in p.split(">")[1:])) for s, _, d, p, c in tree if d and not c)
    heads = Counter()  # the root of a path has the function of its incoming link, if it has one
    for s, f, n, _ in run("g17_equal_paths"):
        heads[(s, f.partition(">")[2])] += n
    assert heads == fork
    flat = Counter((s, n, p.split(">")[-2] if d else None, d, c) for s, n, d, p, c in tree)
    assert {(s, n, up, d, c): k for s, n, up, d, c, k in run("g25_flat_tree")} == flat
    starts = {a for links in LINKS.values() for a, _ in links}
    assert dict(run("g18_path_validations")) == {p: "|".join(sorted({f"at {n}" for n in p.split(">") if n in starts})) for _, _, _, p, _ in tree}
