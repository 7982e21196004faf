"""G09, G10 across functions."""

import __spark_entry__ as entry

NODES = "rec_id long, func_id string, taint_signature string, node_id int, line int, taint string, parents_json string, prune_json string, is_source int, task_id string"
EDGES = "func_id string, taint_signature string, edge_id string, from_node int, to_node int, line int, taints_json string, kind string, sink_ref string, param_taints_json string, task_id string"
CLEAN = '{"reason": "sanitized"}'


def call(func, taint, edge, line, name, param, task="t-1"):
    return (func, taint, edge, 1, 2, line, f'["{taint}"]', "callee", name, f'[{{"param": "{param}", "taint": "{taint}"}}]', task)


def plain(func, taint, edge, line, kind, task="t-1"):
    return (func, taint, edge, 1, None, line, f'["{taint}"]', kind, None, None, task)


def tables(spark, tmp_path):
    graphs = [("A", "m"), ("A", "n"), ("B", "x"), ("C", "y"), *[(f"D{k}", "z") for k in range(11)]]
    nodes = [(k, f, s, 1, 5, s, "[]", CLEAN if f == "C" else None, 1, "t-1") for k, (f, s) in enumerate(graphs)]
    edges = [
        call("A", "m", "e1", 10, "bee", "x"), call("A", "m", "e2", 20, "cee", "y"), plain("A", "m", "e3", 30, "inside"),
        plain("A", "m", "e4", 40, "source"), call("A", "m", "e5", 50, "memcpy", "x"), call("A", "m", "e6", 60, "p->fn", "x"),
        plain("A", "n", "e1", 15, "inside"),
        call("B", "x", "e1", 1, "aye", "m"), plain("B", "x", "e2", 2, "return"), call("B", "x", "e3", 3, "cee", "nothing"),
        *[call(f"D{k}", "z", "e1", 1, f"dee{k + 1}", "z") for k in range(10)],
    ]
    edges += [edges[0]]  # repeated row
    names = [("0xa", "aye"), ("b", "bee"), ("c", "cee"), ("m", "memcpy"), *[(f"d{k}", f"dee{k}") for k in range(11)]]
    spark.createDataFrame(nodes, NODES).write.parquet(f"{tmp_path}/dag_nodes.parquet")
    spark.createDataFrame(edges, EDGES).write.parquet(f"{tmp_path}/dag_edges.parquet")
    spark.createDataFrame([(a, b, b) for a, b in names], "func_id string, func_name string, name_tail string").write.parquet(f"{tmp_path}/dvs_functions.parquet")
    return str(tmp_path)


def test_chains(spark, tmp_path):
    folder = tables(spark, tmp_path)
    rows = entry.queries()["g09_whole_chains"](spark, folder).collect()
    of = lambda f, s: {r.step: (r.at_func, r.kind, r.effect, r.state) for r in rows if (r.func_id, r.taint_signature) == (f, s)}
    assert of("a", "m") == {
        "0": ("a", "entry", None, "tainted"), "1": ("a", "callee", "return", "tainted"),
        "1.0": ("b", "entry", None, "tainted"), "1.1": ("b", "callee", "unchanged", "tainted"), "1.1.0": ("a", "cycle", None, "tainted"),
        "1.2": ("b", "return", None, "tainted"), "1.3": ("b", "callee", "unknown", "tainted"),
        "2": ("a", "callee", "sanitized", "clean"), "2.0": ("c", "entry", None, "tainted"),
        "3": ("a", "inside", None, "clean"), "4": ("a", "source", None, "tainted"),
        "5": ("a", "callee", "sink", "tainted"), "6": ("a", "callee", "indirect", "tainted"),
    }
    assert set(of("a", "n")) == {"0", "1"}  # another taint of the function is another chain
    deep = [r for r in rows if r.func_id == "d0"]
    assert max(r.depth for r in deep) == 8 and {r.at_func for r in deep} == {f"d{k}" for k in range(9)}
    assert len(rows) == len({(r.func_id, r.taint_signature, r.step) for r in rows})
    last = {(r.func_id, r.taint_signature): r.state for r in entry.queries()["g10_whole_final_state"](spark, folder).collect()}
    assert len(last) == 15 and last["a", "m"] == "tainted" and set(last.values()) == {"tainted"}


def test_final_state_is_clean_after_a_sanitizing_callee(spark, tmp_path):
    row = [(1, "C", "y", 1, 5, "y", "[]", CLEAN, 1, "T_1"), (2, "A", "m", 1, 5, "m", "[]", None, 1, "t-1")]
    spark.createDataFrame(row, NODES).write.parquet(f"{tmp_path}/dag_nodes.parquet")
    spark.createDataFrame([call("A", "m", "e1", 9, "cee", "y")], EDGES).write.parquet(f"{tmp_path}/dag_edges.parquet")
    spark.createDataFrame([("c", "cee", "cee")], "func_id string, func_name string, name_tail string").write.parquet(f"{tmp_path}/dvs_functions.parquet")
    got = {(r.func_id, r.taint_signature): r.state for r in entry.queries()["g10_whole_final_state"](spark, str(tmp_path)).collect()}
    assert got == {("a", "m"): "clean", ("c", "y"): "tainted"}
