"""Chains of a function's taint graph, with the chains of the functions it calls.

The graphs of one task are walked in one row: the order in which a chain meets other graphs decides which of
its later calls are cycles, so one chain is sequential.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.scalar import SINK_NAMES

MAX_DEPTH = 8
SINKS = frozenset(SINK_NAMES)
_KINDS = {
    "task_id": "string", "func_id": "string", "taint_signature": "string", "step": "string", "depth": "int", "at_func": "string",
    "at_taint": "string", "kind": "string", "edge_id": "string", "line": "int", "effect": "string", "state": "string",
}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _KINDS.items())


def _is_sink(name: str) -> bool:
    return name.split("::")[-1].split("(")[0].strip("*").strip() in SINKS


def _is_indirect(name: str) -> bool:
    return "->" in name or name.startswith("(") or "*" in name


def _direct(graph: tuple[list, list] | None, taint: str) -> str:
    """What a called graph does to the parameter ``taint``, without looking further."""
    if graph is None:
        return "unknown"
    nodes, edges = graph
    if any(taint in (n["sanitized"] or ()) for n in nodes):
        return "sanitized"
    if any(e["kind"] == "return" and taint in (e["taints"] or ()) for e in edges):
        return "return"
    if any(e["kind"] == "callee" and e["has_param"] for e in edges):
        return "propagate"
    return "unchanged"


def _inferred(steps: list[tuple[str, str | None]]) -> str:
    for _, effect in steps:
        if effect in ("sink", "sanitized"):
            return effect
    if not steps:
        return "unchanged"
    return "return" if any(kind == "return" for kind, _ in steps) else "propagate"


def chain(graphs: dict[tuple[str, str], tuple[list, list]], root: tuple[str, str], max_depth: int = MAX_DEPTH, expand: bool = True) -> list[tuple]:
    """(step, depth, func, taint, kind, edge_id, line, effect, state) of the chain of ``root``.

    A callee that is no sink is expanded to ``max_depth``, each graph once in a chain; a later call of it
    gives a step ``cycle``. With ``expand`` false only the effect of a callee is looked up, sinks included.
    """
    out: list[tuple] = []
    visited: set[tuple[str, str]] = set()

    def walk(key: tuple[str, str], prefix: str, depth: int) -> list[tuple[str, str | None]]:
        if key in visited:
            out.append((prefix + "0", depth, *key, "cycle", None, None, None, "tainted"))
            return []
        visited.add(key)
        nodes, edges = graphs[key]
        steps, state = [], "tainted"
        if nodes:
            entry = next((n for n in nodes if n["entry"]), nodes[0])
            out.append((prefix + "0", depth, *key, "entry", None, entry["line"], None, state))
            steps.append(("entry", None))
        for k, e in enumerate(edges, 1):
            kind, name, effect, at = e["kind"], e["sink_ref"] or "", None, len(out)
            out.append(())  # stands before the steps of the callee
            if kind == "callee":
                effect = "unknown"
                target = (e["callee"], e["param_key"])
                known = bool(e["callee"] and e["param"] and not e["param"].startswith("("))
                graph = graphs.get(target) if known else None
                if expand and name and _is_sink(name):
                    effect = "sink"
                elif name and _is_indirect(name):
                    effect = "indirect" if expand and depth < max_depth else "unknown"
                elif not expand:
                    effect = _direct(graph, e["param"])
                elif graph is not None and graph[0] and depth < max_depth:
                    below = walk(target, f"{prefix}{k}.", depth + 1)
                    effect = "sanitized" if _direct(graph, e["param"]) == "sanitized" else _inferred(below)
                if effect == "sanitized":
                    state = "clean"
            elif kind == "source":
                state = "tainted"
            out[at] = (f"{prefix}{k}", depth, *key, kind, e["edge_id"], e["line"], effect, state)
            steps.append((kind, effect))
        return steps

    walk(root, "", 0)
    return out


def _batches(max_depth: int, expand: bool):
    kinds = [{"string": pa.string(), "int": pa.int32()}[k] for k in _KINDS.values()]
    pack = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _KINDS]
            for task, nodes, edges in zip(*(batch.column(n).to_pylist() for n in ("task_id", "nodes", "edges")), strict=True):
                graphs: dict[tuple[str, str], tuple[list, list]] = {}
                for side, rows in enumerate((nodes or (), edges or ())):
                    for row in rows:
                        graphs.setdefault((row["func_id"], row["taint_signature"]), ([], []))[side].append(row)
                for some, steps in graphs.values():
                    some.sort(key=lambda n: n["node_id"])
                    steps.sort(key=lambda e: (e["line"] or 0, -1 if e["from_node"] is None else e["from_node"], e["edge_id"] or "", e["kind"]))
                for root in sorted(graphs):
                    for row in chain(graphs, root, max_depth, expand):
                        for col, x in zip(cols, (task, *root, *row), strict=True):
                            col.append(x)
                    if len(cols[0]) > 20_000:
                        yield pack(cols)
                        cols = [[] for _ in _KINDS]
            yield pack(cols)

    return run


def chains(nodes: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, expand: bool = True) -> DataFrame:
    """Chains of all graphs. Both tables have task_id, func_id and taint_signature as they compare. ``nodes``: node_id,
    line, entry, sanitized (the sanitized taints). ``edges``: edge_id, from_node, line, kind, sink_ref, callee (func_id
    of sink_ref), param, param_key, has_param, taints."""
    keyed = "task_id is not null and func_id is not null and taint_signature is not null"
    pack = lambda df, name: df.where(keyed).groupBy("task_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "task_id"])).alias(name))
    return pack(nodes, "nodes").join(pack(edges.distinct(), "edges"), "task_id", "full").mapInArrow(_batches(max_depth, expand), _SCHEMA)
