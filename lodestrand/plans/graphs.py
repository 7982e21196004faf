"""Registered graph (G), merge (W) and state (T) operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import scalar as X
from lodestrand.functions.keys import func_key, taint_key, task_key
from lodestrand.operators import chains, graph, lookup, merge, ranking, state
from lodestrand.plans.relational import QUERIES as _KNOWN
from lodestrand.plans.relational import SQL as _KNOWN_SQL
from lodestrand.plans.relational import query, simple

_before = set(_KNOWN)


def _call_edges(t):
    return t("dvs_task_graph_edges").where("visible_in_tree = 1 and source_node_id is not null and target_node_id is not null").select(
        F.col("task_id").alias("scope"), F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"))


def _call_roots(t):
    e = _call_edges(t)
    return e.select("scope", F.col("src").alias("node")).distinct().join(e.select("scope", F.col("dst").alias("node")).distinct(), ["scope", "node"], "left_anti")


_E = "e AS (SELECT DISTINCT task_id AS scope, source_node_id AS src, target_node_id AS dst FROM dvs_task_graph_edges WHERE visible_in_tree = 1 AND source_node_id IS NOT NULL AND target_node_id IS NOT NULL), r AS (SELECT DISTINCT scope, src AS node FROM e WHERE (scope, src) NOT IN (SELECT scope, dst FROM e))"


_FOLDERS = "p AS (SELECT DISTINCT file AS path FROM dvs_functions WHERE contains(file, '/')), e AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS src, array_to_string(list_slice(string_split(path, '/'), 1, k - 1), '/') AS dst FROM (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS k FROM p))"


def _up_links(t):
    """(scope, src, dst): each path and its folder, up to the first one."""
    parts = F.split("file", "/")
    cut = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    steps = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.struct(cut(k).alias("src"), cut(k - 1).alias("dst")))
    return t("dvs_functions").where(F.contains("file", F.lit("/"))).select(F.lit("h").alias("scope"), F.inline(steps)).distinct()


@query("g01_ancestors", f"WITH RECURSIVE {_FOLDERS}, w AS (SELECT src AS item, dst AS ancestor, 1 AS dist FROM e UNION SELECT w.item, e.dst, w.dist + 1 FROM w JOIN e ON e.src = w.ancestor) SELECT item, ancestor, dist FROM w")
def _(t):
    """All ancestors of every file and folder, itself excluded, at their distance; hierarchies of any depth."""
    up = _up_links(t)
    found = graph.all_paths(up, up.select("scope", F.col("src").alias("node")).distinct()).where("depth > 0 and not cycle")
    return found.groupBy(F.col("path")[0].alias("item"), F.col("node").alias("ancestor")).agg(F.min("depth").alias("dist"))


@query("j18_declaring_scope", f"WITH RECURSIVE {_FOLDERS}, w AS (SELECT path AS item, path AS at, 0 AS dist FROM p UNION SELECT w.item, e.dst, w.dist + 1 FROM w JOIN e ON e.src = w.at), m AS (SELECT DISTINCT regexp_extract(file, '^(.*)/[^/]*$', 1) AS at, name_tail AS member FROM dvs_functions WHERE contains(file, '/') AND name_tail IS NOT NULL), q AS (SELECT DISTINCT source_file AS item, list_extract(string_split(target_function_raw, '::'), -1) AS member FROM dvs_task_graph_edges WHERE source_file IS NOT NULL AND target_function_raw IS NOT NULL) SELECT q.item, q.member, arg_min(w.at, w.dist) AS declared_in FROM q JOIN w ON w.item = q.item JOIN m ON m.at = w.at AND m.member = q.member GROUP BY 1, 2")
def _(t):
    """For each name a file calls, the nearest of its folders (itself, then its ancestors) that declares it."""
    up = _up_links(t)
    self_and_up = graph.all_paths(up, up.select("scope", F.col("src").alias("node")).distinct()).select(F.col("path")[0].alias("item"), F.col("node").alias("at"), F.col("depth").alias("dist"))
    members = t("dvs_functions").where(F.contains("file", F.lit("/")) & F.col("name_tail").isNotNull()).select(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("at"), F.col("name_tail").alias("member")).distinct()
    asked = t("dvs_task_graph_edges").where("source_file is not null and target_function_raw is not null").select(F.col("source_file").alias("item"), X.name_tail("target_function_raw").alias("member")).distinct()
    return asked.join(self_and_up, "item").join(members, ["at", "member"]).groupBy("item", "member").agg(F.min_by("at", "dist").alias("declared_in"))


_REACH = "WITH RECURSIVE " + _E + ", w AS (SELECT scope, node, 0 AS depth FROM r UNION SELECT w.scope, e.dst, w.depth + 1 FROM w JOIN e ON e.scope = w.scope AND e.src = w.node WHERE w.depth < 400), m AS (SELECT scope, node, min(depth) AS depth FROM w GROUP BY 1, 2)"


@query("g02_reachable", _REACH + " SELECT scope, node, depth FROM m")
def _(t):
    """Nodes reachable from the roots of their task, at their least depth."""
    return graph.first_visit(_call_edges(t), _call_roots(t)).select("scope", "node", "depth")


@query("g03_file_closure", "WITH RECURSIVE e AS (SELECT DISTINCT task_id AS scope, source_file AS src, target_file AS dst FROM dvs_task_graph_edges WHERE source_file <> target_file), w AS (SELECT DISTINCT task_id AS scope, source_file AS node FROM dvs_task_graph_nodes WHERE depth = 0 AND source_file IS NOT NULL UNION SELECT e.scope, e.dst FROM w JOIN e ON e.scope = w.scope AND e.src = w.node) SELECT scope, count(*) AS files FROM w GROUP BY 1")
def _(t):
    """Files each task's root files reach over calls, counted per task."""
    e = t("dvs_task_graph_edges").where("source_file <> target_file").select(F.col("task_id").alias("scope"), F.col("source_file").alias("src"), F.col("target_file").alias("dst"))
    roots = t("dvs_task_graph_nodes").where("depth = 0").select(F.col("task_id").alias("scope"), F.col("source_file").alias("node"))
    return graph.first_visit(e, roots).groupBy("scope").agg(F.count("*").alias("files"))


_PATHS = "WITH RECURSIVE " + _E + ", w AS (SELECT scope, node, 0 AS depth, [node] AS path, false AS cycle FROM r UNION ALL SELECT w.scope, e.dst, w.depth + 1, list_append(w.path, e.dst), list_contains(w.path, e.dst) FROM w JOIN e ON e.scope = w.scope AND e.src = w.node WHERE NOT w.cycle)"


@query("g04_path_tree", _PATHS + " SELECT w.scope, w.node, depth, array_to_string(path, '>') AS path, cycle, n.node_id IS NULL AS placeholder FROM w LEFT JOIN (SELECT DISTINCT node_id FROM dvs_task_graph_nodes) n ON n.node_id = w.node")
def _(t):
    """Tree of all call paths, cut only where a path meets itself; nodes without a row of their own are placeholders."""
    paths = graph.all_paths(_call_edges(t), _call_roots(t)).select("scope", "node", "depth", F.array_join("path", ">").alias("path"), "cycle")
    known = t("dvs_task_graph_nodes").where("node_id is not null").select(F.col("node_id").alias("node"), F.lit(True).alias("_k")).distinct()
    return paths.join(known, "node", "left").select("scope", "node", "depth", "path", "cycle", F.col("_k").isNull().alias("placeholder"))


@query("g05_first_visit_tree", _REACH + " SELECT m.scope, m.node, m.depth, min(CASE WHEN p.depth = m.depth - 1 THEN e.src END) AS parent FROM m LEFT JOIN e ON e.scope = m.scope AND e.dst = m.node LEFT JOIN m p ON p.scope = e.scope AND p.node = e.src GROUP BY 1, 2, 3")
def _(t):
    return graph.first_visit(_call_edges(t), _call_roots(t))


_PRUNED = "coalesce(reason_code IN ('low_value_callee', 'depth_limit') OR visible_in_tree = 0, false)"
_CONSTRAINTS = "coalesce(array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN json_valid(validations_json) THEN CAST(json_extract_string(validations_json, '$[*].summary') AS VARCHAR[]) ELSE [] END)))), '|'), '')"


@query("g06_trace_tree", _REACH + f", l AS (SELECT edge_id, min(task_id) AS scope, min(source_node_id) AS src, min(target_node_id) AS dst, bool_or({_PRUNED}) AS pruned, {_CONSTRAINTS} AS constraints FROM dvs_task_graph_edges WHERE edge_id IS NOT NULL GROUP BY 1), n AS (SELECT node_id, min(function_name_resolved) AS fn FROM dvs_task_graph_nodes GROUP BY 1) SELECT l.edge_id, l.scope, l.src AS parent, CAST(m.depth + 1 AS INT) AS depth, CASE WHEN m.node IS NULL THEN 'orphan' WHEN pruned THEN 'pruned' ELSE 'linked' END AS place, coalesce(n.fn, 'orphan') AS target, constraints FROM l LEFT JOIN m ON m.scope = l.scope AND m.node = l.src LEFT JOIN n ON n.node_id = l.dst")
def _(t):
    """The trace tree by edges: each follow-up below the node it starts from, at its depth, with the constraints along it;
    pruned edges are marked, edges whose source no root reaches are orphans."""
    edges = t("dvs_task_graph_edges").where("edge_id is not null")
    pruned = F.coalesce(F.col("reason_code").isin("low_value_callee", "depth_limit") | (F.col("visible_in_tree") == 0), F.lit(False))
    said = F.coalesce(F.transform(F.from_json("validations_json", "array<struct<summary:string>>"), lambda v: v["summary"]), F.array().cast("array<string>"))
    own = edges.groupBy("edge_id").agg(F.min("task_id").alias("scope"), F.min("source_node_id").alias("parent"), F.min("target_node_id").alias("dst"), F.bool_or(pruned).alias("pruned"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(said)))), "|").alias("constraints"))
    reach = graph.first_visit(_call_edges(t), _call_roots(t)).select("scope", F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"))
    names = t("dvs_task_graph_nodes").groupBy(F.col("node_id").alias("dst")).agg(F.min("function_name_resolved").alias("fn"))
    place = F.when(F.col("depth").isNull(), "orphan").when(F.col("pruned"), "pruned").otherwise("linked")
    return own.join(reach, ["scope", "parent"], "left").join(names, "dst", "left").select("edge_id", "scope", "parent", "depth", place.alias("place"), F.coalesce("fn", F.lit("orphan")).alias("target"), "constraints")


_W_KEYS = "replace(lower(trim(task_id)), '_', '-') AS t, regexp_replace(lower(trim(func_id)), '^0x', '') AS f, regexp_replace(regexp_replace(regexp_replace(taint_signature, '\\s+', '', 'g'), '^(this|self)(->|\\.)', ''), '[()]+$', '') AS s"
_WORK = ("WITH RECURSIVE g AS (SELECT " + _W_KEYS + ", kind, sink_ref, param_taints_json, taints_json, carrier FROM dag_edges), k AS (SELECT func_name AS name, min(regexp_replace(lower(trim(func_id)), '^0x', '')) AS f FROM dvs_functions WHERE func_name IS NOT NULL GROUP BY 1), "
    "c AS (SELECT t, g.f AS cf, g.s AS cs, k.f AS f, regexp_replace(regexp_replace(regexp_replace(p.param, '\\s+', '', 'g'), '^(this|self)(->|\\.)', ''), '[()]+$', '') AS s FROM (SELECT t, f, s, sink_ref, unnest(from_json(param_taints_json, '[{\"param\":\"VARCHAR\",\"taint\":\"VARCHAR\"}]')) AS p FROM g WHERE kind = 'callee' AND json_valid(param_taints_json)) g JOIN k ON k.name = g.sink_ref WHERE p.param IS NOT NULL), "
    "r AS (SELECT DISTINCT t, f, s, unnest(CAST(from_json(taints_json, '[\"VARCHAR\"]') AS VARCHAR[])) AS x FROM g WHERE kind = 'return' AND json_valid(taints_json)), "
    "x AS (SELECT DISTINCT a.t, a.f AS cf, a.s AS cs, b.f, b.s FROM g a JOIN g b ON a.t = b.t AND a.carrier = b.carrier AND (a.f <> b.f OR a.s <> b.s) WHERE a.kind IN ('extern', 'container') AND b.kind = 'container'), "
    "l AS (SELECT t, cf || '|' || cs AS src, f || '|' || s AS dst, 'callee' AS via FROM c WHERE s <> '' UNION SELECT c.t, c.f || '|' || c.s, c.cf || '|' || regexp_replace(regexp_replace(regexp_replace(r.x, '\\s+', '', 'g'), '^(this|self)(->|\\.)', ''), '[()]+$', ''), 'return' FROM c JOIN r ON r.t = c.t AND r.f = c.f AND r.s = c.s UNION SELECT t, cf || '|' || cs, f || '|' || s, 'escape' FROM x), "
    "a AS (SELECT DISTINCT t, f || '|' || s AS node FROM g WHERE f <> '' AND s <> ''), q AS (SELECT t, node FROM a WHERE (t, node) NOT IN (SELECT t, dst FROM l WHERE via <> 'return' AND t IS NOT NULL AND dst IS NOT NULL)), w AS (SELECT t, node FROM q UNION SELECT l.t, l.dst FROM w JOIN l ON l.t = w.t AND l.src = w.node)")


def _work_links(t):
    """(scope, src, dst, via): what the analysis of (function, taint) asks for next: callee parameters, taints returned to
    its callers, readers of the carriers it writes."""
    g = t("dag_edges").select(task_key("task_id").alias("scope"), func_key("func_id").alias("f"), taint_key("taint_signature").alias("s"), "kind", "sink_ref", "param_taints_json", "taints_json", "carrier")
    node = lambda f, s: F.concat(F.col(f) if isinstance(f, str) else f, F.lit("|"), F.col(s) if isinstance(s, str) else s)
    names = t("dvs_functions").where("func_name is not null").groupBy(F.col("func_name").alias("sink_ref")).agg(F.min(func_key("func_id")).alias("g"))
    asked = g.where("kind = 'callee'").select("scope", "f", "s", "sink_ref", F.explode(F.from_json("param_taints_json", "array<struct<param:string,taint:string>>")).alias("p"))
    calls = asked.join(names, "sink_ref").select("scope", node("f", "s").alias("src"), node("g", taint_key(F.col("p.param"))).alias("dst"), F.col("f").alias("caller")).where("dst is not null").distinct()
    given = g.where("kind = 'return'").select("scope", node("f", "s").alias("dst"), F.explode(F.from_json("taints_json", "array<string>")).alias("x")).distinct()
    returns = calls.join(given, ["scope", "dst"]).select("scope", F.col("dst").alias("src"), node("caller", taint_key("x")).alias("dst")).where("dst is not null")
    writes = g.where("kind in ('extern', 'container') and carrier is not null").select("scope", "carrier", node("f", "s").alias("src")).distinct()
    reads = g.where("kind = 'container' and carrier is not null").select("scope", "carrier", node("f", "s").alias("dst")).distinct()
    escapes = writes.join(reads, ["scope", "carrier"]).where("src <> dst").select("scope", "src", "dst")
    via = lambda df, v: df.select("scope", "src", "dst", F.lit(v).alias("via"))
    return g.select("scope", node("f", "s").alias("node")).where("node is not null").distinct(), via(calls, "callee").unionByName(via(returns, "return")).unionByName(via(escapes, "escape")).distinct()


@query("g07_worklist", _WORK + " SELECT t AS task_id, split_part(node, '|', 1) AS func_id, substr(node, strpos(node, '|') + 1) AS taint FROM w WHERE t IS NOT NULL AND node IS NOT NULL")
def _(t):
    """Every (function, taint) of a task that the worklist reaches from its seeds, each once, without a bound."""
    nodes, links = _work_links(t)
    seeds = nodes.join(links.where("via <> 'return'").select("scope", F.col("dst").alias("node")).distinct(), ["scope", "node"], "left_anti")
    seen = graph.first_visit(links, seeds)
    return seen.select(F.col("scope").alias("task_id"), F.substring_index("node", "|", 1).alias("func_id"), F.expr("substring(node, instr(node, '|') + 1)").alias("taint"))


@query("g07_follow_ups", _WORK + " SELECT l.via, count(*) AS n FROM w JOIN l ON l.t = w.t AND l.src = w.node GROUP BY 1")
def _(t):
    """How many follow-ups of each kind the reached items ask for."""
    nodes, links = _work_links(t)
    seeds = nodes.join(links.where("via <> 'return'").select("scope", F.col("dst").alias("node")).distinct(), ["scope", "node"], "left_anti")
    return links.join(graph.first_visit(links, seeds).select("scope", F.col("node").alias("src")), ["scope", "src"]).groupBy("via").agg(F.count("*").alias("n"))


simple("g08_callee_params", lambda t: t("dag_edges").where("kind = 'callee'").select("func_id", "task_id", "edge_id", "sink_ref", F.explode(F.from_json("param_taints_json", "array<struct<param:string,taint:string>>")).alias("p")).select("func_id", "task_id", "edge_id", "sink_ref", "p.param", "p.taint").join(t("dvs_functions").select(F.col("func_name").alias("sink_ref"), F.lit(True).alias("_i")).distinct(), "sink_ref", "left").withColumn("indexed", F.coalesce("_i", F.lit(False))).drop("_i"),
       "SELECT func_id, task_id, edge_id, sink_ref, p.param AS param, p.taint AS taint, sink_ref IN (SELECT func_name FROM dvs_functions WHERE func_name IS NOT NULL) AS indexed FROM (SELECT func_id, task_id, edge_id, sink_ref, unnest(from_json(param_taints_json, '[{\"param\":\"VARCHAR\",\"taint\":\"VARCHAR\"}]')) AS p FROM dag_edges WHERE kind = 'callee' AND json_valid(param_taints_json)) WHERE p IS NOT NULL")
_CHAIN = "SELECT func_id, task_id, CAST(row_number() OVER w - 1 AS INT) AS step, ln, edge_id, kd, CASE WHEN coalesce(last_value(CASE WHEN kd = 'return' THEN 0 WHEN kd = 'source' THEN 1 END IGNORE NULLS) OVER w, 1) = 1 THEN 'tainted' ELSE 'clean' END AS state FROM (SELECT DISTINCT func_id, task_id, coalesce(line,0) AS ln, edge_id, coalesce(kind,'') AS kd FROM dag_edges) WINDOW w AS (PARTITION BY func_id, task_id ORDER BY ln, edge_id, kd ROWS UNBOUNDED PRECEDING)"
simple("g09_chain_fold", lambda t: graph.fold_state(t("dag_edges").select("func_id", "task_id", F.coalesce("line", F.lit(0)).alias("ln"), "edge_id", F.coalesce("kind", F.lit("")).alias("kd")).distinct(), ["func_id", "task_id"], ["ln", "edge_id", "kd"], F.col("kd") == "return", F.col("kd") == "source"), _CHAIN)
simple("g10_final_state", lambda t: graph.fold_state(t("dag_edges").select("func_id", "task_id", F.coalesce("line", F.lit(0)).alias("ln"), "edge_id", F.coalesce("kind", F.lit("")).alias("kd")).distinct(), ["func_id", "task_id"], ["ln", "edge_id", "kd"], F.col("kd") == "return", F.col("kd") == "source").groupBy("func_id", "task_id").agg(F.max_by("state", "step").alias("state")),
       f"SELECT func_id, task_id, arg_max(state, step) AS state FROM ({_CHAIN}) GROUP BY 1, 2")


def _chains(t, expand):
    keys = [task_key("task_id").alias("task_id"), func_key("func_id").alias("func_id"), taint_key("taint_signature").alias("taint_signature")]
    sanitized = F.get_json_object("prune_json", "$.reason") == "sanitized"
    no_parent = F.regexp_extract(F.coalesce("parents_json", F.lit("")), "-?\\d+", 0) == ""
    nodes = t("dag_nodes").where("node_id is not null").select(*keys, "node_id", "line", no_parent.alias("top"), (F.coalesce("is_source", F.lit(0)) == 1).alias("src"), F.when(sanitized, F.trim("taint")).alias("clean"))
    nodes = nodes.groupBy("task_id", "func_id", "taint_signature", "node_id").agg(F.min("line").alias("line"), (F.bool_and("top") | F.bool_or("src")).alias("entry"), F.collect_set("clean").alias("sanitized"))
    params = F.from_json("param_taints_json", "array<struct<param:string,taint:string>>")
    param = F.trim(F.get(params, F.lit(0))["param"])
    edges = t("dag_edges").select(
        *keys, "edge_id", "from_node", "line", F.coalesce("kind", F.lit("")).alias("kind"), "sink_ref", param.alias("param"), taint_key(param).alias("param_key"),
        F.coalesce(F.exists(params, lambda p: (F.trim(p["param"]) != "") & ~F.startswith(F.trim(p["param"]), F.lit("("))), F.lit(False)).alias("has_param"), F.from_json("taints_json", "array<string>").alias("taints"))
    names = lookup.layered_lookup(t("dag_edges").where("kind = 'callee'").select(F.col("sink_ref").alias("probe")), "probe", t("dvs_functions"), "func_name", "name_tail", "func_id")
    one = names.groupBy(F.col("probe").alias("sink_ref")).agg(F.min(func_key("func_id")).alias("callee"))
    return chains.chains(nodes, edges.join(one, "sink_ref", "left"), expand=expand)


@query("g09_whole_chains")
def _(t):
    """Chains of every taint graph with the chains of the called graphs, eight calls deep, and the state along them."""
    return _chains(t, True)


@query("g10_whole_final_state")
def _(t):
    """State at the end of every taint graph, with the effect of each callee looked up."""
    last = F.struct(F.col("step").cast("int").alias("k"), "state")
    return _chains(t, False).groupBy("task_id", "func_id", "taint_signature").agg(F.max(last)["state"].alias("state"))


_K = ["func_id", "taint_signature", "task_id"]
simple("g11_callee_effect", lambda t: graph.callee_effect(t("dag_nodes").withColumn("sanitized", F.coalesce(F.get_json_object("prune_json", "$.reason") == "sanitized", F.lit(False))), t("dag_edges"), _K),
       "SELECT n.func_id, n.taint_signature, n.task_id, CASE WHEN s THEN 'sanitized' WHEN r THEN 'return' WHEN p THEN 'propagate' ELSE 'unchanged' END AS effect FROM (SELECT func_id, taint_signature, task_id, bool_or(coalesce(contains(prune_json, '\"reason\": \"sanitized\"'), false)) AS s FROM dag_nodes GROUP BY ALL) n LEFT JOIN (SELECT func_id, taint_signature, task_id, bool_or(kind = 'return') AS r, bool_or(kind = 'callee') AS p FROM dag_edges GROUP BY ALL) e USING (func_id, taint_signature, task_id)")
simple("g12_sink_candidates", lambda t: t("dag_edges").where(F.col("kind").isin("callee", "extern", "container")).select("func_id", "task_id", "edge_id", "kind", "sink_ref"), "SELECT func_id, task_id, edge_id, kind, sink_ref FROM dag_edges WHERE kind IN ('callee','extern','container')")
simple("g13_parents_from_edges", lambda t: t("dag_edges").where("from_node is not null and to_node is not null").groupBy(*_K, "to_node").agg(F.array_join(F.transform(F.array_sort(F.collect_set("from_node")), lambda x: x.cast("string")), ",").alias("parents")),
       "SELECT func_id, taint_signature, task_id, to_node, string_agg(DISTINCT CAST(from_node AS VARCHAR), ',') AS parents FROM (SELECT DISTINCT func_id, taint_signature, task_id, to_node, from_node FROM dag_edges WHERE from_node IS NOT NULL AND to_node IS NOT NULL) GROUP BY 1, 2, 3, 4".replace("string_agg(DISTINCT CAST(from_node AS VARCHAR), ',')", "string_agg(CAST(from_node AS VARCHAR), ',' ORDER BY from_node)"))


@query("g14_node_numbers", "SELECT func_id, task_id, taint, CAST(row_number() OVER (PARTITION BY func_id, task_id ORDER BY ln, taint) - 1 AS INT) AS node_no FROM (SELECT func_id, task_id, taint, min(coalesce(line,0)) AS ln FROM dag_nodes WHERE taint <> '' GROUP BY 1, 2, 3)")
def _(t):
    """Variables of a graph numbered in the order they are first seen."""
    first = t("dag_nodes").where("taint <> ''").groupBy("func_id", "task_id", "taint").agg(F.min(F.coalesce("line", F.lit(0))).alias("ln"))
    rows = first.groupBy("func_id", "task_id").agg(F.array_sort(F.collect_list(F.struct("ln", "taint"))).alias("x"))
    return rows.select("func_id", "task_id", F.posexplode("x").alias("node_no", "v")).select("func_id", "task_id", "v.taint", "node_no")


def _steps(t):
    return t("dvs_task_graph_edges").where("target_func_id <> ''").select("task_id", "target_func_id", F.col("target_taint_name").alias("name"), F.col("display_order").alias("position"), F.col("call_line").alias("line"))


simple("g16_merged_steps", lambda t: graph.merge_steps(_steps(t), ["task_id", "target_func_id"]).select("task_id", "target_func_id", F.array_join("names", ",").alias("names"), F.size("positions").alias("n_pos"), "line", "merged"),
       "SELECT task_id, target_func_id, coalesce(string_agg(DISTINCT target_taint_name, ',' ORDER BY target_taint_name), '') AS names, CAST(count(DISTINCT display_order) AS INT) AS n_pos, min(CASE WHEN call_line > 0 THEN call_line END) AS line, count(*) AS merged FROM dvs_task_graph_edges WHERE target_func_id <> '' GROUP BY 1, 2")
_SEQ = ", fn AS (SELECT target_node_id AS node, min(target_function_resolved) AS f FROM dvs_task_graph_edges GROUP BY 1), z AS (SELECT scope, array_to_string(path, '>') AS path, unnest(path) AS node, unnest(range(1, len(path) + 1)) AS k FROM w WHERE depth > 0 AND NOT cycle), y AS (SELECT scope, path, string_agg(coalesce(f, '?'), '>' ORDER BY k) AS functions FROM z LEFT JOIN fn ON fn.node = z.node GROUP BY 1, 2)"


@query("g17_equal_paths", _PATHS + _SEQ + " SELECT scope, functions, count(*) AS merged, min(path) AS path FROM y GROUP BY 1, 2")
def _(t):
    """Call paths whose sequences of functions are equal, as one, with their number and the first of them."""
    paths = graph.all_paths(_call_edges(t), _call_roots(t)).where("depth > 0 and not cycle").select("scope", F.array_join("path", ">").alias("path"), F.posexplode("path").alias("k", "node"))
    names = t("dvs_task_graph_edges").groupBy(F.col("target_node_id").alias("node")).agg(F.min("target_function_resolved").alias("f"))
    step = F.struct("k", F.coalesce("f", F.lit("?")).alias("f"))
    whole = paths.join(names, "node", "left").groupBy("scope", "path").agg(F.array_sort(F.collect_list(step)).alias("x"))
    return whole.groupBy("scope", F.array_join(F.transform("x", lambda s: s["f"]), ">").alias("functions")).agg(F.count("*").alias("merged"), F.min("path").alias("path"))


_SUMMARIES = "SELECT DISTINCT source_node_id AS node, unnest(CAST(json_extract_string(validations_json, '$[*].summary') AS VARCHAR[])) AS s FROM dvs_task_graph_edges WHERE json_valid(validations_json) AND source_node_id IS NOT NULL"


@query("g18_path_validations", _PATHS + f", v AS ({_SUMMARIES}), p AS (SELECT DISTINCT array_to_string(path, '>') AS path, unnest(path) AS node FROM w) SELECT path, string_agg(DISTINCT s, '|' ORDER BY s) AS summaries FROM p JOIN v ON v.node = p.node WHERE s IS NOT NULL GROUP BY 1")
def _(t):
    """Distinct validations accumulated along each call path, whatever its length."""
    rows = t("dvs_task_graph_edges").where("source_node_id is not null").select(F.col("source_node_id").alias("node"), F.explode(F.from_json("validations_json", "array<struct<summary:string>>")).alias("v"))
    facts = graph.all_path_facts(graph.all_paths(_call_edges(t), _call_roots(t)), rows.select("node", "v.summary"), "summary")
    return facts.select(F.array_join("path", ">").alias("path"), F.array_join("facts", "|").alias("summaries"))


simple("g22_bridges", lambda t: t("dvs_task_graph_edges").where("edge_kind = 'indirect_call' and target_func_id <> ''").select(F.concat(F.lit("bridge::"), X.short_id("edge_id", "target_func_id", size=24)).alias("edge_id"), "source_node_id", "target_func_id", F.lit(1).alias("visible_in_tree")), "SELECT 'bridge::' || substr(sha1(concat_ws(chr(31), coalesce(edge_id,''), coalesce(target_func_id,''))),1,24) AS edge_id, source_node_id, target_func_id, 1 AS visible_in_tree FROM dvs_task_graph_edges WHERE edge_kind = 'indirect_call' AND target_func_id <> ''")

_VALID = "SELECT source_func_id, source_function_resolved AS fn, edge_id, display_order, v.line, v.kind, v.target, v.summary FROM (SELECT *, unnest(from_json(validations_json, '[{\"line\":\"INTEGER\",\"kind\":\"VARCHAR\",\"target\":\"VARCHAR\",\"summary\":\"VARCHAR\"}]')) AS v FROM dvs_task_graph_edges WHERE json_valid(validations_json)) WHERE coalesce(v.target, '') <> '' OR coalesce(v.summary, '') <> ''"
_HINT = "'[' || coalesce(kind, 'other') || '] L' || coalesce(line, 0) || ': ' || coalesce(nullif(target, ''), '(unknown)') || ' - ' || coalesce(nullif(summary, ''), '(no summary)')"
_SHOWN = 30  # a rendered chain and a list of hints show so many validations


def _validations(t):
    """(source_func_id, task_id, fn, at, hint): each distinct validation of a function in a task, where it is first met."""
    v = F.explode(F.from_json("validations_json", "array<struct<line:int,kind:string,target:string,summary:string>>"))
    rows = t("dvs_task_graph_edges").select("source_func_id", "task_id", F.col("source_function_resolved").alias("fn"), "display_order", v.alias("v"))
    rows = rows.where((F.coalesce("v.target", F.lit("")) != "") | (F.coalesce("v.summary", F.lit("")) != ""))
    text = lambda c, d: F.coalesce(F.nullif(F.col(f"v.{c}"), F.lit("")), F.lit(d))
    hint = F.concat(F.lit("["), F.coalesce("v.kind", F.lit("other")), F.lit("] L"), F.coalesce("v.line", F.lit(0)), F.lit(": "), text("target", "(unknown)"), F.lit(" - "), text("summary", "(no summary)"))
    return rows.groupBy("source_func_id", "task_id", "fn", hint.alias("hint")).agg(F.min(F.coalesce("display_order", F.lit(0))).alias("at"))


@query("g19_rendered_chain", f"WITH v AS (SELECT task_id, fn, {_HINT} AS hint, min(coalesce(display_order, 0)) AS o FROM ({_VALID.replace('SELECT source_func_id', 'SELECT task_id, source_func_id', 1)}) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY o, fn NULLS FIRST, hint) AS p, count(*) OVER (PARTITION BY task_id) AS n FROM v), k AS (SELECT task_id, fn, min(p) AS p, string_agg('    ' || hint, chr(10) ORDER BY p) AS body, max(n) AS n FROM r WHERE p <= 30 GROUP BY 1, 2) SELECT task_id, string_agg(coalesce(fn, '(unknown)') || chr(10) || body, chr(10) ORDER BY p) || CASE WHEN max(n) > 30 THEN chr(10) || '    (more)' ELSE '' END AS chain FROM k GROUP BY 1")
def _(t):
    """The validations of a task as one text: functions in the order of the trace, their distinct validations below them; the
    first thirty are shown, a last line says if there are more."""
    rows = _validations(t).groupBy("task_id", "fn", "hint").agg(F.min("at").alias("at"))
    ranked = ranking.first_by(rows, ["task_id"], ["at", "fn", "hint"], _SHOWN)
    owner = ranked.groupBy("task_id", "fn").agg(F.min("_place").alias("p"), F.max("_count").alias("n"), F.array_sort(F.collect_list(F.struct("_place", "hint"))).alias("x"))
    body = F.array_join(F.transform("x", lambda h: F.concat(F.lit("    "), h["hint"])), "\n")
    block = owner.select("task_id", "n", F.struct("p", F.concat(F.coalesce("fn", F.lit("(unknown)")), F.lit("\n"), body).alias("text")).alias("b"))
    whole = block.groupBy("task_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("b")).alias("x"))
    return whole.select("task_id", F.concat(F.array_join(F.transform("x", lambda b: b["text"]), "\n"), F.when(F.col("n") > _SHOWN, "\n    (more)").otherwise("")).alias("chain"))


@query("g20_hints", f"WITH v AS (SELECT source_func_id, '- ' || {_HINT} AS hint, 0 AS k FROM ({_VALID}) WHERE source_func_id IS NOT NULL UNION SELECT source_func_id, '- ' || coalesce(source_function_resolved, '') || ' L' || coalesce(call_line, 0) || ' -> ' || trim(target_function_raw) || CASE WHEN coalesce(trim(target_file), '') <> '' THEN ' [callee: ' || trim(target_file) || ']' ELSE '' END, 1 FROM dvs_task_graph_edges WHERE source_func_id IS NOT NULL AND trim(target_function_raw) <> '') SELECT source_func_id, CASE k WHEN 0 THEN 'validation' ELSE 'function' END AS kind, hint FROM (SELECT *, row_number() OVER (PARTITION BY source_func_id, k ORDER BY hint) AS p FROM v) WHERE p <= 30")
def _(t):
    """Distinct hints of a function, at most thirty of each kind: its validations, and the calls it makes."""
    validations = _validations(t).where("source_func_id is not null").select("source_func_id", F.lit("validation").alias("kind"), F.concat(F.lit("- "), "hint").alias("hint"))
    file = F.trim(F.coalesce("target_file", F.lit("")))
    call = F.concat(F.lit("- "), F.coalesce("source_function_resolved", F.lit("")), F.lit(" L"), F.coalesce("call_line", F.lit(0)), F.lit(" -> "), F.trim("target_function_raw"), F.when(file != "", F.concat(F.lit(" [callee: "), file, F.lit("]"))).otherwise(""))
    calls = t("dvs_task_graph_edges").where("source_func_id is not null and trim(target_function_raw) <> ''").select("source_func_id", F.lit("function").alias("kind"), call.alias("hint"))
    return ranking.first_by(validations.unionByName(calls).distinct(), ["source_func_id", "kind"], ["hint"], _SHOWN).select("source_func_id", "kind", "hint")


@query("g23_relays", "WITH w AS (SELECT DISTINCT task_id, carrier, func_id AS writer FROM dag_edges WHERE kind IN ('extern', 'container') AND carrier IS NOT NULL), r AS (SELECT DISTINCT task_id, carrier, func_id AS reader FROM dag_edges WHERE kind = 'container' AND carrier IS NOT NULL) SELECT w.task_id, w.carrier, writer, reader FROM w JOIN r ON r.task_id = w.task_id AND r.carrier = w.carrier WHERE writer <> reader")
def _(t):
    """Relay edges: from each function that lets a taint escape into a carrier to the functions of the task that use it."""
    rows = t("dag_edges").where("carrier is not null")
    writers = rows.where("kind in ('extern', 'container')").select("task_id", "carrier", F.col("func_id").alias("writer")).distinct()
    readers = rows.where("kind = 'container'").select("task_id", "carrier", F.col("func_id").alias("reader")).distinct()
    return writers.join(readers, ["task_id", "carrier"]).where("writer <> reader").select("task_id", "carrier", "writer", "reader")


@query("g23_back_fill", "SELECT task_id, source_func_id, call_line, target_function_resolved AS target, CASE WHEN row_number() OVER (PARTITION BY task_id, source_func_id, call_line ORDER BY target_function_resolved) = 1 THEN 'in_place' ELSE 'duplicate' END AS place FROM (SELECT DISTINCT task_id, source_func_id, call_line, target_function_resolved FROM dvs_task_graph_edges WHERE edge_kind = 'indirect_call' AND target_function_resolved IS NOT NULL)")
def _(t):
    """Targets of an indirect call: the first takes the place of the call, each further one a copy of it."""
    rows = t("dvs_task_graph_edges").where("edge_kind = 'indirect_call' and target_function_resolved is not null").select("task_id", "source_func_id", "call_line", F.col("target_function_resolved").alias("target")).distinct()
    keys = ["task_id", "source_func_id", "call_line"]
    first = F.min("target").over(Window.partitionBy(*keys))  # one call site
    return rows.withColumn("_first", first).select(*keys, "target", F.when(F.col("target") == F.col("_first"), "in_place").otherwise("duplicate").alias("place"))


@query("g24_session_spawns", "WITH s AS (SELECT DISTINCT task_id, node_id, session_relpath AS s, coalesce(session_kind, '') AS k FROM dvs_task_graph_sessions WHERE task_id IS NOT NULL AND node_id IS NOT NULL), p AS (SELECT task_id, node_id, min(s) AS parent FROM s WHERE k <> 'fork' GROUP BY 1, 2), g AS (SELECT task_id, node_id, count(*) AS n FROM s WHERE k = 'fork' GROUP BY 1, 2) SELECT s.task_id, s.node_id, p.parent, s.s AS child, g.n > 1 AS parallel FROM s JOIN p ON p.task_id = s.task_id AND p.node_id = s.node_id JOIN g ON g.task_id = s.task_id AND g.node_id = s.node_id WHERE s.k = 'fork'")
def _(t):
    """Sessions forked for a node below the node's first own session; forks of one node run in parallel."""
    rows = t("dvs_task_graph_sessions").where("task_id is not null and node_id is not null").select("task_id", "node_id", F.col("session_relpath").alias("child"), (F.coalesce("session_kind", F.lit("")) == "fork").alias("fork")).distinct()
    nodes = rows.groupBy("task_id", "node_id").agg(F.min(F.when(~F.col("fork"), F.col("child"))).alias("parent"), F.count_if("fork").alias("n")).where("parent is not null and n > 0")
    return rows.where("fork").join(nodes, ["task_id", "node_id"]).select("task_id", "node_id", "parent", "child", (F.col("n") > 1).alias("parallel"))


@query("g25_flat_tree", _PATHS + f", e2 AS (SELECT task_id AS scope, source_node_id AS parent, target_node_id AS node, bool_and({_PRUNED}) AS pruned FROM dvs_task_graph_edges WHERE visible_in_tree = 1 GROUP BY 1, 2, 3), x AS (SELECT scope, node, CASE WHEN len(path) > 1 THEN path[len(path) - 1] END AS parent, depth, cycle FROM w) SELECT x.scope, x.node, x.parent, x.depth, cycle OR coalesce(e2.pruned, false) AS pruned, count(*) AS places FROM x LEFT JOIN e2 ON e2.scope = x.scope AND e2.parent = x.parent AND e2.node = x.node GROUP BY 1, 2, 3, 4, 5")
def _(t):
    """The whole call tree as flat rows: node, parent, depth, how many places of the tree it has there, and whether it ends there
    because the call was pruned or closes a cycle."""
    paths = graph.all_paths(_call_edges(t), _call_roots(t))
    rows = paths.select("scope", "node", F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"), "depth", "cycle").groupBy("scope", "node", "parent", "depth", "cycle").agg(F.count("*").alias("places"))
    cut = F.coalesce(F.col("reason_code").isin("low_value_callee", "depth_limit"), F.lit(False))
    links = t("dvs_task_graph_edges").where("visible_in_tree = 1").groupBy(F.col("task_id").alias("scope"), F.col("source_node_id").alias("parent"), F.col("target_node_id").alias("node")).agg(F.bool_and(cut).alias("_p"))
    flat = rows.join(links, ["scope", "parent", "node"], "left").withColumn("pruned", F.col("cycle") | F.coalesce("_p", F.lit(False)))
    return flat.groupBy("scope", "node", "parent", "depth", "pruned").agg(F.sum("places").alias("places"))


# ---- merges: rows loaded before 2025 are the old table, later ones the new
_CUT = "timestamp'2025-01-01 00:00:00'"


def _halves(t, name, keys, cols):
    """Old and new rows of a table, one per key with the largest value of each column."""
    df = t(name).where(" and ".join(f"{k} is not null" for k in keys))
    one = lambda d: d.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])
    return one(df.where(f"loaded_at < {_CUT}")), one(df.where(f"loaded_at >= {_CUT}"))


def _halves_sql(name, keys, cols):
    side = lambda op: f"SELECT {', '.join(keys)}, {', '.join(f'max({c}) AS {c}' for c in cols)} FROM {name} WHERE loaded_at {op} TIMESTAMPTZ '2025-01-01 00:00:00+00' AND {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(str(k + 1) for k in range(len(keys)))}"
    return f"WITH o AS ({side('<')}), n AS ({side('>=')}) "


def _wins(query_name, how, name, keys, cols):
    first, then = ("n", "o") if how == "latest" else ("o", "n")
    on = " AND ".join(f"{first}.{k} = {then}.{k}" for k in keys)
    sql = _halves_sql(name, keys, cols) + f"SELECT * FROM {first} UNION ALL SELECT * FROM {then} WHERE NOT EXISTS (SELECT 1 FROM {first} WHERE {on})"
    if how == "latest":
        simple(query_name, lambda t: merge.latest_wins(*_halves(t, name, keys, cols), keys), sql)
    else:
        simple(query_name, lambda t: merge.first_wins(*_halves(t, name, keys, cols), keys, cols), sql)


def _partial(query_name, name, keys, mutable, fixed=()):
    cols = [*mutable, *fixed]
    picked = [f"coalesce(o.{k}, n.{k}) AS {k}" for k in keys] + [f"coalesce(n.{c}, o.{c}) AS {c}" for c in mutable] + [f"CASE WHEN o.{keys[0]} IS NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in fixed]
    sql = _halves_sql(name, keys, cols) + f"SELECT {', '.join(picked)} FROM o FULL JOIN n ON {' AND '.join(f'o.{k} = n.{k}' for k in keys)}"
    simple(query_name, lambda t: merge.partial(*_halves(t, name, keys, cols), keys, mutable), sql)


_wins("w01_upsert_latest", "latest", "dvs_task_graph_nodes", ["node_id"], ["status", "analysis_status"])
_wins("w02_insert_ignore", "first", "dvs_functions", ["func_id"], ["func_name", "file"])
_wins("w05_first_wins", "first", "dvs_task_graph_edges", ["edge_id"], ["status", "edge_kind", "display_order"])
_wins("w08_finding_upsert", "latest", "dvs_task_graph_sessions", ["task_id", "session_relpath"], ["status", "event_count"])
_wins("w13_run_upsert", "latest", "dvs_task_graph_runs", ["task_id", "epoch"], ["run_root", "graph_version", "root_function"])
simple("w03_class_upsert", lambda t: merge.latest_wins(t("nation").select("n_name", "n_regionkey"), t("nation").where("n_regionkey = 1").select("n_name", F.lit(9).alias("n_regionkey")), ["n_name"]), "SELECT n_name, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")
_partial("w04_partial_upsert", "dvs_task_graph_nodes", ["node_id"], ["status"], ["analysis_status"])
_partial("w06_node_columns", "dvs_task_graph_nodes", ["node_id"], ["status", "analysis_status", "findings_count", "finished_at", "primary_session_relpath", "extra_json"], ["func_id", "depth"])
_partial("w06_edge_columns", "dvs_task_graph_edges", ["edge_id"], ["status", "tracker_type", "tracker_result_json", "updated_at"], ["source_node_id", "target_node_id"])
_partial("w06_session_columns", "dvs_task_graph_sessions", ["session_relpath"], ["status", "ended_at", "mtime", "event_count"], ["session_role", "node_id"])
_partial("w07_dynamic_update", "dvs_task_graph_edges", ["edge_id"], ["reason_code", "reason_message"])


def _node_halves(t):
    return _halves(t, "dvs_task_graph_nodes", ["node_id"], ["status", "analysis_status"])


_NH = _halves_sql("dvs_task_graph_nodes", ["node_id"], ["status", "analysis_status"])
simple("w16_lineage_upsert", lambda t: merge.partial(*_node_halves(t), ["node_id"], ["status", "analysis_status"], blank_is_old=True), _NH + "SELECT coalesce(o.node_id, n.node_id) AS node_id, coalesce(nullif(trim(n.status),''), o.status) AS status, coalesce(nullif(trim(n.analysis_status),''), o.analysis_status) AS analysis_status FROM o FULL JOIN n ON n.node_id = o.node_id")
simple("w09_tiered_update", lambda t: merge.tiered_update(t("dag_edges").groupBy("func_id", F.when(F.col("kind") == "source", "").otherwise(F.col("kind")).alias("scope")).agg(F.lit("old").alias("val")), t("dag_nodes").select("func_id").distinct().select("func_id", F.lit("return").alias("scope"), F.lit("new").alias("val")), "func_id", "scope", "val"),
       "WITH r AS (SELECT DISTINCT func_id, CASE WHEN kind = 'source' THEN '' ELSE kind END AS scope FROM dag_edges), b AS (SELECT func_id, min(CASE WHEN scope = 'return' THEN 1 WHEN scope = '' THEN 2 ELSE 3 END) AS best FROM r WHERE func_id IN (SELECT func_id FROM dag_nodes) GROUP BY 1) SELECT r.func_id, r.scope, CASE WHEN CASE WHEN scope = 'return' THEN 1 WHEN scope = '' THEN 2 ELSE 3 END = best THEN 'new' ELSE 'old' END AS val FROM r LEFT JOIN b ON b.func_id = r.func_id")
simple("w10_clear_tasks", lambda t: merge.cleared(t("dvs_task_graph_edges").select("edge_id", "task_id"), t("worker_clocks").where("zone_name is null"), "task_id"), "SELECT edge_id, task_id FROM dvs_task_graph_edges WHERE task_id NOT IN (SELECT task_id FROM worker_clocks WHERE zone_name IS NULL AND task_id IS NOT NULL)")
simple("w11_replace_graph", lambda t: merge.replaced(t("dag_edges").select(*_K, "edge_id"), t("dag_edges").where("kind = 'return'").select(*_K, "edge_id"), _K), "SELECT func_id, taint_signature, task_id, edge_id FROM dag_edges WHERE kind = 'return' UNION ALL SELECT func_id, taint_signature, task_id, edge_id FROM dag_edges e WHERE NOT EXISTS (SELECT 1 FROM dag_edges x WHERE x.kind = 'return' AND x.func_id = e.func_id AND x.taint_signature = e.taint_signature AND x.task_id = e.task_id)")
simple("w14_backfill", lambda t: t("dvs_task_graph_sessions").groupBy("session_relpath").agg(F.max_by("status", F.struct("loaded_at", "status")).alias("status"), F.count("*").alias("copies")), "SELECT session_relpath, arg_max(status, (loaded_at, status)) AS status, count(*) AS copies FROM dvs_task_graph_sessions GROUP BY 1")
simple("w15_manifest", lambda t: t("dvs_task_graph_runs").where(F.startswith("task_id", F.lit("dvs-000000"))).select("task_id", "root_function", F.unix_micros("loaded_at").alias("at")).orderBy(F.desc("at"), F.desc("task_id")), "SELECT task_id, root_function, epoch_us(loaded_at) AS at FROM dvs_task_graph_runs WHERE starts_with(task_id, 'dvs-000000') ORDER BY 3 DESC, 1 DESC")
simple("w17_metric_lines", lambda t: t("events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.concat(F.lit('events_total{type="'), X.label_escape("event_type"), F.lit('"} '), X.metric_value("n")).alias("line")), "SELECT 'events_total{type=\"' || event_type || '\"} ' || printf('%.6f', CAST(count(*) AS DOUBLE)) AS line FROM events GROUP BY event_type")
simple("w18_cache_valid", lambda t: t("dvs_functions").where("func_hash is not null").select("func_id", "func_hash").distinct().join(t("dvs_functions").where("func_hash is not null").groupBy("func_id").agg(F.max_by("func_hash", F.struct("loaded_at", "func_hash")).alias("current")), "func_id").select("func_id", "func_hash", (F.col("func_hash") == F.col("current")).alias("valid")), "SELECT DISTINCT f.func_id, func_hash, func_hash = current AS valid FROM dvs_functions f JOIN (SELECT func_id, arg_max(func_hash, (loaded_at, func_hash)) AS current FROM dvs_functions WHERE func_hash IS NOT NULL GROUP BY 1) c ON c.func_id = f.func_id WHERE func_hash IS NOT NULL")

# ---- state
_NOW = "timestamp_ntz'2024-01-20 00:00:00'"
simple("t01_watermark_scan", lambda t: state.watermark_scan(t("events"), "ts", F.expr(_NOW)).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3600 SECOND GROUP BY 1")
simple("t02_late_dedup", lambda t: t("events").dropDuplicates(["user_id", "event_type", "props"]).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY 1")
simple("t03_claims", lambda t: state.claims(t("dag_nodes"), ["func_id", "taint_signature"], "task_id", ["written_at", "rec_id"]), "SELECT func_id, taint_signature, arg_min(task_id, (CASE WHEN written_at IS NULL THEN 0 ELSE 1 END, coalesce(written_at, TIMESTAMPTZ '1900-01-01 00:00:00+00'), rec_id)) AS holder, count(*) AS requests FROM dag_nodes GROUP BY 1, 2")
simple("t04_cross_task_claims", lambda t: state.claims(t("dag_edges"), ["func_id"], "task_id", ["loaded_at", "task_id"]), "SELECT func_id, arg_min(task_id, (loaded_at, task_id)) AS holder, count(*) AS requests FROM dag_edges GROUP BY 1")
simple("t05_lease_state", lambda t: state.lease_state(t("events").withColumn("kind", F.when(F.col("event_type") == "purchase", "claim").when(F.col("event_type") == "error", "release")), ["user_id"], "ts", "kind").select("user_id", "epoch", "held"), "SELECT user_id, epoch, c IS NOT NULL AND (r IS NULL OR r < c) AS held FROM (SELECT user_id, count(*) FILTER (WHERE event_type='purchase') AS epoch, max(ts) FILTER (WHERE event_type='purchase') AS c, max(ts) FILTER (WHERE event_type='error') AS r FROM events GROUP BY 1)")
simple("t06_orphans", lambda t: t("events").groupBy("user_id").agg(F.max("ts").alias("hb")).select("user_id", state.orphan_reason(F.when(F.col("user_id") % 7 > 0, "w"), F.when(F.col("user_id") % 5 > 0, F.expr(_NOW) + F.expr("interval 1 day")), F.col("hb"), F.expr(_NOW)).alias("why")), "SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'missing_owner' WHEN user_id % 5 = 0 THEN 'expired_lease' WHEN max(ts) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 60 SECOND THEN 'stale_heartbeat' END AS why FROM events GROUP BY 1")
simple("t07_handoff_age", lambda t: t("orders").select("o_orderkey", X.first_of([(F.col("o_orderstatus") == "F", "done"), (F.col("o_orderdate") < F.expr("timestamp_ntz'1993-01-01 00:00:00'"), "published_aged"), (F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01 00:00:00'"), "delivering_aged")], "fresh").alias("age")), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderdate < TIMESTAMP '1993-01-01 00:00:00' THEN 'published_aged' WHEN o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'delivering_aged' ELSE 'fresh' END AS age FROM orders")
simple("t08_liveness", lambda t: t("events").groupBy("user_id").agg((F.max("ts") >= F.expr(_NOW) - F.expr("interval 30 seconds")).alias("alive")), "SELECT user_id, max(ts) >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 SECOND AS alive FROM events GROUP BY 1")
simple("t09_active_sessions", lambda t: t("dvs_task_graph_sessions").where(F.col("status").isin("running", "pending") & (F.col("mtime") >= 1735689600.0 - state.ACTIVE_WINDOW)).select("session_relpath", "mtime"), "SELECT session_relpath, mtime FROM dvs_task_graph_sessions WHERE status IN ('running','pending') AND mtime >= 1735689600.0 - 120")
simple("t12_readiness", lambda t: lookup.ready(t("dag_edges").select("task_id"), "task_id", t("dag_edges").where("kind = 'callee'").select("task_id", "sink_ref"), "sink_ref", t("dvs_functions"), "func_name"), "SELECT DISTINCT task_id FROM dag_edges WHERE task_id NOT IN (SELECT task_id FROM dag_edges WHERE kind = 'callee' AND (sink_ref IS NULL OR sink_ref NOT IN (SELECT func_name FROM dvs_functions WHERE func_name IS NOT NULL)) AND task_id IS NOT NULL)")
simple("t13_retry_window", lambda t: t("events").where(F.col("event_type") == "error").where(F.col("ts").isNull() | (F.col("ts") < F.expr(_NOW) - F.expr(f"interval {state.RETRY_WINDOW} seconds"))).orderBy(F.asc_nulls_first("ts"), "event_id").limit(100).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'error' AND (ts IS NULL OR ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 300 SECOND) ORDER BY ts NULLS FIRST, event_id LIMIT 100")
simple("t11_idle_queues", lambda t: state.idle(t("events").select("user_id", F.when(F.col("event_type").isin("view", "click"), "put").when(F.col("event_type") == "purchase", "done").alias("kind")), ["user_id"], "kind"), "SELECT user_id, puts, dones, puts <= dones AS idle FROM (SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS puts, count(*) FILTER (WHERE event_type = 'purchase') AS dones FROM events GROUP BY 1)")


def _lease_events(t):
    kind = F.when(F.col("event_type").isin("view", "signup"), "claim").when(F.col("event_type") == "click", "renew").otherwise("release")
    return t("events").select(F.col("user_id").cast("string").alias("task"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("owner"))


@query("t05_lease_log")
def _(t):
    """Every claim, renewal and release of a task's lease in order: whether it held, and the fencing epoch and owner after it."""
    return state.lease_log(_lease_events(t), "task", "at", "seq", "kind", "owner", 6 * 3600)


@query("t03_reservations")
def _(t):
    """Reservations that only their owner can release: the same log without an end of the lease."""
    return state.lease_log(_lease_events(t).where("kind <> 'renew'"), "task", "at", "seq", "kind", "owner", None)
simple("t14_superseded", lambda t: t("events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("current"), (F.count("*") - 1).alias("superseded")), "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS current, count(*) - 1 AS superseded FROM events GROUP BY 1, 2")
simple("t15_claim_queued", lambda t: state.claims(t("orders").where("o_orderstatus = 'O'"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"]), "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS holder, count(*) AS requests FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")

QUERIES = {k: v for k, v in _KNOWN.items() if k not in _before}
SQL = {k: v for k, v in _KNOWN_SQL.items() if k in QUERIES}
