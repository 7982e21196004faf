"""Registered filters (F), joins (J), aggregates (A), rankings (R) and orders (L)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import scalar as X
from lodestrand.operators import lookup, ranking
from lodestrand.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
T = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(t)``, where ``t(name)`` reads a table."""

    def keep(fn: Callable[[T], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: table(spark, sf_dir, n))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return keep


def simple(name: str, fn: Callable[[T], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(fn)


n_ = lambda: F.count("*").alias("n")

# ---- scans and filters
_SOME = "(SELECT min(f.func_id) FROM dvs_functions f JOIN dvs_task_graph_edges e ON e.target_func_id = f.func_id)"


def _some_function(t):
    """One row: the smallest id that the index and the edges share."""
    return t("dvs_functions").select("func_id").join(t("dvs_task_graph_edges").select(F.col("target_func_id").alias("func_id")), "func_id", "left_semi").agg(F.min("func_id").alias("func_id"))


simple("s01_point_get", lambda t: t("dvs_functions").join(F.broadcast(_some_function(t)), "func_id").select("func_id", "file", "func_name", "start_line", "end_line"),
       f"SELECT func_id, file, func_name, start_line, end_line FROM dvs_functions WHERE func_id = {_SOME}")
simple("s02_list_functions", lambda t: t("dvs_functions").select("func_id", "file", "func_name", "name_tail", "signature", "start_line", "end_line"), "SELECT func_id, file, func_name, name_tail, signature, start_line, end_line FROM dvs_functions")
simple("s03_functions_by_file", lambda t: t("dvs_functions").where(F.startswith("file", F.lit("src/core/"))).select("file", "start_line", "func_id", "func_name").orderBy("file", "start_line", "func_id"),
       "SELECT file, start_line, func_id, func_name FROM dvs_functions WHERE starts_with(file, 'src/core/') ORDER BY 1, 2, 3")
simple("s04_taints_of_function", lambda t: t("dag_nodes").where(F.col("is_source") == 1).groupBy("func_id", "taint_signature").agg(n_()), "SELECT func_id, taint_signature, count(*) AS n FROM dag_nodes WHERE is_source = 1 GROUP BY 1, 2")
simple("s05_pending_edges", lambda t: t("dvs_task_graph_edges").where(F.col("status").isin("pending", "scheduled")).select("task_id", "edge_id", "display_order", "status").orderBy("task_id", "display_order", "edge_id"),
       "SELECT task_id, edge_id, display_order, status FROM dvs_task_graph_edges WHERE status IN ('pending','scheduled') ORDER BY 1, 3, 2")
simple("s06_files_calling_into", lambda t: t("dvs_task_graph_edges").where(F.col("source_file") != F.col("target_file")).select("target_file", "source_file").distinct(), "SELECT DISTINCT target_file, source_file FROM dvs_task_graph_edges WHERE source_file <> target_file")
simple("f01_null_aware_filter", lambda t: t("dvs_task_graph_edges").where((F.col("reason_code").isNull() | (F.col("reason_code") != "low_value_callee")) & (F.col("visible_in_tree") == 1)).groupBy("status", "edge_kind").agg(n_()),
       "SELECT status, edge_kind, count(*) AS n FROM dvs_task_graph_edges WHERE (reason_code IS NULL OR reason_code <> 'low_value_callee') AND visible_in_tree = 1 GROUP BY 1, 2")
simple("f02_keyword_search", lambda t: t("dvs_functions").where(F.contains("func_name", F.lit("route")) | F.contains("description", F.lit("route"))).select("func_id", "func_name"), "SELECT func_id, func_name FROM dvs_functions WHERE contains(func_name,'route') OR contains(description,'route')")
simple("f03_chained_filters", lambda t: t("dvs_task_graph_sessions").where("session_kind is not null and node_id is not null and event_count > 10").groupBy("session_kind", "session_role", "status").agg(n_()), "SELECT session_kind, session_role, status, count(*) AS n FROM dvs_task_graph_sessions WHERE session_kind IS NOT NULL AND node_id IS NOT NULL AND event_count > 10 GROUP BY 1, 2, 3")
simple("f04_type_in_signature", lambda t: t("dvs_functions").where(F.contains("signature", F.lit("uint8_t"))).select("func_id", "signature"), "SELECT func_id, signature FROM dvs_functions WHERE contains(signature, 'uint8_t')")


@query("f05_class_methods", "WITH c AS (SELECT DISTINCT array_to_string(list_slice(string_split(func_name,'::'),1,len(string_split(func_name,'::'))-1),'::') AS cls FROM dvs_functions WHERE contains(func_name,'::')) SELECT cls, f.func_name, count(*) AS n FROM c JOIN dvs_functions f ON starts_with(f.func_name, cls || '::') GROUP BY 1, 2")
def _(t):
    """Methods under each class scope: the prefixes of a name are its scopes, an equi-join instead of LIKE."""
    scopes = t("dvs_functions").where(F.contains("func_name", F.lit("::"))).select(F.regexp_extract("func_name", "^(.*)::[^:]+$", 1).alias("cls")).distinct()
    named = t("dvs_functions").withColumn("_p", F.split("func_name", "::")).select("func_name", "_p").where("size(_p) > 1")
    every = named.select("func_name", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda k: F.array_join(F.slice("_p", F.lit(1), k), "::"))).alias("cls"))
    return every.join(scopes, "cls").groupBy("cls", "func_name").agg(n_())


_F06 = """
WITH p AS (SELECT DISTINCT target_function_raw AS probe FROM dvs_task_graph_edges WHERE trim(target_function_raw) <> ''),
f AS (SELECT DISTINCT func_id, func_name, name_tail FROM dvs_functions),
h AS (SELECT probe, func_id, 1 AS layer FROM p JOIN f ON func_name = probe
UNION ALL SELECT probe, func_id, 2 FROM p JOIN f ON func_name = list_extract(string_split(probe,'::'),-1) AND NOT contains(func_name,'::')
UNION ALL SELECT probe, func_id, 3 FROM p JOIN f ON name_tail = probe
UNION ALL SELECT probe, func_id, 4 FROM p JOIN f ON func_name = CASE WHEN starts_with(probe,'_') THEN substr(probe,2) ELSE '_' || probe END),
m AS (SELECT probe, func_id, min(layer) AS layer FROM h GROUP BY 1, 2)
SELECT probe, func_id, layer FROM m QUALIFY layer = min(layer) OVER (PARTITION BY probe)"""


@query("f06_layered_name_lookup", _F06)
def _(t):
    """Callee names resolved layer by layer, all matches of the first layer that has any."""
    return lookup.layered_lookup(t("dvs_task_graph_edges").select(F.col("target_function_raw").alias("probe")), "probe", t("dvs_functions"), "func_name", "name_tail", "func_id")


simple("f08_name_candidates", lambda t: lookup.name_candidates(t("dvs_functions").select("func_name").distinct(), "func_name", "label"), "SELECT DISTINCT func_name FROM (SELECT DISTINCT func_name FROM dvs_functions WHERE contains(func_name,'label')) ORDER BY length(func_name), func_name LIMIT 20")
simple("f09_visible_projection", lambda t: t("dvs_task_graph_edges").where("visible_in_all_propagations = 1").select("edge_id", "edge_kind", X.lookup({"direct_call": "direct", "indirect_call": "indirect"}, F.col("edge_kind")).alias("label"), F.col("status").isin("scheduled", "running", "done", "failed", "cancelled").alias("followed")),
       "SELECT edge_id, edge_kind, CASE edge_kind WHEN 'direct_call' THEN 'direct' WHEN 'indirect_call' THEN 'indirect' END AS label, status IN ('scheduled','running','done','failed','cancelled') AS followed FROM dvs_task_graph_edges WHERE visible_in_all_propagations = 1")


@query("f10_sessions_with_owner", "WITH n AS (SELECT node_id, arg_max(function_name_resolved, loaded_at) AS fn FROM dvs_task_graph_nodes GROUP BY 1) SELECT s.session_relpath, epoch_us(s.loaded_at) AS at, coalesce(n.fn, s.display_name, '') AS owner FROM dvs_task_graph_sessions s LEFT JOIN n ON n.node_id = s.node_id")
def _(t):
    nodes = t("dvs_task_graph_nodes").groupBy("node_id").agg(F.max_by("function_name_resolved", "loaded_at").alias("fn"))
    return t("dvs_task_graph_sessions").join(nodes, "node_id", "left").select("session_relpath", F.unix_micros("loaded_at").alias("at"), F.coalesce("fn", "display_name", F.lit("")).alias("owner"))


@query("f11_backed_by_taint", "WITH x AS (SELECT func_id, list(DISTINCT taint) AS taints FROM dag_nodes WHERE taint IS NOT NULL GROUP BY 1) SELECT e.edge_id, coalesce(list_contains(taints, source_taint_name) OR (length(source_taint_name) >= 2 AND len(list_filter(taints, lambda z: starts_with(z, source_taint_name || '->') OR starts_with(z, source_taint_name || '.'))) > 0), false) AS backed FROM dvs_task_graph_edges e LEFT JOIN x ON x.func_id = e.source_func_id")
def _(t):
    """the source taint is confirmed exactly, or as the struct of a confirmed field: equi-joins on the taint and on
    every struct that a taint's name begins with."""
    taints = t("dag_nodes").where("taint is not null and func_id is not null").select("func_id", "taint").distinct()
    cuts = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.length("taint")), lambda k: F.when(F.substring(F.col("taint"), k, F.lit(1)) == ".", F.substring(F.col("taint"), F.lit(1), k - 1)).when(F.substring(F.col("taint"), k, F.lit(2)) == "->", F.substring(F.col("taint"), F.lit(1), k - 1))), lambda x: F.length(x) >= 2))
    names = taints.select("func_id", F.explode(F.array_distinct(F.concat(F.array("taint"), cuts))).alias("name")).distinct()
    marked = names.select(F.col("func_id").alias("source_func_id"), F.col("name").alias("source_taint_name"), F.lit(True).alias("_b"))
    return t("dvs_task_graph_edges").join(marked, ["source_func_id", "source_taint_name"], "left").select("edge_id", F.coalesce("_b", F.lit(False)).alias("backed"))


simple("f12_indirect_call", lambda t: t("dvs_task_graph_edges").select("edge_id", (F.contains("target_function_raw", F.lit("->")) | F.contains("target_function_raw", F.lit("*")) | F.startswith("target_function_raw", F.lit("("))).alias("by_dag"), (F.contains("target_function_raw", F.lit("->")) | F.contains("target_function_raw", F.lit("[")) | F.startswith("target_function_raw", F.lit("*"))).alias("by_edge")),
       "SELECT edge_id, contains(target_function_raw,'->') OR contains(target_function_raw,'*') OR starts_with(target_function_raw,'(') AS by_dag, contains(target_function_raw,'->') OR contains(target_function_raw,'[') OR starts_with(target_function_raw,'*') AS by_edge FROM dvs_task_graph_edges")
simple("f13_sink_edges", lambda t: t("dag_edges").where(X.is_sink("sink_ref")).groupBy("sink_ref").agg(n_()), "SELECT sink_ref, count(*) AS n FROM dag_edges WHERE list_contains(string_split('" + " ".join(X.SINK_NAMES) + "', ' '), list_extract(string_split(sink_ref,'::'),-1)) GROUP BY 1")
simple("f14_escape_consistency", lambda t: t("dag_edges").select("edge_id", "func_id", X.first_of([((F.col("kind") != "extern") & F.col("escape_subkind").isNotNull(), "subkind_without_extern"), ((F.col("kind") == "extern") & F.col("escape_subkind").isNull(), "extern_without_subkind"), (F.col("carrier").isNotNull() & F.col("escape_via").isNull(), "carrier_without_via")], "ok").alias("verdict")),
       "SELECT edge_id, func_id, CASE WHEN kind <> 'extern' AND escape_subkind IS NOT NULL THEN 'subkind_without_extern' WHEN kind = 'extern' AND escape_subkind IS NULL THEN 'extern_without_subkind' WHEN carrier IS NOT NULL AND escape_via IS NULL THEN 'carrier_without_via' ELSE 'ok' END AS verdict FROM dag_edges")
simple("f15_drop_constant_returns", lambda t: t("dag_edges").where(~((F.col("kind") == "return") & F.coalesce(F.col("taints_json").rlike('^\\["?(?:-?\\d+|NULL|nullptr|true|false)"?\\]$'), F.lit(False)))).groupBy("kind").agg(n_()), "SELECT kind, count(*) AS n FROM dag_edges WHERE NOT (kind = 'return' AND coalesce(regexp_matches(taints_json, '^\\[\"?(-?\\d+|NULL|nullptr|true|false)\"?\\]$'), false)) GROUP BY 1")
simple("f16_exclude_error_sessions", lambda t: t("dvs_task_graph_sessions").where(~F.col("session_relpath").rlike("-error\\d+(\\.jsonl)?$")).groupBy("session_kind").agg(n_()), "SELECT session_kind, count(*) AS n FROM dvs_task_graph_sessions WHERE NOT regexp_matches(session_relpath, '-error\\d+(\\.jsonl)?$') GROUP BY 1")
simple("f17_entry_taint", lambda t: t("dag_nodes").select("rec_id", F.when(F.col("taint").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("taint")).otherwise("auto").alias("entry")), "SELECT rec_id, CASE WHEN regexp_matches(taint, '^[A-Za-z_][A-Za-z0-9_]*$') THEN taint ELSE 'auto' END AS entry FROM dag_nodes")
simple("f18_escape_dedup", lambda t: t("dag_edges").where("kind = 'extern'").groupBy("func_id", "carrier", "escape_via").agg(n_()), "SELECT func_id, carrier, escape_via, count(*) AS n FROM dag_edges WHERE kind = 'extern' GROUP BY 1, 2, 3")

# ---- joins
simple("j01_findings_of_runs", lambda t: t("lineitem").join(t("orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(n_()), "SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")


@query("j02_two_tier_reason", "WITH a AS (SELECT func_id AS k, min(file) AS f FROM dvs_functions GROUP BY 1), b AS (SELECT name_tail AS k, min(file) AS f FROM dvs_functions WHERE name_tail IS NOT NULL GROUP BY 1) SELECT e.edge_id, coalesce(a.f, b.f) AS file, CASE WHEN a.f IS NOT NULL THEN 'by_id' WHEN b.f IS NOT NULL THEN 'by_name' ELSE 'unresolved' END AS via FROM dvs_task_graph_edges e LEFT JOIN a ON a.k = e.target_func_id LEFT JOIN b ON b.k = e.target_function_raw")
def _(t):
    edges = t("dvs_task_graph_edges").select("edge_id", "target_func_id", "target_function_raw")
    by_id = t("dvs_functions").groupBy("func_id").agg(F.lit(1).alias("_id"))
    out = lookup.two_tier_left(edges, t("dvs_functions").select("func_id", "name_tail", "file"), ("target_func_id", "func_id"), ("target_function_raw", "name_tail"), "file")
    out = out.join(by_id, out["target_func_id"] == by_id["func_id"], "left")
    via = F.when(F.col("_id").isNotNull(), "by_id").when(F.col("file").isNotNull(), "by_name").otherwise("unresolved")
    return out.select("edge_id", "file", via.alias("via"))


@query("j03_first_propagation", "WITH p AS (SELECT source_func_id, target_function_raw, arg_min(edge_id, (coalesce(call_line,0), edge_id)) AS first_edge FROM dvs_task_graph_edges GROUP BY 1, 2), f AS (SELECT DISTINCT func_id FROM dvs_functions) SELECT p.source_func_id, p.target_function_raw, p.first_edge, f.func_id IS NOT NULL AS known FROM p LEFT JOIN f ON f.func_id = p.source_func_id")
def _(t):
    first = t("dvs_task_graph_edges").groupBy("source_func_id", "target_function_raw").agg(F.min_by("edge_id", F.struct(F.coalesce("call_line", F.lit(0)), "edge_id")).alias("first_edge"))
    known = t("dvs_functions").select(F.col("func_id").alias("source_func_id"), F.lit(True).alias("_k")).distinct()
    return first.join(known, "source_func_id", "left").select("source_func_id", "target_function_raw", "first_edge", F.col("_k").isNotNull().alias("known"))


simple("j04_taint_nodes", lambda t: t("dag_nodes").select("rec_id", "func_id", "taint").join(t("dvs_functions").groupBy("func_id").agg(F.min("func_name").alias("fn")), "func_id", "left").select("rec_id", "taint", F.coalesce("fn", "func_id").alias("owner")), "SELECT rec_id, taint, coalesce(fn, d.func_id) AS owner FROM dag_nodes d LEFT JOIN (SELECT func_id, min(func_name) AS fn FROM dvs_functions GROUP BY 1) f ON f.func_id = d.func_id")
simple("j05_edge_targets", lambda t: t("dvs_task_graph_edges").select("edge_id", "target_func_id").join(t("dvs_functions").groupBy(F.col("func_id").alias("target_func_id")).agg(F.min("start_line").alias("at")), "target_func_id", "left").select("edge_id", "at"), "SELECT edge_id, f.at FROM dvs_task_graph_edges e LEFT JOIN (SELECT func_id, min(start_line) AS at FROM dvs_functions GROUP BY 1) f ON f.func_id = e.target_func_id")
simple("j07_active_jobs", lambda t: t("events").where("event_type = 'purchase'").select("event_id", "user_id").join(t("customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id").select("event_id", "c_name"), "SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
simple("j08_slots_and_owners", lambda t: lookup.with_unmatched(t("worker_clocks").where("zone_name = 'UTC'").groupBy("worker_id").agg(F.count("*").alias("slots")), t("worker_clocks").where("zone_name <> 'UTC'").groupBy("worker_id").agg(F.count("*").alias("owned")), "worker_id", "stale_owner"),
       "WITH s AS (SELECT worker_id, count(*) AS slots FROM worker_clocks WHERE zone_name = 'UTC' GROUP BY 1), o AS (SELECT worker_id, count(*) AS owned FROM worker_clocks WHERE zone_name <> 'UTC' GROUP BY 1) SELECT coalesce(s.worker_id, o.worker_id) AS worker_id, slots, owned, CASE WHEN s.worker_id IS NULL THEN 'stale_owner' WHEN o.worker_id IS NULL THEN 'idle' ELSE 'busy' END AS state FROM s FULL JOIN o ON s.worker_id = o.worker_id")
simple("j09_best_root", lambda t: lookup.best_root(t("dvs_functions").select("file").distinct(), "file", t("dvs_functions").select(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("root")).union(t("dvs_functions").select(F.regexp_extract("file", "^([^/]*)/", 1))).distinct(), "root", []),
       "WITH r AS (SELECT DISTINCT regexp_extract(file,'^(.*)/[^/]*$',1) AS root FROM dvs_functions UNION SELECT DISTINCT regexp_extract(file,'^([^/]*)/',1) FROM dvs_functions) SELECT file, arg_max(root, length(root)) AS root FROM (SELECT DISTINCT file FROM dvs_functions) f JOIN r ON file = root OR starts_with(file, root || '/') GROUP BY 1")
simple("j10_interval_join", lambda t: lookup.interval_join(t("dvs_task_graph_edges").where("call_line is not null and source_file is not null").select("edge_id", F.col("source_file").alias("file"), F.col("call_line").alias("line")).distinct(), t("dvs_functions").where("start_line is not null and end_line is not null"), "file", "line", "start_line", "end_line", "func_id"),
       "SELECT e.edge_id, e.file, e.line, coalesce(arg_min(f.func_id, (f.start_line, f.end_line, f.func_id)), '<global:' || e.file || ':' || e.line || '>') AS func_id FROM (SELECT DISTINCT edge_id, source_file AS file, call_line AS line FROM dvs_task_graph_edges WHERE call_line IS NOT NULL AND source_file IS NOT NULL) e LEFT JOIN dvs_functions f ON f.file = e.file AND e.line BETWEEN f.start_line AND f.end_line GROUP BY 1, 2, 3")
simple("j11_mutex_siblings", lambda t: lookup.siblings(t("dag_edges").where("from_node is not null").select(F.concat_ws("|", "func_id", "task_id", F.col("from_node").cast("string")).alias("grp"), "to_node"), "grp", "to_node"),
       "SELECT grp, to_node, arms FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS arms FROM (SELECT DISTINCT concat_ws('|', func_id, task_id, CAST(from_node AS VARCHAR)) AS grp, to_node FROM dag_edges WHERE from_node IS NOT NULL AND to_node IS NOT NULL)) WHERE arms > 1")


@query("j09_matched_process", """
WITH s AS (SELECT DISTINCT session_relpath AS proc, task_id FROM dvs_task_graph_sessions WHERE session_relpath IS NOT NULL),
r AS (SELECT 'sessions/' || task_id AS root, task_id AS owner, epoch_us(max(loaded_at)) AS u FROM dvs_task_graph_runs GROUP BY 2 UNION ALL SELECT 'sessions/' || task_id || '/judges', task_id, 0 FROM dvs_task_graph_runs GROUP BY 2),
h AS (SELECT proc, 3 AS n, 'session' AS source, root, owner, u FROM s JOIN r ON proc = root OR starts_with(proc, root || '/')
UNION ALL SELECT proc, 2, 'cwd', root, owner, u FROM s JOIN r ON root = 'sessions/' || s.task_id
UNION ALL SELECT proc, 1, 'command', root, owner, u FROM s JOIN r ON root = 'sessions/' || s.task_id OR root = 'sessions/' || s.task_id || '/judges')
SELECT proc, owner, source, root FROM (SELECT *, row_number() OVER (PARTITION BY proc ORDER BY n DESC, length(root) DESC, u DESC, owner DESC, source DESC, root DESC) AS p FROM h) WHERE p = 1""")
def _(t):
    """The task of each process, by its session path, its working folder and its command, the best match first."""
    folder = F.concat(F.lit("sessions/"), "task_id")
    procs = t("dvs_task_graph_sessions").where("session_relpath is not null").select(F.col("session_relpath").alias("proc"), F.col("session_relpath").alias("path"), folder.alias("cwd"), F.concat(F.lit("run --dir="), folder, F.lit("/judges -v")).alias("command")).distinct()
    runs = t("dvs_task_graph_runs").groupBy("task_id").agg(F.unix_micros(F.max("loaded_at")).alias("u"))
    roots = runs.select(folder.alias("root"), "task_id", "u").unionByName(runs.select(F.concat(folder, F.lit("/judges")).alias("root"), "task_id", F.lit(0).cast("long").alias("u")))
    return lookup.matched_root(procs, "proc", [("path", "session", 3), ("cwd", "cwd", 2)], "command", roots, "root", "task_id", [F.col("u")])


@query("j12_session_edges", "WITH p AS (SELECT node_id, min(session_relpath) AS s FROM dvs_task_graph_sessions WHERE node_id IS NOT NULL GROUP BY 1) SELECT DISTINCT e.edge_id, a.s AS from_session, b.s AS to_session FROM dvs_task_graph_edges e JOIN p a ON a.node_id = e.source_node_id JOIN p b ON b.node_id = e.target_node_id")
def _(t):
    first = t("dvs_task_graph_sessions").where("node_id is not null").groupBy("node_id").agg(F.min("session_relpath").alias("s"))
    a, b = (first.select(F.col("node_id").alias(f"{e}_node_id"), F.col("s").alias(f"{o}_session")) for e, o in (("source", "from"), ("target", "to")))
    return t("dvs_task_graph_edges").select("edge_id", "source_node_id", "target_node_id").join(a, "source_node_id").join(b, "target_node_id").select("edge_id", "from_session", "to_session").distinct()


simple("j13_ready_units", lambda t: lookup.ready(t("dag_edges").select("func_id"), "func_id", t("dag_edges").where("kind = 'callee' and sink_ref is not null").select("func_id", "sink_ref"), "sink_ref", t("dvs_functions"), "func_name"),
       "SELECT DISTINCT func_id FROM dag_edges WHERE func_id NOT IN (SELECT func_id FROM dag_edges WHERE kind = 'callee' AND sink_ref IS NOT NULL AND sink_ref NOT IN (SELECT func_name FROM dvs_functions WHERE func_name IS NOT NULL))")
simple("j14_callers", lambda t: t("dag_edges").where("kind = 'callee'").select("sink_ref", "func_id", "taint_signature").distinct(), "SELECT DISTINCT sink_ref, func_id, taint_signature FROM dag_edges WHERE kind = 'callee'")
simple("j15_unmined", lambda t: t("dag_nodes").select("func_id").distinct().join(t("dag_edges").where("kind = 'extern'").select("func_id").distinct(), "func_id", "left_anti"), "SELECT DISTINCT func_id FROM dag_nodes WHERE func_id NOT IN (SELECT func_id FROM dag_edges WHERE kind = 'extern')")
simple("j16_args_by_position", lambda t: t("dvs_task_graph_edges").select("edge_id", F.posexplode(F.from_json("actual_args_json", "array<string>")).alias("pos", "arg")), "SELECT edge_id, CAST(i - 1 AS INT) AS pos, a[i] AS arg FROM (SELECT edge_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT edge_id, CAST(from_json(actual_args_json, '[\"VARCHAR\"]') AS VARCHAR[]) AS a FROM dvs_task_graph_edges WHERE json_valid(actual_args_json)))")
simple("j17_taint_positions", lambda t: t("dvs_task_graph_edges").where("source_taint_name is not null").select("edge_id", F.array_join(F.filter(F.transform(F.from_json("actual_args_json", "array<string>"), lambda a, i: F.when(F.contains(a, F.col("source_taint_name")), (i + 1).cast("string"))), lambda x: x.isNotNull()), ",").alias("positions")),
       "SELECT edge_id, CASE WHEN actual_args_json IS NULL OR NOT json_valid(actual_args_json) THEN NULL ELSE array_to_string(list_filter(list_transform(CAST(from_json(actual_args_json, '[\"VARCHAR\"]') AS VARCHAR[]), lambda a, i: CASE WHEN contains(a, source_taint_name) THEN CAST(i AS VARCHAR) END), lambda x: x IS NOT NULL), ',') END AS positions FROM dvs_task_graph_edges WHERE source_taint_name IS NOT NULL")
simple("j20_either_end", lambda t: t("dvs_task_graph_edges").join(F.broadcast(_some_function(t)), (F.col("source_func_id") == F.col("func_id")) | (F.col("target_func_id") == F.col("func_id"))).select("edge_id", "source_func_id", "target_func_id"),
       f"SELECT edge_id, source_func_id, target_func_id FROM dvs_task_graph_edges WHERE source_func_id = {_SOME} OR target_func_id = {_SOME}")
simple("j21_edges_of_named", lambda t: t("dvs_task_graph_edges").join(t("dvs_functions").where(F.startswith("name_tail", F.lit("route"))).select(F.col("func_id").alias("source_func_id")), "source_func_id", "left_semi").groupBy("edge_kind").agg(n_()), "SELECT edge_kind, count(*) AS n FROM dvs_task_graph_edges WHERE source_func_id IN (SELECT func_id FROM dvs_functions WHERE starts_with(name_tail,'route')) GROUP BY 1")


@query("j22_pointer_candidates", "WITH k AS (SELECT DISTINCT list_extract(string_split(name_tail,'_'),1) AS part FROM dvs_functions WHERE contains(name_tail,'_')), f AS (SELECT DISTINCT name_tail FROM dvs_functions) SELECT part, count(*) AS n FROM k JOIN f ON starts_with(name_tail, part || '_') OR ends_with(name_tail, '_' || part) WHERE part <> '' GROUP BY 1")
def _(t):
    """Names that begin or end with a key part, by equi-join on their first and last parts."""
    names = t("dvs_functions").select("name_tail").distinct().withColumn("_p", F.split("name_tail", "_")).where("size(_p) > 1")
    parts = t("dvs_functions").where(F.contains("name_tail", F.lit("_"))).select(F.element_at(F.split("name_tail", "_"), 1).alias("part")).where("part <> ''").distinct()
    ends = names.select("name_tail", F.explode(F.array_distinct(F.array(F.element_at("_p", 1), F.element_at("_p", -1)))).alias("part"))
    return ends.join(parts, "part").groupBy("part").agg(n_())


simple("j23_max_findings", lambda t: t("dvs_task_graph_sessions").select("session_relpath", "node_id", F.coalesce("event_count", F.lit(0)).alias("own"), F.unix_micros("loaded_at").alias("at")).join(t("dvs_task_graph_nodes").groupBy("node_id").agg(F.max("findings_count").alias("g")), "node_id", "left").select("session_relpath", "at", F.greatest("own", F.coalesce("g", F.lit(0))).alias("findings")),
       "SELECT session_relpath, epoch_us(loaded_at) AS at, greatest(coalesce(event_count,0), coalesce(g,0)) AS findings FROM dvs_task_graph_sessions s LEFT JOIN (SELECT node_id, max(findings_count) AS g FROM dvs_task_graph_nodes GROUP BY 1) n ON n.node_id = s.node_id")

# ---- aggregates
_ST = ("done", "running", "pending", "failed", "skipped", "cached")
simple("a01_status_pivot", lambda t: t("dvs_task_graph_nodes").groupBy("task_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in _ST], F.count("*").alias("total")), "SELECT task_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in _ST) + ", count(*) AS total FROM dvs_task_graph_nodes GROUP BY 1")
simple("a02_nonnegative_sums", lambda t: t("customer").groupBy("c_nationkey").agg(F.round(F.sum(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(0.0)), 2).alias("total")), "SELECT c_nationkey, round(sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0.0 END), 2) AS total FROM customer GROUP BY 1")
simple("a03_finding_stats", lambda t: t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("reported")).withColumn("unreported", F.greatest(F.lit(0), F.col("total") - F.col("reported"))),
       "SELECT o_orderkey, count(l_orderkey) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS reported, greatest(0, count(l_orderkey) - count(*) FILTER (WHERE l_returnflag = 'R')) AS unreported FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
simple("a04_batch_stats", lambda t: t("customer").select("c_custkey").join(t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k")), "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n")), "SELECT c_custkey, coalesce(k, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey")
simple("a05_per_function", lambda t: t("dvs_task_graph_nodes").groupBy("func_id").agg(n_(), F.sum(F.coalesce("findings_count", F.lit(0))).alias("findings")), "SELECT func_id, count(*) AS n, CAST(sum(coalesce(findings_count,0)) AS BIGINT) AS findings FROM dvs_task_graph_nodes GROUP BY 1")


@query("a06_global_counts", "SELECT 'functions' AS what, count(*) AS n FROM dvs_functions UNION ALL SELECT 'nodes', count(*) FROM dvs_task_graph_nodes UNION ALL SELECT 'edges', count(*) FROM dvs_task_graph_edges UNION ALL SELECT 'taints', count(*) FROM dag_nodes")
def _(t):
    one = lambda name, what: t(name).agg(n_()).select(F.lit(what).alias("what"), "n")
    return one("dvs_functions", "functions").unionAll(one("dvs_task_graph_nodes", "nodes")).unionAll(one("dvs_task_graph_edges", "edges")).unionAll(one("dag_nodes", "taints"))


@query("a07_min_depth", "WITH d AS (SELECT func_id AS f, depth AS d FROM dvs_task_graph_nodes UNION ALL SELECT e.target_func_id, n.depth + 1 FROM dvs_task_graph_edges e JOIN dvs_task_graph_nodes n ON n.node_id = e.source_node_id) SELECT f, min(d) AS depth FROM d WHERE f IS NOT NULL GROUP BY 1")
def _(t):
    """Least depth of a function over both ends; nodes are combined to one depth per id before the join."""
    nodes = t("dvs_task_graph_nodes")
    at = nodes.groupBy(F.col("node_id").alias("source_node_id")).agg(F.min("depth").alias("d"))
    ends = t("dvs_task_graph_edges").select("source_node_id", F.col("target_func_id").alias("f")).distinct().join(at, "source_node_id").select("f", (F.col("d") + 1).alias("d"))
    return nodes.select(F.col("func_id").alias("f"), F.col("depth").alias("d")).unionAll(ends).where("f is not null").groupBy("f").agg(F.min("d").alias("depth"))


simple("a08_graph_summaries", lambda t: t("dvs_task_graph_edges").groupBy("task_id").agg(F.count("*").alias("edges"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status").isin("scheduled", "running", "done", "failed", "cancelled")).alias("followed"), F.count_if(F.col("status").isin("pending", "scheduled")).alias("open"), F.count_if(F.col("visible_in_tree") == 0).alias("hidden")),
       "SELECT task_id, count(*) AS edges, count(*) FILTER (WHERE status='done') AS done, count(*) FILTER (WHERE status IN ('scheduled','running','done','failed','cancelled')) AS followed, count(*) FILTER (WHERE status IN ('pending','scheduled')) AS open, count(*) FILTER (WHERE visible_in_tree=0) AS hidden FROM dvs_task_graph_edges GROUP BY 1")
simple("a09_round_summary", lambda t: t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.round(F.sum(F.coalesce(F.nullif("value", F.lit(0.0)), F.get_json_object("props", "$.k").cast("double"))), 2).alias("cost")), "SELECT event_type, count(DISTINCT user_id) AS users, round(sum(coalesce(nullif(value, 0.0), CAST(json_extract_string(props,'$.k') AS DOUBLE))), 2) AS cost FROM events GROUP BY 1")
simple("a13_trace_stats", lambda t: t("dvs_task_graph_nodes").groupBy("task_id").agg(F.max("depth").alias("deepest"), n_()), "SELECT task_id, max(depth) AS deepest, count(*) AS n FROM dvs_task_graph_nodes GROUP BY 1")
simple("a14_jobs_with_none", lambda t: t("dvs_task_graph_runs").select("task_id").distinct().join(t("dvs_task_graph_nodes").select("task_id", "status"), "task_id", "left").groupBy("task_id", F.coalesce("status", F.lit("none")).alias("st")).agg(F.count("status").alias("n")), "SELECT r.task_id, coalesce(n.status,'none') AS st, count(n.status) AS n FROM (SELECT DISTINCT task_id FROM dvs_task_graph_runs) r LEFT JOIN dvs_task_graph_nodes n ON n.task_id = r.task_id GROUP BY 1, 2")
simple("a15_grouped_counts", lambda t: t("dvs_task_graph_sessions").groupBy("status", "session_role", "session_kind").agg(n_()), "SELECT status, session_role, session_kind, count(*) AS n FROM dvs_task_graph_sessions GROUP BY 1, 2, 3")

_H = "WITH b AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([" + ", ".join(str(b) for b in ranking.BOUNDS) + ", 'inf'::DOUBLE]) AS le) WHERE value IS NOT NULL GROUP BY 1, 2)"


def _q_sql(q: float, out: str) -> str:
    return (f"SELECT event_type, CASE WHEN t = 0 THEN NULL WHEN le = 'inf'::DOUBLE THEN lo ELSE CASE WHEN n = bn OR le = lo THEN le ELSE lo + (le - lo) * (t * {q} - bn) / (n - bn) END END AS {out} "
            f"FROM (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(n) OVER w, 0) AS bn, max(n) OVER (PARTITION BY event_type) AS t FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)) WHERE n >= t * {q} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1")


simple("a17_histogram_quantile", lambda t: ranking.histogram_quantile(ranking.cumulative_buckets(t("events"), ["event_type"], "value", ranking.BOUNDS), ["event_type"], 0.9, "p90").withColumn("p90", F.round("p90", 6)), _H + " SELECT event_type, round(p90, 6) AS p90 FROM (" + _q_sql(0.9, "p90") + ")")
simple("a18_histogram_mean", lambda t: t("events").groupBy("event_type").agg(F.round(F.sum("value") / F.nullif(F.count("value"), F.lit(0)), 6).alias("mean")), "SELECT event_type, round(sum(value) / nullif(count(value), 0), 6) AS mean FROM events GROUP BY 1")
simple("a20_sum_by_label", lambda t: t("events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.round(F.sum("value"), 2).alias("total")), "SELECT json_extract_string(props,'$.k') AS k, round(sum(value), 2) AS total FROM events GROUP BY 1")
simple("a22_histogram", lambda t: ranking.cumulative_buckets(t("events"), ["event_type"], "value", ranking.BOUNDS).select("event_type", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_string("%.3f", "le")).alias("le"), "n"), _H + " SELECT event_type, CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE printf('%.3f', le) END AS le, n FROM b")
simple("a23_failure_counts", lambda t: t("documents").groupBy(X.failure_class(F.lit(""), "text").alias("cls")).agg(n_()), "SELECT cls, count(*) AS n FROM (SELECT CASE " + " ".join("WHEN (" + " OR ".join(f"contains(lower(coalesce(text,'')), '{w}')" for w in ws) + f") THEN '{n}'" for n, ws in X.FAILURE_WORDS) + " ELSE 'none' END AS cls FROM documents) GROUP BY 1")
simple("a24_status_by_project", lambda t: t("orders").groupBy("o_custkey", "o_orderstatus").agg(n_()), "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
simple("a25_snapshot", lambda t: t("dvs_task_graph_sessions").where("task_id is not null").groupBy("task_id").agg(F.countDistinct("session_relpath").alias("n"), F.array_join(F.array_sort(F.collect_set("session_kind")), ",").alias("kinds")), "SELECT task_id, count(DISTINCT session_relpath) AS n, coalesce(string_agg(DISTINCT session_kind, ',' ORDER BY session_kind), '') AS kinds FROM dvs_task_graph_sessions WHERE task_id IS NOT NULL GROUP BY 1")
simple("a26_merged_snapshots", lambda t: t("dvs_task_graph_nodes").select("task_id", "node_id").unionAll(t("dvs_task_graph_sessions").where("task_id is not null and node_id is not null").select("task_id", "node_id")).distinct().groupBy("task_id").agg(n_()), "SELECT task_id, count(*) AS n FROM (SELECT task_id, node_id FROM dvs_task_graph_nodes UNION SELECT task_id, node_id FROM dvs_task_graph_sessions WHERE task_id IS NOT NULL AND node_id IS NOT NULL) GROUP BY 1")
simple("a27_capacity", lambda t: t("worker_clocks").agg(F.countDistinct("worker_id").alias("workers"), F.count_if(F.col("zone_name").isNull()).alias("stale"), F.count("*").alias("slots")), "SELECT count(DISTINCT worker_id) AS workers, count(*) FILTER (WHERE zone_name IS NULL) AS stale, count(*) AS slots FROM worker_clocks")
simple("a28_catalog_counts", lambda t: t("dvs_task_graph_sessions").groupBy("session_role").agg(n_(), F.countDistinct("session_kind").alias("kinds")), "SELECT session_role, count(*) AS n, count(DISTINCT session_kind) AS kinds FROM dvs_task_graph_sessions GROUP BY 1")
simple("a29_paths_as_steps", lambda t: t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ">").alias("steps")), "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '>' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem GROUP BY 1")
simple("a30_findings_per_node", lambda t: t("dvs_task_graph_nodes").groupBy("task_id", "func_id").agg(F.sum(F.coalesce("findings_count", F.lit(0))).alias("n")), "SELECT task_id, func_id, CAST(sum(coalesce(findings_count,0)) AS BIGINT) AS n FROM dvs_task_graph_nodes GROUP BY 1, 2")
simple("a31_stage_groups", lambda t: t("dvs_task_graph_nodes").where("session_group_key is not null").groupBy("task_id", "session_group_key").agg(F.min("function_name_raw").alias("label"), F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("nodes")), "SELECT task_id, session_group_key, min(function_name_raw) AS label, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS nodes FROM dvs_task_graph_nodes WHERE session_group_key IS NOT NULL GROUP BY 1, 2")

# ---- rankings and orders
simple("r01_latest_node", lambda t: ranking.latest(t("dvs_task_graph_nodes").select("node_id", "status", "depth", F.unix_micros("loaded_at").alias("at")), ["node_id"], [F.col("at"), F.col("status"), F.col("depth")]), "SELECT node_id, status, depth, epoch_us(loaded_at) AS at FROM dvs_task_graph_nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC, status DESC NULLS LAST, depth DESC NULLS LAST) = 1")
simple("r02_adjacent_pairs", lambda t: ranking.adjacent(t("events"), "user_id", "event_id", ["ts", "event_id"]), "SELECT user_id, event_id AS from_item, nx AS to_item FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL")


@query("r03_running_context", "SELECT event_id, max(CASE WHEN event_type='view' THEN event_id END) OVER w AS last_view, count(*) FILTER (WHERE event_type='click') OVER w AS depth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(w).alias("last_view"), F.count_if(F.col("event_type") == "click").over(w).alias("depth"))


simple("r04_deepest_hit", lambda t: t("dvs_task_graph_nodes").groupBy("task_id").agg(F.min_by("node_id", F.struct(-F.coalesce("depth", F.lit(-1)), "node_id")).alias("node_id")), "SELECT task_id, arg_min(node_id, (-coalesce(depth,-1), node_id)) AS node_id FROM dvs_task_graph_nodes GROUP BY 1")
simple("r06_primary_session", lambda t: t("dvs_task_graph_sessions").where("node_id is not null").groupBy("node_id").agg(F.min("session_relpath").alias("session")), "SELECT node_id, min(session_relpath) AS session FROM dvs_task_graph_sessions WHERE node_id IS NOT NULL GROUP BY 1")
simple("r07_roots", lambda t: t("dvs_task_graph_edges").select("task_id", F.col("source_node_id").alias("node_id")).distinct().join(t("dvs_task_graph_edges").select(F.col("target_node_id").alias("node_id")).distinct(), "node_id", "left_anti").select("task_id", "node_id"), "SELECT DISTINCT task_id, source_node_id AS node_id FROM dvs_task_graph_edges WHERE source_node_id NOT IN (SELECT target_node_id FROM dvs_task_graph_edges WHERE target_node_id IS NOT NULL)")


@query("r08_last_reasons", "SELECT task_id, node_id, loaded_us, p FROM (SELECT task_id, node_id, epoch_us(loaded_at) AS loaded_us, row_number() OVER (PARTITION BY task_id ORDER BY loaded_at DESC, node_id) AS p FROM dvs_task_graph_nodes WHERE status IN ('failed','error','cancelled')) WHERE p <= 10")
def _(t):
    p = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("loaded_at"), "node_id"))
    return t("dvs_task_graph_nodes").where(F.col("status").isin("failed", "error", "cancelled")).select("task_id", "node_id", F.unix_micros("loaded_at").alias("loaded_us"), p.alias("p")).where("p <= 10")


simple("r09_first_last", lambda t: t("events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last")), "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
simple("l03_graph_order", lambda t: t("dvs_task_graph_nodes").select("task_id", "node_id", F.unix_micros("loaded_at").alias("at"), F.row_number().over(Window.partitionBy("task_id").orderBy("depth", "function_name_raw", "node_id", "loaded_at")).alias("p")), "SELECT task_id, node_id, epoch_us(loaded_at) AS at, row_number() OVER (PARTITION BY task_id ORDER BY depth NULLS FIRST, function_name_raw NULLS FIRST, node_id, loaded_at) AS p FROM dvs_task_graph_nodes")
simple("l04_fifo_batch", lambda t: t("orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
simple("l05_claim_order", lambda t: t("orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("next")), "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS next FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
simple("l06_session_order", lambda t: t("dvs_task_graph_sessions").where("task_id is not null").select("task_id", "session_relpath", "mtime", F.rank().over(Window.partitionBy("task_id").orderBy("session_role", F.desc("mtime"), "session_relpath")).alias("p")), "SELECT task_id, session_relpath, mtime, rank() OVER (PARTITION BY task_id ORDER BY session_role NULLS FIRST, mtime DESC NULLS LAST, session_relpath) AS p FROM dvs_task_graph_sessions WHERE task_id IS NOT NULL")
simple("l07_rounds_order", lambda t: t("lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey"))["l_partkey"].alias("first_part")), "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS first_part FROM lineitem GROUP BY 1")
