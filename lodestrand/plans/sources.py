"""Registered sources (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import scalar as X
from lodestrand.operators import lookup, merge, ranking
from lodestrand.plans.relational import QUERIES as _KNOWN
from lodestrand.plans.relational import SQL as _KNOWN_SQL
from lodestrand.plans.relational import query, simple
from lodestrand.sources import legacy, lines, paths

_before = set(_KNOWN)
_L = "WITH l AS (SELECT doc_id, i AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS ls FROM documents WHERE text IS NOT NULL))) "


def _docs(t):
    return lines.text_lines(t("documents").select("doc_id", "text"), "doc_id", "text")


simple("s07_timeline", lambda t: lines.timeline(_docs(t)).select("doc_id", "line_no", "at"), _L + "SELECT doc_id, CAST(line_no AS INT) AS line_no, '' AS at FROM l WHERE json_valid(line) AND starts_with(trim(line), '{')")
simple("s08_tail", lambda t: lines.tail(_docs(t), "doc_id", 3).select("doc_id", "line_no", "line"), _L + "SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) <= 3")
simple("s09_session_lines", lambda t: lines.session_lines(_docs(t)).groupBy("doc_id", "kind").agg(F.count("*").alias("n")), _L + "SELECT doc_id, CASE WHEN NOT json_valid(line) OR NOT starts_with(trim(line),'{') THEN 'raw' WHEN json_extract_string(line,'$.type') = 'session' THEN 'header' ELSE 'event' END AS kind, count(*) AS n FROM l GROUP BY 1, 2")


@query("s10_metric_samples", "SELECT 'events_seen' AS name, event_type AS type, 'a' || chr(92) || 'n' || chr(34) || 'b' AS path, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type")
def _(t):
    """Prometheus text made of events, read back."""
    made = t("events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.concat(F.lit('events_seen{type="first",path="a\\\\n\\"b",type="'), "event_type", F.lit('"} '), X.metric_value("n")).alias("line"))
    return lines.metric_samples(made).select("name", F.col("labels")["type"].alias("type"), F.col("labels")["path"].alias("path"), "value")


simple("s12_schema_drift_scan", lambda t: lines.unify([t("nation").select("n_name", "n_regionkey"), t("region").select(F.col("r_name").alias("n_name"))], {"n_regionkey": -1}), "SELECT n_name, n_regionkey FROM nation UNION ALL SELECT r_name, -1 FROM region")
simple("s15_grep", lambda t: _docs(t).where(F.contains("line", F.lit("memcpy"))).select("doc_id", "line_no", "line"), _L + "SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM l WHERE contains(line, 'memcpy')")
simple("s22_trajectory", lambda t: lines.trajectory(t("dvs_task_graph_nodes").where("task_id is not null").select("task_id", F.to_json(F.struct(F.col("function_name_raw").alias("function"), "depth")).alias("line")), "task_id"),
       "SELECT task_id, count(*) AS steps, count(DISTINCT function_name_raw) AS functions, max(depth) AS deepest FROM dvs_task_graph_nodes WHERE task_id IS NOT NULL GROUP BY 1")
simple("s26_body_slice", lambda t: lines.body_slice(_docs(t), "doc_id", F.lit(2), F.lit(4)), _L + "SELECT doc_id, string_agg(printf('%4d | %s', line_no, line), chr(10) ORDER BY line_no) AS body FROM l WHERE line_no BETWEEN 2 AND 4 GROUP BY 1")
simple("s28_best_file", lambda t: lines.best_file(t("documents").where("source is not null and text is not null").select("source", F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"), F.unix_micros("created_at").alias("mtime"), F.coalesce(F.contains(F.substring("text", 1, 500), F.lit("label")), F.lit(False)).alias("hit")), "source", "name", "size", "mtime", F.col("hit")),
       "SELECT source, arg_max(CAST(doc_id AS VARCHAR), (CASE WHEN contains(substr(text,1,500),'label') AND n_chars > 200 THEN 3 WHEN n_chars > 200 THEN 2 ELSE 1 END, coalesce(epoch_us(created_at), -9223372036854775807), CAST(doc_id AS VARCHAR))) AS name FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1")


# ---- lookups that share the layers of F06
_LAYERS = _KNOWN_SQL["f06_layered_name_lookup"]


def _resolved(t):
    return lookup.layered_lookup(t("dvs_task_graph_edges").select(F.col("target_function_raw").alias("probe")), "probe", t("dvs_functions"), "func_name", "name_tail", "func_id")


simple("f07_by_layer", lambda t: _resolved(t).groupBy("layer").agg(F.countDistinct("probe").alias("n")), f"SELECT layer, count(DISTINCT probe) AS n FROM ({_LAYERS}) GROUP BY 1")
simple("j06_callee_fan_out", lambda t: _resolved(t).groupBy("probe").agg(F.count("*").alias("n")), f"SELECT probe, count(*) AS n FROM ({_LAYERS}) GROUP BY 1")


@query("j19_callers_of_resolved", f"SELECT l.func_id, count(DISTINCT e.source_func_id) AS callers FROM ({_LAYERS}) l JOIN dvs_task_graph_edges e ON e.target_function_raw = l.probe GROUP BY 1")
def _(t):
    """Distinct callers of each function, over the names that resolve to it; callers per name are combined first."""
    callers = t("dvs_task_graph_edges").select(F.col("target_function_raw").alias("probe"), "source_func_id").distinct()
    return _resolved(t).join(callers, "probe").groupBy("func_id").agg(F.countDistinct("source_func_id").alias("callers"))


simple("l02_page_with_total", lambda t: ranking.page(t("dvs_functions").where("func_name is not null").select("func_name").distinct(), [F.asc("func_name")], 10, 10).withColumn("total", t("dvs_functions").agg(F.countDistinct("func_name").alias("total")).scalar()), "SELECT func_name, (SELECT count(DISTINCT func_name) FROM dvs_functions) AS total FROM (SELECT DISTINCT func_name FROM dvs_functions WHERE func_name IS NOT NULL ORDER BY 1 LIMIT 10 OFFSET 10)")
simple("w12_delete_events", lambda t: merge.cleared(t("events").select("event_id", "user_id"), t("events").where("event_type = 'error'").select("event_id"), "event_id"), "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")

simple("w12_append", lambda t: merge.appended(t("events").select("event_id", "user_id"), t("events").where("event_type = 'error'").select("event_id")), "SELECT event_id, user_id FROM events UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'")
simple("w12_clear", lambda t: merge.cleared(t("events").select("event_id", "user_id"), t("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("user_id")), "user_id"), "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")


@query("s13_run_precedence", "SELECT task_id, arg_max(run_root, (coalesce(TRY_CAST(nullif(regexp_extract(epoch, '\\d+'), '') AS INT), -1), epoch, run_root)) AS by_number, arg_max(run_root, (epoch, run_root)) AS by_name FROM dvs_task_graph_runs WHERE task_id IS NOT NULL AND run_root IS NOT NULL AND epoch IS NOT NULL GROUP BY 1")
def _(t):
    """The run that counts for each task: the latest by the number of its epoch, and by its name."""
    return paths.latest_runs(t("dvs_task_graph_runs").where("run_root is not null and epoch is not null"), "task_id", "epoch", "run_root")


@query("s11_legacy_table", "SELECT n_name, n_regionkey, CAST(NULL AS VARCHAR) AS note FROM nation")
def _(t):
    """Rows of a legacy database file (made of the nation table, 25 rows by definition), with a column the file lacks."""
    return legacy.demo(t("nation").select("n_name", "n_regionkey"), "nation", "n_name string, n_regionkey int, note string").drop("path")


@query("s14_legacy_events", "SELECT r_name AS event, 0 AS level FROM region")
def _(t):
    """Events of a legacy timeline file (made of the region table, 5 rows by definition); levels it lacks are 0."""
    return legacy.demo(t("region").select(F.col("r_name").alias("event")), "timeline", "event string, level int").drop("path").fillna(0, ["level"])


@query("s24_process_table", "SELECT CAST(n_nationkey AS BIGINT) AS pid, n_name || ' --region ' || n_regionkey AS command FROM nation")
def _(t):
    """Processes of a process table (made of the nation table, 25 rows by definition) with their command lines."""
    rows = t("nation").select("n_nationkey", "n_name", F.lit("--region").alias("flag"), "n_regionkey")
    return legacy.demo_processes(rows, "n_nationkey", ["n_name", "flag", "n_regionkey"]).select("pid", "command")


@query("s25_paged_cases", "SELECT CAST(100 - i AS BIGINT) AS id, CAST(2000 - i AS VARCHAR) AS updated_at FROM range(0, 30) x(i)")
def _(t):
    """Numbered pages of ten cases, newest first, read in one task until a page is older than the watermark."""
    page = lambda n: [{"id": 100 - k, "updated_at": str(2000 - k)} for k in range((n - 1) * 10, n * 10)]
    return legacy.read_pages(t("region").sparkSession, page, "1971", "id long, updated_at string")


# ---- not from the inventory: Spark's own windows, grouping sets and set operations on the event table
simple("extra_tumbling_windows", lambda t: t("events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("w"), "event_type", "n"), "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")
simple("extra_session_windows", lambda t: t("events").groupBy("user_id", F.session_window("ts", "1 day")).agg(F.count("*").alias("n")).select("user_id", "n"), "SELECT user_id, n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2)")
simple("extra_rollup", lambda t: t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
simple("extra_cube", lambda t: t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
simple("extra_set_operations", lambda t: t("orders").select(F.col("o_custkey").alias("k")).intersect(t("customer").select("c_custkey")).exceptAll(t("supplier").select("s_suppkey")), "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier")

QUERIES = {k: v for k, v in _KNOWN.items() if k not in _before}
SQL = {k: v for k, v in _KNOWN_SQL.items() if k in QUERIES}
