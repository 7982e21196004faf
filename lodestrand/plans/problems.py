"""Queries of the data problems in the core: p1, p2, p4, p5, p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.keys import func_key, plain_key, taint_key, task_key
from lodestrand.operators import drift, hierarchy, intervals, references, timestamps
from lodestrand.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of all values that are not written canonically."""
    at = lambda name: table(spark, sf_dir, name)
    return timestamps.found(
        [
            ("dvs_task_graph_nodes", at("dvs_task_graph_nodes"), "node_id", "started_at"),
            ("dvs_task_graph_sessions", at("dvs_task_graph_sessions"), "session_relpath", "ended_at"),
            ("dvs_task_graph_runs", at("dvs_task_graph_runs"), "task_id", "generated_at"),
        ],
        at("worker_clocks"),
    )


def session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, start_micros, end_micros) of every session with a task, UTC; NULL where a time is open."""
    sessions = table(spark, sf_dir, "dvs_task_graph_sessions").select("task_id", "started_at", "ended_at")
    sessions = sessions.where("task_id is not null and started_at is not null and ended_at is not null")
    return timestamps.normalise(
        sessions, {"started_at": "start_micros", "ended_at": "end_micros"}, "task_id", table(spark, sf_dir, "worker_clocks")
    ).select(task_key("task_id").alias("task_id"), "start_micros", "end_micros")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of work of each task and the gaps between them."""
    return intervals.periods_and_gaps(session_spans(spark, sf_dir), "task_id", "start_micros", "end_micros")


def _graph_references(spark: SparkSession, sf_dir: str) -> list[references.Reference]:
    at = lambda name: table(spark, sf_dir, name)
    deleted = at("deleted_records")
    gone = lambda name: deleted.where(plain_key("table_name") == name)
    functions = references.live_keys(at("dvs_functions"), func_key("func_id"), gone("dvs_functions"), func_key("record_key"))
    nodes = references.live_keys(
        at("dvs_task_graph_nodes"), plain_key("node_id"), gone("dvs_task_graph_nodes"), plain_key("record_key")
    )
    dag = F.concat_ws("|", func_key("func_id"), taint_key("taint_signature"), task_key("task_id"), F.lit(""))
    dag_nodes = references.live_keys(at("dag_nodes").where("node_id is not null"), F.concat(dag, F.col("node_id")))
    edges, sessions, dag_edges = at("dvs_task_graph_edges"), at("dvs_task_graph_sessions"), at("dag_edges")
    stored = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("func_id", "taint_signature", "task_id", "edge_id")])
    refs = [
        references.Reference(
            "dvs_task_graph_edges", "target_func_id", edges, func_key("target_func_id"), F.col("edge_id"), plain_key("target_func_id"), functions
        ),
        references.Reference(
            "dvs_task_graph_sessions", "node_id", sessions, plain_key("node_id"), F.col("session_relpath"), plain_key("node_id"), nodes
        ),
    ]
    for end in ("from_node", "to_node"):
        refs.append(references.Reference(
            "dag_edges", end, dag_edges, F.concat(dag, F.col(end)), stored, F.col(end).cast("string"), dag_nodes
        ))
    return refs


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of edges, sessions and DAG edges to a record that does not exist."""
    return references.found(_graph_references(spark, sf_dir))


def p4_orphans_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field and month of loaded_at."""
    return references.counted(_graph_references(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of fields between neighbouring versions of the golden files."""
    return drift.changes(table(spark, sf_dir, "expected_dag"))


def call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, child, parent): visible call links of each task."""
    edges = table(spark, sf_dir, "dvs_task_graph_edges").where("visible_in_tree = 1")
    node = lambda c: F.regexp_replace(plain_key(c), "^0x", "")
    return edges.select(
        task_key("task_id").alias("scope"), node("target_node_id").alias("child"), node("source_node_id").alias("parent")
    ).where("child is not null and parent is not null")


def dag_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, child, parent): parents that any record of a DAG node names; nodes without any have a NULL parent."""
    rows = table(spark, sf_dir, "dag_nodes").where("node_id is not null")
    scope = F.concat(func_key("func_id"), F.lit("|"), taint_key("taint_signature"), F.lit("|"), task_key("task_id"))
    parents = F.regexp_extract_all(F.coalesce("parents_json", F.lit("")), F.lit("-?\\d+"), F.lit(0))
    # NULL stands for the node itself, so that a record without parents still names its node
    named = F.explode(F.concat(F.array(F.lit(None).cast("string")), parents))
    return rows.select(scope.alias("scope"), F.col("node_id").cast("string").alias("child"), named.alias("parent")).withColumn(
        "parent", F.regexp_replace("parent", "^(-?)0+(?=\\d)", "$1")
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_links(spark, sf_dir).select(F.concat(F.lit("e"), "scope").alias("scope"), "child", "parent").unionAll(
        dag_links(spark, sf_dir).select(F.concat(F.lit("d"), "scope").alias("scope"), "child", "parent")
    )


def _by_table(solved: DataFrame) -> DataFrame:
    first = F.substring("scope_key", 1, 1)
    return solved.select(
        F.when(first == "e", "dvs_task_graph_edges").otherwise("dag_nodes").alias("src_table"),
        F.expr("substring(scope_key, 2)").alias("scope_key"), *[c for c in solved.columns if c != "scope_key"],
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth below every root of all nodes of call links and DAG parent lists, and the nodes on cycles."""
    return _by_table(hierarchy.solve(_links(spark, sf_dir)))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path from every root to each node it reaches, root first, as text."""
    return _by_table(hierarchy.paths(_links(spark, sf_dir))).withColumn("path", F.array_join("path", ">"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descendant of each node, with the fewest links to it."""
    return _by_table(hierarchy.descendants(_links(spark, sf_dir)))


def p5_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent table of all facts of the golden files."""
    return drift.facts(table(spark, sf_dir, "expected_dag"))


def p5_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of fields inside objects below the four levels; obj_level is the path of the object."""
    return drift.nested_changes(table(spark, sf_dir, "expected_dag"))


_P4_SQL = r"""
WITH gone AS (
    SELECT lower(trim(table_name)) AS tab, lower(trim(record_key)) AS k, max(deleted_at) AS deleted_at FROM deleted_records GROUP BY 1, 2),
f AS (
    SELECT k FROM (SELECT regexp_replace(lower(trim(func_id)), '^0x', '') AS k, max(loaded_at) AS loaded FROM dvs_functions GROUP BY 1) a
    WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.tab = 'dvs_functions' AND regexp_replace(g.k, '^0x', '') = a.k AND g.deleted_at > a.loaded)),
n AS (
    SELECT k FROM (SELECT lower(trim(node_id)) AS k, max(loaded_at) AS loaded FROM dvs_task_graph_nodes GROUP BY 1) a
    WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.tab = 'dvs_task_graph_nodes' AND g.k = a.k AND g.deleted_at > a.loaded)),
d AS (
    SELECT DISTINCT regexp_replace(lower(trim(func_id)), '^0x', '') AS fk,
        regexp_replace(regexp_replace(regexp_replace(taint_signature, '\s+', '', 'g'), '^(this|self)(->|\.)', ''), '[()]+$', '') AS sk,
        replace(lower(trim(task_id)), '_', '-') AS tk, node_id FROM dag_nodes),
e AS (
    SELECT *, regexp_replace(lower(trim(func_id)), '^0x', '') AS fk,
        regexp_replace(regexp_replace(regexp_replace(taint_signature, '\s+', '', 'g'), '^(this|self)(->|\.)', ''), '[()]+$', '') AS sk,
        replace(lower(trim(task_id)), '_', '-') AS tk FROM dag_edges),
r AS (
    SELECT 'dvs_task_graph_edges' AS ref_table, 'target_func_id' AS ref_field, edge_id AS ref_key, lower(trim(target_func_id)) AS missing_key, loaded_at, regexp_replace(lower(trim(target_func_id)), '^0x', '') AS cmp
    FROM dvs_task_graph_edges WHERE trim(target_func_id) <> '' AND regexp_replace(lower(trim(target_func_id)), '^0x', '') NOT IN (SELECT k FROM f)
    UNION ALL
    SELECT 'dvs_task_graph_sessions', 'node_id', session_relpath, lower(trim(node_id)), loaded_at, lower(trim(node_id))
    FROM dvs_task_graph_sessions WHERE trim(node_id) <> '' AND lower(trim(node_id)) NOT IN (SELECT k FROM n)
    UNION ALL
    SELECT 'dag_edges', 'from_node', concat_ws('|', func_id, taint_signature, task_id, edge_id), CAST(from_node AS VARCHAR), loaded_at, concat_ws('|', fk, sk, tk, from_node)
    FROM e WHERE from_node IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM d WHERE d.fk = e.fk AND d.sk = e.sk AND d.tk = e.tk AND d.node_id = e.from_node)
    UNION ALL
    SELECT 'dag_edges', 'to_node', concat_ws('|', func_id, taint_signature, task_id, edge_id), CAST(to_node AS VARCHAR), loaded_at, concat_ws('|', fk, sk, tk, to_node)
    FROM e WHERE to_node IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM d WHERE d.fk = e.fk AND d.sk = e.sk AND d.tk = e.tk AND d.node_id = e.to_node))
"""

_P6_SQL = r"""
WITH RECURSIVE raw AS (
    SELECT 'dvs_task_graph_edges' AS src_table, nullif(replace(lower(trim(task_id)), '_', '-'), '') AS scope, nullif(regexp_replace(lower(trim(target_node_id)), '^0x', ''), '') AS child,
        nullif(regexp_replace(lower(trim(source_node_id)), '^0x', ''), '') AS parent
    FROM dvs_task_graph_edges WHERE visible_in_tree = 1 AND nullif(regexp_replace(lower(trim(target_node_id)), '^0x', ''), '') IS NOT NULL AND nullif(regexp_replace(lower(trim(source_node_id)), '^0x', ''), '') IS NOT NULL
    UNION
    SELECT 'dag_nodes', nullif(regexp_replace(lower(trim(func_id)), '^0x', ''), '') || '|'
        || nullif(regexp_replace(regexp_replace(regexp_replace(taint_signature, '\s+', '', 'g'), '^(this|self)(->|\.)', ''), '[()]+$', ''), '') || '|' || nullif(replace(lower(trim(task_id)), '_', '-'), ''),
        CAST(node_id AS VARCHAR), CASE WHEN p IS NOT NULL THEN regexp_replace(p, '^(-?)0+(\d)', '\1\2') END
    FROM (SELECT *, unnest(list_prepend(NULL, regexp_extract_all(coalesce(parents_json, ''), '-?\d+'))) AS p FROM dag_nodes WHERE node_id IS NOT NULL)),
l AS (SELECT DISTINCT src_table, scope, child, parent FROM raw WHERE scope IS NOT NULL AND parent IS NOT NULL),
n AS (SELECT src_table, scope, child AS node FROM raw WHERE scope IS NOT NULL UNION SELECT src_table, scope, parent FROM l),
r AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src_table = n.src_table AND l.scope = n.scope AND l.child = n.node)),
d(src_table, scope, node, root, depth) USING KEY (src_table, scope, node, root) AS (
    SELECT src_table, scope, node, node, 0 FROM r
    UNION
    SELECT l.src_table, l.scope, l.child, d.root, min(d.depth + 1) FROM d JOIN l ON l.src_table = d.src_table AND l.scope = d.scope AND l.parent = d.node
    LEFT JOIN recurring.d AS k ON k.src_table = l.src_table AND k.scope = l.scope AND k.node = l.child AND k.root = d.root
    WHERE k.depth IS NULL OR k.depth > d.depth + 1 GROUP BY 1, 2, 3, 4),
b(src_table, scope, node, below, depth) USING KEY (src_table, scope, node, below) AS (
    SELECT DISTINCT src_table, scope, parent, child, 1 FROM l
    UNION
    SELECT b.src_table, b.scope, b.node, l.child, min(b.depth + 1) FROM b JOIN l ON l.src_table = b.src_table AND l.scope = b.scope AND l.parent = b.below
    LEFT JOIN recurring.b AS k ON k.src_table = b.src_table AND k.scope = b.scope AND k.node = b.node AND k.below = l.child
    WHERE k.depth IS NULL OR k.depth > b.depth + 1 GROUP BY 1, 2, 3, 4)
"""

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_orphans_per_month": p4_orphans_per_month,
    "p5_found": p5_found,
    "p5_facts": p5_facts,
    "p5_nested": p5_nested,
    "p6_found": p6_found,
    "p6_paths": p6_paths,
    "p6_descendants": p6_descendants,
}
SQL = {
    "p6_found": _P6_SQL
    + "SELECT src_table, scope AS scope_key, node AS node_key, root AS root_key, CAST(depth AS BIGINT) AS link_depth FROM d UNION ALL SELECT src_table, scope, node, '', -1 FROM b WHERE node = below",
    "p6_paths": _P6_SQL
    + """, a AS (SELECT d.src_table, d.scope, d.node, d.root, d.depth, min(u.node) AS up FROM d JOIN l ON l.src_table = d.src_table AND l.scope = d.scope AND l.child = d.node
    JOIN d u ON u.src_table = d.src_table AND u.scope = d.scope AND u.root = d.root AND u.node = l.parent AND u.depth = d.depth - 1 GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT src_table, scope, node, root, depth, node AS path FROM d WHERE depth = 0
    UNION ALL SELECT a.src_table, a.scope, a.node, a.root, a.depth, p.path || '>' || a.node FROM p JOIN a ON a.src_table = p.src_table AND a.scope = p.scope AND a.root = p.root AND a.up = p.node)
SELECT src_table, scope AS scope_key, node AS node_key, root AS root_key, CAST(depth AS BIGINT) AS link_depth, path FROM p""",
    "p6_descendants": _P6_SQL + "SELECT src_table, scope AS scope_key, node AS node_key, below AS descendant_key, CAST(depth AS BIGINT) AS link_depth FROM b",
    "p4_found": _P4_SQL + "SELECT DISTINCT ref_table, ref_field, ref_key, missing_key FROM r",
    "p4_orphans_per_month": _P4_SQL
    + "SELECT ref_table, ref_field, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS loaded_month, count(*) AS orphan_refs, count(DISTINCT cmp) AS orphan_keys FROM r GROUP BY 1, 2, 3",
}
