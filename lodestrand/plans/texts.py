"""Registered text functions (S17–S23, S27, X18, X22, X31, X32, G15, G21) over source texts and reports made of the
symbol index and the graphs, so that SQL can tell what must be found in them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestrand.functions import scalar as X
from lodestrand.functions import text
from lodestrand.functions.branches import branch_contexts
from lodestrand.operators import verify
from lodestrand.plans.relational import QUERIES as _KNOWN
from lodestrand.plans.relational import SQL as _KNOWN_SQL
from lodestrand.plans.relational import query, simple
from lodestrand.sources import lines

_before = set(_KNOWN)


def _sources(t):
    """(func_id, tail, source): a file of one function with includes, a comment, a branch and a nested call."""
    tail = F.coalesce("name_tail", F.lit("f"))
    source = F.concat(
        F.lit('#include "'), F.coalesce("file", F.lit("x.h")), F.lit('"\n  #  include <stdint.h>\n// a {comment}\n'), "signature", F.lit(" {\n    if (x) {\n        memcpy(dst, src, n);\n    }\n    "),
        tail, F.lit('_next(a,\n        "b, (c", g(1, 2));\n}\n'))
    return t("dvs_functions").where("signature is not null").select("func_id", tail.alias("tail"), "func_name", "signature", "file", source.alias("source"))


_SOURCES = (
    "(SELECT func_id, coalesce(name_tail, 'f') AS tail, func_name, signature, coalesce(file, 'x.h') AS file, '#include \"' || coalesce(file, 'x.h') || '\"' || chr(10) || '  #  include <stdint.h>' || chr(10) || '// a {comment}' || chr(10) "
    "|| signature || ' {' || chr(10) || '    if (x) {' || chr(10) || '        memcpy(dst, src, n);' || chr(10) || '    }' || chr(10) || '    ' || coalesce(name_tail, 'f') || '_next(a,' || chr(10) || '        \"b, (c\", g(1, 2));' || chr(10) || '}' || chr(10) AS source "
    "FROM dvs_functions WHERE signature IS NOT NULL) s"
)
simple("s17_functions_in_text", lambda t: text.apply(_sources(t), ["func_id"], "source", text.functions_in, "name string, signature string, first_line int, last_line int"),
       f"SELECT func_id, func_name AS name, signature, 4 AS first_line, 10 AS last_line FROM {_SOURCES}")
simple("s18_function_spans", lambda t: text.apply(_sources(t), ["func_id"], "source", lambda s: [(n, b - a + 1) for n, _, a, b in text.functions_in(s)], "name string, n_lines int"),
       f"SELECT func_id, func_name AS name, 7 AS n_lines FROM {_SOURCES}")
@query("s16_definition_grep", f"WITH d AS (SELECT DISTINCT func_id, func_name AS name FROM {_SOURCES}), c AS (SELECT DISTINCT raw, array_to_string(list_slice(p, k, len(p)), '::') AS name FROM (SELECT raw, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT target_function_raw AS raw, string_split(target_function_raw, '::') AS p FROM dvs_task_graph_edges WHERE trim(target_function_raw) <> ''))) SELECT raw, name, func_id FROM c JOIN d USING (name)")
def _(t):
    """Definitions of every name that a call gives, tried from the qualified name down to its tail, in the source texts."""
    found = text.apply(_sources(t), ["func_id"], "source", text.functions_in, "name string, signature string, first_line int, last_line int").select("func_id", "name").distinct()
    names = t("dvs_task_graph_edges").where("trim(target_function_raw) <> ''").select(F.col("target_function_raw").alias("raw")).distinct()
    return names.select("raw", F.explode(X.qualified_candidates("raw")).alias("name")).distinct().join(found, "name").select("raw", "name", "func_id")


simple("s19_includes", lambda t: lines.includes(lines.text_lines(_sources(t), "func_id", "source"), "func_id"), f"SELECT DISTINCT func_id, unnest([file, 'stdint.h']) AS header FROM {_SOURCES}")
simple("s21_calls_in_text", lambda t: text.apply(_sources(t), ["func_id"], "source", text.calls_in, "callee string, line_no int"),
       f"SELECT func_id, unnest(['memcpy', tail || '_next', 'g']) AS callee, unnest([6, 8, 9]) AS line_no FROM {_SOURCES}")
simple("g21_branch_contexts", lambda t: text.apply(_sources(t), ["func_id"], "source", branch_contexts, "callee string, line_no int, branch string"),
       f"SELECT func_id, unnest([list_extract(string_split(func_name, '::'), -1), 'memcpy', tail || '_next', 'g']) AS callee, unnest([4, 6, 8, 9]) AS line_no, unnest(['', '1/then', '', '']) AS branch FROM {_SOURCES}")
simple("x18_call_arguments", lambda t: text.apply(_sources(t).withColumn("asked", F.to_json(F.struct("source", "tail"))), ["func_id"], "asked", lambda s: [(k, a) for x in [json.loads(s)] for k, a in enumerate(text.call_arguments(x["source"], 8, x["tail"] + "_next") or ())], "pos int, arg string"),
       f"SELECT func_id, unnest([0, 1, 2]) AS pos, unnest(['a', '\"b, (c\"', 'g(1, 2)']) AS arg FROM {_SOURCES}")
simple("x18_split_arguments", lambda t: text.apply(t("dvs_functions"), ["func_id"], "signature", lambda s: [(len(text.split_arguments(s.partition("(")[2].rpartition(")")[0])),)], "n_args int"),
       "SELECT func_id, CAST(CASE WHEN trim(regexp_extract(signature, '^[^(]*\\((.*)\\)', 1)) = '' THEN 0 ELSE len(string_split(regexp_extract(signature, '^[^(]*\\((.*)\\)', 1), ',')) END AS INT) AS n_args FROM dvs_functions WHERE signature IS NOT NULL")


def _classes(t):
    return t("dvs_functions").where(F.contains("func_name", F.lit("::"))).withColumn("_p", F.split("func_name", "::")).select(
        "func_id", F.concat(F.lit("struct Plain { int x; };\nclass "), F.element_at("_p", -2), F.lit(" : public "), F.col("_p")[0], F.lit("_base, private virtual Other {\n};\n")).alias("source"))


simple("s20_classes_in_text", lambda t: text.apply(_classes(t), ["func_id"], "source", text.classes_in, "class_name string, base string"),
       "SELECT func_id, unnest(['Plain', list_extract(p, -2), list_extract(p, -2)]) AS class_name, unnest(['', p[1] || '_base', 'Other']) AS base FROM (SELECT func_id, string_split(func_name, '::') AS p FROM dvs_functions WHERE contains(func_name, '::'))")
simple("s23_tainted_list", lambda t: text.apply(t("dvs_functions").select("func_id", F.concat(F.lit("# made\n###\n"), "func_name", F.lit(" # note\n@taintvar "), F.coalesce("name_tail", F.lit("f")), F.lit(" rest\n###\nmemcpy\n@taintvar n\n")).alias("list")), ["func_id"], "list", text.tainted_list, "func string, var string"),
       "SELECT func_id, func_name AS func, coalesce(name_tail, 'f') AS var FROM dvs_functions WHERE func_name IS NOT NULL")
simple("s27_callee_tables", lambda t: text.apply(t("dvs_functions").select("func_id", F.concat(F.lit("intro\n## 函数调用\n| 函数名 | 参数 | 跟入 |\n|---|:--|---|\n| `"), "func_name", F.lit("` | a, b | 是 |\n| `other` | a | ❌ |\n| memcpy | n | 是 |\n| silent | 无 | 是 |\n## rest\n| 函数名 | 参数 |\n| late | z |\n")).alias("report")), ["func_id"], "report", text.callee_table, "callee string, params string, cells string"),
       "SELECT func_id, func_name AS callee, 'a, b' AS params, '{\"函数名\": \"' || func_name || '\", \"参数\": \"a, b\", \"跟入\": \"是\"}' AS cells FROM dvs_functions WHERE func_name IS NOT NULL")
simple("x22_extract_json", lambda t: text.apply(t("dag_edges").select("edge_id", "func_id", "task_id", F.concat(F.lit("Result {draft}:\n```json\n{\"kind\": \""), F.coalesce("kind", F.lit("")), F.lit("\", \"at\": ["), F.coalesce("line", F.lit(0)), F.lit(",],}\n```\n")).alias("reply")), ["edge_id", "func_id", "task_id"], "reply", lambda s: [text.extract_json(s, "kind")], "json string, actions string"),
       "SELECT edge_id, func_id, task_id, '{\"at\": [' || coalesce(line, 0) || '], \"kind\": \"' || coalesce(kind, '') || '\"}' AS json, 'fence,comma' AS actions FROM dag_edges")
simple("x32_callee_claims", lambda t: text.apply(_sources(t), ["func_id"], "source", text.callee_claims, "callee string, at int, around string"),
       f"SELECT func_id, callee, CAST(p AS INT) AS \"at\", substr(source, greatest(p - 80, 0) + 1, p + length(callee) + 81 - greatest(p - 80, 0)) AS around FROM (SELECT func_id, source, unnest([func_name, 'memcpy', tail || '_next', 'g']) AS callee, unnest([strpos(source, signature) + strpos(signature, func_name || '('), strpos(source, 'memcpy(dst') + 1, strpos(source, tail || '_next(a') + 1, strpos(source, 'g(1, 2)') + 1]) - 2 AS p FROM {_SOURCES})")


@query("x31_verified_claims", """
WITH f AS (SELECT edge_id AS claim_id, source_func_id AS caller, source_file AS file, call_line AS line, nullif(trim(target_function_raw), '') AS callee, task_id FROM dvs_task_graph_edges),
len AS (SELECT file, max(end_line) AS n FROM dvs_functions WHERE file IS NOT NULL GROUP BY 1),
own AS (SELECT DISTINCT func_id AS caller FROM dag_edges WHERE kind = 'callee' AND sink_ref IS NOT NULL AND func_id IS NOT NULL),
calls AS (SELECT DISTINCT func_id AS caller, sink_ref AS callee FROM dag_edges WHERE kind = 'callee' AND sink_ref IS NOT NULL AND func_id IS NOT NULL),
body AS (SELECT func_name AS callee, bool_or(coalesce(contains(lower(description), 'check') OR contains(lower(description), 'verify'), false)) AS checks FROM dvs_functions WHERE func_name IS NOT NULL GROUP BY 1),
audited AS (SELECT DISTINCT task_id FROM dvs_task_graph_sessions WHERE task_id IS NOT NULL AND display_name IS NOT NULL),
heard AS (SELECT DISTINCT task_id, display_name AS callee FROM dvs_task_graph_sessions WHERE task_id IS NOT NULL AND display_name IS NOT NULL),
c AS (SELECT f.claim_id,
  CASE WHEN len.n IS NULL OR f.line IS NULL THEN 'skipped' WHEN f.line > len.n THEN 'fail' ELSE 'pass' END AS v1,
  CASE WHEN f.callee IS NULL OR own.caller IS NULL THEN 'skipped' WHEN calls.callee IS NULL THEN 'fail' ELSE 'pass' END AS v2,
  CASE WHEN f.callee IS NULL OR NOT contains(lower(f.callee), 'check') OR body.callee IS NULL THEN 'skipped' WHEN body.checks THEN 'pass' ELSE 'fail' END AS v3,
  CASE WHEN f.callee IS NULL OR audited.task_id IS NULL THEN 'skipped' WHEN heard.callee IS NULL THEN 'fail' ELSE 'pass' END AS v5
  FROM f LEFT JOIN len ON len.file = f.file LEFT JOIN own ON own.caller = f.caller LEFT JOIN calls ON calls.caller = f.caller AND calls.callee = f.callee
  LEFT JOIN body ON body.callee = f.callee LEFT JOIN audited ON audited.task_id = f.task_id LEFT JOIN heard ON heard.task_id = f.task_id AND heard.callee = f.callee),
chain AS (SELECT e.edge_id AS claim_id, bool_or(own.caller IS NOT NULL) AS known, bool_and(own.caller IS NULL OR calls.callee IS NOT NULL) AS ok
  FROM dvs_task_graph_edges e JOIN dvs_task_graph_edges n ON n.task_id = e.task_id AND n.source_node_id = e.target_node_id AND trim(n.target_function_raw) <> ''
  LEFT JOIN own ON own.caller = n.source_func_id LEFT JOIN calls ON calls.caller = n.source_func_id AND calls.callee = trim(n.target_function_raw) GROUP BY 1)
SELECT DISTINCT c.claim_id, v1, v2, v3, CASE WHEN chain.claim_id IS NULL OR NOT known THEN 'skipped' WHEN ok THEN 'pass' ELSE 'fail' END AS v4, v5,
  NOT (v1 = 'fail' OR v2 = 'fail' OR v3 = 'fail' OR v5 = 'fail' OR (chain.claim_id IS NOT NULL AND known AND NOT ok)) AS passed
FROM c LEFT JOIN chain ON chain.claim_id = c.claim_id""")
def _(t):
    """Claims of the call edges (caller, line, callee) checked against the symbol index, the taint graphs and the sessions."""
    edges = t("dvs_task_graph_edges")
    claims = edges.select(F.col("edge_id").alias("claim_id"), F.col("source_func_id").alias("caller"), F.col("source_file").alias("file"), F.col("call_line").alias("line"), F.nullif(F.trim("target_function_raw"), F.lit("")).alias("callee"), "task_id",
                          F.when(F.contains(F.lower("target_function_raw"), F.lit("check")), "checks").alias("behaviour"))
    after = edges.select(F.col("task_id"), F.col("source_node_id").alias("node"), F.col("source_func_id").alias("caller"), F.nullif(F.trim("target_function_raw"), F.lit("")).alias("callee")).where("callee is not null").distinct()
    hops = edges.select(F.col("edge_id").alias("claim_id"), "task_id", F.col("target_node_id").alias("node")).distinct().join(after, ["task_id", "node"]).select("claim_id", "caller", "callee")
    calls = t("dag_edges").where("kind = 'callee'").select(F.col("func_id").alias("caller"), F.col("sink_ref").alias("callee"))
    told = F.coalesce(F.contains(F.lower("description"), F.lit("check")) | F.contains(F.lower("description"), F.lit("verify")), F.lit(False))
    bodies = t("dvs_functions").select(F.col("func_name").alias("callee"), F.lit("checks").alias("behaviour"), told.alias("shown"))
    reads = t("dvs_task_graph_sessions").select("task_id", F.col("display_name").alias("callee"))
    return verify.verdicts(claims, t("dvs_functions").select("file", F.col("end_line").alias("line")), calls, bodies, hops, reads).distinct()


# ---- paths through call sites
@query("g15_forked_paths")
def _(t):
    """Paths through the ordered call sites of each function's graph: a from_node with several callees is a branch."""
    steps = t("dag_edges").where("kind = 'callee' and sink_ref is not null and from_node is not null").select(
        "func_id", "task_id", "taint_signature", F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.col("from_node").cast("string").alias("group"), F.col("to_node").cast("string").alias("arm"), F.array("sink_ref").alias("targets")).alias("s"))
    packed = steps.groupBy("func_id", "taint_signature", "task_id").agg(F.to_json(F.array_sort(F.collect_set("s"))).alias("steps"))
    return text.apply(packed, ["func_id", "taint_signature", "task_id"], "steps", _fork, "path_no int, path string")


def _fork(steps: str):
    return ((k, ">".join(p)) for k, p in enumerate(text.forked_paths(json.loads(steps))))


@query("g15_branching_steps", """
WITH s AS (SELECT DISTINCT func_id, taint_signature, task_id, from_node, to_node, sink_ref, coalesce(line, 0) AS line FROM dag_edges WHERE kind = 'callee' AND sink_ref IS NOT NULL AND from_node IS NOT NULL),
g AS (SELECT func_id, taint_signature, task_id, from_node, count(DISTINCT coalesce(CAST(to_node AS VARCHAR), '')) AS arms, count(*) AS steps FROM s GROUP BY 1, 2, 3, 4)
SELECT func_id, taint_signature, task_id, round(exp(sum(ln(CASE WHEN arms > 1 THEN arms ELSE 1 END)))) AS paths FROM g GROUP BY 1, 2, 3""")
def _(t):
    """How many paths fork from each function's graph: the product of the arms of its branches."""
    steps = t("dag_edges").where("kind = 'callee' and sink_ref is not null and from_node is not null").select("func_id", "taint_signature", "task_id", "from_node", F.coalesce(F.col("to_node").cast("string"), F.lit("")).alias("arm")).distinct()
    arms = steps.groupBy("func_id", "taint_signature", "task_id", "from_node").agg(F.count("*").alias("arms"))
    return arms.groupBy("func_id", "taint_signature", "task_id").agg(F.round(F.exp(F.sum(F.ln("arms")))).alias("paths"))


QUERIES = {k: v for k, v in _KNOWN.items() if k not in _before}
SQL = {k: v for k, v in _KNOWN_SQL.items() if k in QUERIES}
