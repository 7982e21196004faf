"""Registered scalar functions (X), each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import scalar as X
from lodestrand.functions import text
from lodestrand.session import table

VALIDATIONS = "array<struct<line:int,kind:string,target:string,summary:string>>"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _project(name: str, source: str, columns: dict[str, str | Column | Callable[[], Column]], sql: str | None) -> None:
    """Register a projection of ``source``; ``sql`` is the select list of its SQL twin."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = {k: v() if callable(v) else F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
        return table(spark, sf_dir, source).select(*[c.alias(k) for k, c in made.items()])

    run.__doc__ = f"{name} over {source}."
    QUERIES[name] = run
    if sql:
        SQL[name] = f"SELECT {sql} FROM {source}"


def _contains_any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_project("x01_short_id", "dvs_functions", {"func_id": "func_id", "loaded_at": lambda: F.unix_micros("loaded_at"), "made_id": lambda: X.short_id("file", "func_name", X.signature_key("signature"))},
         "func_id, epoch_us(loaded_at) AS loaded_at, substr(sha1(concat_ws(chr(31), coalesce(file,''), coalesce(func_name,''), coalesce(lower(regexp_replace(signature,'\\s+','','g')),''))),1,16) AS made_id")
_project("x02_signature_key", "dvs_functions", {"func_id": "func_id", "sig": lambda: X.signature_key("signature")}, "func_id, lower(regexp_replace(signature,'\\s+','','g')) AS sig")
_project("x03_taint_signature", "dag_nodes", {"rec_id": "rec_id", "sig": lambda: F.regexp_replace(F.regexp_replace("taint_signature", "^(?:this|self)(?:->|\\.)", ""), "[()]+$", "")},
         "rec_id, regexp_replace(regexp_replace(taint_signature,'^(this|self)(->|\\.)',''),'[()]+$','') AS sig")
_project("x04_validation_signature", "dvs_task_graph_edges", {"edge_id": "edge_id", "sig": lambda: X.validation_signature(F.from_json("validations_json", VALIDATIONS))},
         "edge_id, CASE WHEN validations_json IS NULL OR NOT json_valid(validations_json) OR validations_json = '' THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(list_transform(from_json(validations_json, '[{\"kind\":\"VARCHAR\",\"target\":\"VARCHAR\",\"summary\":\"VARCHAR\"}]'), lambda v: concat_ws(':', lower(trim(v.kind)), trim(v.target), lower(regexp_replace(v.summary,'\\s+','','g')))))), '|'), '') END AS sig")
_project("x05_line_number", "dvs_functions", {"func_id": "func_id", "line": lambda: X.line_number(F.concat(F.lit("L"), "start_line", F.lit("-"), "end_line"))}, "func_id, start_line AS line")
_project("x06_finding_id", "dvs_functions", {"func_id": "func_id", "finding_id": lambda: X.finding_id("func_name", F.lit("overflow"), "start_line"), "bucket": lambda: X.line_bucket("start_line")},
         "func_id, 'vuln_' || substr(sha1(concat_ws('|', coalesce(func_name,''), 'overflow', coalesce(CAST(start_line // 10 * 10 AS VARCHAR),''))),1,16) AS finding_id, CAST(start_line // 10 * 10 AS INT) AS bucket")
_project("x07_severity", "orders", {"o_orderkey": "o_orderkey", "severity": lambda: X.severity(F.regexp_extract("o_orderpriority", "\\d-(.*)", 1)), "label": lambda: X.severity_label(F.regexp_extract("o_orderpriority", "\\d-(.*)", 1))},
         "o_orderkey, CASE lower(trim(regexp_extract(o_orderpriority,'\\d-(.*)',1))) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' ELSE 'medium' END AS severity, "
         "coalesce(CASE lower(trim(regexp_extract(o_orderpriority,'\\d-(.*)',1))) WHEN 'critical' THEN '致命' WHEN 'high' THEN '严重' WHEN 'medium' THEN '一般' WHEN 'low' THEN '提示' WHEN 'info' THEN '提示' WHEN 'unknown' THEN '未知' END, nullif(lower(trim(regexp_extract(o_orderpriority,'\\d-(.*)',1))),''), '未知') AS label")
_project("x07_confidence_percent", "lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "pct": lambda: X.confidence_percent(F.col("l_discount").cast("string")), "pct_big": lambda: X.confidence_percent(F.col("l_quantity").cast("string"))},
         "l_orderkey, l_linenumber, CAST(greatest(0, least(100, round_even(CASE WHEN l_discount <= 1 THEN l_discount * 100 ELSE l_discount END, 0))) AS INT) AS pct, CAST(greatest(0, least(100, round_even(CASE WHEN l_quantity <= 1 THEN l_quantity * 100 ELSE l_quantity END, 0))) AS INT) AS pct_big")
_project("x08_report_id", "dvs_task_graph_nodes", {"node_id": "node_id", "loaded_at": lambda: F.unix_micros("loaded_at"), "report_id": lambda: X.report_id("task_id", "task_id", "node_id", "source_file", "function_name_raw")},
         "node_id, epoch_us(loaded_at) AS loaded_at, 'DVS-' || right(task_id, 8) || '-' || upper(substr(sha1(concat_ws('|', coalesce(task_id,''), coalesce(node_id,''), coalesce(source_file,''), coalesce(function_name_raw,''))),1,10)) AS report_id")
_project("x09_route_template", "events", {"event_id": "event_id", "route": lambda: X.route_template(F.concat(F.lit("/tasks/"), "user_id", F.lit("/"), "event_type")), "cls": lambda: X.status_class((F.col("event_id") % 6) * 100)},
         "event_id, '/tasks/{id}/' || event_type AS route, CASE WHEN event_id % 6 = 0 THEN '5xx' ELSE CAST(event_id % 6 AS VARCHAR) || 'xx' END AS cls")
_project("x10_metric_family", "part", {"p_partkey": "p_partkey", "fam": lambda: X.metric_family(F.concat(F.lit("m_"), F.regexp_replace("p_name", " ", "_"), F.element_at(F.array(*[F.lit(x) for x in ("_bucket", "_sum", "_count", "_total", "_x")]), (F.col("p_partkey") % 5 + 1).cast("int"))))},
         "p_partkey, 'm_' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 5 = 4 THEN '_x' ELSE '' END AS fam")
_project("x11_failure_class", "documents", {"doc_id": "doc_id", "cls": lambda: X.failure_class("source", "text")},
         "doc_id, CASE " + " ".join(f"WHEN {_contains_any('lower(concat_ws(chr(32), coalesce(source,chr(0)), coalesce(text,chr(0))))', w)} THEN '{n}'" for n, w in X.FAILURE_WORDS) + " ELSE 'none' END AS cls")
_project("x13_abnormal_code", "dvs_task_graph_nodes", {"node_id": "node_id", "loaded_at": lambda: F.unix_micros("loaded_at"), "code": lambda: X.abnormal_code("status", "analysis_status")},
         "node_id, epoch_us(loaded_at) AS loaded_at, CASE WHEN status IN ('failed','error','cancelled') THEN CASE WHEN status='cancelled' THEN 'user_cancelled' WHEN contains(lower(coalesce(analysis_status,'')),'lease') THEN 'lease_lost' WHEN contains(lower(coalesce(analysis_status,'')),'dispatch') THEN 'dispatch_failed' WHEN contains(lower(coalesce(analysis_status,'')),'timeout') OR contains(lower(coalesce(analysis_status,'')),'dependency') THEN 'dependency_unavailable' WHEN status='error' THEN 'unknown_abnormal' ELSE 'orchestration_failed' END END AS code")
_FACTS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {_contains_any('t', w)}" + (" OR regexp_matches(t, '(<=|<|>=|>)\\s*-?[0-9]+')" if k == "range" else "") + f" THEN '{k}' END" for k, w in X.FACT_WORDS.items()
) + "], lambda x: x IS NOT NULL)"
_project("x15_fact_kinds", "dvs_task_graph_edges", {"edge_id": "edge_id", "kinds": lambda: F.array_join(X.fact_kinds(F.coalesce("validations_json", F.lit(""))), ","), "risk": lambda: X.risk_rank(X.fact_kinds(F.coalesce("validations_json", F.lit(""))))},
         "edge_id, array_to_string(k, ',') AS kinds, CASE WHEN list_contains(k,'unknown') THEN 80 WHEN k = ['sanitizer'] THEN 10 WHEN list_has_any(k, ['range','bounds','enum','auth','null_check']) THEN 40 ELSE 60 END AS risk")
SQL["x15_fact_kinds"] = SQL["x15_fact_kinds"].replace("FROM dvs_task_graph_edges", f"FROM (SELECT edge_id, CASE WHEN len(f) > 0 THEN f ELSE ['unknown'] END AS k FROM (SELECT edge_id, {_FACTS_SQL} AS f FROM (SELECT edge_id, lower(coalesce(validations_json,'')) AS t FROM dvs_task_graph_edges)))")


_project("x19_positional_signature", "dvs_task_graph_edges", {"edge_id": "edge_id", "sig": lambda: X.positional_signature(F.array(F.coalesce("source_taint_name", F.lit("arg7"))), F.coalesce(F.from_json("actual_args_json", "array<string>"), F.array().cast("array<string>")))},
         "edge_id, CASE WHEN regexp_extract(lower(coalesce(source_taint_name,'arg7')), '(arg|param|参数|第)\\s*([0-9]+)', 2) <> '' THEN 'arg' || CAST(CAST(regexp_extract(lower(coalesce(source_taint_name,'arg7')), '(arg|param|参数|第)\\s*([0-9]+)', 2) AS INT) AS VARCHAR) WHEN list_position(list_transform(a, lambda x: trim(regexp_replace(trim(x),'^&+',''))), trim(source_taint_name)) > 0 THEN 'arg' || list_position(list_transform(a, lambda x: trim(regexp_replace(trim(x),'^&+',''))), trim(source_taint_name)) ELSE trim(coalesce(source_taint_name,'arg7')) END AS sig")
SQL["x19_positional_signature"] = SQL["x19_positional_signature"].replace("FROM dvs_task_graph_edges", "FROM (SELECT edge_id, source_taint_name, CASE WHEN actual_args_json IS NULL OR NOT json_valid(actual_args_json) THEN CAST([] AS VARCHAR[]) ELSE CAST(from_json(actual_args_json, '[\"VARCHAR\"]') AS VARCHAR[]) END AS a FROM dvs_task_graph_edges)")
_project("x20_formal_parameters", "dvs_functions", {"func_id": "func_id", "names": lambda: F.array_join(X.formal_parameters("signature"), ","), "typed": lambda: F.array_join(X.formal_parameters_typed("signature"), ","), "n": lambda: X.formal_parameter_count("signature")},
         "func_id, array_to_string(list_filter(list_transform(string_split(i, ','), lambda p: regexp_extract(p, '([A-Za-z_]\\w*)\\s*(\\[[^\\]]*\\])?\\s*$', 1)), lambda x: x NOT IN ('','void')), ',') AS names, array_to_string(list_filter(list_transform(string_split(i, ','), lambda p: regexp_extract(p, '[\\w>*&]\\s*[\\s*&]([A-Za-z_]\\w*)\\s*(\\[[^\\]]*\\])?\\s*$', 1)), lambda x: x <> ''), ',') AS typed, CASE WHEN trim(i) IN ('','void') THEN 0 ELSE len(string_split(trim(i), ',')) END AS n")
SQL["x20_formal_parameters"] = SQL["x20_formal_parameters"].replace("FROM dvs_functions", "FROM (SELECT func_id, regexp_extract(signature, '\\((.*)\\)', 1) AS i FROM dvs_functions)")
_project("x21_qualified_candidates", "dvs_functions", {"func_id": "func_id", "names": lambda: F.array_join(X.qualified_candidates("func_name"), "|"), "tail": lambda: X.name_tail("func_name")},
         "func_id, array_to_string(list_transform(range(1, len(string_split(func_name,'::'))+1), lambda k: array_to_string(list_slice(string_split(func_name,'::'), k, len(string_split(func_name,'::'))), '::')), '|') AS names, list_extract(string_split(func_name,'::'), -1) AS tail")
_project("x24_session_descriptor", "dvs_task_graph_sessions", {"session_relpath": "session_relpath", "loaded_at": lambda: F.unix_micros("loaded_at"), "role": lambda: X.session_descriptor("session_relpath")["role"], "flow": lambda: X.session_descriptor("session_relpath")["flow"]},
         "session_relpath, epoch_us(loaded_at) AS loaded_at, CASE WHEN contains(session_relpath,'/judges/') THEN 'judge' ELSE 'worker' END AS role, CASE WHEN contains(session_relpath,'/judges/') THEN 'parallel' ELSE 'worker' END AS flow")
_project("x25_session_status", "dvs_task_graph_sessions", {"session_relpath": "session_relpath", "loaded_at": lambda: F.unix_micros("loaded_at"), "st": lambda: X.session_status("status", F.coalesce(F.col("event_count") > 90, F.lit(False)))},
         "session_relpath, epoch_us(loaded_at) AS loaded_at, CASE WHEN coalesce(event_count > 90, false) THEN 'running' WHEN lower(trim(coalesce(status,''))) IN ('failed','error','cancelled','invalid_input','completed_limited') THEN 'blocked' ELSE 'completed' END AS st")
_project("x26_units", "part", {"p_partkey": "p_partkey", "cpu": lambda: X.cpu_millicores(F.concat("p_size", F.lit("m"))), "mem": lambda: X.memory_bytes(F.concat("p_size", F.when(F.col("p_partkey") % 2 == 0, "Mi").otherwise("G")))},
         "p_partkey, CAST(p_size AS BIGINT) AS cpu, CAST(p_size AS BIGINT) * CASE WHEN p_partkey % 2 = 0 THEN 1048576 ELSE 1000000000 END AS mem")
_project("x27_safe_name", "dvs_functions", {"func_id": "func_id", "safe": lambda: X.safe_name("signature")}, "func_id, regexp_replace(signature, '[^A-Za-z0-9._-]+', '_', 'g') AS safe")
_project("x28_seconds_between", "deleted_records", {"record_key": "record_key", "secs": lambda: X.seconds_between(F.to_timestamp(F.lit("2024-06-01")), "deleted_at")},
         "record_key, coalesce(greatest(0.0, (epoch_us(deleted_at) - epoch_us(TIMESTAMPTZ '2024-06-01 00:00:00+00')) / 1000000.0), 0.0) AS secs")
_project("x29_epoch_iso", "dvs_task_graph_sessions", {"session_relpath": "session_relpath", "loaded_at": lambda: F.unix_micros("loaded_at"), "iso": lambda: X.epoch_iso("mtime")},
         "session_relpath, epoch_us(loaded_at) AS loaded_at, strftime(make_timestamp(CAST(floor(mtime) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso")
_project("x34_event_envelope", "events", {"event_id": "event_id", "level": lambda: X.first_of([(F.col("event_type") == "error", "error"), (F.col("event_type") == "signup", "warn")], "info"), "k": lambda: F.get_json_object("props", "$.k").cast("long"), "at": lambda: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")},
         "event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at")
_project("x35_parent_scope", "documents", {"doc_id": "doc_id", "scope": lambda: X.parent_scope("task_id")}, f"doc_id, coalesce(nullif(trim(task_id),''), '{X.PARENT_SCOPE_SENTINEL}') AS scope")
_project("x36_default_fill", "dvs_task_graph_edges", {"edge_id": "edge_id", "reason": lambda: F.coalesce("reason_code", F.lit("")), "line": lambda: F.coalesce("call_line", F.lit(0)), "args": lambda: F.coalesce("actual_args_json", F.lit("[]")), "tracker": lambda: F.coalesce("tracker_type", F.lit(""))},
         "edge_id, coalesce(reason_code,'') AS reason, coalesce(call_line,0) AS line, coalesce(actual_args_json,'[]') AS args, coalesce(tracker_type,'') AS tracker")
_project("x37_metric_value", "lineitem", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "txt": lambda: X.metric_value(F.col("l_quantity"))}, "l_orderkey, l_linenumber, printf('%.6f', l_quantity) AS txt")


def _rules_sql(rules: tuple, text: str) -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(_contains_any(text, words) for words in groups) + f" THEN '{name}'" for name, groups in rules) + " END"


_project("x05_line_range", "dvs_functions", {"func_id": "func_id", **{k: lambda k=k: X.line_range(F.when(F.col("start_line") % 4 == 0, F.concat_ws("-", "start_line", "end_line")).when(F.col("start_line") % 4 == 1, F.concat(F.lit(" ["), "start_line", F.lit(", "), "end_line", F.lit("]"))).when(F.col("start_line") % 4 == 2, F.concat(F.lit("["), "start_line", F.lit("]"))).otherwise(F.concat("start_line", F.lit("x"))))[k] for k in ("first", "last")}},
         "func_id, CASE WHEN start_line IS NULL OR start_line % 4 = 3 THEN 0 ELSE start_line END AS first, CASE WHEN start_line % 4 IN (0, 1) THEN coalesce(end_line, 0) ELSE 0 END AS last")
_project("x10_label_unescape", "dvs_functions", {"func_id": "func_id", "text": lambda: X.label_unescape(X.label_escape(F.concat("signature", F.lit('\n"\\n\\\\"')))), "raw": lambda: X.label_unescape(F.concat("func_name", F.lit('\\\\n\\n\\q')))},
         "func_id, signature || chr(10) || chr(34) || chr(92) || 'n' || chr(92) || chr(92) || chr(34) AS text, func_name || chr(92) || 'n' || chr(10) || chr(92) || 'q' AS raw")
_project("x12_error_kind", "documents", {"doc_id": "doc_id", "kind": lambda: X.error_kind("text"), "stage": lambda: X.error_stage("text"), "external": lambda: X.external_reason("text")},
         f"doc_id, {_rules_sql(X.ERROR_KINDS, 'lower(text)')} AS kind, {_rules_sql(X.ERROR_STAGES, 'lower(text)')} AS stage, {_rules_sql(X.EXTERNAL_REASONS, 'lower(text)')} AS external")


def _edge() -> Column:
    op = F.when(F.col("kind") == "callee", "Call_Argument").when(F.col("kind") == "container", " container ").when(F.col("kind") == "extern", "terminate").when(F.col("kind") == "inside", "assign").otherwise(F.col("kind"))
    return X.graph_edge(F.col("from_node"), F.col("to_node"), F.col("line"), F.col("condition_json"), op, F.col("escape_subkind"))


_project("x14_graph_edge", "dag_edges", {"edge_id": "edge_id", "func_id": "func_id", **{k: lambda k=k: (F.array_join(_edge()[k], "|") if k == "warnings" else _edge()[k]) for k in ("from", "to", "line", "evidence", "operation", "effect", "warnings")}},
         "edge_id, func_id, coalesce(CAST(from_node AS VARCHAR), 'unknown') AS \"from\", coalesce(CAST(to_node AS VARCHAR), CASE WHEN kind = 'extern' THEN 'terminate' END, 'unknown') AS \"to\", coalesce(CAST(line AS VARCHAR), 'unknown') AS line, coalesce(nullif(trim(condition_json), ''), 'not provided') AS evidence, "
         "CASE kind WHEN 'callee' THEN 'call_arg' WHEN 'container' THEN 'container' WHEN 'extern' THEN 'terminate' WHEN 'return' THEN 'return' ELSE 'unknown' END AS operation, CASE WHEN coalesce(lower(trim(escape_subkind)), 'none') IN ('none', 'partial', 'complete', 'unknown') THEN coalesce(lower(trim(escape_subkind)), 'none') ELSE 'unknown' END AS effect, "
         "concat_ws('|', CASE WHEN from_node IS NULL THEN 'missing from' END, CASE WHEN to_node IS NULL THEN 'missing to' END, CASE WHEN line IS NULL THEN 'missing line' END, CASE WHEN coalesce(trim(condition_json), '') = '' THEN 'missing evidence' END, CASE kind WHEN 'callee' THEN 'unknown operation: Call_Argument' WHEN 'inside' THEN 'unknown operation: assign' WHEN 'source' THEN 'unknown operation: source' END, "
         "CASE WHEN lower(trim(escape_subkind)) NOT IN ('none', 'partial', 'complete', 'unknown') THEN 'invalid sanitizer_effect: ' || lower(trim(escape_subkind)) END) AS warnings")
_GUARD = "(SELECT edge_id, validations_json, CASE WHEN json_valid(validations_json) THEN coalesce(json_extract_string(validations_json, '$[0].summary'), '') ELSE '' END AS g, CASE WHEN json_valid(validations_json) THEN coalesce(json_extract_string(validations_json, '$[0].target'), '?') ELSE '?' END AS s FROM dvs_task_graph_edges)"


def _guard() -> tuple[Column, Column]:
    first = lambda k, d: F.coalesce(F.get_json_object("validations_json", f"$[0].{k}"), F.lit(d))
    return first("summary", ""), first("target", "?")


_project("x17_guard_range", "dvs_task_graph_edges", {"edge_id": "edge_id", "op": lambda: X.guard_range(*_guard())["op"], "bound": lambda: X.guard_range(*_guard())["bound"]},
         "edge_id, CASE WHEN starts_with(g, s || ' ') THEN nullif(regexp_extract(substr(g, length(s) + 1), '^\\s*(<=|<|>=|>)\\s*(-?\\d+)', 1), '') END AS op, CASE WHEN starts_with(g, s || ' ') THEN TRY_CAST(nullif(regexp_extract(substr(g, length(s) + 1), '^\\s*(<=|<|>=|>)\\s*(-?\\d+)', 2), '') AS BIGINT) END AS bound")
SQL["x17_guard_range"] = SQL["x17_guard_range"].replace("FROM dvs_task_graph_edges", f"FROM {_GUARD}", 1)
_project("x17_flipped_guard", "dvs_functions", {"func_id": "func_id", "op": lambda: X.guard_range(F.concat(F.lit("if ("), "start_line", F.lit(" >= n.len)")), F.lit("n.len"))["op"], "bound": lambda: X.guard_range(F.concat(F.lit("if ("), "start_line", F.lit(" >= n.len)")), F.lit("n.len"))["bound"]},
         "func_id, CASE WHEN start_line IS NOT NULL THEN '<=' END AS op, CAST(start_line AS BIGINT) AS bound")


def _covered() -> Column:
    rows = F.from_json("validations_json", VALIDATIONS)
    fact = lambda v, slack: F.struct(
        F.lower(v["kind"]).alias("kind"), v["target"].alias("target"), F.nullif(F.regexp_extract(v["summary"], "(<=|<|>=|>)\\s*(-?\\d+)", 1), F.lit("")).alias("op"),
        (F.nullif(F.regexp_extract(v["summary"], "(<=|<|>=|>)\\s*(-?\\d+)", 2), F.lit("")).cast("long") + slack).alias("bound"))
    facts = F.coalesce(rows, F.array().cast(VALIDATIONS))
    return X.facts_cover(F.transform(facts, lambda v: fact(v, F.lit(0))), F.transform(facts, lambda v: fact(v, F.col("display_order") % 3 - 1)))


_CMP = "regexp_extract({v}.summary, '(<=|<|>=|>)\\s*(-?\\d+)', {k})"
_project("x16_facts_cover", "dvs_task_graph_edges", {"edge_id": "edge_id", "covered": _covered},
         "edge_id, len(v) = 0 OR len(list_filter(v, lambda i: len(list_filter(v, lambda e: lower(e.kind) = lower(i.kind) AND e.target = i.target AND CASE WHEN lower(e.kind) = 'range' THEN coalesce((" + _CMP.format(v="e", k=1) + " IN ('<', '<=') AND " + _CMP.format(v="i", k=1) + " IN ('<', '<=') AND TRY_CAST(" + _CMP.format(v="e", k=2) + " AS BIGINT) >= TRY_CAST(" + _CMP.format(v="i", k=2) + " AS BIGINT) + s) OR ("
         + _CMP.format(v="e", k=1) + " IN ('>', '>=') AND " + _CMP.format(v="i", k=1) + " IN ('>', '>=') AND TRY_CAST(" + _CMP.format(v="e", k=2) + " AS BIGINT) <= TRY_CAST(" + _CMP.format(v="i", k=2) + " AS BIGINT) + s), false) ELSE " + _CMP.format(v="e", k=1) + " = " + _CMP.format(v="i", k=1) + " END)) = 0)) = 0 AS covered")
SQL["x16_facts_cover"] = SQL["x16_facts_cover"].replace("FROM dvs_task_graph_edges", "FROM (SELECT edge_id, display_order % 3 - 1 AS s, CASE WHEN json_valid(validations_json) THEN coalesce(from_json(validations_json, '[{\"kind\":\"VARCHAR\",\"target\":\"VARCHAR\",\"summary\":\"VARCHAR\"}]'), []) ELSE [] END AS v FROM dvs_task_graph_edges)")
_FLAT = "trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_project("x23_preview", "documents", {"doc_id": "doc_id", **{f"p{n}": lambda n=n: X.preview("text", n) for n in (240, 160, 500)}},
         "doc_id, " + ", ".join(f"CASE WHEN length(t) > {n} THEN substr(t, 1, {n - 1}) || '…' ELSE t END AS p{n}" for n in (240, 160, 500)))
SQL["x23_preview"] = SQL["x23_preview"].replace("FROM documents", f"FROM (SELECT doc_id, {_FLAT} AS t FROM documents)")
_project("x23_tagged_result", "documents", {"doc_id": "doc_id", "result": lambda: X.tagged_result(F.concat(F.lit("draft <result> "), "source", F.lit("\n</result> <result>late</result>")))}, "doc_id, source || chr(10) AS result")
_project("x30_fingerprint", "events", {"event_id": "event_id", "decision": lambda: F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "rejected").otherwise("open"),
         "fp": lambda: X.fingerprint({"reason": F.col("props"), "case_id": F.col("user_id").cast("string"), "decision": F.upper("event_type")})},
         "event_id, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' ELSE 'open' END AS decision, sha256(CAST(to_json({'case_id': CAST(user_id AS VARCHAR), 'decision': upper(event_type), 'reason': props}) AS VARCHAR)) AS fp")
_project("x33_budget_cut", "documents", {"doc_id": "doc_id", "cut": lambda: X.budget_cut("text", 20)}, "doc_id, substr(text, 1, 60) AS cut")
_project("x34_reverse_event", "events", {"event_id": "event_id", "internal": lambda: X.internal_event("event_type", {"trace_start": "view", "trace_callees": "click", "task_failed": "error"})},
         "event_id, CASE event_type WHEN 'view' THEN 'trace_start' WHEN 'click' THEN 'trace_callees' WHEN 'error' THEN 'task_failed' ELSE event_type END AS internal")


def _applied(name: str, made: Callable[[], Column], fn, schema: str, sql: str) -> None:
    """Register a text function over a text made of each order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return text.apply(table(spark, sf_dir, "orders").select("o_orderkey", made().alias("t")), ["o_orderkey"], "t", fn, schema)

    run.__doc__ = fn.__doc__
    QUERIES[name] = run
    SQL[name] = sql


def _review() -> Column:
    k, score = F.col("o_orderkey"), (F.col("o_orderkey") % 130).cast("string")
    head = F.concat(F.lit("<think>## 评分: 1</think>## 评分："), score, F.when(k % 3 == 0, "\n## 通过：否").when(k % 3 == 1, "\n## Pass: yes").otherwise(""), F.lit("\n## 评审意见\n"), "o_orderpriority", F.lit("\nmore\n## Refinement\nfix it\n"))
    reply = F.concat(F.lit('Verdict:\n```json\n{"pass": '), F.when(k % 3 == 0, "false").otherwise("true"), F.lit(', "score": '), score, F.lit(', "feedback": "ok",}\n```'))
    return F.when(k % 4 == 0, head).when(k % 4 == 1, reply).when(k % 4 == 2, F.concat(F.lit("I give "), score, F.lit(" / 100."))).otherwise("no opinion")


_applied("x38_review", _review, lambda s: [text.review(s)], "pass boolean, score int, feedback string, refinement string", """
SELECT o_orderkey, CASE m WHEN 0 THEN CASE WHEN s = 0 THEN false WHEN o_orderkey % 3 = 0 THEN false WHEN o_orderkey % 3 = 1 THEN true ELSE s >= 60 END WHEN 1 THEN o_orderkey % 3 <> 0 WHEN 2 THEN s >= 70 ELSE false END AS pass,
  CAST(CASE m WHEN 0 THEN least(s, 100) WHEN 3 THEN 0 ELSE s END AS INT) AS score,
  CASE m WHEN 0 THEN CASE WHEN s = 0 THEN '## 评分：0' || CASE o_orderkey % 3 WHEN 0 THEN chr(10) || '## 通过：否' WHEN 1 THEN chr(10) || '## Pass: yes' ELSE '' END || chr(10) || '## 评审意见' || chr(10) || o_orderpriority || chr(10) || 'more' || chr(10) || '## Refinement' || chr(10) || 'fix it' ELSE o_orderpriority || chr(10) || 'more' END WHEN 1 THEN 'ok' WHEN 2 THEN 'I give ' || s || ' / 100.' ELSE 'no opinion' END AS feedback,
  CASE WHEN m = 0 AND s > 0 THEN 'fix it' ELSE '' END AS refinement
FROM (SELECT *, o_orderkey % 4 AS m, o_orderkey % 130 AS s FROM orders)""")


def _comparison() -> Column:
    k, worker = F.col("o_orderkey"), F.concat(F.lit("worker-"), F.col("o_custkey") % 9)
    head = F.concat(F.lit("## 最佳 Worker: "), worker, F.lit("\n## 整体通过："), F.when(k % 3 == 0, "是").otherwise("否"), F.lit("\n## 理由\n"), "o_orderpriority")
    reply = F.concat(F.lit('{"best_worker": "'), worker, F.lit('", "overall_passed": '), F.when(k % 3 == 0, "true").otherwise("false"), F.lit("}"))
    return F.when(k % 4 == 0, head).when(k % 4 == 1, reply).when(k % 4 == 2, F.concat(F.lit("clearly the winner is "), worker)).otherwise(F.concat(worker, F.lit(" 最优")))


_applied("x39_summary", _comparison, lambda s: [text.verdict_summary(s)], "best string, overall boolean, reasoning string", """
SELECT o_orderkey, 'worker-' || (o_custkey % 9) AS best, o_orderkey % 4 < 2 AND o_orderkey % 3 = 0 AS overall,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' WHEN 2 THEN 'clearly the winner is worker-' || (o_custkey % 9) ELSE 'worker-' || (o_custkey % 9) || ' 最优' END AS reasoning FROM orders""")
