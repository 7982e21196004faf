"""Registered roll-ups (A10–A12, A16, A19, A21, R05, L01). Runs are mapped from the order tables: an order is a task, its
line items are rounds and their judges; requests are events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import scalar as X
from lodestrand.operators import metrics, ranking
from lodestrand.plans.relational import _H, _q_sql
from lodestrand.plans.relational import QUERIES as _KNOWN
from lodestrand.plans.relational import SQL as _KNOWN_SQL
from lodestrand.plans.relational import query, simple

_before = set(_KNOWN)


def _rounds(t):
    li = t("lineitem")
    passed = F.col("l_returnflag") != "R"
    rounds = li.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("round_no"), F.col("l_linestatus").alias("stage"), (F.col("l_partkey") % 3).alias("function"), (F.col("l_linenumber") % 4).alias("stage_round"), passed.alias("passed"), F.col("l_quantity").alias("duration"))
    judges = li.where("l_suppkey % 5 > 0").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("round_no"), F.when(F.col("l_discount") > 0.01, F.col("l_discount") * 1000).alias("score"), passed.alias("vote"))
    return rounds, judges


_R = """WITH r AS (SELECT task_id, round_no, m.stage, m.function, m.stage_round, m.passed, m.duration FROM (SELECT l_orderkey AS task_id, l_linenumber AS round_no, min({'stage': l_linestatus, 'function': l_partkey % 3, 'stage_round': l_linenumber % 4, 'passed': l_returnflag <> 'R', 'duration': l_quantity}) AS m FROM lineitem GROUP BY 1, 2)),
j AS (SELECT l_orderkey AS task_id, l_linenumber AS round_no, avg(CASE WHEN l_discount > 0.01 THEN l_discount * 1000 END) AS avg_score, count(*) FILTER (WHERE l_returnflag <> 'R') AS pc, count(*) AS n FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY 1, 2),
x AS (SELECT r.*, avg_score, pc / n AS pass_rate FROM r LEFT JOIN j USING (task_id, round_no)),
l AS (SELECT task_id, function, arg_max(passed, (stage_round, round_no)) AS passed FROM x GROUP BY 1, 2),
d AS (SELECT task_id, count(*) AS functions, count(*) FILTER (WHERE passed) AS completed FROM l GROUP BY 1) """
simple("a10_round_metrics", lambda t: metrics.evaluation(*_rounds(t))[0].select("task_id", "round_no", F.round("avg_score", 6).alias("avg_score"), F.round("pass_rate", 6).alias("pass_rate")), _R + "SELECT task_id, round_no, round(avg_score, 6) AS avg_score, round(pass_rate, 6) AS pass_rate FROM x")
simple("a10_stage_rollup", lambda t: metrics.evaluation(*_rounds(t))[1].withColumn("avg_pass_rate", F.round("avg_pass_rate", 6)), _R + "SELECT task_id, stage, count(*) AS rounds, count(*) FILTER (WHERE passed) AS passed_rounds, round(avg(pass_rate), 6) AS avg_pass_rate FROM x GROUP BY 1, 2")
simple("a10_evaluation_rollup", lambda t: metrics.evaluation(*_rounds(t))[2].withColumn("final_rate", F.round("final_rate", 6)),
       _R + "SELECT w.*, functions, completed, functions - completed AS failed, round(completed / functions, 6) AS final_rate FROM (SELECT task_id, count(*) AS rounds, count(*) FILTER (WHERE passed) AS passed_rounds, sum(duration) AS duration FROM x GROUP BY 1) w JOIN d USING (task_id)")
simple("a11_usage_merge", lambda t: metrics.usage(t("lineitem"), ["l_suppkey"], F.create_map(F.when(F.col("l_linenumber") % 2 == 0, "input").otherwise("prompt_tokens"), F.col("l_quantity"), F.when(F.col("l_linestatus") == "O", "output").otherwise("completion_tokens"), F.col("l_quantity") * 2, F.lit("cache_read"), F.col("l_linenumber").cast("double"), F.lit("cost"), F.col("l_tax"))).select("l_suppkey", *[F.round(c, 2).alias(c) for c in (*metrics.USAGE, "total")]),
       "SELECT l_suppkey, round(sum(l_quantity), 2) AS input, round(sum(l_quantity * 2), 2) AS output, round(sum(CAST(l_linenumber AS DOUBLE)), 2) AS cache_read, 0.0::DOUBLE AS cache_write, round(sum(l_tax), 2) AS cost, round(sum(l_quantity) + sum(l_quantity * 2), 2) AS total FROM lineitem GROUP BY 1")

_STAT = "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE CASE WHEN o_custkey % 9 = 0 THEN 'failed' ELSE 'done' END END"


@query("a12_cluster_metrics", f"""
WITH b AS (SELECT *, {_STAT} AS status, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 50 END AS owner, CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate + INTERVAL 300 DAY END AS lease, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + INTERVAL 400 DAY END AS hb,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(CAST(o_orderkey % 4 - 1 AS INT)) END AS started, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 10 AS INT)) END AS finished,
  CASE o_custkey % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'cancel' WHEN 2 THEN 'error' ELSE 'none' END AS failure, TIMESTAMP '1999-06-01 00:00:00' AS now FROM orders),
t AS (SELECT *, status = 'running' AS r, coalesce(lease >= now, false) AS fresh, greatest(0.0, (epoch_us(now) - epoch_us(hb)) / 1e6) AS age, greatest(0.0, (epoch_us(started) - epoch_us(o_orderdate)) / 1e6) AS q, greatest(0.0, (epoch_us(finished) - epoch_us(o_orderdate)) / 1e6) AS tt,
  greatest(0.0, (epoch_us(finished) - epoch_us(started)) / 1e6) AS ex, hb IS NOT NULL AS hasb, started IS NOT NULL AS s, finished IS NOT NULL AS f FROM b),
v AS (SELECT coalesce(age <= 30 AND hasb, false) AS live, * FROM t),
m AS (SELECT count(*) AS tasks, count(*) FILTER (WHERE status = 'pending') AS status_pending, count(*) FILTER (WHERE r) AS status_running, count(*) FILTER (WHERE status = 'done') AS status_done, count(*) FILTER (WHERE status = 'failed') AS status_failed,
  count(*) FILTER (WHERE r AND owner IS NULL) AS running_without_owner, count(*) FILTER (WHERE r AND (owner IS NULL OR NOT fresh)) AS orphan_running, count(*) FILTER (WHERE owner IS NOT NULL AND fresh) AS leased, count(*) FILTER (WHERE owner IS NOT NULL AND NOT fresh) AS stale_leases,
  count(DISTINCT owner) FILTER (WHERE fresh) AS active_owners, count(DISTINCT owner) FILTER (WHERE live) AS live_owners, count(*) FILTER (WHERE live) AS heartbeat_live, coalesce(max(age) FILTER (WHERE hasb), 0) AS heartbeat_age_max,
  count(*) FILTER (WHERE s) AS queue_count, sum(q) FILTER (WHERE s) AS queue_seconds, count(*) FILTER (WHERE f) AS turnaround_count, sum(tt) FILTER (WHERE f) AS turnaround_seconds, count(*) FILTER (WHERE s AND f) AS execution_count, sum(ex) FILTER (WHERE s AND f) AS execution_seconds,
  sum(CAST(o_orderkey % 100 AS DOUBLE)) AS usage_input, sum(CAST(o_orderkey % 10 AS DOUBLE)) AS usage_output, sum(CAST(o_orderkey % 3 AS DOUBLE)) AS usage_cache_read, 0.0 AS usage_cache_write, sum(CAST(o_orderkey % 7 AS DOUBLE)) AS usage_cost,
  sum(CASE WHEN r THEN o_orderkey % 100 ELSE 0 END) AS usage_input_running, sum(CASE WHEN r THEN o_orderkey % 10 ELSE 0 END) AS usage_output_running, sum(CASE WHEN r THEN o_orderkey % 7 ELSE 0 END) AS usage_cost_running,
  count(*) FILTER (WHERE failure = 'timeout') AS timeouts, count(*) FILTER (WHERE failure = 'cancel') AS cancels, count(*) FILTER (WHERE failure <> 'none') AS failures, max(o_orderkey % 17) AS depth_max, sum(o_orderkey % 6) AS callees FROM v),
k AS (SELECT sum(n) AS rounds, sum(n - 1) AS retries, sum(f) AS round_functions, sum(d) AS round_seconds FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS d, count(DISTINCT l_partkey) AS f FROM lineitem GROUP BY 1)),
u AS (SELECT count(*) AS judges, sum(l_tax) AS judge_seconds, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS judge_sessions FROM lineitem WHERE l_returnflag = 'A'),
w AS (SELECT count(DISTINCT worker_id) AS workers, count(DISTINCT CASE WHEN zone_name IS NOT NULL THEN worker_id END) AS healthy_workers, count(*) * 4 AS slots, count(*) FILTER (WHERE zone_name = 'UTC') * 3 AS busy_slots FROM worker_clocks),
a AS (SELECT *, greatest(0, slots - busy_slots) AS free_slots, busy_slots / slots AS slot_utilisation, status_pending / slots AS queue_pressure, active_owners / workers AS owner_coverage, greatest(0, status_running - heartbeat_live) AS heartbeat_stale FROM m, k, u, w)
SELECT metric, round(value, 4) AS value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM a) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def _(t):
    """All measures of a cluster: states, leases, heartbeats, waits, usage, rounds, judges and slots."""
    o, li = F.col, t("lineitem")
    status = F.when(o("o_orderstatus") == "O", "running").when(o("o_orderstatus") == "P", "pending").when(o("o_custkey") % 9 == 0, "failed").otherwise("done")
    days = lambda n: o("o_orderdate") + F.make_dt_interval(days=n)
    number = lambda k: (o("o_orderkey") % k).cast("double")
    tasks = t("orders").select(
        status.alias("status"), F.when(o("o_orderkey") % 11 > 0, o("o_custkey") % 50).alias("owner"), F.when(o("o_orderkey") % 13 > 0, days(F.lit(300))).alias("lease_until"), F.when(o("o_orderkey") % 5 > 0, days(F.lit(400))).alias("heartbeat_at"),
        o("o_orderdate").alias("created_at"), F.when(o("o_orderstatus") != "P", days((o("o_orderkey") % 4 - 1).cast("int"))).alias("started_at"), F.when(o("o_orderstatus") == "F", days((o("o_orderkey") % 10).cast("int"))).alias("finished_at"),
        F.element_at(F.array(*[F.lit(x) for x in ("timeout", "cancel", "error", "none", "none", "none", "none")]), (o("o_custkey") % 7 + 1).cast("int")).alias("failure"), (o("o_orderkey") % 17).alias("depth"), (o("o_orderkey") % 6).alias("callees"),
        number(100).alias("input"), number(10).alias("output"), number(3).alias("cache_read"), F.lit(None).cast("double").alias("cache_write"), number(7).alias("cost"))
    rounds = li.select(o("l_orderkey").alias("task_id"), o("l_partkey").alias("function"), o("l_quantity").alias("duration"))
    judges = li.where("l_returnflag = 'A'").select(o("l_tax").alias("duration"), F.when(o("l_linestatus") == "O", "s").alias("session"))
    slots = t("worker_clocks").select(o("worker_id").alias("worker"), F.lit(4).alias("capacity"), F.when(o("zone_name") == "UTC", 3).otherwise(0).alias("running"), o("zone_name").isNotNull().alias("healthy"))
    return metrics.cluster(tasks, rounds, judges, slots, F.expr("timestamp_ntz'1999-06-01 00:00:00'")).withColumn("value", F.round("value", 4))


def _requests(t):
    return t("events").select((F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST")).alias("method"), X.route_template(F.concat(F.lit("/tasks/"), "user_id", F.lit("/"), "event_type")).alias("route"),
                              F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 10 == 0, 404).otherwise(200).alias("status"), F.col("value").alias("seconds"), (F.col("event_id") % 7 == 0).alias("open"))


_EV = "(SELECT CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END || ' /tasks/{id}/' || event_type AS event_type, value, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 10 = 0 THEN 404 ELSE 200 END AS st, event_id % 7 = 0 AS op FROM events)"
_RH = _H.replace("FROM events,", f"FROM {_EV} ev,")
_ROUTES = _RH + "".join(f", {n} AS ({_q_sql(q, n)})" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + (
    f", s AS (SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE st = 200) AS n_2xx, count(*) FILTER (WHERE st = 404) AS n_4xx, count(*) FILTER (WHERE st = 500) AS n_5xx, count(*) FILTER (WHERE op) AS inflight, avg(value) AS mean FROM {_EV} GROUP BY 1), "
    "z AS (SELECT s.*, p50.p50, p95.p95, p99.p99 FROM s LEFT JOIN p50 USING (event_type) LEFT JOIN p95 USING (event_type) LEFT JOIN p99 USING (event_type)) ")


def _summary(t):
    requests = _requests(t)
    return metrics.routes(requests, ranking.cumulative_buckets(requests, ["method", "route"], "seconds", ranking.BOUNDS))


simple("a16_route_summary", lambda t: _summary(t).select("method", "route", "requests", "n_2xx", "n_4xx", "n_5xx", "inflight", "slow", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99", "error_rate", "worst")]),
       _ROUTES + "SELECT split_part(event_type, ' ', 1) AS method, split_part(event_type, ' ', 2) AS route, requests, n_2xx, n_4xx, n_5xx, inflight, coalesce(p95, 0) >= 1 OR coalesce(mean, 0) >= 0.5 AS slow, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(n_5xx / requests, 6) AS error_rate, round(greatest(mean, p95, p99), 6) AS worst FROM z")
simple("r05_top_routes", lambda t: metrics.top_routes(_summary(t)).withColumn("value", F.round("value", 6)),
       _ROUTES + ", a AS (SELECT event_type AS name, 'count' AS list, CAST(requests AS DOUBLE) AS value FROM z UNION ALL SELECT event_type, 'p95', coalesce(p95, 0) FROM z UNION ALL SELECT event_type, '5xx', n_5xx FROM z WHERE n_5xx > 0) SELECT list, CAST(p - 1 AS INT) AS place, name, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, name) AS p FROM a) WHERE p <= 6")
_NAMES = ("dvs_ai_session_total", "dvs_ai_token_usage_total", "dvs_ai_role_count", "dvs_ai_retry_total", "dvs_ai_timeout_total", "dvs_ai_failure_total", "dvs_ai_review_total", "dvs_ai_round_total", "other_total")
_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_SUM = lambda cond: f"sum(CASE WHEN {cond} THEN value ELSE 0 END)"
simple("a19_ai_summary", lambda t: metrics.ai_summary(t("events").select("user_id", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % len(_NAMES) + 1).cast("int")).alias("name"), F.element_at(F.array(F.lit("input"), F.lit("output"), F.lit("total")), (F.col("event_id") % 3 + 1).cast("int")).alias("label"), "value"), ["user_id"]).select(
    "user_id", "coverage", "families", *[F.round(c, 4).alias(c) for c in ("sessions", "tokens", "token_input", "roles", "retries", "timeouts", "failures", "rounds", "reviews", "cost")]),
    f"SELECT user_id, CASE WHEN f >= 7 THEN 'complete' WHEN f >= 4 THEN 'partial' ELSE 'basic' END AS coverage, f AS families, round(sessions, 4) AS sessions, round(coalesce(nullif(tt, 0), ti + tou), 4) AS tokens, round(ti, 4) AS token_input, round(roles, 4) AS roles, round(retries, 4) AS retries, round(timeouts, 4) AS timeouts, round(failures, 4) AS failures, round(rounds, 4) AS rounds, round(reviews, 4) AS reviews, 0.0::DOUBLE AS cost FROM (SELECT user_id, count(DISTINCT CASE WHEN n <> 'other_total' THEN n END) AS f, "
    + ", ".join(f"{_SUM(c)} AS {k}" for k, c in (("sessions", "contains(n, 'session')"), ("ti", "contains(n, 'token_usage') AND l = 'input'"), ("tou", "contains(n, 'token_usage') AND l = 'output'"), ("tt", "contains(n, 'token_usage') AND l = 'total'"), ("roles", "contains(n, 'role_count')"), ("retries", "contains(n, 'retry')"), ("timeouts", "contains(n, 'timeout')"), ("failures", "contains(n, 'fail')"), ("rounds", "contains(n, 'round')"), ("reviews", "contains(n, 'review')")))
    + f" FROM (SELECT user_id, value, {_LIST}[event_id % {len(_NAMES)} + 1] AS n, ['input', 'output', 'total'][event_id % 3 + 1] AS l FROM events) GROUP BY 1)")
simple("a21_cards_and_alerts", lambda t: metrics.cards(t("dvs_task_graph_nodes").groupBy("task_id", F.col("status").alias("status")).agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.lit(0.5).alias("p")), ["task_id"], "depth", "p"),
       "SELECT task_id, running, pending, failed, passed, queue_depth, 0.5::DOUBLE AS p95, CASE WHEN queue_depth > 0 AND pending > 0 AND failed > 0 THEN 'backlog,failures' WHEN queue_depth > 0 AND pending > 0 THEN 'backlog' WHEN failed > 0 THEN 'failures' ELSE 'calm' END AS alerts FROM (SELECT task_id, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status IN ('pending', 'queued')) AS pending, count(*) FILTER (WHERE status IN ('failed', 'error')) AS failed, count(*) FILTER (WHERE status IN ('passed', 'success', 'completed', 'done')) AS passed, max(depth) AS queue_depth FROM dvs_task_graph_nodes GROUP BY 1)")
simple("l01_page", lambda t: ranking.sorted_page(t("orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_totalprice", True, "o_orderkey", {"o_totalprice", "o_orderdate"}, 20, 20).select("o_orderkey", "o_totalprice", "total"), "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 20 OFFSET 20")
simple("l01_unknown_sort", lambda t: ranking.sorted_page(t("orders").select("o_orderkey", "o_totalprice"), "drop table", False, "o_orderkey", {"o_totalprice"}, 0, 5).select("o_orderkey", "total"), "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY 1 DESC LIMIT 5")

QUERIES = {k: v for k, v in _KNOWN.items() if k not in _before}
SQL = {k: v for k, v in _KNOWN_SQL.items() if k in QUERIES}
