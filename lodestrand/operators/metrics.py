"""Roll-ups of runs and metric samples (A10–A12, A16, A19, A21, R05): one wide aggregation per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.ranking import histogram_quantile

USAGE = {"input": ("input", "prompt_tokens"), "output": ("output", "completion_tokens"), "cache_read": ("cache_read",), "cache_write": ("cache_write",), "cost": ("cost",)}


def usage(df: DataFrame, keys: list[str], cells: Column) -> DataFrame:
    """Sums of the five usage fields of ``cells`` (a map name -> double) per key; of a field's names the first
    that is there counts, missing fields count 0. total is input plus output."""
    picked = {f: F.coalesce(*[F.try_element_at(cells, F.lit(n)) for n in names], F.lit(0.0)) for f, names in USAGE.items()}
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(f) for f, c in picked.items()])
    return sums.withColumn("total", F.col("input") + F.col("output"))


def evaluation(rounds: DataFrame, judges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A10: (per round, per task and stage, per task).

    ``rounds``: task_id, round_no, stage, function, stage_round, passed, duration. ``judges``: task_id, round_no, score
    (may be NULL), vote. Rates of rounds without judges are NULL and are left out of the averages of a stage. Of a
    function the round with the largest stage_round counts, of equal ones the later. Repeated rounds count once.
    """
    seen = judges.groupBy("task_id", "round_no").agg(F.avg("score").alias("avg_score"), F.count_if("vote").alias("pass_count"), F.count("*").alias("judges"))
    once = rounds.groupBy("task_id", "round_no").agg(F.min(F.struct("stage", "function", "stage_round", "passed", "duration")).alias("r")).select("task_id", "round_no", "r.*")
    records = once.join(seen, ["task_id", "round_no"], "left").withColumn("pass_rate", F.col("pass_count") / F.nullif("judges", F.lit(0)))
    stages = records.groupBy("task_id", "stage").agg(F.count("*").alias("rounds"), F.count_if("passed").alias("passed_rounds"), F.avg("pass_rate").alias("avg_pass_rate"))
    latest = records.groupBy("task_id", "function").agg(F.max_by("passed", F.struct("stage_round", "round_no")).alias("passed"))
    done = latest.groupBy("task_id").agg(F.count("*").alias("functions"), F.count_if("passed").alias("completed"))
    whole = records.groupBy("task_id").agg(F.count("*").alias("rounds"), F.count_if("passed").alias("passed_rounds"), F.sum("duration").alias("duration")).join(done, "task_id")
    tasks = whole.withColumn("failed", F.col("functions") - F.col("completed")).withColumn("final_rate", F.col("completed") / F.col("functions"))
    return records, stages, tasks


def cluster(tasks: DataFrame, rounds: DataFrame, judges: DataFrame, slots: DataFrame, now: Column, heartbeat: int = 15) -> DataFrame:
    """(metric, value) of a whole cluster.

    ``tasks``: status, owner, lease_until, heartbeat_at, created_at, started_at, finished_at, failure, depth, callees and
    the usage fields; ``rounds``: task_id, function, duration; ``judges``: duration, session; ``slots``: worker, capacity,
    running, healthy. Times are timestamps; negative durations count 0; NULL owners are none.
    """
    c = F.col
    least0 = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))
    span = lambda a, b: least0((F.unix_micros(c(b).cast("timestamp")) - F.unix_micros(c(a).cast("timestamp"))) / 1e6)
    running, owned = c("status") == "running", c("owner").isNotNull()
    fresh = c("lease_until").isNotNull() & (c("lease_until") >= now)
    age = least0((F.unix_micros(now.cast("timestamp")) - F.unix_micros(c("heartbeat_at").cast("timestamp"))) / 1e6)
    live = F.coalesce(age <= heartbeat * 2, F.lit(False))
    measures = {
        "tasks": F.count("*"), **{f"status_{s}": F.count_if(c("status") == s) for s in ("pending", "running", "done", "failed")},
        "running_without_owner": F.count_if(running & ~owned), "orphan_running": F.count_if(running & (~owned | ~F.coalesce(fresh, F.lit(False)))),
        "leased": F.count_if(owned & F.coalesce(fresh, F.lit(False))), "stale_leases": F.count_if(owned & ~F.coalesce(fresh, F.lit(False))),
        "active_owners": F.countDistinct(F.when(owned & fresh, c("owner"))), "live_owners": F.countDistinct(F.when(live, c("owner"))),
        "heartbeat_live": F.count_if(live), "heartbeat_age_max": F.coalesce(F.max(age), F.lit(0.0)),
        "queue_count": F.count(span("created_at", "started_at")), "queue_seconds": F.sum(span("created_at", "started_at")),
        "turnaround_count": F.count(span("created_at", "finished_at")), "turnaround_seconds": F.sum(span("created_at", "finished_at")),
        "execution_count": F.count(span("started_at", "finished_at")), "execution_seconds": F.sum(span("started_at", "finished_at")),
        **{f"usage_{u}": F.sum(F.coalesce(c(u), F.lit(0.0))) for u in USAGE}, **{f"usage_{u}_running": F.sum(F.when(running, F.coalesce(c(u), F.lit(0.0))).otherwise(0.0)) for u in ("input", "output", "cost")},
        "timeouts": F.count_if(c("failure") == "timeout"), "cancels": F.count_if(c("failure") == "cancel"), "failures": F.count_if(c("failure") != "none"),
        "depth_max": F.coalesce(F.max("depth"), F.lit(0)), "callees": F.sum(F.coalesce("callees", F.lit(0))),
    }
    per_task = rounds.groupBy("task_id").agg(F.count("*").alias("n"), F.sum("duration").alias("d"), F.countDistinct("function").alias("f"))
    of_rounds = {"rounds": F.sum("n"), "retries": F.sum(c("n") - 1), "round_functions": F.sum("f"), "round_seconds": F.sum("d")}
    of_judges = {"judges": F.count("*"), "judge_seconds": F.sum("duration"), "judge_sessions": F.count("session")}
    of_slots = {"workers": F.countDistinct("worker"), "healthy_workers": F.countDistinct(F.when(c("healthy"), c("worker"))), "slots": F.sum("capacity"), "busy_slots": F.sum("running")}
    sets = ((tasks, measures), (per_task, of_rounds), (judges, of_judges), (slots, of_slots))
    # each table gives one row; their measures as rows, then as the columns of one row
    listed = None
    for df, what in sets:
        cells = df.agg(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in what.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), c(k).alias("value")) for k in what])))
        listed = cells if listed is None else listed.unionAll(cells)
    row = listed.agg(*[F.max(F.when(c("metric") == k, c("value"))).alias(k) for _, what in sets for k in what])
    ratio = lambda a, b: F.coalesce(c(a) / F.nullif(c(b), F.lit(0.0)), F.lit(0.0))
    extra = {
        "free_slots": F.greatest(F.lit(0.0), c("slots") - c("busy_slots")), "slot_utilisation": ratio("busy_slots", "slots"), "queue_pressure": ratio("status_pending", "slots"),
        "owner_coverage": ratio("active_owners", "workers"), "heartbeat_stale": F.greatest(F.lit(0.0), c("status_running") - c("heartbeat_live")),
    }
    row = row.select("*", *[v.alias(k) for k, v in extra.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), c(k).alias("value")) for k in row.columns])))


def routes(requests: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per (method, route) counts by status class, requests in flight, mean, p50, p95, p99, error rate and whether it is
    slow (p95 of a second or mean of half a second, or more). ``requests``: method, route, status, seconds, open (boolean).
    ``buckets``: method, route, le, n (cumulative)."""
    keys = ["method", "route"]
    kind = lambda d: F.count_if(F.startswith(F.col("status").cast("string"), F.lit(d)))
    out = requests.groupBy(*keys).agg(
        F.count("*").alias("requests"), kind("2").alias("n_2xx"), kind("4").alias("n_4xx"), kind("5").alias("n_5xx"), F.count_if("open").alias("inflight"), F.avg("seconds").alias("mean"))
    for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        out = out.join(histogram_quantile(buckets, keys, q, name), keys, "left")
    slow = (F.coalesce("p95", F.lit(0.0)) >= 1.0) | (F.coalesce("mean", F.lit(0.0)) >= 0.5)
    return out.withColumn("error_rate", F.col("n_5xx") / F.col("requests")).withColumn("worst", F.greatest("mean", "p95", "p99")).withColumn("slow", slow)


def top_routes(summary: DataFrame, count: int = 6) -> DataFrame:
    """(list, place, name, value): the largest ``count`` routes by requests, by p95 and by 5xx (above 0); a report."""
    name = F.concat_ws(" ", "method", "route")
    rows = summary.select(name.alias("name"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("list"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("value")) for k, v in (("count", F.col("requests")), ("p95", F.col("p95")), ("5xx", F.col("n_5xx")))])))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("value"), "name"))  # cut per input partition first
    best = rows.where("list <> '5xx' or value > 0").withColumn("place", place).where(F.col("place") <= count)
    return best.select("list", (F.col("place") - 1).alias("place"), "name", "value")


# fixed values: suffixes that make a metric family count towards coverage
FAMILY_SUFFIXES = ("_ai_role_count", "_ai_session_total", "_ai_round_total", "_ai_retry_total", "_ai_timeout_total", "_ai_failure_total", "_ai_token_usage_total", "_ai_token_cost_total", "_ai_review_total")


def ai_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of metric samples (name, label, value) by suffix or word per key; a total that is 0 is replaced by input plus
    output; coverage by the number of families: 7 complete, 4 partial, any basic, else none."""
    ends = lambda s: F.endswith("name", F.lit(s))
    has = lambda w: F.contains("name", F.lit(w))
    total = lambda cond, name: F.sum(F.when(cond, F.col("value")).otherwise(0.0)).alias(name)
    token = ends("_ai_token_usage_total")
    family = F.when(F.greatest(*[ends(s).cast("int") for s in FAMILY_SUFFIXES]) == 1, F.regexp_replace("name", "_total$", ""))
    out = samples.groupBy(*keys).agg(
        total(ends("_ai_session_total") | has("session"), "sessions"), *[total(token & (F.col("label") == k), f"token_{k}") for k in ("input", "output", "cache_read", "cache_write", "total")],
        total(ends("_ai_token_cost_total") | has("cost_usage"), "cost"), total(ends("_ai_role_count"), "roles"), total(has("retry"), "retries"), total(has("timeout"), "timeouts"), total(has("fail") | has("error"), "failures"),
        total(has("round") | has("cycle"), "rounds"), total(has("review"), "reviews"), F.countDistinct(family).alias("families"), F.count("*").alias("samples"))
    out = out.withColumn("tokens", F.coalesce(F.nullif("token_total", F.lit(0.0)), F.col("token_input") + F.col("token_output")))
    return out.withColumn("coverage", F.when(F.col("families") >= 7, "complete").when(F.col("families") >= 4, "partial").when(F.col("samples") > 0, "basic").otherwise("none"))


def cards(counts: DataFrame, keys: list[str], depth: str, p95: str) -> DataFrame:
    """Running, pending, passed and failed of status counts (keys, status, n, depth, p95) with the alerts they give."""
    group = lambda name, *words: F.sum(F.when(F.col("status").isin(*words), F.col("n")).otherwise(0)).alias(name)
    out = counts.groupBy(*keys).agg(
        group("running", "running"), group("pending", "pending", "queued"), group("failed", "failed", "error"), group("passed", "passed", "success", "completed", "done"), F.max(depth).alias("queue_depth"), F.max(p95).alias("p95"))
    backlog = F.when((F.col("queue_depth") > 0) & (F.col("pending") > 0), "backlog")
    alerts = F.array_compact(F.array(backlog, F.when(F.col("failed") > 0, "failures")))
    return out.withColumn("alerts", F.when(F.size(alerts) > 0, F.array_join(alerts, ",")).otherwise("calm"))
