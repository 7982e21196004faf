"""Lookups, rankings, graphs, merges and state on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import scalar as X
from lodestrand.operators import graph, lookup, merge, ranking, state


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_layered_lookup(spark):
    index = spark.createDataFrame([("1", "f", "f"), ("2", "A::f", "f"), ("3", "_g", "_g"), ("4", "h", "h"), ("5", "B::h", "h"), ("6", None, None)], "func_id string, name string, tail string")
    probes = spark.createDataFrame([("A::f",), ("Z::f",), ("g",), ("h",), ("none",), (None,), (" ",)], "probe string")
    got = rows(lookup.layered_lookup(probes, "probe", index, "name", "tail", "func_id"))
    assert got == sorted([("A::f", "2", 1), ("Z::f", "1", 2), ("g", "3", 4), ("h", "4", 1)], key=repr)


def test_interval_join(spark):
    points = spark.createDataFrame([("a", 5), ("a", 700), ("a", 9999), ("b", 5), (None, 5)], "file string, line int")
    ranges = spark.createDataFrame([("a", 1, 900, "outer"), ("a", 4, 6, "inner"), ("c", 1, 9, "x")], "file string, s int, e int, k string")
    got = rows(lookup.interval_join(points, ranges, "file", "line", "s", "e", "k"))
    assert ("a", 5, "outer") in got and ("a", 700, "outer") in got and ("a", 9999, "<global:a:9999>") in got and ("b", 5, "<global:b:5>") in got
    assert lookup.interval_join(points.limit(0), ranges, "file", "line", "s", "e", "k").count() == 0


def test_best_root_siblings_ready(spark):
    items = spark.createDataFrame([("/a/b/c",), ("/ab",), ("/x",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("",)], "root string")
    assert rows(lookup.best_root(items, "path", roots, "root", [])) == [("/a/b/c", "/a/b"), ("/ab", ""), ("/x", "")]
    arms = spark.createDataFrame([("g", "1"), ("g", "2"), ("g", "2"), ("h", "1"), (None, "1"), ("g", None)], "g string, a string")
    assert rows(lookup.siblings(arms, "g", "a")) == [("g", "1", 2), ("g", "2", 2)]
    units = spark.createDataFrame([("u",), ("v",), ("w",)], "u string")
    needs = spark.createDataFrame([("u", "x"), ("v", "x"), ("v", "y")], "u string, n string")
    done = spark.createDataFrame([("x",)], "d string")
    assert rows(lookup.ready(units, "u", needs, "n", done, "d")) == [("u",), ("w",)]


def test_histogram_quantile(spark):
    inf = float("inf")
    b = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 6), ("a", inf, 8), ("e", 1.0, 0), ("e", inf, 0), ("i", 1.0, 0), ("i", inf, 3)], "k string, le double, n int")
    q = {r["k"]: r["q"] for r in ranking.histogram_quantile(b, ["k"], 0.5, "q").collect()}
    assert q["a"] == pytest.approx(1.5) and q["e"] is None and q["i"] == 1.0
    top = {r["k"]: r["q"] for r in ranking.histogram_quantile(b, ["k"], 0.99, "q").collect()}
    assert top["a"] == 2.0


def test_first_visit_local_equals_rounds(spark):
    edges = spark.createDataFrame([("s", "r", "a"), ("s", "r", "b"), ("s", "a", "c"), ("s", "b", "c"), ("s", "c", "a"), ("t", "x", "y"), ("t", None, "y")], "scope string, src string, dst string")
    roots = spark.createDataFrame([("s", "r"), ("t", "q"), (None, "x")], "scope string, node string")
    want = sorted([("s", "r", 0, None), ("s", "a", 1, "r"), ("s", "b", 1, "r"), ("s", "c", 2, "a"), ("t", "q", 0, None)], key=repr)
    assert rows(graph.first_visit(edges, roots)) == want
    assert rows(graph.first_visit(edges, roots, local_links=0)) == want
    assert len(rows(graph.first_visit(edges, roots, max_depth=1))) == 4


def test_paths_are_cut_at_cycles(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "a"), ("s", "b", "c")], "scope string, src string, dst string")
    got = rows(graph.all_paths(edges, spark.createDataFrame([("s", "a")], "scope string, node string")).select("path", "cycle"))
    assert got == sorted([(["a"], False), (["a", "b"], False), (["a", "b", "a"], True), (["a", "b", "c"], False)], key=repr)


def test_fold_and_effect(spark):
    steps = spark.createDataFrame([("c", 1, "x"), ("c", 2, "clean"), ("c", 3, "x"), ("c", 4, "source"), ("c", 5, "x")], "k string, line int, kind string")
    got = graph.fold_state(steps, ["k"], ["line", "kind"], F.col("kind") == "clean", F.col("kind") == "source")
    assert [r["state"] for r in got.orderBy("step").collect()] == ["tainted", "clean", "clean", "tainted", "tainted"]
    nodes = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", False)], "f string, sanitized boolean")
    edges = spark.createDataFrame([("a", "return"), ("b", "return"), ("b", "callee"), ("c", "callee")], "f string, kind string")
    assert {r["f"]: r["effect"] for r in graph.callee_effect(nodes, edges, ["f"]).collect()} == {"a": "sanitized", "b": "return", "c": "propagate", "d": "unchanged"}


def test_merges(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "k string, v string, w string")
    new = spark.createDataFrame([("b", "3", "z"), ("c", None, "q")], "k string, v string, w string")
    assert rows(merge.latest_wins(old, new, ["k"])) == [("a", "1", "x"), ("b", "3", "z"), ("c", None, "q")]
    assert rows(merge.first_wins(old, new, ["k"], ["w"])) == [("a", "1", "x"), ("b", "2", "y"), ("c", None, "q")]
    assert rows(merge.partial(old, new, ["k"], ["v"])) == [("a", "1", "x"), ("b", "3", "y"), ("c", None, "q")]
    assert rows(merge.replaced(old, new, ["k"])) == [("a", "1", "x"), ("b", "3", "z"), ("c", None, "q")]
    assert rows(merge.cleared(old, new, "k")) == [("a", "1", "x")]
    found = spark.createDataFrame([("f", "t1", "o"), ("f", "", "o"), ("g", "", "o"), ("g", "t2", "o"), ("h", "t9", "o"), ("i", "t1", "o")], "f string, t string, s string")
    upd = spark.createDataFrame([("f", "t1", "n"), ("g", "t1", "n"), ("h", "t1", "n")], "f string, t string, s string")
    assert rows(merge.tiered_update(found, upd, "f", "t", "s").select("f", "t", "s")) == [("f", "", "o"), ("f", "t1", "n"), ("g", "", "n"), ("g", "t2", "o"), ("h", "t9", "n"), ("i", "t1", "o")]


def test_scalars(spark):
    df = spark.createDataFrame([("A::B::f(x)", "0.615", "严重", "128Mi", "a\\\"b")], "n string, c string, s string, m string, l string")
    r = df.select(
        X.qualified_candidates(F.lit("A::B::f")).alias("q"), X.confidence_percent("c").alias("c"), X.severity("s").alias("s"), X.memory_bytes("m").alias("m"), X.label_unescape("l").alias("l"),
        X.guard_range(F.lit("1024 >= len"), F.lit("len")).alias("g"), X.session_descriptor(F.lit("sessions/d03-foo-track-x.jsonl")).alias("d"), X.confidence_percent(F.lit("bad")).alias("b"),
        X.tagged_result(F.lit("x <result> y </result>")).alias("t"), X.cpu_millicores(F.lit("1.5")).alias("cpu"),
    ).first()
    assert r["q"] == ["A::B::f", "B::f", "f"] and r["c"] == 62 and r["s"] == "critical" and r["m"] == 128 * 2**20 and r["l"] == 'a"b'
    assert tuple(r["g"]) == ("<=", 1024) and r["d"]["role"] == "tracker" and r["d"]["module"] == "foo" and r["d"]["attempt"] == 3 and r["b"] == 60
    assert r["t"] == "y" and r["cpu"] == 1500


def test_state(spark):
    df = spark.sql("select timestamp'2024-01-01 10:00:00' at, 'a' k union all select timestamp'2024-01-01 07:00:00', 'b' union all select null, 'c'")
    assert rows(state.watermark_scan(df, "at", F.lit("2024-01-01 10:30:00").cast("timestamp")).select("k")) == [("a",), ("c",)]
    ev = spark.createDataFrame([("x", 1, "claim"), ("x", 2, "release"), ("x", 3, "claim"), ("y", 1, "claim"), ("y", 2, "release"), ("z", 1, "other")], "k string, at int, kind string")
    assert rows(state.lease_state(ev, ["k"], "at", "kind").select("k", "epoch", "held")) == [("x", 2, True), ("y", 1, False), ("z", 0, False)]


def test_lease_log_against_a_plain_machine(spark):
    import random

    rnd, ttl = random.Random(8), 10
    rows_in = [(rnd.choice(["a", "b", None]), rnd.randrange(0, 400) * 1_000_000, k, rnd.choice(["claim", "claim", "renew", "release", "odd"]), rnd.choice(["w1", "w2", None])) for k in range(600)]
    df = spark.createDataFrame(rows_in, "task string, at long, seq long, kind string, owner string")
    for life in (ttl, None):
        want = []
        for key in ("a", "b"):
            holder, epoch, until = None, 0, 0
            for _, at, seq, kind, owner in sorted((r for r in rows_in if r[0] == key), key=lambda r: (r[1], r[2])):
                held = holder if holder is not None and (life is None or at <= until) else None
                ok = kind == "claim" and held is None and owner is not None or kind in ("renew", "release") and held is not None and held == owner
                if ok and kind == "claim":
                    holder, epoch = owner, epoch + 1
                if ok and kind == "release":
                    holder = None
                if ok and kind != "release" and life:
                    until = at + life * 1_000_000
                want.append((key, seq, ok, epoch, holder))
        assert sorted(map(tuple, state.lease_log(df, "task", "at", "seq", "kind", "owner", life).collect()), key=repr) == sorted(want, key=repr)
    assert state.lease_log(df.limit(0), "task", "at", "seq", "kind", "owner", ttl).count() == 0


def test_snapshot_is_kept_for_its_time(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    kept = state.Snapshot(make, ttl=3600)
    assert kept.get().count() == 1 and kept.get().count() == 1 and len(made) == 1
    kept.ttl = -1
    assert kept.get().count() == 2


def test_matched_root(spark):
    procs = spark.createDataFrame([("p1", "/r/t1/x/s.jsonl", "/r/t2", "run"), ("p2", None, "/r/t2/sub", None), ("p3", None, None, "go --dir=/r/t1/x -v"), ("p4", "/r/t10", None, "x/r/t1")], "pid string, arg string, cwd string, cmd string")
    roots = spark.createDataFrame([("/r/t1", "t1", 1), ("/r/t1/x", "t1", 0), ("/r/t2", "t2", 0), ("/r/t2", "t3", 5), ("", "none", 9)], "root string, owner string, rank int")
    got = lookup.matched_root(procs, "pid", [("arg", "arg", 3), ("cwd", "cwd", 2)], "cmd", roots, "root", "owner", [F.col("rank")])
    assert rows(got) == [("p1", "t1", "arg", "/r/t1/x"), ("p2", "t3", "cwd", "/r/t2"), ("p3", "t1", "command", "/r/t1/x")]


def test_claims_are_checked(spark):
    from lodestrand.operators import verify

    df = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    claims = df([("c1", "f", "a.c", 10, "g", None, "t"), ("c2", "f", "a.c", 99, "h", "checks", "t"), ("c3", "z", "b.c", None, None, None, None)], "claim_id string, caller string, file string, line int, callee string, behaviour string, task_id string")
    got = verify.verdicts(
        claims, df([("a.c", 50), ("a.c", 20), (None, 3)], "file string, line int"), df([("f", "g"), ("f", "g"), ("g", "k")], "caller string, callee string"), df([("h", "checks", False)], "callee string, behaviour string, shown boolean"),
        df([("c1", "g", "k"), ("c2", "g", "x")], "claim_id string, caller string, callee string"), df([("t", "g"), ("t", "g")], "task_id string, callee string"))
    assert rows(got) == [("c1", "pass", "pass", "skipped", "pass", "pass", True), ("c2", "fail", "fail", "fail", "fail", "fail", False), ("c3", "skipped", "skipped", "skipped", "skipped", "skipped", True)]
