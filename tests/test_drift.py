"""Problem 5."""

import json
from datetime import datetime

from lodestrand.operators import drift as D

T0 = datetime(2024, 1, 1)


def dag(**x):
    return {"taint_signature": "a", "self_contained": True, "nodes": [{"id": 0, "line": 1}], "edges": [{"from": 0, "to": 1, "taint": "a"}, {"from": 1, "to": None, "taint": "b"}], **x}


def changes(spark, versions, case=1):
    rows = [(k, case, v, "f", body if body is None or isinstance(body, str) else json.dumps(body), T0, 5) for k, (v, body) in enumerate(versions)]
    df = spark.createDataFrame(rows, "file_id long, case_id long, case_version int, file_path string, body string, loaded_at timestamp, profile int")
    return sorted(tuple(r)[1:] for r in D.changes(df).collect())


def test_retyped_renamed_added_gone(spark):
    a = dag()
    b = dag(self_contained=1)
    c = {("selfContained" if k == "self_contained" else k): v for k, v in dag(gap="G").items()}
    c["edges"] = [{"from_node": x["from"], "to": x["to"], "taints": [x["taint"]]} for x in a["edges"]]
    got = changes(spark, [(1, a), (2, b), (3, "{broken"), (5, c), (6, {k: v for k, v in c.items() if k != "gap"}), (6, c["gap"])])
    assert got == sorted([
        (2, "dag", "self_contained", "self_contained", "boolean", "number"),
        (5, "dag", "self_contained", "selfContained", "number", "boolean"),
        (5, "dag", "", "gap", "", "string"),
        (5, "edges", "from", "from_node", "number", "number"),
        (5, "edges", "taint", "taints", "string", "array<string>"),
        (6, "dag", "gap", "", "string", ""),
    ])


def test_analyze_keys_rename_by_function(spark):
    a = {"analyze_A": dag(), "analyze_B": dag(taint_signature="q"), "note": "n"}
    b = {"analyze_A_taint_a": dag(), "analyze_B": dag(taint_signature="q"), "design_note": "n"}
    assert changes(spark, [(1, a), (2, b)]) == sorted([
        (2, "file", "analyze_A", "analyze_A_taint_a", "object", "object"), (2, "file", "note", "design_note", "string", "string")])


def test_nothing_to_report(spark):
    assert changes(spark, [(1, None), (2, ""), (3, "[]"), (4, "5"), (5, dag())]) == []
    assert changes(spark, [(1, dag()), (2, dag()), (2, dag())]) == []
    df = spark.createDataFrame([], "file_id long, case_id long, case_version int, body string, loaded_at timestamp")
    assert D.changes(df).count() == 0


def test_many_versions_cross_buckets(spark):
    versions = [(k * 100, dag(x="1") if k % 2 else dag()) for k in range(1, 40)]
    assert len(changes(spark, versions)) == 38


def test_canonical():
    same = [(True, 1), ("true", True), (12, "12"), (["x"], "x"), ([{"param": "p", "taint": "x"}], ["p=x"]), (None, []), ({}, "")]
    assert all(D.canonical(a) == D.canonical(b) for a, b in same)
    assert D.canonical(["a", "b"]) != D.canonical("ab")
    assert D.tag([1, "a"]) == "array<number>|array<string>" and D.tag([]) is None


def test_facts_have_one_name_and_typed_branches(spark):
    a = dag()
    b = {("selfContained" if k == "self_contained" else k): v for k, v in dag(self_contained="true").items()}
    b["edges"] = [{"from": str(x["from"]), "to": x["to"], "taint": [x["taint"]]} for x in a["edges"]]
    rows = [(1, 1, 1, json.dumps(a), T0), (2, 1, 2, json.dumps(b), T0), (3, 1, 2, "{", T0), (4, 1, 2, None, T0)]
    df = spark.createDataFrame(rows, "file_id long, case_id long, case_version int, body string, loaded_at timestamp")
    got = D.facts(df).collect()
    flags = {r["case_version"]: r for r in got if r["obj_level"] == "dag" and "elf" in r["field"]}
    assert len({r["field"] for r in flags.values()}) == 1 and {r["value"] for r in flags.values()} == {"1"}
    assert flags[1]["flag_value"] is True and flags[2]["text_value"] == "true" and flags[2]["flag_value"] is None
    taints = [r for r in got if r["obj_level"] == "edges" and r["field"] == "taint" and r["obj_no"] == 0]
    assert {(r["type_tag"], r["value"]) for r in taints} == {("string", "a"), ("array<string>", "a")}
    assert D.facts(df.limit(0)).count() == 0


def test_facts_take_the_latest_object_body_and_loose_elements(spark):
    late = datetime(2024, 1, 2)
    bodies = [(1, 1, json.dumps(dag(gap="old")), T0), *[(k, 1, body, late) for k, body in enumerate(("null", "[]", '"text"', "3"), 2)],
              (6, 2, '{"weight": NaN, "gap": "x"}', T0), (7, 3, '{"nodes": [7, {"id": 1}, "n"], "edges": "none"}', T0)]
    df = spark.createDataFrame([(k, 1, v, body, at) for k, v, body, at in bodies], "file_id long, case_id long, case_version int, body string, loaded_at timestamp")
    got = {(r["case_version"], r["obj_level"], r["field"], r["obj_no"]): r["value"] for r in D.facts(df).collect()}
    assert got[1, "dag", "gap", 0] == "old" and got[2, "dag", "gap", 0] == "x" and (2, "dag", "weight", 0) in got
    assert {k: v for k, v in got.items() if k[0] == 3} == {
        (3, "nodes", "", 0): "7", (3, "nodes", "", 2): "n", (3, "nodes", "id", 0): "1", (3, "dag", "edges", 0): "none"}


def test_nested_changes_and_exact_objects(spark):
    a = dag(meta={"b": 1, "deep": [{"x": {"y": 2}}]}, gone={"k": 1})
    b = dag(meta={"b": "t", "deep": [{"x": {"y": "2", "z": None}}]})
    rows = [(k, 1, k, json.dumps(x), T0) for k, x in enumerate((a, b), 1)]
    df = spark.createDataFrame(rows, "file_id long, case_id long, case_version int, body string, loaded_at timestamp")
    assert sorted(tuple(r)[2:] for r in D.nested_changes(df).collect()) == [
        ("dag.meta", "b", "b", "number", "string"), ("dag.meta.deep[].x", "", "z", "", ""), ("dag.meta.deep[].x", "y", "y", "number", "string")]
    assert sorted(tuple(r)[2:] for r in D.changes(df).collect()) == [("dag", "gone", "", "object", "")]
    got = {(r["case_version"], r["field"]): r["json_value"] for r in D.facts(df).collect() if r["obj_level"] == "dag"}
    assert json.loads(got[1, "meta"]) == a["meta"] and got[1, "taint_signature"] is None


def test_weak_values_are_renamed_only_if_nothing_else_fits(spark):
    old = dag(edges=[{"to": 0}, {"to": 1}])
    new = dag(edges=[{"dst": "0"}, {"dst": "1"}])
    assert changes(spark, [(1, old), (2, new)]) == [(2, "edges", "to", "dst", "number", "string")]
    two = dag(edges=[{"dst": "0", "alt": "0"}, {"dst": "1", "alt": "1"}])
    assert len(changes(spark, [(1, old), (2, two)])) == 3
    same = dag(edges=[{"dst": "1"}, {"dst": "1"}])
    assert len(changes(spark, [(1, dag(edges=[{"to": 1}, {"to": 1}])), (2, same)])) == 2


def test_names_of_a_chain_of_renames(spark):
    rows = [(k, 1, k, json.dumps(dag(**{f"name{k}": "some text"})), T0) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "file_id long, case_id long, case_version int, body string, loaded_at timestamp")
    got = {r["field"] for r in D.facts(df).collect() if r["value"] == "some text"}
    assert got == {"name1"}
