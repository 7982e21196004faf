"""Sequential text functions, line sources and path resolution."""

import json

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.sources import lines, paths


def test_arguments():
    assert T.split_arguments("a, f(b, c), p->q, {1, 2}, ") == ["a", "f(b, c)", "p->q", "{1, 2}"]
    assert T.split_arguments("") == []
    src = "int x;\n  obj->copy(a,\n     g(b, (c)));\n// copy(no)\ndone();\n" + "\n" * 20 + "copy(late);"
    assert T.call_arguments(src, 2, "Ns::copy") == ["a", "g(b, (c))"] and T.call_arguments(src, 4, "copy") == ["a", "g(b, (c))"] and T.call_arguments(src, 1, "nope") is None
    assert T.call_arguments(src, 26, "copy") == ["late"] and T.call_arguments(src, 14, "copy") is None and T.call_arguments(src, 0, "copy") == ["a", "g(b, (c))"] and T.call_arguments("f(", 1, "f") is None


def test_extract_json():
    ok = lambda s, **k: T.extract_json(s, **k)
    assert ok('x ```json\n{"a": 1}\n``` y') == ('{"a": 1}', "fence")
    assert ok('see {"a": [1, 2,],} end') == ('{"a": [1, 2]}', "comma")
    assert ok('{“a”: 1}')[0] == '{"a": 1}'
    assert ok('{"a": {"b": [1, 2')[0] == '{"a": {"b": [1, 2]}}'
    assert ok('{"p": "c:\\x"}')[1] == "backslash"
    assert ok('{"b": 1} {"a": 2}', required="a")[0] == '{"a": 2}'
    assert ok("[1]", kind="array")[0] == "[1]" and ok("[1]") == (None, "none") and ok("") == (None, "none")


def test_code_scanners():
    src = '// void no() {}\nstatic int add(int a, char *s)\n{\n  if (a) { return f("}", a); }\n  return 0;\n}\nclass B : public A, C { };\nvoid N::g() { add(1, h(2)); }\n'
    assert [(n, a, b) for n, _, a, b in T.functions_in(src)] == [("add", 2, 6), ("N::g", 8, 8)]
    assert T.classes_in(src) == [("B", "A"), ("B", "C")]
    assert T.calls_in(src) == [("f", 4), ("add", 8), ("h", 8)]
    assert T.functions_in("") == [] and T.functions_in("int f() {") == [("f", "int f()", 1, 1)]


def test_tables_and_lists():
    md = "# 需要跟入的函数调用\n| 序号 | 函数名 | 行号 |\n|---|---|---|\n| 1 | `foo` | 3 |\n| 2 | bar | ❌ |\n# other\n| x | baz |\n"
    assert T.callee_table(md) == [("foo", "", '{"序号": "1", "函数名": "foo", "行号": "3"}')]
    md = "## Callee\n| Func | Params |\n|--|--|\n| a(x, y) | p |\n| b(q) | none |\n| std::memcpy | n |\n"
    assert [r[:2] for r in T.callee_table(md)] == [("a", "p")]
    assert T.tainted_list("###\nfoo # c\n@taintvar a\n@taintvar b\n###\nbar\n") == [("foo", "a"), ("foo", "b")]


def test_forked_paths():
    step = lambda line, group, arm, *t: {"line": line, "group": group, "arm": arm, "targets": list(t)}
    assert list(T.forked_paths([step(2, "", "", "b"), step(1, "", "", "a")])) == [["a", "b"]]
    assert list(T.forked_paths([step(1, "g", "1", "a"), step(2, "g", "2", "b"), step(3, "", "", "c", "d"), step(4, "", "")])) == [["a", "c"], ["a", "d"], ["b", "c"], ["b", "d"]]
    assert list(T.forked_paths([])) == [[]]


def test_line_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type":"session","timestamp":"1"}\n{"type":"x","timestamp":"3"}\nbad\n\n5\n{"timestamp":"2"}')
    got = lines.read_lines(spark, str(tmp_path / "s.jsonl"))
    assert [r["at"] for r in lines.timeline(got).collect()] == ["3", "2", "1"]
    assert [r["kind"] for r in lines.session_lines(got).orderBy("line_no").collect()] == ["header", "event", "raw", "raw", "raw", "event"]
    assert [r["line_no"] for r in lines.tail(got, "file", 2).orderBy("line_no").collect()] == [5, 6]
    m = spark.createDataFrame([('# HELP x',), ('x{a="1",b="q\\"r"} 2.5 1700000000',), ("y 3",), ('z_bucket{le="+Inf"} +Inf',), ("bad nan?",), ("",)], "line string")
    assert sorted((r["name"], r["labels"], r["value"]) for r in lines.metric_samples(m).collect()) == [("x", {"a": "1", "b": 'q"r'}, 2.5), ("y", {}, 3.0), ("z_bucket", {"le": "+Inf"}, float("inf"))]
    out = spark.createDataFrame([("a\"b", 1.0)], "k string, v double")
    lines.write_metric_text(out, "m", "v", ["k"], str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == 'm{k="a\\"b"} 1.000000'
    lines.append_jsonl(out, str(tmp_path / "j"))
    lines.append_jsonl(out, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"k": 'a"b', "v": 1.0}
    code = spark.createDataFrame([("f", '#include <a.h>\n#include "b.h"\nx')], "k string, t string")
    assert sorted(r["header"] for r in lines.includes(lines.text_lines(code, "k", "t"), "k").collect()) == ["a.h", "b.h"]
    assert lines.body_slice(lines.text_lines(code, "k", "t"), "k", F.lit(2), F.lit(3)).first()["body"] == '   2 | #include "b.h"\n   3 | x'


def test_paths():
    assert paths.latest_epoch(["epoch_2", "epoch_10", "x"]) == "epoch_10" and paths.latest_epoch([]) is None
    order = paths.result_candidates("/r", ["e1", "e12", "e2"], run_first=True, name="g")
    assert order == ["/r/run/e12/g", "/r/run/e2/g", "/r/run/e1/g", "/r/output/g"]
    assert paths.first_existing(order, lambda p: "output" in p) == "/r/output/g"


def test_metric_labels_are_unescaped_and_the_last_counts(spark):
    line = 'x{a="1",b="c:\\\\new\\n\\"q\\"",a="2",a="3"} 1'
    got = lines.metric_samples(spark.createDataFrame([(line,)], "line string")).first()
    assert got["labels"] == {"a": "3", "b": 'c:\\new\n"q"'}


def test_reviews_and_summaries():
    assert T.review("<think>## 评分: 90</think>## 评分：75\n## 通过：否\n## Feedback\nbad\n\n## 改进指令\nfix") == (False, 75, "bad", "fix")
    assert T.review("## Score = 61") == (True, 61, "## Score = 61", "") and T.review("## score: 999")[1] == 100
    assert T.review('so: {"pass": true, "score": 12, "feedback": null}') == (True, 12, "", "")
    assert T.review("about 80/100") == (True, 80, "about 80/100", "") and T.review("得 65分")[:2] == (False, 65) and T.review("") == (False, 0, "", "")
    assert T.verdict_summary("## Best Worker: worker-3\n## Overall Pass: yes\n## Reasoning\nfast") == ("worker-3", True, "fast")
    assert T.verdict_summary('{"best_worker": "worker-2", "pass": true}') == ("worker-2", True, "") and T.verdict_summary("worker-7 胜出")[0] == "worker-7" and T.verdict_summary("none")[0] == ""


def test_apply_gives_rows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "PART", 3)
    df = spark.createDataFrame([(1, "5"), (2, "0"), (3, None), (4, "4")], "k int, n string")
    got = T.apply(df, ["k"], "n", lambda s: ((j,) for j in range(int(s))), "j int")
    assert sorted(map(tuple, got.collect())) == [(1, j) for j in range(5)] + [(4, j) for j in range(4)]
