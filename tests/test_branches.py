"""G21."""

from lodestrand.functions.branches import branch_contexts


def test_arms_of_if_and_switch():
    src = """void f(int a) {
  start(a);
  if (check(a)) { one(); }
  else if (a > 2) two();
  else { three(); if (x) deep(); }
  switch (kind(a)) {
    case 1: four(); break;
    default: five();
  }
  end();
}
"""
    got = {name: path for name, _, path in branch_contexts(src)}
    assert got["start"] == "" and got["end"] == "" and got["check"] == "" and got["kind"] == ""
    assert got["one"] == "1/then" and got["two"] == "1/else1" and got["three"] == "1/else2"
    assert got["deep"].startswith("1/else2>2/then")
    assert got["four"] == "3/case 1" and got["five"] == "3/default"
    assert branch_contexts("") == [] and branch_contexts("if (") == [] and branch_contexts("} ; else") == []
