"""Problem 2."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from lodestrand.operators import intervals as I


def brute(rows):
    out = []
    for k in {r[0] for r in rows if r[0] is not None}:
        found = []
        for a, b in sorted((a, b) for x, a, b in rows if x == k and a is not None and b is not None and b >= a):
            if found and a <= found[-1][1]:
                found[-1][1] = max(found[-1][1], b)
            else:
                found.append([a, b])
        out += [(k, "period", *p) for p in found] + [(k, "gap", p[1], q[0]) for p, q in zip(found, found[1:], strict=False)]
    return sorted(out)


def run(spark, rows, chunk=100):
    df = spark.createDataFrame(rows, "k string, a long, b long").repartition(5)
    return sorted(tuple(r) for r in I.periods_and_gaps(df, "k", "a", "b", chunk).collect())


def test_random_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        a = rnd.randrange(0, 20_000)
        rows.append((rnd.choice("xyz"), a, a + rnd.choice([0, 1, 3, 10, 50, 700, 3000 if i % 50 == 0 else 5])))
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [("a", 0, 10), ("a", 0, 10), ("a", 10, 20), ("a", 5, 3), (None, 0, 1), ("a", None, 4), ("a", 7, None), ("b", 5, 5), ("c", 0, 1000), ("c", 10, 20), ("c", 1001, 1002), ("d", -5, -1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [("x", 1, 2)][:0] or [("n", None, None)]) == []


def test_leaves_are_merged_before_the_shuffle(monkeypatch):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), a := rnd.randrange(-500, 5000), a + rnd.choice([0, 1, 40])) for _ in range(900)]
    monkeypatch.setattr(I, "LEAF_ROWS", 400)
    batch = I.pa.RecordBatch.from_pylist([dict(zip(("_k", "_a", "_b"), r, strict=True)) for r in rows])
    out = [x for part in I._leaves(100)(iter([batch.slice(0, 450), batch.slice(450)])) for x in part.to_pylist()]
    for part in out:
        assert all(a // 100 == part["_c"] for a in part["_l"]["s"]) and all(e < s for e, s in zip(part["_l"]["e"], part["_l"]["s"][1:], strict=False))
    assert len(out) < 450 and brute([(p["_k"], a, b) for p in out for a, b in zip(p["_l"]["s"], p["_l"]["e"], strict=True)]) == brute(rows)


def test_hot_entity_over_many_chunks(spark):
    rows = [("hot", i * 10, i * 10 + (11 if i % 7 else 3)) for i in range(3000)] + [("cold", 1, 2)]
    assert run(spark, rows) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=30))
def test_linear_merge(pairs):
    starts = np.array([a for a, _ in pairs])
    ends = np.array([a + n for a, n in pairs])
    s, e = I._linear_merge(starts, ends)
    want = [(x[2], x[3]) for x in brute([("k", a, a + n) for a, n in pairs]) if x[1] == "period"]
    assert sorted(zip(s.tolist(), e.tolist(), strict=True)) == sorted(want)
