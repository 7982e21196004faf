"""Problem 8."""

from collections import Counter, defaultdict

from lodestrand.llm import mixing as M

TARGETS = "mix_id int, source string, weight double, max_repeats int, total_share double, tokens int"


def build(spark, sizes, targets):
    rows = [(k, s, n, "x") for k, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long, mix_id string"), spark.createDataFrame([(*t, 1) for t in targets], TARGETS)


SIZES = [("big", 10 + k % 7) for k in range(2000)] + [("mid", 30) for _ in range(200)] + [("small", 5) for _ in range(10)] + [(None, 9)] * 50 + [("big", 0)] * 3


def test_shares_caps_and_budget(spark):
    docs, targets = build(spark, SIZES, [(1, "big", 6.0, 1, 0.5), (1, "mid", 3.0, 2, 0.5), (1, "small", 1.0, 3, 0.5), (1, "none", 2.0, 4, 0.5), (2, "small", 1.0, 1, 1.0), (3, "big", None, 1, 1.0)])
    total = sum(n for _, n in SIZES)
    uses = M.mix(docs, targets).collect()
    again = M.mix(docs.repartition(7), targets).collect()
    assert {(r["mix_id"], r["doc_id"], r["repeat_no"]) for r in uses} == {(r["mix_id"], r["doc_id"], r["repeat_no"]) for r in again}
    spent, repeats, by = Counter(), Counter(), defaultdict(Counter)
    for r in uses:
        assert r["source"] is not None and r["tokens"] > 0
        spent[r["mix_id"]] += r["tokens"]
        repeats[(r["mix_id"], r["source"], r["doc_id"])] += 1
        by[r["mix_id"]][r["source"]] += r["tokens"]
    assert total * 0.5 - 40 <= spent[1] <= total * 0.5
    assert max(n for (m, s, _), n in repeats.items() if s == "small" and m == 1) == 3
    assert max(n for (m, s, _), n in repeats.items() if s == "mid") <= 2
    assert max(n for (m, s, _), n in repeats.items() if s == "big") == 1
    assert by[1]["small"] == 150  # all it has, three times
    assert abs(by[1]["big"] / by[1]["mid"] - 2) < 0.02  # the others keep their ratio
    assert spent[2] == 50 and 3 not in spent
    assert sorted(r["mix_upto"] for r in uses if r["mix_id"] == 1)[-1] == spent[1]


def test_against_a_plain_queue(spark):
    docs, targets = build(spark, SIZES, [(1, "big", 1.0, 2, 0.3), (1, "mid", 1.0, 2, 0.3), (1, "small", 0.5, 2, 0.3)])
    queue = M.queue_positions(docs, range_rows=100).collect()
    items = []
    for r in queue:
        for k in (1, 2):
            share = {"big": 0.4, "mid": 0.4, "small": 0.2}[r["source"]]
            items.append((((k - 1) * r["source_tokens"] + r["upto"]) / share, r["source"], r["doc_id"], k, r["tokens"]))
    budget, upto, want = int(0.3 * sum(n for _, n in SIZES)), 0, set()
    for _, source, doc, k, n in sorted(items):
        upto += n
        if upto > budget:
            break
        want.add((doc, k))
    for rows in (1, 50, 100_000):
        assert {(r["doc_id"], r["repeat_no"]) for r in M.mix(docs, targets, range_rows=rows).collect()} == want


def test_report_and_empty(spark):
    docs, targets = build(spark, SIZES, [(1, "big", 1.0, 1, 0.1), (1, "none", 3.0, 1, 0.1), (1, "bad", -1.0, 0, 0.1)])
    got = {r["source"]: r for r in M.shares(M.mix(docs, targets), targets).collect()}
    assert got["none"]["target_share"] == 0.75 and got["none"]["actual_share"] == 0 and got["bad"]["target_share"] == 0
    assert got["big"]["actual_share"] == 1.0
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0
