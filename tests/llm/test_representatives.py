"""Problem 3."""

import random

from pyspark.sql import functions as F

from lodestrand.llm import representatives as R

SCHEMA = "rec_id long, g string, trust long, at long, line int, taint string, value string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = R.representatives(df, F.col("g"), "rec_id", ["line", "taint"], F.col("trust"), F.col("at"), **kw)
    return sorted((r["group_key"], r["first_rec_id"], r["field_name"], r["rec_id"]) for r in out.collect())


def brute(rows, least=2):
    out = []
    for g in {r[1] for r in rows if r[1] is not None}:
        own = [r for r in rows if r[1] == g]
        if len(own) >= least:
            for k, f in ((4, "line"), (5, "taint")):
                have = [r for r in own if r[k] is not None and "".join(str(r[k]).split()).lower() not in ("", "0", "[]", "{}", "null")]
                if have:
                    best = max(have, key=lambda r: (r[2] or 0, r[3] if r[3] is not None else -(2**62), r[0]))
                    out.append((g, min(r[0] for r in own), f, best[0]))
    return sorted(out)


def rows_of(rnd, n, groups, values):
    return [
        (k, rnd.choice(groups), rnd.choice([None, 0, 1, 4]), rnd.choice([None, 5, 6, 7]), rnd.choice([None, 0, 3, 9]), rnd.choice(values), "x") for k in range(n)
    ]


def test_random_groups(spark):
    rnd = random.Random(1)
    rows = rows_of(rnd, 800, [None, *map(str, range(200))], [None, "", " ", "null", "[]", "{ }", "a b", "a c", "len"])
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least_records=1) == brute(rows, 1)


def test_hot_group_is_reduced_in_rounds(spark):
    rnd = random.Random(2)
    rows = rows_of(rnd, 3000, ["hot", "hot", "a", "b"], [f"value {k}" for k in range(900)])
    assert run(spark, rows, fan_in=8) == brute(rows)


def test_empty(spark):
    assert run(spark, rows_of(random.Random(0), 3, ["a"], ["x"])[:0] or [(1, None, 1, 1, 1, "x", "x")]) == []


def test_consensus_votes_by_token():
    votes = [("check len < 64", 1), ("check len < 128", 2), ("check size < 128", 1)]
    assert " ".join(R.consensus(votes)) == "check len < 128"
    assert R.closest([("abc def", 1), ("abc def ghi", 1), ("abc ghi", 1)]) == 1
    assert R.closest([("low", 1), ("mid x", 2), ("top y z", 4)]) == 2


def test_very_long_values():
    a, b = "x " * 60_000, "x " * 59_999 + "y "
    assert R.closest([(a, 1), (b, 2)]) == 1


def test_a_node_without_any_value_keeps_its_record(spark, tmp_path):
    from lodestrand.llm import queries

    rows = [(1, "f", "t", 1, 0, "", "[]", "null", "k"), (2, "0xF", "t", 1, None, " ", None, "{}", "k"), (3, "f", "t", 2, 7, "x", None, None, "k")]
    spark.createDataFrame(
        [(*r, None, None) for r in rows],
        "rec_id long, func_id string, taint_signature string, node_id int, line int, taint string, checks_json string, prune_json string, task_id string, written_by string, written_at timestamp",
    ).write.parquet(f"{tmp_path}/dag_nodes.parquet")
    spark.createDataFrame([("w", 1)], "writer string, trust int").write.parquet(f"{tmp_path}/writers.parquet")
    got = sorted(tuple(r) for r in queries.p3_survivors(spark, str(tmp_path)).select("first_rec_id", *queries.FIELDS).collect())
    assert got == [(1, None, None, None, None), (3, "7", "x", None, None)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_and_alignment_are_exact_at_any_length():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        assert R.distance(a, b) == plain_distance(a, b)
    a, b = ([rnd.choice("abcdefgh") for _ in range(n)] for n in (2100, 2300))  # more than 4 million cells
    assert R.distance(a, b) == plain_distance(a, b)
    one, two = ([{t: 1} for t in x] for x in (a, b))
    pairs = R.merge(one, 1, two, 1)
    kept = sum(1 for c in pairs if 2 in c.values())
    # an alignment of least cost: every column that does not agree costs one
    assert [t for c in pairs for t, w in c.items() if t is not None].count(None) == 0 and len(pairs) - kept == R.distance(a, b)


def test_majority_needs_no_alignment(monkeypatch):
    monkeypatch.setattr(R, "consensus", lambda w: 1 / 0)
    assert R.closest([("a b", 2), ("c d", 3), ("e", 0)]) == 1


def test_planted_majorities(spark):
    """Each group has one true value; every record but a few garble one token of it; no record has a majority."""
    rnd, rows, want = random.Random(6), [], {}
    for g in range(60):
        true = [f"w{rnd.randint(0, 99)}" for _ in range(9)]
        own = [(len(rows) + k, str(g), 1, 1, None, " ".join(true), "x") for k in range(2)]
        for k in range(2, 9 if g else 120):
            bad = list(true)
            bad[rnd.randrange(9)] = f"noise{k}"
            own.append((len(rows) + k, str(g), 1, 1, None, " ".join(bad), "x"))
        rows += own
        want[str(g)] = " ".join(true)
    df = spark.createDataFrame(rows, SCHEMA)
    for fan_in in (4, 32):  # with 4, all groups go through profiles; with 32, the group of 119 values does
        got = R.representatives(df, F.col("g"), "rec_id", ["taint"], F.col("trust"), F.col("at"), weighting="votes", fan_in=fan_in)
        assert {r["group_key"]: r["value"] for r in got.collect()} == want


def test_votes_of_a_hot_group_are_all_counted(spark):
    """Forty values of one record each differ in the second token; the first token's votes are spread over all buckets."""
    rows = [(k, "g", 1, 1, None, f"{'left' if k % 5 < 3 else 'right'} v{k}", "x") for k in range(40)] + [(99, "g", 1, 1, None, "left", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = R.representatives(df, F.col("g"), "rec_id", ["taint"], F.col("trust"), F.col("at"), weighting="votes", fan_in=4).collect()
    assert len(got) == 1 and got[0]["value"].startswith("left")


def test_precedence_goes_by_alignment_vote_and_distance(monkeypatch):
    """p3_found's winners come from the consensus: each step runs, and another vote or another distance gives another winner."""
    import pyarrow as pa

    values = [("check len < 64", 1), ("check len <= 128", 3), ("test size", 2)]
    items = [{"value": v, "rank": {"t": 0, "w": 5, "i": i}, "votes": 1} for v, i in values]
    kind = pa.list_(pa.struct([("value", pa.string()), ("rank", pa.struct([(k, pa.int64()) for k in "twi"])), ("votes", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["g", "h"]), pa.array([items, items[:1]], kind)], ["g", "items"])
    winners = lambda: next(R._reduce_batches(["g"], True)(iter([batch]))).column("value").to_pylist()
    seen = []
    for step in ("align_tokens", "ranked_vote", "distance"):
        monkeypatch.setattr(R, step, lambda *a, _s=step, _f=getattr(R, step): seen.append(_s) or _f(*a))
    assert winners() == ["check len <= 128", "check len < 64"]
    assert seen == ["align_tokens"] * 2 + ["ranked_vote"] + ["distance"] * 3
    with monkeypatch.context() as m:
        m.setattr(R, "ranked_vote", lambda profile: ["test", "size"])
        assert winners()[0] == "test size"
    monkeypatch.setattr(R, "distance", lambda a, b: "64" not in a)
    assert winners()[0] == "check len < 64"


def test_token_alignments_cost_their_distance():
    rnd = random.Random(5)
    for n in [*rnd.choices(range(15), k=500), 3000]:
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(n // 2, n))] for _ in range(2))
        pairs = R.align_tokens(a, b)
        for side, whole in enumerate((a, b)):
            assert [p[side] for p in pairs if p[side] is not None] == list(range(len(whole)))
        assert sum(i is None or j is None or a[i] != b[j] for i, j in pairs) == (R.distance(a, b) if n == 3000 else plain_distance(a, b))


def test_ranked_votes_equal_votes_of_powers_of_two():
    rnd = random.Random(7)
    for _ in range(300):
        n = rnd.randint(2, 9)
        texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 7))) + " " * k for k in range(n)]
        ranked = [(t, R.weight_of({"t": rnd.randint(0, 1), "w": rnd.choice([-(2**62), 3]), "i": k or None})) for k, t in enumerate(texts)]
        order = sorted(w for _, w in ranked)
        want = R.consensus([(t, 2 ** order.index(w)) for t, w in ranked])
        assert R.ranked_vote(R.ranked_profile(ranked)[0]) == want
        one, two = R.ranked_profile(ranked[: n // 2]), R.ranked_profile(ranked[n // 2:])
        assert R.ranked_vote(R.merge_ranked(*one, *two)) == want
        assert R.closest(ranked, precedence=True) == max(range(n), key=lambda k: ranked[k][1])
    many = [(" ".join(rnd.choice("abcdefgh") for _ in range(20)), k) for k in range(300)]
    assert len(R.ranked_profile(many)[0]) < 200  # columns do not add up
