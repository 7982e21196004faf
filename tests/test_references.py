"""Problem 4."""

from datetime import datetime

from pyspark.sql import functions as F

from lodestrand.functions.keys import func_key, plain_key
from lodestrand.operators import references as R


def at(day):
    return datetime(2024, 1, day)


def build(spark, edges, functions, deleted):
    e = spark.createDataFrame(edges, "edge_id string, target string, loaded_at timestamp, _key int")
    f = spark.createDataFrame(functions, "func_id string, loaded_at timestamp")
    d = spark.createDataFrame(deleted, "record_key string, deleted_at timestamp")
    live = R.live_keys(f, func_key("func_id"), d, func_key("record_key"))
    return [R.Reference("edges", "target", e, func_key("target"), F.col("edge_id"), plain_key("target"), live)]


EDGES = [
    ("e1", "A", at(1), 1), ("e1", "A", at(1), 2), ("e2", " 0xb ", at(2), 1), ("e3", None, at(3), 1), ("e4", "  ", at(3), 1), ("e5", "gone", at(4), 1),
    ("e6", "back", at(5), 1), ("e7", "ZZ", at(6), 1), ("e8", "nulltime", at(6), 1),
]
FUNCTIONS = [("a", at(1)), ("0xB", at(1)), ("gone", at(1)), ("gone", at(2)), ("back", at(1)), ("back", at(9)), ("nulltime", None), (None, at(1))]
DELETED = [("GONE", at(3)), ("back", at(5)), ("never", at(5)), (None, None), ("nulltime", at(1))]
WANT = {("edges", "target", "e5", "gone"), ("edges", "target", "e7", "zz"), ("edges", "target", "e8", "nulltime")}


def test_found(spark):
    for heavy in (1, 2, 500):
        got = [tuple(r) for r in R.found(build(spark, EDGES, FUNCTIONS, DELETED), heavy).collect()]
        assert len(got) == len(set(got)) and set(got) == WANT


def test_counts(spark):
    got = [tuple(r) for r in R.counted(build(spark, EDGES, FUNCTIONS, DELETED)).collect()]
    assert got == [("edges", "target", "2024-01", 3, 3)]


def test_hot_key_is_split_off(spark):
    edges = [(f"h{k}", "hot", at(1 + k % 3), 0) for k in range(3000)] + [(f"c{k}", f"k{k}", at(1), 0) for k in range(500)]
    refs = build(spark, edges, [(f"k{k}", at(1)) for k in range(0, 500, 2)], [("x", at(1))])
    assert R.found(refs, 50).count() == 3000 + 250


def test_empty_tables(spark):
    refs = build(spark, EDGES, FUNCTIONS, DELETED)
    empty = [R.Reference(r.ref_table, r.ref_field, r.rows.limit(0), r.key, r.ref_key, r.missing_key, r.live) for r in refs]
    assert R.found(empty).count() == 0
    none = [R.Reference(r.ref_table, r.ref_field, r.rows, r.key, r.ref_key, r.missing_key, r.live.limit(0)) for r in refs]
    assert R.found(none).count() == 6
