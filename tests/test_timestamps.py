"""Problem 1."""

from datetime import datetime, timezone

import pytest

from lodestrand.operators import timestamps as T


def us(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    # text, zone of the task, instant
    ("2024-01-03T01:07:27Z", None, us(2024, 1, 3, 1, 7, 27)),
    ("2024-01-03T01:07:27.123456789Z", None, us(2024, 1, 3, 1, 7, 27) + 123456),
    ("2024-01-03t01:07:27z", None, us(2024, 1, 3, 1, 7, 27)),
    ("2024-01-03T10:59Z", None, us(2024, 1, 3, 10, 59)),
    ("2024-01-03T08:07:27+0800", "America/New_York", us(2024, 1, 3, 0, 7, 27)),
    ("2024-01-03T08:07:27+08", None, us(2024, 1, 3, 0, 7, 27)),
    ("2024-01-03T18:18:23+08:00[Asia/Shanghai]", None, us(2024, 1, 3, 10, 18, 23)),
    ("2024-01-03 18:18:23 Asia/Shanghai", None, us(2024, 1, 3, 10, 18, 23)),
    ("2024-01-03 01:00:00 America/New_York", None, us(2024, 1, 3, 6)),
    ("2024-07-03 12:00:00 EDT", None, us(2024, 7, 3, 16)),
    ("Fri, 01 Aug 2025 03:04:49 +0800", None, us(2025, 7, 31, 19, 4, 49)),
    ("02/Dec/2024:05:17:30 +0100", None, us(2024, 12, 2, 4, 17, 30)),
    ("20240103T142110Z", None, us(2024, 1, 3, 14, 21, 10)),
    ("2024-060T00:00:00+00:00", None, us(2024, 2, 29)),
    ("01/02/2025 12:48:31 AM", "UTC", us(2025, 1, 2, 0, 48, 31)),
    ("01/02/2025 12:48:31 PM", "UTC", us(2025, 1, 2, 12, 48, 31)),
    ("01.02.2024 11:33:39", "Europe/Berlin", us(2024, 2, 1, 10, 33, 39)),
    ("2024-01-03 03:52:25,250", "Asia/Kolkata", us(2024, 1, 2, 22, 22, 25) + 250_000),
    ("2024-01-03", "UTC", us(2024, 1, 3)),
    ("1704248766", None, 1704248766 * 10**6),
    ("1704269441.25", None, 1704269441250000),
    ("1704247107123", None, 1704247107123000),
    ("1704246839000001", None, 1704246839000001),
    ("1704246839000001999", None, 1704246839000001),
    ("0001-01-02 00:00:01", "Asia/Shanghai", -62_135_539_542_000_000),
    ("9999-12-31 23:59:59", "UTC", 253_402_300_799_000_000),
    # none
    ("2024-11-03 01:30:00 America/New_York", None, None),
    ("2024-03-10 02:30:00", "America/New_York", None),
    ("2024-10-27 02:30:00", "Europe/Berlin", None),
    ("2024-01-03 03:52:25", None, None),
    ("2024-01-03 03:52:25", "Mars/Phobos", None),
    ("2024-02-30T11:20:05Z", None, None),
    ("2025-366T00:00:00Z", None, None),
    ("2024-13-04T08:00:00+0800", None, None),
    ("2024-01-03T24:00:00Z", None, None),
    ("13/13/2024 1:00:00 AM", "UTC", None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("0", "UTC", None),
    ("9999999999", None, None),
    ("25:61:00", "UTC", None),
    ("yesterday", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 200_000, "UTC", None),
    ("2024\x01", "UTC", None),
]


@pytest.fixture(scope="module")
def clocks(spark):
    zones = sorted({z for _, z, _ in CASES if z})
    rows = [(f"T_{z}", z) for z in zones] + [("two", "UTC"), ("TWO ", "Asia/Shanghai"), (None, "UTC"), ("nil", None)]
    return spark.createDataFrame(rows, "task_id string, zone_name string")


def test_spellings(spark, clocks):
    rows = [(k, t, f"t-{z}" if z else None) for k, (t, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, raw string, task_id string")
    got = {r["id"]: r["u"] for r in T.normalise(df, {"raw": "u"}, "task_id", clocks).collect()}
    for k, (text, zone, want) in enumerate(CASES):
        assert got[k] == want, (text and text[:60], zone)


def test_task_with_two_zones_is_open(spark, clocks):
    df = spark.createDataFrame([("2024-01-03 00:00:00", "two"), ("2024-01-03 00:00:00", "nil")], "raw string, task_id string")
    assert [r["u"] for r in T.normalise(df, {"raw": "u"}, "task_id", clocks).collect()] == [None, None]


def test_found_is_distinct_skips_canonical_and_ignores_extra_columns(spark, clocks):
    rows = [("k1", "2024-01-03T00:00:00.000000Z", None, 1), ("k2", "2024-01-03T00:00:00Z", None, 1), ("k2", "2024-01-03T00:00:00Z", None, 2)]
    df = spark.createDataFrame(rows, "node_id string, started_at string, task_id string, zone_name int")
    got = T.found([("t", df, "node_id", "started_at")], clocks).collect()
    assert [tuple(r) for r in got] == [("t", "k2", us(2024, 1, 3))]
    assert T.found([("t", df.limit(0), "node_id", "started_at")], clocks.limit(0)).count() == 0


def test_day_number(spark):
    from pyspark.sql import functions as F

    df = spark.sql("select explode(sequence(date'0001-01-01', date'2400-03-01', interval 97 day)) d")
    n = T.day_number(F.year("d").cast("long"), F.month("d").cast("long"), F.dayofmonth("d").cast("long"))
    assert df.where(n != F.datediff("d", F.lit("1970-01-01").cast("date"))).count() == 0
