"""Dominance counts against pairs, with blocks of a few cells, and on odd sales."""

import datetime as dt
import random
import zlib

import pytest

from tessella.llm import dominance


def by_pairs(points):
    return {(s, v): (sum(a < s and b > v for a, b, _ in points), sum(m for a, b, m in points if a < s and b > v)) for s, v, _ in points}


CASES = {
    "signs": lambda r: (r.randrange(-2000, 70000), r.randrange(-50, 500)),
    "one slot": lambda r: (r.choice([5, r.randrange(70000)]), r.randrange(5000)),
    "one level": lambda r: (r.randrange(70000), r.choice([77, r.randrange(5000)])),
    "far apart": lambda r: (r.choice([-(1 << 61), 0, 1 << 61]) + r.randrange(9), r.choice([-(1 << 63), 0, (1 << 63) - 9]) + r.randrange(9)),
    "alone": lambda r: (3, 4),
}


@pytest.mark.parametrize("name", CASES)
def test_above(spark, monkeypatch, name):
    monkeypatch.setattr(dominance, "RANK_BITS", 4)
    monkeypatch.setattr(dominance, "CELLS", 16)
    r = random.Random(3)
    points = [(*CASES[name](r), r.randrange(1, 6)) for _ in range(500)]
    rows = dominance.above(spark.createDataFrame(points, "slot long, level long, m long")).collect()
    assert {(x.slot, x.level): (x.n_above, x.m_above) for x in rows} == by_pairs(points)
    assert len(rows) == len(by_pairs(points))


def test_odd_sales(spark):
    at = dt.datetime(2024, 3, 10, 2, 30)
    rows = [(1, at, 10.0), (2, at + dt.timedelta(seconds=59), 1.0), (3, at + dt.timedelta(minutes=1), 5.005), (3, at + dt.timedelta(minutes=1), 5.005), (None, at, 99.0), (4, None, 1.0), (5, at, None), (6, at + dt.timedelta(days=1), float("nan")), (7, dt.datetime(1969, 12, 31, 23, 59, 59), 1e300), (8, at + dt.timedelta(days=1), -3.0)]
    sales = spark.createDataFrame(rows, "sale_id long, sold_at timestamp_ntz, total double").selectExpr("*", "1 AS slot", "'x' AS level", "2 AS n", "3 AS m", "4 AS block")
    minute = int((at - dt.datetime(1970, 1, 1)).total_seconds()) // 60
    times = {i: 1 + zlib.crc32(str(i).encode()) % 5 for i in range(9)} | {None: 1}
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [tuple(r) for r in dominance.sales_above(sales).collect()]
        assert sorted(x[1:3] for x in got if x[0] == 1) == [(minute, 1000)] and next(x for x in got if x[0] == 7)[1:] == (-1, (1 << 63) - 1, 0, 0)
        assert next(x for x in got if x[0] == 3)[1:] == (minute + 1, 501, 3, times[1] + 1 + times[7]) and sum(x[0] == 3 for x in got) == 2
        assert next(x for x in got if x[0] == 8)[3:] == (7 - 1, times[1] + times[2] + 2 * times[3] + times[None] + times[7])
        assert all(x[3] is None and x[4] is None for x in got if x[0] in (4, 5, 6)) and len(got) == len(rows)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert dominance.sales_above(sales.limit(0)).count() == 0
    assert dominance.sales_above(sales.where("sale_id = 4")).collect()[0][3] is None
