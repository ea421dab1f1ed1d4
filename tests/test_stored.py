"""Rows that a plan needs twice are worked out once, and the quick way of rounding is the slow one's."""

import datetime

import pytest
from pyspark.sql import functions as F

from swingkit.operators import barlocal, cups_pipes
from swingkit.plans.base import rounded

DAY = datetime.date(2000, 1, 3)


def some_bars(spark, rows):
    return spark.createDataFrame([("A", k, DAY + datetime.timedelta(days=k), o, h, l, c, 1.0) for k, (o, h, l, c) in enumerate(rows)], "symbol string, idx int, date date, open double, high double, low double, close double, volume_ratio double")


def test_a_search_of_breakouts_works_out_its_rows_once(spark):
    bars = some_bars(spark, [(10.0 + k, 10.0 + k, 10.0 + k, 10.0 + k) for k in range(40)])
    seen = spark.sparkContext.accumulator(0)

    def level(k):
        seen.add(1)
        return 12.0 + k

    found = spark.createDataFrame([(f"p{k}", "A", k) for k in range(5)], "id string, symbol string, end_idx int").withColumn("level", F.udf(level, "double")("end_idx"))
    got = cups_pipes.confirmed_breakout(found, bars, "id", 10, cups_pipes.Breakout()).collect()
    assert {r.id: r.hit.idx for r in got} == {f"p{k}": k + 3 for k in range(5)}
    assert seen.value == 5


@pytest.mark.parametrize("height", [(None, None), (0.0, 1e9)])
def test_islands_that_begin_flat_end_behind_their_first_move(spark, height):
    """The gap right behind a flat bar ends no island; with and without limits of height the same islands are found."""
    flat = lambda p: (p, p, p, p)
    rows = [flat(100.0), flat(110.0), flat(100.0), flat(100.0), flat(110.0), (110.0, 112.0, 109.0, 111.0), flat(100.0), flat(101.0), (105.0, 106.0, 104.0, 105.0), flat(100.0)]
    got = sorted(tuple(r.pivot_indices) for r in barlocal.islands(some_bars(spark, rows), height=height).collect())
    gap = {k: "up" if rows[k][2] > rows[k - 1][1] * 1.005 else "down" if rows[k][1] < rows[k - 1][2] * 0.995 else None for k in range(1, len(rows))}
    want, at = [], 1
    while at < len(rows):
        ends = [j for j in range(at + 1, min(at + 20, len(rows))) if gap[at] and gap[j] and gap[j] != gap[at] and max(r[1] for r in rows[at:j]) > min(r[2] for r in rows[at:j])]
        if ends:
            want.append((at, ends[0]))
        at = ends[0] + 1 if ends else at + 1
    assert got == want and want


def test_rounding(spark):
    values = [0.0, -0.0, 0.1, 100.01, -3.07, 1.0000000005, 2.0000000015, 1 / 3, -2 / 3, 1e15 / 7, 123456.785, 1e-9, 5e-10, 1e300, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x")).cast("string").alias("a"), F.round("x", 9).cast("string").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
