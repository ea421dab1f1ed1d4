import datetime

import pytest
from pyspark.sql import functions as F

from swingkit.operators import cells, clean, pivots
from swingkit.plans import base  # noqa: F401


def walk(spark, n=6_000):
    """One symbol of ``n`` bars over 16 years, one of 300, with equal dates and repeated rows."""
    day = F.expr("date_add(date '2001-01-01', cast(id as int))")
    wave = F.round(50 + 20 * F.sin(F.col("id") / 7) + F.pmod(F.xxhash64("id"), F.lit(900)) / 100, 2)
    rows = spark.range(n).select(F.lit("long").alias("symbol"), day.alias("date"), wave.alias("open"), (wave + 2).alias("high"), (wave - 2).alias("low"), (wave + 1).alias("close"), F.pmod(F.col("id"), F.lit(37)).alias("volume"))
    return rows.union(rows.limit(300).withColumn("symbol", F.lit("short"))).union(rows.limit(2))


def same(a, b):
    rows = lambda x: sorted(map(str, (tuple(r) for r in x.select(sorted(x.columns)).collect())))
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("period", ["quarter"])
def test_positions_by_period(spark, period):
    bars = walk(spark)
    assert same(clean.clean(bars), clean.clean(bars, period=period))
    assert clean.clean(bars.limit(0), period=period).count() == 0


def test_positions_of_null_dates(spark):
    day = datetime.date
    bars = spark.createDataFrame([("a", None, 1.0), ("a", day(2001, 2, 3), 2.0), ("a", None, 3.0), (None, day(2002, 1, 1), 4.0)], "symbol string, date date, close double")
    assert sorted((r.close, r.idx) for r in cells.positioned(bars, ["close"]).collect()) == [(1.0, 0), (2.0, 2), (3.0, 1), (4.0, 0)]


@pytest.mark.parametrize("cell", [7, 500])
def test_indicators_and_pivots_in_cells(spark, cell):
    bars = clean.clean(walk(spark, 1_500))
    indicators = clean.add_indicators(bars)
    assert same(cells.in_cells(bars, clean.add_indicators, clean.REACH, 0, cell), indicators)
    for level, k in (("minor", 3), ("major", 10)):
        reach = max(k, pivots.NEARBY)
        found = pivots.pivots(indicators, level)
        assert found.count() > 20
        assert same(cells.in_cells(indicators, lambda x, level=level: pivots.pivots(x, level), reach, reach, cell), found)


def test_no_window_is_over_a_whole_symbol(spark):
    bars = clean.clean(walk(spark), period="year")
    plan = cells.in_cells(bars, clean.add_indicators, clean.REACH, 0)._jdf.queryExecution().optimizedPlan().toString()
    # Only the counts of periods meet by symbol alone.
    alone = [line for line in plan.splitlines() if "Window [" in line and "_n#" in line]
    assert len(alone) == 1 and plan.count("Window [") > 2
