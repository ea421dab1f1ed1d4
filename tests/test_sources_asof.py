"""Databases and text dates as sources of bars, and the last value on or before a time."""

import bisect
import datetime
import random

import pytest
from pyspark.sql import functions as F

from swingkit.operators.asof import as_of
from swingkit.plans import reports
from swingkit.sources import bars as source


@pytest.mark.parametrize("kind", ["VARCHAR(30)", "DATE", "TIMESTAMP"])
def test_bars_of_a_database(spark, kind):
    """An embedded database: several ranges of time at once, with symbols and dates in their statements."""
    url = f"jdbc:derby:memory:bars_{kind[:4].lower()};create=true"
    db = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    step = db.createStatement()
    step.execute(f'CREATE TABLE history ("symbol" VARCHAR(9), "time" {kind}, "open" DOUBLE, "high" DOUBLE, "low" DOUBLE, "close" DOUBLE, "volume" BIGINT)')
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=7 * i) for i in range(60)]
    clock = " 00:00:00" if kind == "TIMESTAMP" else ""
    for s in ("A", "B", "O'K"):
        quoted = s.replace("'", "''")
        step.execute("INSERT INTO history VALUES " + ", ".join(f"('{quoted}', '{d}{clock}', 1.5, 2, 1, {i}, 10)" for i, d in enumerate(days)))
    step.execute("INSERT INTO history VALUES ('A', NULL, 1, 2, 1, 1, 10)")
    got = source.load_bars_jdbc(spark, url, "history", parts=5)
    assert got.rdd.getNumPartitions() == 5 and got.count() == 181 and got.filter("date is null").count() == 1
    some = source.load_bars_jdbc(spark, url, "history", ["A", "O'K"], "2020-03-01", str(days[20]), parts=4)
    want = sorted((s, d, float(i)) for s in ("A", "O'K") for i, d in enumerate(days) if datetime.date(2020, 3, 1) <= d <= days[20])
    assert sorted((r.symbol, r.date, r.close) for r in some.collect()) == want
    plan = some._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters", 1)[1]
    assert "In(symbol" in pushed and "GreaterThanOrEqual(time" in pushed and "Less" in pushed
    step.execute("DELETE FROM history")
    assert source.load_bars_jdbc(spark, url, "history").count() == 0
    db.close()


def test_a_text_date_reaches_the_scan(spark, tmp_path):
    rows = [("A", f"2020-01-{d:02}{t}", 1.0, 1.0, 1.0, 1.0, 1) for d in range(1, 29) for t in ("", " 09:30:00")]
    spark.createDataFrame(rows, "symbol string, date string, open double, high double, low double, close double, volume bigint").write.parquet(str(tmp_path / "b"))
    some = source.load_bars(spark, str(tmp_path / "b"), ["A"], "2020-01-05", "2020-01-06")
    assert [(r.date.day) for r in some.orderBy("date").collect()] == [5, 5, 6, 6]
    pushed = some._jdf.queryExecution().executedPlan().toString().split("PushedFilters", 1)[1]
    assert "GreaterThanOrEqual(date,2020-01-05" in pushed and "Less" in pushed


@pytest.mark.parametrize("cells", [1, 3, 64])
def test_last_value_on_or_before(spark, cells):
    rng, begin = random.Random(cells), datetime.datetime(2020, 1, 1)
    moment = lambda: begin + datetime.timedelta(seconds=rng.randint(0, 10**6), microseconds=rng.randint(0, 1) * 500_000)
    series = sorted((moment(), float(i)) for i in range(300)) + [(begin, None), (None, 1.0)]
    asked = [(moment() - datetime.timedelta(days=1), i, "x") for i in range(500)] + [(series[7][0], -1, "x"), (None, -2, "x"), (begin + datetime.timedelta(days=99), -3, "x")]
    got = as_of(spark.createDataFrame(asked, "at timestamp, n int, _value string"), spark.createDataFrame(series, "at timestamp, v double"), "at", "v", cells)
    known = sorted((t, v) for t, v in series if t and v is not None)
    times = [t for t, _ in known]
    want = {n: known[bisect.bisect_right(times, t) - 1][1] if t and bisect.bisect_right(times, t) else None for t, n, _ in asked}
    assert {r.n: r.v for r in got.collect()} == want
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    empty = as_of(spark.createDataFrame(asked[:3], "at timestamp, n int, _value string"), spark.createDataFrame([], "at timestamp, v double"), "at", "v", cells)
    assert [r.v for r in empty.collect()] == [None] * 3


def test_regime_of_timestamps(spark):
    months = [datetime.date(2018 + k // 12, k % 12 + 1, 28) for k in range(48)]
    index = spark.createDataFrame([(d, float(100 + (k if k < 30 else 60 - k))) for k, d in enumerate(months)], "date date, close double")
    asked = [("a", datetime.datetime(2020, 3, 1, 12)), ("b", datetime.datetime(2021, 12, 30, 1)), ("c", datetime.datetime(2018, 5, 1)), ("d", None)]
    frame = spark.createDataFrame(asked, "pattern_id string, seen timestamp")
    found = reports.with_regime(frame, index, "seen")
    assert {r.pattern_id: r.market_regime for r in found.collect()} == {"a": "bull", "b": "bear", "c": None, "d": None}
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString() and F is not None
