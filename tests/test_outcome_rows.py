"""The look-ahead hands on the rows that it is asked for, and pivots meet bars only where a level needs them."""

import datetime
import random

import pytest

from swingkit.operators import outcomes
from swingkit.plans import reports

DAY = datetime.date(2000, 1, 3)
DETECTION = "pattern_id string, symbol string, pattern_name string, pattern_type string, breakout_date date, breakout_idx int, breakout_direction string, breakout_price double, target_price double, stop_loss_price double, pivot_indices array<int>"


def day(k):
    return DAY + datetime.timedelta(days=k)


@pytest.fixture(scope="module")
def tables(spark):
    bars = [(s, k, day(k), 101.0 + k % 7, 99.0 - k % 5, 100.0 + k % 3) for s in ("A", "B") for k in range(300)]
    rows = [
        ("plain", "A", "gaps", "continuation_both", day(20), 20, "up", 101.0, 105.0, 98.0, [19, 20]),
        ("far", "B", "double_tops", "reversal_bearish", day(290), 290, "down", 100.0, 95.0, None, [200, 220, 240]),
        ("by date", "A", "gaps", None, day(30), 9000, None, 100.0, None, None, [29, 30]),
        ("two bars", "A", "gaps", "reversal_bullish", day(297), 297, None, 100.0, 1000.0, 90.0, [297]),
        ("one bar", "A", "gaps", "reversal_bullish", day(298), 298, None, 100.0, 103.0, 90.0, [298]),
        ("last bar", "A", "gaps", "reversal_bullish", day(299), 299, None, 100.0, 103.0, 90.0, [299]),
        ("no price", "A", "gaps", "reversal_bullish", day(40), 40, "up", None, 103.0, 90.0, [40]),
        ("no finite price", "A", "gaps", "reversal_bullish", day(40), 40, "up", float("inf"), 103.0, 90.0, [40]),
        ("no such bar", "C", "gaps", "reversal_bullish", None, None, "up", 100.0, 103.0, 90.0, []),
    ]
    types = spark.createDataFrame([("double_tops", "HLH")], "pattern_name string, types string")
    return spark.createDataFrame(rows, DETECTION), spark.createDataFrame(bars, "symbol string, idx int, date date, high double, low double, close double"), types


def test_every_row_is_handed_on_once_and_joined_to_nothing(tables):
    found, bars, types = tables
    out = outcomes.evaluate(found, bars, types=types)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")] and "MapInArrow" in plan
    rows = {r.pattern_id: r for r in out.collect()}
    assert out.count() == len(rows) == 9
    assert {k for k, r in rows.items() if r.ultimate_price is not None} == {"plain", "far", "by date", "two bars"}
    assert {k: r.evaluation_window_bars for k, r in rows.items()} == {"plain": 252, "far": 9, "by date": 252, "two bars": 2} | dict.fromkeys(("one bar", "last bar", "no price", "no finite price", "no such bar"), 252)
    empty = rows["no price"]
    assert (empty.symbol, empty.pattern_name, empty.breakout_date, empty.target_price, empty.stop_loss_price, empty.breakout_direction) == ("A", "gaps", day(40), 103.0, 90.0, "up") and empty.target_achieved_intraday is None


def test_levels_come_out_the_same_from_fewer_pivots(tables):
    found, bars, types = tables
    given = outcomes.evaluate(found, bars, outcomes.pivot_levels(found, bars, types)).collect()
    assert sorted(map(str, given)) == sorted(map(str, outcomes.evaluate(found, bars, types=types).collect()))
    few = {r.pattern_id: r for r in outcomes.with_levels(found, bars, types, with_boundary=False).collect()}
    whole = {r.pattern_id: r for r in outcomes.pivot_levels(found, bars, types).collect()}
    assert {k: (r.breakout_level, r.opposite_level) for k, r in few.items()} == {k: (r.breakout_level, r.opposite_level) for k, r in whole.items()}
    assert {r.boundary_price for r in few.values()} == {None} and whole["plain"].boundary_price == 107.0  # the higher of the highs of bars 19 and 20


def test_means_do_not_depend_on_the_order_of_rows(spark):
    """The mean lies on the edge of its ninth place, so that a sum that is off by its last bit is shown."""
    rng = random.Random(1)
    cents = [rng.randrange(4000) for _ in range(1535)]
    cents.append(-sum(cents) % 2_269_494)  # 1536 values whose mean is a multiple of 22694.94 / 1536
    want = {sum(cents) / 153600}
    seen = set()
    for k in range(6):
        rng.shuffle(cents)
        rows = spark.createDataFrame([(c / 100,) for c in cents], "x double").coalesce(1)
        seen.add(rows.agg(reports._finite("x")).first()[0])
    assert seen == want
    odd = spark.createDataFrame([(0.5,), (1 / 3,), (float("inf"),), (float("nan"),), (None,), (1e300,)], "x double")
    assert odd.agg(reports._finite("x")).first()[0] == (0.5 + (1 / 3 + 1e300)) / 3
    assert odd.filter("x is null").agg(reports._finite("x")).first()[0] is None
