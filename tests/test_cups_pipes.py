"""Cups and pipes on hand-made bars with known turning points."""

import datetime

import pytest

from swingkit.operators import clean, cups_pipes, outcomes, pivots
from swingkit.operators.cups_pipes import Breakout, Cup, Pipe
from swingkit.sources import bars as source
from swingkit.sources import sinks, specs


def legs(spark, *symbols):
    """Bars of straight legs between (bar, price) points, a range of 0.2 around each close."""
    rows, day = [], datetime.date(2001, 1, 1)
    for name, points in symbols:
        for (i, p), (j, q) in zip(points, points[1:]):
            for k in range(i, j + (j == points[-1][0])):
                c = p + (q - p) * (k - i) / (j - i)
                rows.append((name, day + datetime.timedelta(days=k), c, c + 0.1, c - 0.1, c, 1000))
    return clean.add_indicators(clean.clean(spark.createDataFrame(rows, source.BAR_SCHEMA)))


CUP = [(0, 80), (30, 100), (80, 75), (130, 100), (138, 95), (150, 120)]


def flipped(points):
    return [(i, 200 - p) for i, p in points]


def test_cup_and_its_mirror_image(spark):
    bars = legs(spark, ("cup", CUP), ("shallow", [(i, 90 if p == 75 else p) for i, p in CUP]), ("deep handle", [(i, 80 if p == 95 else p) for i, p in CUP]), ("never broken", [*CUP[:-1], (150, 96)]), ("down", flipped(CUP)))
    raw = pivots.pivots(bars)
    found = cups_pipes.cups_with_handle(bars, raw).collect()
    assert [r.symbol for r in found] == ["cup"]
    row = found[0]
    assert row.pivot_indices[:3] == [30, 80, 130] and row.breakout_direction == "up" and row.breakout_price > 101 and row.touch_count == 6
    assert row.target_price == pytest.approx(row.breakout_price + (100.1 - 74.9)) and row.stop_loss_price == pytest.approx(100 - 5 * 5 / 8 - 0.1)  # the handle ends with its fifth bar
    below = cups_pipes.inverted_cups_with_handle(bars, raw).collect()
    assert [(r.symbol, r.breakout_direction, r.pivot_indices[:3]) for r in below] == [("down", "down", [30, 80, 130])]
    assert below[0].target_price == pytest.approx(below[0].breakout_price - (125.1 - 99.9))
    assert not cups_pipes.cups_with_handle(bars, raw, Cup(width=(120, 504))).count()
    assert not cups_pipes.cups_with_handle(bars.limit(0), raw.limit(0)).count()


PIPE = [(0, 100), (20, 110), (26, 90), (33, 108), (40, 90.5), (60, 130)]


def test_pipe_bottom_and_top(spark):
    bars = legs(spark, ("bottom", PIPE), ("uneven", [(i, 80 if p == 90.5 else p) for i, p in PIPE]), ("top", flipped(PIPE)))
    raw = pivots.pivots(bars)
    pipe = Pipe((2, 30), (0, 30), leg=(2.0, 50.0))
    found = cups_pipes.pipes(bars, raw, pipe).collect()
    assert [(r.symbol, r.pivot_indices) for r in found] == [("bottom", [26, 33, 40])] and found[0].breakout_price > 108.1 * 1.01
    above = cups_pipes.pipes(bars, raw, pipe, bottom=False).collect()
    assert [(r.symbol, r.breakout_direction, r.pivot_indices) for r in above] == [("top", "down", [26, 33, 40])]
    assert not cups_pipes.pipes(bars, raw, Pipe((2, 30), (0, 30), leg=(40.0, 50.0))).count()


def test_a_breakout_has_to_hold(spark):
    closes = [10, 10, 12, 10, 12, 12, 13, 9, 12]
    day = datetime.date(2001, 1, 1)
    bars = spark.createDataFrame([("s", k, day + datetime.timedelta(days=k), float(c), 1.0) for k, c in enumerate(closes)], "symbol string, idx int, date date, close double, volume_ratio double")
    found = spark.createDataFrame([("a", "s", 0, 11.0), ("b", "s", 6, 11.0)], "id string, symbol string, end_idx int, level double")
    hits = lambda **rule: {r.id: r.hit.idx for r in cups_pipes.confirmed_breakout(found, bars, "id", 8, Breakout(**rule)).collect()}
    assert hits(closes=1) == {"a": 2, "b": 8}
    assert hits(closes=2) == {"a": 4, "b": 8}  # cut off at the end of the data
    assert hits(closes=3) == {"a": 4, "b": 8}
    assert hits(closes=1, volume_required=True) == {}
    down = {r.id: r.hit.idx for r in cups_pipes.confirmed_breakout(found, bars, "id", 8, Breakout(), up=False).collect()}
    assert down == {"a": 1, "b": 7}


def test_proxies_and_names():
    rows = {r[0]: r for r in specs.metadata_rows()}
    assert [k for k, r in rows.items() if r[8]] == specs.EVENTS and {r[1] for r in rows.values()} == {1, 2}
    assert rows["cup_with_handle_inverted"][2:5] == (10, "Cup with Handle (Inverted)", "cup_with_handle")


def test_run_config(spark):
    runs = spark.createDataFrame([("a", 1, '{"x": "1"}'), ("b", 2, "no json"), ("c", 0, None)], "run_id string, created_at int, config_json string")
    assert sinks.run_config(runs).count() == 0
    assert [tuple(r) for r in sinks.run_config(runs, "a").collect()] == [("a", "x", "1")]


def test_another_height_moves_the_target_alone(spark):
    bars = legs(spark, ("cup", CUP))
    found = cups_pipes.cups_with_handle(bars, pivots.pivots(bars))
    name = found.first().pattern_id
    levels = spark.createDataFrame([(name, 100.0, 90.0, 100.0)], "pattern_id string, breakout_level double, opposite_level double, boundary_price double")
    plain = outcomes.evaluate(found, bars, levels).first()
    other = outcomes.evaluate(found, bars, levels, overrides=spark.createDataFrame([(name, 1.0)], "pattern_id string, height double")).first()
    assert plain.target_price > 120 and other.target_price == pytest.approx(plain.breakout_price + 1)
    assert other.target_achieved_close and other.boundary_invalidated is plain.boundary_invalidated is False
