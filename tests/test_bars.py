"""Cleaning, pivots, detectors and outcomes on bars made by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from swingkit.operators import barlocal, clean, outcomes, overlap, pivots, sequences, universe
from swingkit.sources import bars as source
from swingkit.sources import sinks, specs

DAY = datetime.date(2020, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def legs(points, symbol="A"):
    """Bars along straight legs between (bar, price) points; each bar spans 0.2 around its close."""
    out = []
    for (i, a), (j, b) in zip(points, points[1:]):
        for k in range(i, j + (j == points[-1][0])):
            p = a + (b - a) * (k - i) / (j - i)
            out.append((symbol, day(k), p, p + 0.1, p - 0.1, p, 1000))
    return out


def ready(spark, rows):
    return clean.add_indicators(clean.clean(spark.createDataFrame(rows, source.BAR_SCHEMA)))


def test_cleaning(spark):
    nan = math.nan
    rows = [("A", day(0), 1.0, 2.0, 0.5, 1.5, 10), ("A", day(1), 1.0, 0.5, 2.0, 1.5, 0), ("A", day(2), 9.0, 2.0, 1.0, 0.1, 5), ("A", day(3), nan, 2.0, 1.0, 1.0, 5), ("A", day(4), 1.0, 2.0, 0.0, 1.0, 5), ("A", day(5), 1.0, None, 1.0, 1.0, 5)]
    bars = spark.createDataFrame(rows, source.BAR_SCHEMA)
    got = [tuple(r)[2:] for r in clean.clean(bars).orderBy("idx").collect()]
    assert got == [(1.0, 2.0, 0.5, 1.5, 10, 0), (1.0, 2.0, 0.5, 1.5, 0, 1), (2.0, 2.0, 1.0, 1.0, 5, 2)]
    stats = clean.cleaning_stats(bars).first()
    assert tuple(stats)[1:] == (6, 2, 1, 1, 1, 1, 3)


def test_first_bar_has_no_true_range_and_no_nan(spark):
    rows = ready(spark, legs([(0, 10), (30, 40)])).orderBy("idx").collect()
    assert rows[0].true_range is None and rows[13].atr is None and rows[14].atr is not None and rows[18].volume_ma is None and rows[19].volume_ratio == 1.0


def test_pivots_need_strict_extremes(spark):
    peak = legs([(0, 10), (10, 20), (20, 10)])
    assert [(r.idx, r.ptype) for r in pivots.pivots(ready(spark, peak)).collect()] == [(10, "H")]
    tied = [(s, d, min(o, 19.0), min(h, 19.1), min(l, 18.9), min(c, 19.0), v) for s, d, o, h, l, c, v in peak]
    assert pivots.pivots(ready(spark, tied)).count() == 0


def raw(spark, rows):
    return spark.createDataFrame([("A", i, day(i), float(p), t, s) for i, p, t, s in rows], "symbol string, idx int, date date, price double, ptype string, strength int")


def test_thinning(spark):
    found = raw(spark, [(0, 10, "H", 5), (3, 12, "H", 5), (5, 8, "L", 5), (9, 7, "L", 5), (14, 9, "H", 5), (30, 11, "H", 5), (41, 5, "L", 5), (44, 9, "H", 7)])
    assert [(r.idx, r.ptype) for r in pivots.merge_runs(found).orderBy("idx").collect()] == [(3, "H"), (9, "L"), (30, "H"), (41, "L"), (44, "H")]
    assert [r.idx for r in pivots.thin(found, 10).orderBy("k").collect()] == [3, 44]
    assert [r.idx for r in pivots.thin(found, 2).orderBy("k").collect()] == [3, 9, 30, 41, 44]


PEAKS = [(0, 60), (25, 100), (45, 85), (65, 95), (85, 80), (105, 90), (125, 60), (150, 40)]


def test_three_falling_peaks_and_its_outcome(spark):
    bars = ready(spark, legs(PEAKS))
    spec = specs.pattern_spec(spark, {"three_falling_peaks": specs.SPECS["three_falling_peaks"]})
    found = sequences.detect_sequences(bars, pivots.pivots(bars), spec).collect()
    assert [(r.pattern_id, r.breakout_direction, r.pivot_indices) for r in found] == [("A_three_falling_peaks_25_105", "down", [25, 45, 65, 85, 105])]
    df = sequences.detect_sequences(bars, pivots.pivots(bars), spec)
    types = spark.createDataFrame([("three_falling_peaks", "HLHLH")], "pattern_name string, types string")
    out = outcomes.evaluate(df, bars, outcomes.pivot_levels(df, bars, types)).first()
    assert out.ultimate_stop_reason == "end_of_window" and abs(out.ultimate_price - 39.9) < 1e-9 and not out.bust_failure_5pct and not out.boundary_invalidated
    rising = legs([(0, 60), (25, 100), (45, 85), (65, 105), (85, 80), (105, 90), (125, 60), (150, 40)])
    bars = ready(spark, rising)
    assert sequences.detect_sequences(bars, pivots.pivots(bars), spec).count() == 0


def test_breakout_on_the_last_bar_gives_an_empty_outcome(spark):
    bars = ready(spark, legs(PEAKS))
    row = [("x", "A", "p", "reversal_bearish", day(150), 150, "down", 40.0, 30.0, 50.0, [25, 105])]
    df = spark.createDataFrame(row, "pattern_id string, symbol string, pattern_name string, pattern_type string, breakout_date date, breakout_idx int, breakout_direction string, breakout_price double, target_price double, stop_loss_price double, pivot_indices array<int>")
    out = outcomes.evaluate(df, bars).first()
    assert out.evaluation_window_bars == 252 and out.ultimate_price is None and out.throwback_pullback_occurred is None and out.bust_failure_5pct is None


@pytest.mark.parametrize(("rule", "prices", "held"), [
    ("near_equal", [10, 5, 10.2], True), ("near_equal", [10, 5, 10.4], False), ("near_equal_to_position_1", [10, 5, 10.2], True), ("lower_than_previous", [10, 5, 9], True), ("lower_than_previous", [10, 5, 10], False),
    ("higher_than_previous_H", [10, 5, 11], True), ("lower_than_previous_high", [10, 5, 9], True), ("higher_than_previous_low", [10, 5, 4], False), ("must_be_highest", [10, 5, 9], False), ("not_highest", [10, 5, 9], True), ("unheard_of", [10, 5, 1], True),
])
def test_rules(spark, rule, prices, held):
    win = [(i * 10, None, float(p), t) for i, (p, t) in enumerate(zip(prices, "HLH"))]
    df = spark.createDataFrame([(win, [(3, rule)], 3.0, 15.0, float(max(prices)), float(min(prices)))], "win array<struct<idx: int, date: date, price: double, ptype: string>>, mandatory array<struct<position: int, constraint: string>>, tolerance double, depth_tolerance double, upper double, lower double")
    assert df.filter(sequences.rules_hold()).count() == int(held)


@pytest.mark.parametrize(("position", "rule", "prices", "held"), [
    (4, "in_upper_third", [20, 10, 19, 16, 19, 18], True), (4, "in_upper_third", [20, 10, 19, 15.9, 19, 18], False), (5, "near_cup_lip", [20, 10, 19, 16, 19.5, 18], True), (5, "near_cup_lip", [20, 10, 19, 16, 19.6, 18], False),
    (6, "shallow_decline", [20, 10, 19, 16, 20, 17], True), (6, "shallow_decline", [20, 10, 19, 16, 20, 16.9], False), (6, "shallow_decline", [20, 10, 19, 16, 0, -5], True),
])
def test_rules_of_a_handle(spark, position, rule, prices, held):
    """The upper third lies between the second pivot and the third, the lip is the third, the decline is from the fifth."""
    win = [(i * 10, None, float(p), t) for i, (p, t) in enumerate(zip(prices, "HLHLHL"))]
    df = spark.createDataFrame([(win, [(position, rule)], 3.0, 15.0, 20.0, 10.0)], "win array<struct<idx: int, date: date, price: double, ptype: string>>, mandatory array<struct<position: int, constraint: string>>, tolerance double, depth_tolerance double, upper double, lower double")
    assert df.filter(sequences.rules_hold()).count() == int(held)


def flat(prices):
    return [("A", day(i), float(c), float(h), float(l), float(c), 1000) for i, (h, l, c) in enumerate(prices)]


def test_gaps_islands_and_inside_days(spark):
    bars = ready(spark, flat([(10, 9, 9.5), (12, 11, 11.5), (12.5, 11.2, 12), (10.5, 9.8, 10), (10.4, 9.9, 10.1), (11, 10.6, 10.9)]))
    assert [(r.breakout_idx, r.breakout_direction) for r in barlocal.gaps(bars).orderBy("breakout_idx").collect()] == [(1, "up"), (3, "down"), (5, "up")]
    assert [(r.pattern_id, r.breakout_direction) for r in barlocal.islands(bars).collect()] == [("A_islands_1_3", "down")]
    assert [(r.pattern_id, r.breakout_direction) for r in barlocal.inside_days(bars).collect()] == [("A_inside_day_3_4", "up")]


def detection(i, lo, hi, confidence, date=True):
    return (f"d{i}", "A", "p", day(hi) if date else None, 1.0 if date else None, confidence, hi - lo + 1, [lo, hi])


def test_overlaps(spark):
    rows = [detection(1, 0, 10, 70), detection(2, 10, 15, 90), detection(3, 11, 15, 60), detection(4, 11, 15, 60, False), ("d5", "A", "p", None, None, 50, 3, None)]
    df = spark.createDataFrame(rows, "pattern_id string, symbol string, pattern_name string, breakout_date date, breakout_price double, confidence_score int, pattern_width_bars int, pivot_indices array<int>")
    assert sorted(r.pattern_id for r in overlap.resolve_overlaps(df).collect()) == ["d1", "d3", "d5"]
    assert overlap.resolve_overlaps(df, "none").count() == 5
    assert universe.cap(df, ["symbol"], 0).count() == 0 and universe.cap(df, ["symbol"], 2, "random", 3).count() == 2
    assert [r.pattern_id for r in universe.cap(df, ["symbol"], 1, "top_confidence").collect()] == ["d2"]


def test_specs_from_files_and_unknown_patterns(spark, tmp_path):
    assert source.load_specs(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "flags_digitized.json").write_text('{"pattern_type": "reversal_bullish", "geometry_constraints": {"width_min_bars": 5}}')
    row = source.load_specs(spark, str(tmp_path)).first()
    assert row.spec_key == "flags" and row.geometry_constraints.width_min_bars == 5
    df = spark.createDataFrame([("flags",)], "pattern_name string")
    with pytest.raises(ValueError, match="unknown"):
        universe.of_patterns(df, ["nothing"], specs.pattern_dim(spark))
    with pytest.raises(ValueError, match="no index rows"):
        source.index_series(spark.createDataFrame([], source.BAR_SCHEMA), "IDX")


def test_result_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, math.inf), ("a", 2, 1.0), ("b", 1, math.nan)], "pattern_id string, v int, x double")
    for run in ("one", "two", "two"):
        sinks.write_run(df, run, str(tmp_path / "t"), ["pattern_id"], ["v"])
    got = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.run_id, r.pattern_id, r.v, r.x) for r in got.collect()) == [("one", "a", 2, 1.0), ("one", "b", 1, None), ("two", "a", 2, 1.0), ("two", "b", 1, None)]
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, created_at int")
    assert sinks.latest_run(runs).first().run_id == "r2"


def test_metadata():
    rows = specs.metadata_rows()
    assert len(rows) == 55 and [r[2] for r in rows] == list(range(1, 56)) and F is not None
