"""Searches of few bars meet few bars, axes are worked out once, and bar-local patterns don't wait for pivots."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from swingkit.operators import cups_pipes, derived, pivots, sequences
from swingkit.plans import pattern_queries

DAY = datetime.date(2000, 1, 3)


@pytest.mark.parametrize("cell", [1, 3, 8, 32, 64])
def test_searches_do_not_depend_on_their_cells(spark, cell):
    bars = spark.createDataFrame([(s, k, float(k)) for s in "AB" for k in range(150)], "symbol string, idx int, close double")
    spans = {("A", 0): (0, 0), ("A", 1): (-5, 9), ("A", 2): (60, 68), ("B", 3): (140, 170), ("B", 4): (30, 100), ("B", 5): (9, 8)}
    asked = spark.createDataFrame([(s, n, a, b) for (s, n), (a, b) in spans.items()], "symbol string, n int, a int, b int")
    near = sequences.near_bars(asked, bars, "n", F.col("a"), F.col("b"), cell)
    assert sorted((r.n, r.idx) for r in near.select("n", "idx").collect()) == sorted((n, k) for (_, n), (a, b) in spans.items() for k in range(max(a, 0), min(b, 149) + 1))


def test_axes_are_worked_out_once(spark, monkeypatch):
    rows = []
    for goal in (100, 60, 80, 100, 130, 100, 60, 70, 60, 45):
        start = rows[-1] if rows else 100.0
        rows += [start + (goal - start) * (k + 1) / 20 for k in range(20)]
    bars = spark.createDataFrame([("A", k, DAY + datetime.timedelta(days=k), c, c + 0.5, c - 0.5, c, 1000, 2.0, 1.0) for k, c in enumerate(rows)], "symbol string, idx int, date date, open double, high double, low double, close double, volume long, atr double, volume_ratio double")
    calls = []

    def counted(df):
        calls.append(df)
        return whole(df)

    whole = derived.axes
    monkeypatch.setattr(cups_pipes, "axes", counted)
    monkeypatch.setattr(derived, "axes", counted)
    cups_pipes.inverted_cups_with_handle(bars, pivots.pivots(bars), cups_pipes.Cup(width=(20, 200), depth=(1.0, 90.0)))
    assert len(calls) == 1
    plain, given = (df.select("idx", "open", "high", "low", "close").orderBy("idx").collect() for df in (derived.mirrored(bars), derived.mirrored(bars, whole(bars))))
    assert plain == given and len(plain) == len(rows)


def test_bar_local_patterns_do_not_wait_for_pivots(spark, monkeypatch):
    started = threading.Event()

    def kept(session, sf_dir, name, make, by_symbol=False):
        if name == "found bar local":
            started.set()
        return session.range(1).withColumn("name", F.lit(name))

    seen = []
    monkeypatch.setattr(pattern_queries, "kept", kept)
    monkeypatch.setattr(pattern_queries, "bars_of", lambda *_: None)
    monkeypatch.setattr(pattern_queries, "pivots_of", lambda *_: None)
    monkeypatch.setattr(pattern_queries, "thinned_of", lambda *_: seen.append(started.wait(20)))
    found = pattern_queries.detections_of(spark, "none")
    assert seen == [True] and found.count() == 5
