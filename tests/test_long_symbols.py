"""Greedy passes over one long symbol: thinned pivots, islands, overlaps, against plain loops."""

import datetime
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swingkit.operators import barlocal, chain, lookahead, overlap, pivots
from swingkit.sources import bars as source

def day(i):
    return datetime.date(1000, 1, 1) + datetime.timedelta(days=i)


PIVOT = "symbol string, idx int, date date, price double, ptype string, strength int"


def some_pivots(symbol, n, seed, step=6):
    rng, at, out = random.Random(seed), 0, []
    while len(out) < n:
        at += rng.randint(0, step)
        kinds = rng.choice(["H", "L", "HL"])
        out += [(symbol, at, day(at), round(rng.uniform(5, 15), 1), t, rng.choice([5, 5, 5, 7])) for t in kinds]
        at += 1
    return out


def thinned(rows, spacing):
    """The walk pivot by pivot: runs of one type first, then the spacing."""
    runs = []
    for r in sorted(rows, key=lambda r: (r[1], r[4])):
        beyond = lambda a, b: a[3] > b[3] if a[4] == "H" else a[3] < b[3]
        if runs and runs[-1][4] == r[4]:
            runs[-1] = r if beyond(r, runs[-1]) else runs[-1]
        else:
            runs.append(r)
    kept = []
    for r in runs:
        if not kept:
            kept.append(r)
        elif kept[-1][4] == r[4]:
            kept[-1] = r if beyond(r, kept[-1]) else kept[-1]
        elif r[1] - kept[-1][1] < spacing:
            kept[-1] = r if r[5] > kept[-1][5] else kept[-1]
        else:
            kept.append(r)
    return [(k, r[1], r[3], r[4]) for k, r in enumerate(kept)]


@pytest.mark.parametrize("segment", [3, 8, 256])
def test_thinning_in_segments(spark, segment):
    rows = {s: some_pivots(s, n, i) for i, (s, n) in enumerate((("A", 400), ("B", 37), ("C", 1)))}
    found = spark.createDataFrame([r for own in rows.values() for r in own], PIVOT)
    got = pivots.thin_all(found, [1, 4, 12], segment).collect()
    for s, own in rows.items():
        for spacing in (1, 4, 12):
            assert sorted((r.k, r.idx, r.price, r.ptype) for r in got if r.symbol == s and r.spacing == spacing) == thinned(own, spacing), (s, spacing)


def test_thinning_of_a_hundred_thousand_pivots(spark):
    rows = some_pivots("A", 100_000, 9)
    found = pivots.thin(spark.createDataFrame(rows, PIVOT), 10)
    assert sorted((r.k, r.idx, r.price, r.ptype) for r in found.select("k", "idx", "price", "ptype").collect()) == thinned(rows, 10)


def test_followed_rows_and_their_size(spark):
    rng = random.Random(4)
    nxt = {g: [k + rng.randint(1, 40) for k in range(n)] for g, n in (("a", 5000), ("b", 1), (None, 700))}
    nodes = spark.createDataFrame([(g, k, None if k % 501 == 500 and g == "b" else x, f"{g}{k}") for g, own in nxt.items() for k, x in enumerate(own)], "g string, k int, nxt int, value string")
    got = sorted(r.value for r in chain.followed(nodes, ["g"], 8).collect())
    want = []
    for g, own in nxt.items():
        k = 0
        while k < len(own):
            want.append(f"{g}{k}")
            k = own[k]
    assert got == sorted(want)


def test_islands_that_skip_ahead_in_segments(spark):
    rng, rows, level = random.Random(1), [], 100.0
    for i in range(3000):
        level += rng.choice([0.0, 0.0, 4.0, -4.0])
        level = max(50.0, level)
        rows.append(("A", day(i), level, level + 0.5, level - 0.5, level, 100))
    bars = spark.createDataFrame(rows, source.BAR_SCHEMA).withColumn("idx", F.datediff("date", F.lit(day(0))))
    cut = {}
    for i in range(1, len(rows)):
        (h0, l0), (h, low) = rows[i - 1][3:5], rows[i][3:5]
        if low > h0 * 1.005:
            cut[i] = "up"
        elif h < l0 * 0.995:
            cut[i] = "down"
    want, upto = [], 0
    for i in sorted(cut):
        ends = [j for j in range(i + 1, i + 20) if cut.get(j, cut[i]) != cut[i]]
        if i > upto and ends:
            want.append((i, ends[0]))
            upto = ends[0]
    for segment in (5, 256):
        got = sorted((r.pivot_indices[0], r.pivot_indices[1]) for r in barlocal.islands(bars, segment=segment).collect())
        assert got == want and len(want) > 100


OVERLAP = "pattern_id string, symbol string, pattern_name string, breakout_date date, breakout_price double, confidence_score int, pattern_width_bars int, pivot_indices array<int>"


def test_overlaps_of_one_crowded_symbol(spark):
    rng, rows = random.Random(2), []
    for k in range(100_000):
        low = rng.randint(0, 400_000)
        rows.append((f"d{k:06}", "A", rng.choice("pq"), day(1) if k % 3 else None, 1.0, rng.choice([60, 70]), 3, [low, low + rng.choice([0, 1, 5, 40, 300])]))
    began = time.time()
    got = sorted(r.pattern_id for r in overlap.resolve_overlaps(spark.createDataFrame(rows, OVERLAP)).collect())
    took = time.time() - began
    kept, taken = [], bytearray(400_301)
    for r in sorted(rows, key=lambda r: (r[7][0] - r[7][1], r[3] is None, -r[5], r[2], r[0])):
        low, high = r[7]
        if not any(taken[low : high + 1]):
            taken[low : high + 1] = b"\x01" * (high - low + 1)
            kept.append(r[0])
    assert got == sorted(kept) and took < 60


def test_look_aheads_do_not_depend_on_their_cells(spark, monkeypatch):
    """Breakouts at every bar of a long walk, with small and wide cells and blocks; a plain loop gives the same extremes and stops."""
    rng, rows, price = random.Random(6), [], 100.0
    for i in range(900):
        price = max(5.0, price * (1 + rng.uniform(-0.06, 0.06)))
        rows.append(("A", i, day(i), price * 1.01, price * 0.99, price))
    bars = spark.createDataFrame(rows, "symbol string, idx int, date date, high double, low double, close double")
    asked = [(f"p{i}", "A", i, day(i), rows[i][5], rows[i][5] * 1.02 if i % 2 else None, None if i % 5 == 0 else rows[i][5] * (1 - w / 10), None if i % 7 == 0 else rows[i][5] * (1 + w / 5), w, 252 if i % 3 else 40) for i in range(900) for w in ((1,) if i % 2 else (-1,))]
    names = "pattern_id string, symbol string, breakout_idx int, b_date date, bp double, breakout_level double, opposite_level double, target_price double, way int, look int"
    found = []
    for cell, block in ((256, 2048), (1024, 7)):
        monkeypatch.setattr(lookahead, "CELL", cell)
        monkeypatch.setattr(lookahead, "BLOCK", block)
        got = lookahead.look_ahead(spark.createDataFrame(asked, names), bars, 20.0, 30, 1.0, 0.0)
        found.append({r.pattern_id: r for r in got.collect()})
    assert found[0] == found[1] and len(found[0]) == 899
    for key, _, at, _, bp, _, _, target, w, look in asked[:-1]:
        after, r = rows[at + 1 : at + 1 + look], found[0][key]
        best, stop = None, None
        for _, i, _, h, low, _ in after:
            best = max(best, h * w, low * w) if best is not None else max(h * w, low * w)
            run, worst = best * w, low if w > 0 else h
            if stop is None and (run - bp) * w > 0 and abs(worst - run) / run * 100 >= 20 and (run - worst) * w > 0:
                stop = i
        signed = [(max(h * w, low * w), -i) for _, i, _, h, low, _ in after if stop is None or i <= stop]
        assert (r.bars, r.stop_idx, r.ultimate_signed, r.ultimate_date) == (len(after), stop, max(signed)[0], day(-max(signed)[1]))
        assert r.against == max(-w * (c - bp) / bp * 100 for *_, c in after)
        assert r.hit == (None if target is None else any((h * w >= target * w) or (low * w >= target * w) for _, _, _, h, low, _ in after))


def test_look_aheads_of_many_cells_are_worked_on_together():
    rows = []
    for n in range(300):
        rows += [dict(symbol=f"{n:03}", cell=0, kind=0, idx=k, day=k, high=12.0 + k, low=11.0 + k, close=11.5 + k, target_price=None, way=0, look=0, pattern_id=None) for k in range(4)]
        rows.append(dict(symbol=f"{n:03}", cell=0, kind=1, idx=0, day=30, high=10.0, low=10.0, close=None, target_price=13.0, way=1, look=2 + n % 2, pattern_id=f"p{n:03}"))
    kinds = {"symbol": pa.string(), "cell": pa.int32(), "kind": pa.int32(), "idx": pa.int64(), "day": pa.int32(), "high": pa.float64(), "low": pa.float64(), "close": pa.float64(), "target_price": pa.float64(), "way": pa.int32(), "look": pa.int32(), "pattern_id": pa.string()}
    whole = pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))
    read = lookahead._reader(20.0, 1.0, 0.0)
    found = list(read(iter([whole])))
    assert len(found) == 1 and found[0].num_rows == 300  # a block for all cells, not one for each
    cut = [r for batch in read(whole.slice(k, 7) for k in range(0, whole.num_rows, 7)) for r in batch.to_pylist()]
    by_id = lambda rows: sorted(rows, key=lambda r: r["pattern_id"])
    assert by_id(cut) == by_id(found[0].to_pylist())
    assert [r["ultimate_signed"] for r in by_id(cut)[:2]] == [14.0, 15.0] and {r["bars"] for r in cut} == {2, 3}
