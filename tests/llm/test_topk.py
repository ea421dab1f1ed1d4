import math

import numpy as np
from pyspark.sql import functions as F

from swingkit.llm import topk


def brute(rows, k=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in kept:
        if q % 50 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.integers(-3, 4, (400, 6)) / 8).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1050, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cell int")
    q = topk.quantised(df)
    for cell_values, block in ((1 << 19, 128), (300, 7)):
        got = topk.top_k(q, q.filter("vec_id % 50 = 0"), 5, cell_values, block).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_ids_wide_values_and_mixed_widths(spark):
    """Every row of a repeated query id has ranks of its own; large components give exact scores; widths don't mix."""
    rows = [(0, [1.0, 2.0]), (0, [3.0, -1.0]), *((i, [float(i), 1.0]) for i in range(1, 9)), (50, [2.0**25, 3.0]), (60, [2.0**20, 1.0]), (100, [1.0]), (101, [2.0]), (102, [])]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.top_k(q, q.filter("vec_id % 50 = 0")).collect()))
    want = []
    for i, a in rows:
        if i % 50 == 0:
            best = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(a, b)), j) for j, b in rows if j != i and len(b) == len(a))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id long, embedding array<float>")
    q = topk.quantised(df)
    assert [tuple(r) for r in topk.top_k(q, q.filter("vec_id = 0")).collect()] == [(0, 1, 1, 128 * 64)]
    assert topk.top_k(q.limit(0), q.limit(0)).count() == 0


def test_pruning_skips_blocks():
    rows = np.concatenate([np.full((256, 4), 9), np.zeros((256 * 3, 4), int)])
    cell = topk.Range(np.arange(len(rows)), rows)
    q, i, s = cell.best(np.array([5000]), np.ones((1, 4), int), np.array([-(10**9)]))
    assert i.tolist() == [0, 1, 2, 3, 4] and set(s) == {36} and len(q) == 5
    assert (cell.scored, cell.met) == (2, 8)
    assert not len(cell.best(np.array([5000]), np.ones((1, 4), int), np.array([37]))[0])


def test_ranges_that_cannot_reach_a_floor_are_left_out(spark):
    """Eight groups of vectors far apart: queries visit their own range and few others."""
    rng = np.random.default_rng(3)
    ends = np.eye(8) * 4
    df = spark.createDataFrame([(i, (ends[i % 8] + rng.normal(0, 0.05, 8)).tolist()) for i in range(1600)], "vec_id long, embedding array<double>")
    q = topk.quantised(df)
    ranges = topk.placed(q, 8 * 100).cache()
    asked = q.filter("vec_id % 50 = 0").withColumns({"width": F.size("v"), "qid": F.monotonically_increasing_id()}).cache()
    found = topk.top_k(q, q.filter("vec_id % 50 = 0"), 5, 8 * 100)
    floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("floor"))
    pairs = topk.reached(asked.join(floors, "vec_id").withColumn("first", F.lit(-1)), topk.extremes(ranges), 32, 16, first=False).count()
    assert ranges.select("range").distinct().count() == 16 and pairs < 32 * 16 / 3
