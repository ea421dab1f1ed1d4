import math

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from swingkit.operators import clean, medians
from swingkit.sources import bars as source


def values(spark):
    """Groups of 0 to 40,000 rows, a null key, ties, nulls, infinities and one group with a third of all rows."""
    rng = np.random.default_rng(3)
    rows = [("even", 1.0, 4), ("even", 2.0, None), ("one", 7.5, 1), ("none", None, None), (None, 3.0, 2), (None, 4.0, 2), ("inf", -math.inf, 0), ("inf", math.inf, 0), ("inf", 5.0, 1)]
    rows += [("ties", float(x), int(x)) for x in rng.integers(0, 3, 5_000)]
    rows += [("hot", float(x), int(x * 50)) for x in rng.normal(0, 1, 40_000)] + [(f"g{k % 40}", float(x), k) for k, x in enumerate(rng.exponential(9, 40_000))]
    return spark.createDataFrame(rows, "key string, x double, n int")


@pytest.mark.parametrize(("groups", "accuracy"), [(10_000, 10_000), (3, 10_000), (10_000, 100)])
def test_medians_equal_the_built_in(spark, monkeypatch, groups, accuracy):
    monkeypatch.setattr(medians, "MOST_GROUPS", groups)
    monkeypatch.setattr(medians, "ACCURACY", accuracy)
    frame = values(spark)
    got = {r.key: (r.a, r.b) for r in medians.medians(frame, ["key"], {"a": F.col("x"), "b": F.col("n")}).collect()}
    want = {r.key: (r.a, r.b) for r in frame.groupBy("key").agg(F.median("x").alias("a"), F.median("n").alias("b")).collect() if r.key != "none"}
    assert got.keys() == want.keys() and len(got) == 46
    assert all(np.allclose(np.array(got[k], float), np.array(want[k], float), rtol=1e-12, equal_nan=True) for k in want)


def test_medians_of_all_rows_and_of_none(spark):
    frame = values(spark)
    assert medians.medians(frame, [], {"a": F.col("n")}).first().a == frame.agg(F.median("n")).first()[0]
    assert [r.a for r in medians.medians(frame.limit(0), [], {"a": F.col("n")}).collect()] == [None]
    sums = frame.groupBy("key").agg(F.count("*").alias("rows"))
    out = {r.key: r for r in medians.with_medians(sums, frame, ["key"], {"a": F.col("x")}).collect()}
    assert len(out) == 47 and out["none"].a is None and out[None].a == 3.5


def test_few_values_of_a_hot_group_meet_in_a_task(spark):
    """The hot group of 200,000 distinct values meets a broadcast bracket and isn't shuffled whole."""
    n = 200_000
    frame = spark.range(n, numPartitions=8).select(F.lit("hot").alias("key"), (F.xxhash64("id") / 1e12).alias("x"))
    out = medians.medians(frame, ["key"], {"a": F.col("x")})
    exact = np.median(frame.toPandas().x)
    assert out.first().a == exact
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_counters_come_with_the_clean_bars(spark):
    bars = source.damaged(source.lineitem_bars(spark, "/root/testdata/sf0.001"))
    counters = Observation("cleaning")
    clean.clean(bars, counters=counters).write.format("noop").mode("overwrite").save()
    sums = clean.cleaning_stats(bars).drop("symbol").toPandas().sum()
    assert counters.get == {k: int(v) for k, v in sums.items()} and counters.get["removed_null"] > 0
