"""Bars of a symbol are shuffled once, greedy walks work out their rows once, and queries ask for no detector that they don't show."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from swingkit.operators import barlocal, chain, clean, sequences
from swingkit.plans import base, pattern_queries
from swingkit.sources import bars as source
from swingkit.sources import sinks

SF = "/root/testdata/sf0.01"
DAY = datetime.date(2000, 1, 3)


def shuffles(df) -> int:
    """Exchanges by key in the physical plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bars_are_shuffled_once(spark):
    assert shuffles(clean.add_indicators(clean.clean(source.lineitem_bars(spark, SF)))) == 1


def test_bars_in_buckets_are_not_shuffled_for_searches(spark, tmp_path):
    entry.queries()["a1_load_bars"](spark, SF)  # sets what registered queries set
    rows = [(s, k, DAY, float(k)) for s in ("A", "B") for k in range(300)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bars = sinks.write_by_symbol(spark.createDataFrame(rows, "symbol string, idx int, date date, close double"), str(tmp_path / "bars"), n).hint("merge")
    asked = spark.createDataFrame([("A", 10), ("B", 200)], "symbol string, at int")
    near = sequences.near_bars(asked, bars, "at", F.col("at"), F.col("at") + 99).groupBy("symbol", "at").agg(F.sum("close").alias("x"))
    assert shuffles(near) == 1  # that of what is asked
    assert {(r.symbol, r.x) for r in near.collect()} == {("A", float(sum(range(10, 110)))), ("B", float(sum(range(200, 300))))}


def test_a_walk_works_out_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def far(k):
        seen.add(1)
        return k + 3

    nodes = spark.range(50).select(F.lit("A").alias("symbol"), F.col("id").alias("k")).withColumn("nxt", F.udf(far, "long").asNondeterministic()("k")).withColumn("value", F.struct("k"))
    met = chain.followed(nodes, ["symbol"], 8)
    assert sorted(r.value.k for r in met.collect()) == list(range(0, 50, 3))
    assert seen.value == 50


@pytest.mark.parametrize("seed", range(4))
def test_islands_by_running_values_are_those_by_arrays(spark, seed):
    """Without limits of height the next opposite gap is a running value; with limits that all meet, it is found in an array."""
    rng, rows = random.Random(seed), []
    for k in range(400):
        low = 100.0 + rng.randrange(6)
        high = low + rng.choice([0.0, 0.0, 0.5, 2.0])
        rows.append((rng.choice("AB"), k, DAY + datetime.timedelta(days=k), low, high, low, high, 1.0))
    table = spark.createDataFrame(rows, "symbol string, idx int, date date, open double, high double, low double, close double, volume_ratio double")
    bars = clean.positioned(table.withColumn("volume", F.lit(1)).drop("idx"))
    plain, limited = (sorted(r.pattern_id for r in barlocal.islands(bars, height=h).collect()) for h in ((None, None), (0.0, 1e9)))
    assert plain == limited and plain


def test_double_tops_ask_for_no_other_detectors(spark):
    base._KEPT.clear()
    got = entry.queries()["h13_double_top_outcomes"](spark, SF).collect()
    names = {k[2] for k in base._KEPT}
    assert "found specs" in names and not names & {"found bar local", "found cups", "found pipes", "outcomes"}
    assert got and len({r.pattern_id for r in got}) == len(got)
    whole = pattern_queries.outcomes_of(spark, SF).filter("pattern_name = 'double_tops'")
    assert {r.pattern_id: r.max_favorable_excursion_pct for r in whole.collect()} == {r.pattern_id: r.max_favorable_excursion_pct for r in got}


def test_groups_and_regimes_ask_for_no_outcomes(spark):
    base._KEPT.clear()
    assert entry.queries()["j8_pattern_groups"](spark, SF).collect() and entry.queries()["j6_market_regime"](spark, SF).collect()
    assert not {"outcomes", "frame"} & {k[2] for k in base._KEPT}
