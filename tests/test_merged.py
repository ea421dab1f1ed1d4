"""Keyed merging of batches into stored tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from swingkit.operators import barlocal, clean, pivots
from swingkit.sources import bars as source
from swingkit.sources import merged, sinks

SCHEMA = "run_id string, pattern_id string, v int, x double"


def write(spark, path, rows, **more):
    return merged.merge_batch(spark.createDataFrame(rows, SCHEMA), path, ["pattern_id"], ["v"], **more)


def stored(spark, path, run=None):
    return sorted(map(tuple, merged.read_merged(spark, path, run).select("run_id", "pattern_id", "v", "x").collect()), key=str)


def test_later_batches_replace_by_key_and_leave_the_rest(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    batches = [
        [("1", f"p{i}", i, 1.0) for i in range(50)] + [("1", "p3", 99, float("inf"))],
        [("1", f"p{i}", -i, float("nan")) for i in range(40, 60)] + [("2", "p3", 7, 2.0)],
        [("007", "p3", 1, 1.0), ("1", None, 5, 1.0), (None, "p3", 6, 1.0)],
        [("1", None, 4, 3.0)],
        [],
    ]
    for n, rows in enumerate(batches, 1):
        assert write(spark, path, rows, buckets=5) == n
        for run, key, v, x in sorted(rows, key=lambda r: r[2]):
            want[run, key] = (run, key, v, x if x in (1.0, 2.0, 3.0) else None)
    assert stored(spark, path) == sorted(want.values(), key=str)
    assert stored(spark, path, "1") == sorted((r for r in want.values() if r[0] == "1"), key=str)
    assert stored(spark, path, "007") == [("007", "p3", 1, 1.0)] and stored(spark, path, "none") == []


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, path, [("r", f"p{i}", i, 0.0) for i in range(200)], buckets=16)
    write(spark, path, [("r", "p7", 0, 0.0)], buckets=4)  # the table keeps its 16
    versions = [r.version for r in merged.live_buckets(spark, path).filter("bucket is not null").collect()]
    assert sorted(versions) == [1] * 15 + [2]
    rows = spark.read.parquet(f"{path}/rows")
    assert 1 <= rows.filter("version = 2").count() < 40
    plan = merged.read_merged(spark, path, "r")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "run" in plan.split("PartitionFilters", 1)[1][:200]


def test_a_failed_batch_changes_nothing_and_old_versions_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, path, [("r", "a", 1, 0.0), ("r", "b", 1, 0.0)], buckets=1)
    broken = spark.createDataFrame([("r", "a", 2, 0.0)], SCHEMA).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        merged.merge_batch(broken, path, ["pattern_id"], ["v"])
    # Rows of a version that was never committed, as a writer leaves them that is lost before its list is written.
    spark.createDataFrame([("r", "c", 9, 0.0, 2, "rr", 0)], SCHEMA + ", version int, run string, bucket int").write.mode("append").partitionBy("version", "run", "bucket").parquet(f"{path}/rows")
    assert stored(spark, path) == [("r", "a", 1, 0.0), ("r", "b", 1, 0.0)]
    write(spark, path, [("r", "a", 3, 0.0)])
    assert stored(spark, path) == [("r", "a", 3, 0.0), ("r", "b", 1, 0.0)]
    write(spark, path, [("r", "b", 4, 0.0)])
    before = stored(spark, path)
    assert merged.expire(spark, path) == 2 and stored(spark, path) == before


def test_columns_may_be_added(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, path, [("r", "a", 1, 0.0), ("r", "b", 1, 0.0)], buckets=2)
    merged.merge_batch(spark.createDataFrame([("r", "a", 2, 0.5, "new")], SCHEMA + ", note string"), path, ["pattern_id"], ["v"])
    got = merged.read_merged(spark, path)
    assert {(r.pattern_id, r.v, r.note) for r in got.collect()} == {("a", 2, "new"), ("b", 1, None)}


def test_a_table_may_begin_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write(spark, path, []) == 1 and stored(spark, path) == []
    assert write(spark, path, [("r", "a", 1, 0.0)]) == 2 and stored(spark, path) == [("r", "a", 1, 0.0)]


def test_tables_by_symbol_need_no_shuffle(spark, tmp_path):
    """Windows of gaps, spikes and pivots over a table in buckets; opened again, it has the same rows and buckets."""
    rows = [(f"S{s}", datetime.date(2020, 1, 1) + datetime.timedelta(days=i), 10.0 + (i * s) % 7, 12.0 + (i * s) % 7, 9.0 + (i * s) % 7, 11.0 + (i * s) % 7, 100) for s in range(1, 9) for i in range(60)]
    bars = clean.add_indicators(clean.clean(spark.createDataFrame(rows, source.BAR_SCHEMA)))
    path = str(tmp_path / "b ars")
    first = sinks.write_by_symbol(bars, path, 4)
    again = sinks.open_by_symbol(spark, path, 4)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, bars.select(again.columns).collect()), key=str)
    for table in (first, again):
        for found in (barlocal.gaps(table), barlocal.spikes(table), pivots.pivots(table)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Window" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    raw = sinks.write_by_symbol(pivots.pivots(first), str(tmp_path / "p"), 4)
    joined = raw.join(first.select("symbol", F.col("idx").alias("i"), "close"), "symbol").hint("merge")
    assert "Exchange hash" not in joined._jdf.queryExecution().executedPlan().toString()
