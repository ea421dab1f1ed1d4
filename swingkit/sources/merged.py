"""Tables that batches are merged into by key: a row replaces the stored one of its key, all other rows stay.

Rows lie in bucket folders by the hash of their key within their run. A batch rewrites the buckets that it touches, each
as a new version: the stored rows whose key the batch lacks, and the batch. A list of the live version of every bucket is
written last, as one file, so readers see the whole batch or nothing of it, and a batch that fails leaves the table as it
was. One writer at a time: the second of two finds its version taken and fails.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swingkit.sources.sinks import finite, last_wins

BUCKETS = 64
#: Run, bucket and version are folders; a run's folder has a letter in front, so that no run is read back as a number.
_PLACE = ["run", "bucket", "version"]
_LIVE = "run string, bucket int, version int, buckets int, columns string"


def merge_batch(batch: DataFrame, path: str, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS, run: str = "run_id") -> int:
    """Merges ``batch`` into the table at ``path`` and returns the table's new version.

    Of rows of one run and key the last by ``order`` wins, within the batch alone: a later batch always replaces an
    earlier one. Null keys are keys like others, doubles that aren't finite are stored as null. An empty batch commits
    a version that changes nothing. The number of ``buckets`` is the one with which the table began.
    """
    spark = batch.sparkSession
    live = live_buckets(spark, path)
    known = live.filter("bucket is null").first() if live is not None else None
    version, buckets = (known.version + 1, known.buckets) if known else (1, buckets)
    own = F.coalesce(F.col(run).cast("string"), F.lit(""))
    rows = last_wins(finite(batch), [run, *keys], order or keys).withColumns({"run": F.concat(F.lit("r"), own), "bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})
    fresh = f"{path}/staged/version={version}"
    rows.write.mode("overwrite").parquet(fresh)  # the batch is worked out once
    rows = spark.read.parquet(fresh)
    touched = rows.select("run", "bucket").distinct()
    merged = rows
    if known:
        stored = _rows(spark, path, known.columns).join(F.broadcast(live.join(touched, ["run", "bucket"], "left_semi").select(_PLACE)), _PLACE, "left_semi").drop("version")  # at most `buckets` rows a run of the batch
        same = [stored[c].eqNullSafe(rows[c]) for c in ["run", "bucket", *keys]]
        together = same[0]
        for s in same[1:]:
            together = together & s
        merged = stored.join(rows.select("run", "bucket", *keys), together, "left_anti").unionByName(rows, allowMissingColumns=True)
    merged.hint("rebalance", "run", "bucket").write.mode("overwrite").partitionBy("run", "bucket").parquet(f"{path}/rows/version={version}")  # over what a lost writer may have left
    changed = touched.select("run", "bucket", F.lit(version).alias("version"))
    if known:
        changed = live.filter("bucket is not null").select(_PLACE).join(touched, ["run", "bucket"], "left_anti").unionByName(changed)
    begin = spark.createDataFrame([(None, None, version, buckets, merged.drop("run", "bucket").schema.json())], _LIVE)
    changed.unionByName(begin, allowMissingColumns=True).coalesce(1).write.parquet(f"{path}/live/commit={version}")  # fails if it exists
    _delete(spark, fresh)
    return version


def read_merged(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The live rows of a table, of one run or of all; folders of other versions aren't scanned."""
    live = live_buckets(spark, path)
    rows, live = _rows(spark, path, live.filter("bucket is null").first().columns), live.filter("bucket is not null").select(_PLACE)
    if run_id is not None:
        live, rows = live.filter(F.col("run") == "r" + run_id), rows.filter(F.col("run") == "r" + run_id)
    return rows.join(live, _PLACE, "left_semi").drop(*_PLACE)


def merge_detections(batch: DataFrame, run_id: str, path: str) -> int:
    """Merges detections into a run, by pattern_id; of one batch's rows of an id the surest stays, then the latest."""
    return merge_batch(batch.withColumn("run_id", F.lit(run_id)), path, ["pattern_id"], ["confidence_score", "formation_end"])


def merge_outcomes(batch: DataFrame, run_id: str, path: str) -> int:
    """Merges outcomes into a run, by pattern_id; of one batch's rows of an id that of the longest window stays."""
    return merge_batch(batch.withColumn("run_id", F.lit(run_id)), path, ["pattern_id"], ["evaluation_window_bars"])


def live_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """run, bucket and version of every live bucket, and a row without a bucket that has the last version, the number of buckets and the columns; None where there is no table."""
    if not _exists(spark, f"{path}/live"):
        return None
    whole = spark.read.schema(f"{_LIVE}, commit int").parquet(f"{path}/live")
    last = whole.agg(F.max("commit")).first()[0]
    return whole.filter(F.col("commit") == last).drop("commit")


def expire(spark: SparkSession, path: str) -> int:
    """Deletes the versions that hold no live bucket, and the lists before the last; returns how many versions went. No reader may be at work."""
    live = live_buckets(spark, path)
    last = live.agg(F.max("version")).first()[0]
    kept = {r.version for r in live.filter("bucket is not null").select("version").distinct().collect()}  # versions that are live
    gone = [v for v in range(1, last + 1) if v not in kept and _exists(spark, f"{path}/rows/version={v}")]
    for v in gone:
        _delete(spark, f"{path}/rows/version={v}")
    for v in range(1, last):
        _delete(spark, f"{path}/live/commit={v}")
    return len(gone)


def _rows(spark: SparkSession, path: str, columns: str) -> DataFrame:
    whole = T.StructType.fromJson(json.loads(columns)).add("version", T.IntegerType()).add("run", T.StringType()).add("bucket", T.IntegerType())
    return spark.read.schema(whole).parquet(f"{path}/rows")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
