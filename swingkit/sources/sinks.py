"""Tables of results that are written as a whole for a run; those that batches are merged into are in ``merged``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """Where tables are written: in the folder of ``spark.checkpoint.dir``; a folder of this machine only in local mode."""
    path, master = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir(), spark.sparkContext.master
    if not path and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (path or tempfile.mkdtemp(prefix="spark-", dir="/tmp")) + "/tables"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet and read from there: for rows that a plan needs more than once and that are dear to work out."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finite(df: DataFrame) -> DataFrame:
    """``df`` with nulls for doubles that aren't finite."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in doubles})


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def write_run(df: DataFrame, run_id: str, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Write one run's rows to ``path``, replacing what the run had; other runs stay."""
    rows = last_wins(finite(df), keys, order or keys).withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def run_row(spark: SparkSession, run_id: str, config: dict, planned: DataFrame, failed: DataFrame) -> DataFrame:
    """The registry's row of a run: counts of symbols, its configuration as JSON and that text's hash."""
    items = spark.createDataFrame([(run_id, {k: str(v) for k, v in sorted(config.items())})], "run_id string, config map<string, string>")
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("config"))))
    counts = planned.agg(F.countDistinct("symbol").alias("symbols_planned")).withColumn("symbols_failed", failed.agg(F.countDistinct("symbol").alias("n")).scalar())
    return items.select(
        "run_id", counts.select("symbols_planned").scalar().alias("symbols_planned"), counts.select((F.col("symbols_planned") - F.col("symbols_failed")).alias("n")).scalar().alias("symbols_scanned"), counts.select("symbols_failed").scalar().alias("symbols_failed"),
        text.alias("config_json"), F.substring(F.md5(text), 1, 8).alias("config_hash"),
    )


def write_statistics(stats: dict[str, DataFrame], run_id: str, path: str) -> None:
    """The tables of a run's statistics as rows of table, row number and JSON, replacing what the run had."""
    parts = [
        df.select(F.lit(name).alias("table"), F.to_json(F.struct(*sorted(df.columns))).alias("row_json")).withColumn("row", F.row_number().over(Window.orderBy("row_json")))  # a row a pattern
        for name, df in stats.items()
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    write_run(both, run_id, path, ["table", "row"])


def run_config(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """The settings of a run, the newest by default, as rows of name and value; none where the text is no JSON object."""
    own = runs.filter(F.col("run_id") == run_id) if run_id else runs.join(latest_run(runs), "run_id")
    return own.select("run_id", F.explode(F.from_json("config_json", "map<string, string>")).alias("name", "value"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run_id of the newest run."""
    return runs.agg(F.max_by("run_id", "created_at").alias("run_id"))


def write_by_symbol(rows: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """``rows`` (symbol, idx and more) at ``path`` in buckets of symbols, a file each, in order; returns the table.

    Windows, groups and joins by symbol over it, and over others with as many buckets, start without a shuffle.
    """
    spark, name = rows.sparkSession, f"by_symbol_{uuid.uuid4().hex}"
    placed = rows.repartition(buckets, "symbol")
    placed.write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "idx").option("path", path).saveAsTable(name)
    return spark.table(name)


def open_by_symbol(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """A table that :func:`write_by_symbol` wrote, maybe in another application, with its buckets; ``buckets`` as written."""
    name, columns = f"by_symbol_{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, idx) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file of any file system that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
