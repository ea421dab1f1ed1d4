"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word class ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep the Arrow batches that go to Python small, since one text may have megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and Spark runs in one process."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint: its lineage is cut and no executor's loss can hurt it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, merged: bool = True) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and the table's path; if ``merged``, AQE merges its small partitions, by a shuffle, before they are written."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    (df.hint("rebalance") if merged else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`kept` that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(small: DataFrame, rows: int) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``rows`` rows; else Spark shuffles the join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` in order; none for a null text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def id_remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")
