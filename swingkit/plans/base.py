"""How queries are registered, and the bars that they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swingkit.operators import clean, pivots
from swingkit.sources import bars as source
from swingkit.sources import sinks, specs
from swingkit.sources.sinks import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Spark 4.1.2 loses matches of joins above a union of inputs that are partitioned alike.
            spark.conf.set("spark.sql.unionOutputPartitioning", "false")
            # Tables in buckets of symbols are read in their order, and what is joined by symbol and more stays with them.
            spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            return tidy(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def rounded(c: Column) -> Column:
    """``c`` rounded to 9 places. Numbers of at most two places, as whole cents are, are left as they are: rounding goes through decimals, which is slow."""
    return F.when((F.rint(c * 100) / 100 == c) & (c != 0) & (F.abs(c) < 1e12), c).otherwise(F.round(c, 9))


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to 9, whole numbers as long, dates as text, arrays of numbers as comma-joined text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(out)


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], by_symbol: bool = False) -> DataFrame:
    """A table that several queries of one application share, written once as Parquet.

    What is built on it starts from a scan: its plan stays short, a lost executor loses nothing, and no memory is held.
    ``by_symbol`` tables lie in buckets of symbols, so that windows over a symbol need no shuffle.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        path = f"{folder(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        if by_symbol:
            _KEPT[key] = sinks.write_by_symbol(make(), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
        else:
            make().write.parquet(path)
            _KEPT[key] = spark.read.parquet(path)
    return _KEPT[key]


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned bars with indicators, kept for all that is detected over them."""
    return kept(spark, sf_dir, "bars", lambda: clean.add_indicators(clean.clean(source.lineitem_bars(spark, sf_dir))), by_symbol=True)


def pivots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivots of the bars, kept for all detectors."""
    return kept(spark, sf_dir, "pivots", lambda: pivots.pivots(bars_of(spark, sf_dir)), by_symbol=True)


def thinned_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivots thinned to every spacing of the specs, kept for all detectors of pivot sequences."""
    spacings = sorted({specs.SPACING.get(k, 10) for k in specs.SPECS} | {10})
    return kept(spark, sf_dir, "thinned", lambda: pivots.thin_all(pivots_of(spark, sf_dir), spacings), by_symbol=True)
