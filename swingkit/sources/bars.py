"""Reading bars, index series and specs, and the bars that stand in for them in the driver's tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swingkit.sources.specs import SPEC_SCHEMA

BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume bigint"


def load_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a Parquet path, of some symbols and an inclusive range of dates; both reach the scan."""
    return select_bars(spark.read.parquet(path), symbols, start, end)


def select_bars(bars: DataFrame, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of some symbols and an inclusive range of dates, with ``date`` as a date.

    The stored column itself is compared, so that the range reaches the scan: a text date (year first, maybe with a time
    after it) as text.
    """
    kind = bars.schema["date"].dataType
    bound = (lambda d: F.lit(str(d))) if isinstance(kind, T.StringType) else (lambda d: F.lit(str(d)).cast(kind))
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(symbols))
    if start is not None:
        bars = bars.filter(F.col("date") >= bound(start))
    if end is not None:
        bars = bars.filter(F.col("date") < bound(date.fromisoformat(end) + timedelta(days=1)))
    return bars.withColumn("date", F.to_date("date"))


def load_bars_jdbc(spark: SparkSession, url: str, table: str = "stock_price_history", symbols: list[str] | None = None, start: str | None = None, end: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """Bars of a database table whose ``time`` is a date, a timestamp or a text date, read in ``parts`` ranges of time at once.

    Symbols and the range of dates are part of each range's statement. Ranges are even in time between the table's first
    and last bar; rows without a time come with the first.
    """
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    time = quoted("time")
    ends = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({time}) AS {quoted('a')}, MAX({time}) AS {quoted('b')} FROM {table}", **options).load().first()
    whole = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    if ends is None or ends[0] is None or parts < 2:
        return select_bars(whole.withColumnRenamed("time", "date"), symbols, start, end)
    first, last = (date.fromisoformat(str(x)[:10]) for x in ends)
    cuts = sorted({first + timedelta(days=(last - first).days * k // parts) for k in range(1, parts)} - {first})
    literal = {T.DateType: "CAST('{}' AS DATE)", T.TimestampType: "CAST('{} 00:00:00' AS TIMESTAMP)"}.get(type(whole.schema["time"].dataType), "'{}'").format
    limits = [None, *map(literal, cuts), None]
    ranges = [" AND ".join([*([f"{time} >= {a}"] if a else []), *([f"{time} < {b}"] if b else [])]) or "1 = 1" for a, b in zip(limits, limits[1:])]
    ranges[0] = f"({ranges[0]}) OR {time} IS NULL"
    rows = spark.read.jdbc(url, table, predicates=ranges, properties=options)
    return select_bars(rows.withColumnRenamed("time", "date"), symbols, start, end)


def index_series(bars: DataFrame, symbol: str) -> DataFrame:
    """Date and close of one symbol, without rows that lack either; an error if nothing is left."""
    series = bars.filter(F.col("symbol") == symbol).select(F.to_date("date").alias("date"), "close").filter("date is not null and close is not null and not isnan(close)")
    if series.isEmpty():
        raise ValueError(f"no index rows for {symbol}")
    return series


def load_specs(spark: SparkSession, path: str) -> DataFrame:
    """The ``*_digitized.json`` specs of a folder, one row each, keyed by the file's name; no rows if there are none."""
    try:
        rows = spark.read.schema(SPEC_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*_digitized.json").json(path)
    except Exception as e:  # a missing folder means no specs
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"spec_key string, {SPEC_SCHEMA}")
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_digitized\.json$", 1).alias("spec_key"), "*")


def lineitem_bars(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """Bars of ``days`` days from a whole-cent walk over each supplier's line items; sums are exact."""
    walk = Window.partitionBy("symbol").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    tick = F.round(F.col("l_extendedprice") * 100).cast("bigint") % 401 - 200
    ticks = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .withColumn("symbol", F.col("l_suppkey").cast("string"))
        .withColumn("px", F.greatest(10000 + F.sum(tick).over(walk), F.lit(100)) / F.lit(100.0))
        .withColumn("rn", F.row_number().over(walk))
        .withColumn("bucket", F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / days))
    )
    return ticks.groupBy("symbol", "bucket").agg(
        F.min_by("px", "rn").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "rn").alias("close"), F.sum("l_quantity").cast("bigint").alias("volume")
    ).select("symbol", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("bucket") * days).cast("int")).alias("date"), "open", "high", "low", "close", "volume")


def market_index(bars: DataFrame, symbol: str = "IDX") -> DataFrame:
    """The mean close of all symbols on every date, rounded to 4, as bars of one more symbol."""
    cents = F.sum(F.round(F.col("close") * 100).cast("bigint"))
    rows = bars.groupBy("date").agg(F.round(cents / F.count("*") / 100, 4).alias("close"), F.sum("volume").alias("volume"))
    return rows.select(F.lit(symbol).alias("symbol"), "date", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", "volume")


def region_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker and index_code: every supplier's region."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    return read("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("index_code"))


def damaged(bars: DataFrame) -> DataFrame:
    """The bars with fixed kinds of damage at fixed bar numbers of each symbol."""
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1
    hit = lambda n, r: F.col("k") % n == r
    return (
        bars.withColumn("k", k)
        .withColumns({"high": F.when(hit(97, 5), F.col("low")).otherwise(F.col("high")), "low": F.when(hit(97, 5), F.col("high")).otherwise(F.col("low"))})
        .withColumns(
            {
                "close": F.when(hit(101, 7), None).when(hit(89, 3), F.col("high") * F.lit(1.05)).otherwise(F.col("close")),
                "open": F.when(hit(107, 13), F.lit(float("nan"))).when(hit(83, 2), F.col("low") * F.lit(0.95)).otherwise(F.col("open")),
                "low": F.when(hit(103, 11), F.lit(0.0)).otherwise(F.col("low")),
                "volume": F.when(hit(19, 4), F.lit(0)).otherwise(F.col("volume")).cast("bigint"),
            }
        )
        .drop("k")
    )
