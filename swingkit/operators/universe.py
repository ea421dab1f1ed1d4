"""Choosing symbols, bars and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_enough_bars(bars: DataFrame, min_rows: int = 500) -> DataFrame:
    """Bars of symbols with at least ``min_rows``."""
    enough = bars.groupBy("symbol").count().filter(F.col("count") >= min_rows)
    return bars.join(enough, "symbol", "left_semi")


def without_indices(bars: DataFrame, indices: DataFrame) -> DataFrame:
    """Bars of symbols that aren't an index_code."""
    return bars.join(indices.select(F.col("index_code").alias("symbol")), "symbol", "left_anti")


def members_of(bars: DataFrame, stock_index: DataFrame, codes: list[str]) -> DataFrame:
    """Bars of the tickers of any of the index codes."""
    return bars.join(stock_index.filter(F.col("index_code").isin(codes)).select(F.col("ticker").alias("symbol")), "symbol", "left_semi")


def first_symbols(bars: DataFrame, n: int) -> DataFrame:
    """Bars of the first ``n`` symbols by name."""
    return bars.join(bars.select("symbol").distinct().orderBy("symbol").limit(n), "symbol", "left_semi")


def date_window(bars: DataFrame, start: str | None = None, end: str | None = None, warmup: int = 300) -> DataFrame:
    """Bars up to ``end``, from ``warmup`` bars before the first at or after ``start``; without one, the last ``warmup`` bars."""
    out = bars if end is None else bars.filter(F.col("date") <= F.lit(end).cast("date"))
    if start is None:
        return out
    own = Window.partitionBy("symbol")
    out = out.withColumns({"_n": F.row_number().over(own.orderBy("date")) - 1, "_all": F.count("*").over(own)})
    out = out.withColumn("_from", F.coalesce(F.min(F.when(F.col("date") >= F.lit(start).cast("date"), F.col("_n"))).over(own), F.col("_all")))
    return out.filter(F.col("_n") >= F.col("_from") - warmup).drop("_n", "_all", "_from")


def by_anchor(detections: DataFrame, anchor: str = "breakout_or_end", start: str | None = None, end: str | None = None) -> DataFrame:
    """Detections whose anchor date is in the range; those without one go, if a bound is given."""
    at = F.coalesce("breakout_date", "formation_end") if anchor == "breakout_or_end" else F.col(anchor)
    out = detections
    if start is not None:
        out = out.filter(at >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(at <= F.lit(end).cast("date"))
    return out


def confirmed(detections: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Detections with a breakout date and price, of patterns that aren't skipped."""
    out = detections.filter("breakout_date is not null and breakout_price is not null")
    return out.filter(~F.col("pattern_name").isin(skip)) if skip else out


def min_price(detections: DataFrame, least: float, keep_null: bool = False) -> DataFrame:
    """Detections whose breakout price is at least ``least``; a null price stays only where asked."""
    return detections.filter(F.coalesce(F.col("breakout_price") >= least, F.lit(keep_null)))


def of_patterns(detections: DataFrame, keys: list[str], dim: DataFrame) -> DataFrame:
    """Detections of the named patterns; an unknown name is an error."""
    known = {r.pattern_key for r in dim.select("pattern_key").collect()}  # a row a pattern
    if unknown := sorted(set(keys) - known):
        raise ValueError(f"unknown patterns: {unknown}")
    return detections.filter(F.col("pattern_name").isin(keys))


def cap(detections: DataFrame, by: list[str], n: int, mode: str = "first", seed: int = 0) -> DataFrame:
    """At most ``n`` detections a group: the first, those of top_confidence, or a repeatable random choice; none for n < 1."""
    date, down = F.coalesce(F.col("breakout_date").cast("string"), F.lit("")), F.desc("confidence_score")
    orders = {"first": [date, down, "pattern_name", "pattern_id"], "top_confidence": [down, date, "pattern_id"], "random": [F.xxhash64("pattern_id", F.lit(seed)), "pattern_id"]}
    return detections.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*orders[mode]))).filter(F.col("_r") <= n).drop("_r")


def top_cases(detections: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` confirmed detections of each pattern and direction with the highest confidence, then the widest."""
    order = Window.partitionBy("pattern_name", "breakout_direction").orderBy(F.desc("confidence_score"), F.desc("pattern_width_bars"), "pattern_id")
    chosen = confirmed(detections).filter(F.col("breakout_direction").isin("up", "down"))
    return chosen.withColumn("case_rank", F.row_number().over(order)).filter(F.col("case_rank") <= n)
