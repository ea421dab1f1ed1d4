"""Cleaning of bars and indicators; every window is over one symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from swingkit.operators import cells

PRICES = ["open", "high", "low", "close"]
#: Bars that an indicator looks back at most.
REACH = 20


def _bad(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def _any(test, columns: list[str] = PRICES) -> Column:
    found = test(columns[0])
    for c in columns[1:]:
        found = found | test(c)
    return found


def _by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("idx")


def flagged(bars: DataFrame, fix_high_low: bool = True, clamp: bool = True) -> DataFrame:
    """``bars`` with prices mended and the flags was_null, was_swapped, was_clamped and not_positive of every row."""
    out = bars.withColumn("was_null", _any(_bad))
    out = out.withColumn("was_swapped", ~F.col("was_null") & (F.col("high") < F.col("low")))
    if fix_high_low:
        out = out.withColumns({"high": F.when(F.col("was_swapped"), F.col("low")).otherwise(F.col("high")), "low": F.when(F.col("was_swapped"), F.col("high")).otherwise(F.col("low"))})
    inside = lambda c: F.least(F.greatest(F.col(c), F.col("low")), F.col("high"))
    out = out.withColumn("was_clamped", ~F.col("was_null") & ((inside("open") != F.col("open")) | (inside("close") != F.col("close"))))
    if clamp:
        out = out.withColumns({c: F.when(F.col("was_null"), F.col(c)).otherwise(inside(c)) for c in ("open", "close")})
    return out.withColumn("not_positive", ~F.col("was_null") & _any(lambda c: (F.col(c) <= 0) | (F.abs(c) == float("inf"))))


def clean(bars: DataFrame, drop_null: bool = True, fix_high_low: bool = True, clamp: bool = True, drop_non_positive: bool = True, counters: Observation | None = None, period: str | None = None) -> DataFrame:
    """Clean bars with their position ``idx`` in the symbol, in date order (ties by the other columns).

    ``counters`` gets the counters of :func:`cleaning_stats` over all symbols from the first job that reads the clean bars, without a pass of its own.
    With a ``period`` such as "year" no task holds more of a symbol than that (see :func:`swingkit.operators.cells.positioned`).
    """
    out = flagged(bars, fix_high_low, clamp)
    if counters is not None:
        out = out.observe(counters, *_counters())
    if drop_null:
        out = out.filter(~F.col("was_null"))
    if drop_non_positive:
        out = out.filter(~F.col("not_positive"))
    out = out.drop("was_null", "was_swapped", "was_clamped", "not_positive")
    return cells.positioned(out, [*PRICES, "volume"], period) if period else positioned(out)


def positioned(bars: DataFrame) -> DataFrame:
    """``bars`` with ``idx``, 0 to N - 1 in each symbol."""
    order = Window.partitionBy("symbol").orderBy("date", *PRICES, "volume")
    return bars.withColumn("idx", F.row_number().over(order) - 1)


def _counters() -> list[Column]:
    """Counts over rows of :func:`flagged`."""
    n = lambda c: F.count_if(c).alias
    kept = ~F.col("was_null") & ~F.col("not_positive")
    return [
        F.count("*").alias("input_rows"), n(F.col("was_null"))("removed_null"), n(F.col("was_swapped"))("fixed_high_low"), n(F.col("was_clamped"))("fixed_open_close"),
        n(F.col("not_positive"))("removed_non_positive"), n(kept & (F.col("volume") == 0))("zero_volume"), n(kept)("output_rows"),
    ]


def cleaning_stats(bars: DataFrame) -> DataFrame:
    """Counters of the cleaning of every symbol."""
    return flagged(bars).groupBy("symbol").agg(*_counters())


def add_indicators(bars: DataFrame) -> DataFrame:
    """Typical price, true range, ATR (14), volume mean (20, zeros missing) and ratio, return and range in percent."""
    w = _by_symbol()
    previous = F.lag("close").over(w)
    full = lambda c, n, f=F.avg: F.when(F.count(c).over(w.rowsBetween(1 - n, 0)) == n, f(c).over(w.rowsBetween(1 - n, 0)))
    out = bars.withColumns(
        {
            "typical_price": (F.col("high") + F.col("low") + F.col("close")) / 3,
            "true_range": F.when(previous.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))),
            "return_pct": (F.col("close") - previous) / F.nullif(previous, F.lit(0.0)) * 100,
            "range_pct": (F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0)) * 100,
            "_traded": F.nullif(F.col("volume"), F.lit(0)),
        }
    )
    out = out.withColumns({"atr": full("true_range", 14), "volume_ma": full("_traded", 20)}).drop("_traded")
    return out.withColumn("volume_ratio", F.col("volume") / F.nullif(F.col("volume_ma"), F.lit(0.0)))


def quarantine(bars: DataFrame, min_rows: int = 200) -> DataFrame:
    """symbol, reason and n_rows of symbols that can't be scanned: too few rows, repeated dates, or no valid price."""
    valid = ~_any(_bad) & ~_any(lambda c: F.coalesce(F.col(c) <= 0, F.lit(True)))
    sums = bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("days"), F.count_if(valid).alias("valid"))
    reason = F.when(F.col("valid") == 0, "no_valid_price").when(F.col("days") < F.col("n_rows"), "duplicate_dates").when(F.col("n_rows") < min_rows, "too_few_rows")
    return sums.select("symbol", reason.alias("reason"), "n_rows").filter("reason is not null")


def without(bars: DataFrame, dropped: DataFrame) -> DataFrame:
    """The bars of symbols that aren't in ``dropped``."""
    return bars.join(dropped.select("symbol"), "symbol", "left_anti")
