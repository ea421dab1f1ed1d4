"""Patterns of a few neighbouring bars, by window functions over each symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from swingkit.operators import chain
from swingkit.operators.sequences import DETECTION, SHORT_CELL, near_bars


def _by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("idx")


def _lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(_by_symbol())


def _between(value: Column, low: float | None, high: float | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return ok


def _detections(found: DataFrame, key: str, kind: str, start: Column, end: Column, **values: Column) -> DataFrame:
    """The detection columns; ``start`` and ``end`` are the bars of the id."""
    fixed = {"pattern_id": F.concat_ws("_", "symbol", F.lit(key), start, end), "symbol": F.col("symbol"), "pattern_name": F.lit(key), "pattern_type": F.lit(kind), "volume_confirmed": F.lit(False), "target_price": F.lit(None).cast("double"), "stop_loss_price": F.lit(None).cast("double")}
    return found.select(*[(fixed | values)[c].alias(c) for c in DETECTION])


def inside_days(bars: DataFrame, threshold_pct: float = 0.5, max_return: int = 2, height: tuple = (None, None), key: str = "inside_day", kind: str = "continuation_both") -> DataFrame:
    """A bar inside the one before, left by a close beyond it within ``max_return`` bars."""
    out = bars.withColumns({"h0": _lag("high"), "l0": _lag("low"), "d0": _lag("date")} | {f"{c}{n}": F.lead(c, n).over(_by_symbol()) for n in range(1, max_return + 1) for c in ("close", "date")})
    out = out.filter((F.col("high") < F.col("h0")) & (F.col("low") > F.col("l0")) & (F.col("high") > F.col("low")))
    size = (F.col("high") - F.col("low")) / ((F.col("high") + F.col("low")) / 2) * 100
    hit = lambda n: F.when(F.col(f"close{n}") > F.col("high") * (1 + threshold_pct / 100), "up").when(F.col(f"close{n}") < F.col("low") * (1 - threshold_pct / 100), "down")
    first = F.coalesce(*(F.when(hit(n).isNotNull(), F.struct((F.col("idx") + n).alias("idx"), F.col(f"date{n}").alias("date"), F.col(f"close{n}").alias("price"), hit(n).alias("way"))) for n in range(1, max_return + 1)))
    out = out.withColumns({"hit": first, "size": size}).filter(F.col("hit").isNotNull() & _between(F.col("size"), *height))
    up, span = F.col("hit.way") == "up", F.col("high") - F.col("low")
    return _detections(
        out, key, kind, F.col("idx") - 1, F.col("idx"), formation_start=F.col("d0"), formation_end=F.col("date"), breakout_date=F.col("hit.date"), breakout_idx=F.col("hit.idx"), breakout_direction=F.col("hit.way"), breakout_price=F.col("hit.price"),
        target_price=F.when(up, F.col("hit.price") + span).otherwise(F.col("hit.price") - span), stop_loss_price=F.when(up, F.col("low")).otherwise(F.col("high")), confidence_score=F.lit(70),
        pattern_height_pct=F.round("size", 2), pattern_width_bars=F.lit(2), touch_count=F.lit(2), pivot_indices=F.array(F.col("idx") - 1, F.col("idx")),
    )


def with_gaps(bars: DataFrame, least_pct: float, most_pct: float | None) -> DataFrame:
    """``bars`` plus the last bar's high and low and ``gap``: up, down or null."""
    out = bars.withColumns({"h0": _lag("high"), "l0": _lag("low")})
    rise = (F.col("low") - F.col("h0")) / ((F.col("low") + F.col("h0")) / 2)
    fall = (F.col("l0") - F.col("high")) / ((F.col("l0") + F.col("high")) / 2)
    most = None if most_pct is None else most_pct / 100
    way = F.when((F.col("low") > F.col("h0") * (1 + least_pct / 100)) & _between(rise, None, most), "up").when((F.col("high") < F.col("l0") * (1 - least_pct / 100)) & _between(fall, None, most), "down")
    return out.withColumns({"gap": way, "gap_share": F.when(way == "up", rise).otherwise(fall), "gap_size": F.when(way == "up", F.col("low") - F.col("h0")).otherwise(F.col("l0") - F.col("high"))})


def gaps(bars: DataFrame, least_pct: float = 0.1, most_pct: float | None = None, height: tuple = (None, None), key: str = "gaps", kind: str = "continuation_both") -> DataFrame:
    """Bars wholly above or below the bar before, by at least ``least_pct``."""
    out = with_gaps(bars, least_pct, most_pct).filter(F.col("gap").isNotNull() & _between(F.col("gap_share") * 100, *height))
    up = F.col("gap") == "up"
    return _detections(
        out, key, kind, F.col("idx"), F.col("idx"), formation_start=F.col("date"), formation_end=F.col("date"), breakout_date=F.col("date"), breakout_idx=F.col("idx"), breakout_direction=F.col("gap"), breakout_price=F.col("close"),
        target_price=F.when(up, F.col("close") + F.col("gap_size")).otherwise(F.col("close") - F.col("gap_size")), stop_loss_price=F.when(up, F.col("h0")).otherwise(F.col("l0")), confidence_score=F.lit(65),
        pattern_height_pct=F.round(F.col("gap_share") * 100, 3), pattern_width_bars=F.lit(1), touch_count=F.lit(1), pivot_indices=F.array(F.col("idx") - 1, F.col("idx")),
    )


def three_methods(bars: DataFrame, body_atr: float = 1.5, last_body_atr: float = 1.5, middle_pct: float = 50, height: tuple = (None, None), key: str = "rising_falling_three_methods", kind: str = "continuation_both") -> DataFrame:
    """A long bar, three small ones inside it, and a long bar of the same way that closes beyond the first."""
    out = bars.withColumns({f"{c}{n}": _lag(c, 5 - n) for n in range(1, 5) for c in ("open", "close", "high", "low", "date")} | {"atr1": _lag("atr", 4)})
    atr = F.coalesce(F.nullif(F.col("atr1"), F.lit(0.0)), F.col("atr"))
    body = lambda n="": F.abs(F.col(f"close{n}") - F.col(f"open{n}"))
    inside = F.lit(True)
    for n in (2, 3, 4):
        inside = inside & (F.col(f"high{n}") <= F.col("high1")) & (F.col(f"low{n}") >= F.col("low1")) & (body(n) <= body(1) * (middle_pct / 100))
    long = (atr > 0) & (body(1) >= body_atr * atr) & (body() >= last_body_atr * atr)
    way = F.when((F.col("close1") > F.col("open1")) & (F.col("close") > F.col("open")) & (F.col("close") > F.col("close1")), "up").when((F.col("close1") < F.col("open1")) & (F.col("close") < F.col("open")) & (F.col("close") < F.col("close1")), "down")
    span = F.col("high1") - F.col("low1")
    out = out.withColumns({"way": way, "size": span / ((F.col("high1") + F.col("low1")) / 2) * 100}).filter(inside & long & F.col("way").isNotNull() & (span > 0) & _between(F.col("size"), *height))
    up = F.col("way") == "up"
    return _detections(
        out, key, kind, F.col("idx") - 4, F.col("idx"), formation_start=F.col("date1"), formation_end=F.col("date"), breakout_date=F.col("date"), breakout_idx=F.col("idx"), breakout_direction=F.col("way"), breakout_price=F.col("close"),
        target_price=F.when(up, F.col("close") + span).otherwise(F.col("close") - span), stop_loss_price=F.when(up, F.col("low1")).otherwise(F.col("high1")), confidence_score=F.lit(80),
        pattern_height_pct=F.round("size", 2), pattern_width_bars=F.lit(5), touch_count=F.lit(5), pivot_indices=F.sequence(F.col("idx") - 4, F.col("idx")),
    )


def spikes(bars: DataFrame, least_pct: float = 3.0, height: tuple = (None, None), key: str = "spike_formation", kind: str = "continuation_both") -> DataFrame:
    """Bars whose range is at least ``least_pct`` of the last close; the way is that of their body."""
    out = bars.withColumn("c0", _lag("close")).withColumn("share", F.when(F.col("c0") > 0, (F.col("high") - F.col("low")) / F.col("c0")))
    out = out.filter((F.col("share") >= least_pct / 100) & _between(F.col("share") * 100, *height))
    up, span = F.col("close") >= F.col("open"), F.col("high") - F.col("low")
    return _detections(
        out, key, kind, F.col("idx"), F.col("idx"), formation_start=F.col("date"), formation_end=F.col("date"), breakout_date=F.col("date"), breakout_idx=F.col("idx"), breakout_direction=F.when(up, "up").otherwise("down"), breakout_price=F.col("close"),
        target_price=F.when(up, F.col("close") + span).otherwise(F.col("close") - span), stop_loss_price=F.when(up, F.col("low")).otherwise(F.col("high")), confidence_score=F.lit(70),
        pattern_height_pct=F.round(F.col("share") * 100, 2), pattern_width_bars=F.lit(1), touch_count=F.lit(1), pivot_indices=F.array("idx"),
    )


def dead_cat_bounces(bars: DataFrame, decline: float = 15, decline_bars: int = 8, bounce: tuple = (15, 35), bounce_bars: tuple = (5, 25), volume: float = 2.0, least_bars: int = 50, key: str = "dead_cat_bounce", kind: str = "event_bearish") -> DataFrame:
    """A fall of 15 % within 8 bars, then a bounce of 15 to 35 % that peaks 5 to 25 bars after the low."""
    ahead = _by_symbol().rowsBetween(bounce_bars[0], bounce_bars[1])
    marked = bars.withColumns(
        {
            "n": F.count("*").over(Window.partitionBy("symbol")), "h0": _lag("high"), "l0": _lag("low"),
            "bottom": F.min(F.struct("low", "idx")).over(_by_symbol().rowsBetween(0, decline_bars)), "peak": F.max(F.struct("high", -F.col("idx"))).over(ahead),
        }
    )
    lows = marked.select("symbol", F.col("idx").alias("low_idx"), F.col("peak.high").alias("peak_high"), (-F.col("peak.col2")).alias("peak_idx"))
    starts = marked.filter((F.col("n") >= least_bars) & (F.col("idx") >= 1) & (F.col("idx") < F.col("n") - 2) & (F.col("h0") > 0)).withColumns({"low_idx": F.col("bottom.idx"), "bottom_low": F.col("bottom.low"), "fall": (F.col("h0") - F.col("bottom.low")) / F.col("h0") * 100})
    out = starts.filter(F.col("fall") >= decline).join(lows, ["symbol", "low_idx"]).withColumn("rise", (F.col("peak_high") - F.col("bottom_low")) / F.col("bottom_low") * 100).filter(F.col("rise").between(*bounce))
    first = Window.partitionBy("symbol", "low_idx", "peak_idx").orderBy("idx")
    out = out.withColumn("r", F.row_number().over(first)).filter("r = 1").join(bars.select("symbol", F.col("idx").alias("peak_idx"), F.col("date").alias("peak_date"), F.col("close").alias("peak_close")), ["symbol", "peak_idx"])
    gap = F.coalesce(F.col("high") < F.col("l0"), F.lit(False))
    points = F.lit(65) + F.when(gap, 10).otherwise(0) + F.when(F.col("fall") >= 25, 5).otherwise(0) + F.when(F.col("rise") >= 25, 5).otherwise(0) + F.when(F.col("volume_ratio") >= volume, 10).otherwise(0)
    return _detections(
        out, key, kind, F.col("idx"), F.col("peak_idx"), formation_start=F.col("date"), formation_end=F.col("peak_date"), breakout_date=F.col("peak_date"), breakout_idx=F.col("peak_idx"), breakout_direction=F.lit("down"), breakout_price=F.col("peak_close"),
        confidence_score=F.least(F.lit(100), points), volume_confirmed=gap, pattern_height_pct=F.round("fall", 2), pattern_width_bars=F.col("peak_idx") - F.col("idx") + 1, touch_count=F.lit(4), pivot_indices=F.array(F.col("idx") - 1, F.col("idx"), F.col("low_idx"), F.col("peak_idx")),
    )


def inverted_dead_cats(bars: DataFrame, rise: float = 5.0, volume: float = 2.0, least_bars: int = 10, key: str = "dead_cat_bounce_inverted", kind: str = "event_bearish") -> DataFrame:
    """A close 5 % up, then a bar with a higher high and a higher low; anchored at that second bar."""
    out = bars.withColumns({"n": F.count("*").over(Window.partitionBy("symbol")), "c0": _lag("close"), "h0": _lag("high"), "d0": _lag("date")} | {f"{c}2": F.lead(c).over(_by_symbol()) for c in ("high", "low", "close", "date")})
    move = F.when(F.col("c0") > 0, (F.col("close") - F.col("c0")) / F.col("c0") * 100)
    out = out.withColumn("move", move).filter((F.col("n") >= least_bars) & (F.col("move") >= rise) & (F.col("high2") > F.col("high")) & (F.col("low2") > F.col("low")) & (F.col("close2") > 0))
    gap = F.col("low") > F.col("h0")
    points = F.lit(60) + F.when(gap, 10).otherwise(0) + F.when(F.col("move") >= 10, 10).otherwise(0) + F.when(F.col("volume_ratio") >= volume, 10).otherwise(0)
    return _detections(
        out, key, kind, F.col("idx"), F.col("idx") + 1, formation_start=F.col("d0"), formation_end=F.col("date2"), breakout_date=F.col("date2"), breakout_idx=F.col("idx") + 1, breakout_direction=F.lit("down"), breakout_price=F.col("close2"),
        confidence_score=F.least(F.lit(100), points), volume_confirmed=gap, pattern_height_pct=F.round("move", 2), pattern_width_bars=F.lit(3), touch_count=F.lit(3), pivot_indices=F.array(F.col("idx") - 1, F.col("idx"), F.col("idx") + 1),
    )


def islands(bars: DataFrame, least_pct: float = 0.5, most_pct: float | None = None, max_bars: int = 20, min_bars: int = 1, height: tuple = (None, None), key: str = "islands", kind: str = "reversal_both", segment: int = chain.SEGMENT) -> DataFrame:
    """Bars cut off by a gap on one side and the opposite gap on the other; after an island the search goes on behind it.

    An island's successor is the first that begins behind it, one of the ``max_bars`` that follow. An island has a height, so it
    ends behind the first bar that isn't flat at the price of its first; bars are clean, with no high below its low. Where any
    height will do, the first opposite gap behind that bar is the end, and no other pair of gaps is looked at.
    """
    marked = with_gaps(bars, least_pct, most_pct)
    flat_on = (F.col("high") <= F.col("low")) & (F.col("h0") <= F.col("l0")) & (F.col("high") == F.col("h0"))
    later = Window.partitionBy("symbol").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    first_only = height == (None, None) and min_bars <= 2
    if first_only:
        # The next gap of each way behind every bar, and from there behind the bar that moves: running values, no arrays.
        marked = marked.withColumns({way: F.last(F.when(F.col("gap") == way, F.struct("idx", "date", "close")), ignorenulls=True).over(later) for way in ("up", "down")})
        both = F.struct("up", "down")
        behind = F.when(F.col("high") > F.col("low"), both).otherwise(F.last(F.when(~F.coalesce(flat_on, F.lit(False)), both), ignorenulls=True).over(later))
        cut = marked.withColumn("behind", behind).filter("gap is not null").withColumn("x", F.when(F.col("gap") == "up", F.col("behind.down")).otherwise(F.col("behind.up")))
        pairs = cut.filter(F.col("x.idx") - F.col("idx") <= max_bars - 1).select("symbol", F.col("idx").alias("i"), F.col("gap").alias("way"), F.col("date").alias("start_date"), "x")
    else:
        next_move = F.last(F.when(~F.coalesce(flat_on, F.lit(False)), F.col("idx")), ignorenulls=True).over(later)
        marked = marked.withColumn("moves", F.when(F.col("high") > F.col("low"), F.col("idx")).otherwise(next_move))
        beside = _by_symbol().rowsBetween(1, max(1, max_bars - 1))
        cut = marked.filter("gap is not null").withColumn("ahead", F.collect_list(F.struct("idx", "gap", "date", "close")).over(beside))
        ends = F.filter("ahead", lambda x: (x["gap"] != F.col("gap")) & (x["idx"] > F.col("moves")) & (x["idx"] - F.col("idx")).between(max(1, min_bars - 1), max_bars - 1))
        pairs = cut.select("symbol", F.col("idx").alias("i"), F.col("gap").alias("way"), F.col("date").alias("start_date"), F.explode(F.slice(ends, 1, 1) if height == (None, None) else ends).alias("x"))
    pairs = pairs.select("symbol", "i", "way", "start_date", F.col("x.idx").alias("j"), F.col("x.date").alias("end_date"), F.col("x.close").alias("end_close"))
    ranges = near_bars(pairs, bars.select("symbol", "idx", "high", "low"), "i", F.col("i"), F.col("j") - 1, SHORT_CELL).groupBy("symbol", "i", "j", "way", "start_date", "end_date", "end_close").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    ranges = ranges.withColumn("size", (F.col("top") - F.col("bottom")) / ((F.col("top") + F.col("bottom")) / 2) * 100).filter((F.col("top") > F.col("bottom")) & _between(F.col("size"), *height))
    first = ranges if first_only else ranges.withColumn("r", F.row_number().over(Window.partitionBy("symbol", "i").orderBy("j"))).filter("r = 1")
    order = Window.partitionBy("symbol").orderBy("i")
    first = first.withColumns({"k": F.row_number().over(order) - 1, "ahead": F.collect_list("i").over(order.rowsBetween(1, max_bars))})
    passed = F.size(F.filter("ahead", lambda i: i <= F.col("j")))
    out = chain.followed(first.select("symbol", "k", (F.col("k") + 1 + passed).alias("nxt"), F.struct("i", "j", "way", "start_date", "end_date", "end_close", "top", "bottom", "size").alias("value")), ["symbol"], segment).select("symbol", "value.*")
    down, span = F.col("way") == "up", F.col("top") - F.col("bottom")
    return _detections(
        out, key, kind, F.col("i"), F.col("j"), formation_start=F.col("start_date"), formation_end=F.col("end_date"), breakout_date=F.col("end_date"), breakout_idx=F.col("j"), breakout_direction=F.when(down, "down").otherwise("up"), breakout_price=F.col("end_close"),
        target_price=F.when(down, F.col("end_close") - span).otherwise(F.col("end_close") + span), stop_loss_price=F.when(down, F.col("top")).otherwise(F.col("bottom")), confidence_score=F.lit(75),
        pattern_height_pct=F.round("size", 2), pattern_width_bars=F.col("j") - F.col("i") + 1, touch_count=F.lit(2), pivot_indices=F.array("i", "j"),
    )
