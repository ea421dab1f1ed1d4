"""Cups with a handle and pipes, upright and inverted, with breakouts that hold for several closes.

Pairs of pivots come from a window over each symbol's pivots (cups) or a join by cells of bars (pipes), so a pivot meets
only those within the pattern's width. Bars are joined by cells too; each leg of a cup between two rims is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swingkit.operators.derived import axes, degrees, mirrored, with_pivot_prices
from swingkit.operators.pivots import thin
from swingkit.operators.sequences import DETECTION, SHORT_CELL, near_bars, prior_trend
from swingkit.sources.sinks import stored

# Bars of a handle, of the breakout search after a pipe, and of a pipe's legs; the widest difference of rims (%).
HANDLE_MIN, HANDLE_MAX, PIPE_SEARCH, LEG, RIMS_APART = 5, 20, 30, 3, 10.0


@dataclass(frozen=True)
class Breakout:
    """How a close has to leave a level: by ``threshold_pct``, and so many closes in a row; maybe with volume."""

    threshold_pct: float = 1.0
    closes: int = 1
    volume_required: bool = False
    volume_min: float = 1.3


@dataclass(frozen=True)
class Cup:
    """Limits of a cup and its handle; percentages of the mean rim."""

    width: tuple[int, int] = (84, 504)
    depth: tuple[float, float] = (15.0, 33.0)
    handle_decline: tuple[float, float] = (2.0, 12.0)
    handle_position: float = 67.0
    tolerance: float = 2.0
    trend: tuple[str, int, float] = ("up", 0, 0.0)
    search: int = 60
    breakout: Breakout = Breakout()
    kind: str = "continuation_bullish"


@dataclass(frozen=True)
class Pipe:
    """Limits of a pipe: width and separation in bars, ratio of its two extremes, legs (% and degrees), height (%).

    The widest pipe has to be named, since every pair of extremes up to it is looked at.
    """

    width: tuple[int, int]
    separation: tuple[int, int]
    ratio: tuple[float, float] = (0.97, 1.03)
    leg: tuple[float, float] = (0.0, 1e9)
    angle: tuple[float, float] = (0.0, 90.0)
    height: tuple[float, float] = (0.0, 1e9)
    trend: tuple[str, int, float] = ("any", 0, 0.0)
    breakout: Breakout = Breakout()


def _asked(trend: tuple[str, int, float]) -> dict[str, Column]:
    return dict(zip(("trend", "trend_bars", "trend_pct"), map(F.lit, trend), strict=True))


def _gap_pct(a: str, b: str) -> Column:
    return F.coalesce(F.abs(F.col(a) - F.col(b)) / F.nullif(F.least(F.abs(a), F.abs(b)), F.lit(0.0)) * 100, F.lit(float("inf")))


def confirmed_breakout(found: DataFrame, bars: DataFrame, key: str, search: int, rule: Breakout, up: bool = True) -> DataFrame:
    """``found`` (key, symbol, end_idx, level) plus ``hit``: the first bar within ``search`` bars after ``end_idx`` whose close, and
    as many after it as asked (fewer at the end of the data), lie beyond the level. Rows without one are left out.
    ``found`` is stored, as both the search and its result need it."""
    found = stored(found)
    ahead = Window.partitionBy("symbol").orderBy("idx").rowsBetween(0, rule.closes - 1)
    held = (F.min if up else F.max)("close").over(ahead)
    lean = bars.select("symbol", "idx", "date", "close", "volume_ratio", held.alias("held"))
    near = near_bars(found.select(key, "symbol", "end_idx", "level"), lean, key, F.col("end_idx") + 1, F.col("end_idx") + search)
    limit = F.col("level") * (1 + rule.threshold_pct / 100 * (1 if up else -1))
    beyond = F.col("held") > limit if up else F.col("held") < limit
    volume_ok = F.coalesce(F.col("volume_ratio") >= rule.volume_min, F.lit(False))
    hits = near.filter(beyond & (volume_ok | F.lit(not rule.volume_required))).groupBy("symbol", key).agg(F.min(F.struct("idx", "date", "close", volume_ok.alias("volume_ok"))).alias("hit"))
    return found.join(hits, ["symbol", key])


def _cups(bars: DataFrame, rims: DataFrame, key: str, cup: Cup, spacing: int, dates: DataFrame | None = None) -> DataFrame:
    """Cups under the ``rims`` (symbol, idx, price), one row a pair of rims, with the detection columns and ``breakout_price`` of ``bars``.

    ``dates`` has the same bars for what asks for no price, where prices have to be worked out.
    """
    dates = bars if dates is None else dates
    by_rim = Window.partitionBy("symbol").orderBy("idx")
    rims = rims.select("symbol", "idx", "price", F.lead("idx").over(by_rim).alias("next_idx"))
    legs = near_bars(rims.filter("next_idx is not null").withColumnRenamed("idx", "at"), bars.select("symbol", "idx", "low"), "at", F.col("at"), F.col("next_idx"), SHORT_CELL)
    legs = legs.groupBy("symbol", F.col("at").alias("idx")).agg(F.min(F.struct("low", "idx")).alias("leg"))
    most = cup.width[1] // spacing + 1  # rims are at least so far apart
    ahead = F.collect_list(F.struct("idx", "price", "leg")).over(by_rim.rowsBetween(0, most))
    last = dates.groupBy("symbol").agg(F.max("idx").alias("last_idx"))
    left = rims.join(legs, ["symbol", "idx"], "left").select("symbol", F.col("idx").alias("start_idx"), F.col("price").alias("p0"), ahead.alias("ahead")).join(last, "symbol")
    left = prior_trend(left.filter(F.col("start_idx") + cup.width[0] - 1 <= F.col("last_idx")).withColumns(_asked(cup.trend)), bars)
    pairs = left.select("*", F.posexplode("ahead").alias("step", "right")).filter("step > 0")
    pairs = pairs.withColumns({"right_idx": F.col("right.idx"), "p1": F.col("right.price"), "bottom": F.array_min(F.transform(F.slice("ahead", 1, F.col("step")), lambda x: x["leg"]))}).drop("ahead", "right")
    pairs = pairs.withColumns({"width": F.col("right_idx") - F.col("start_idx") + 1, "rim_gap": _gap_pct("p0", "p1"), "rim": (F.col("p0") + F.col("p1")) / 2})
    pairs = pairs.withColumn("depth", (F.col("rim") - F.col("bottom.low")) / F.col("rim") * 100)
    pairs = pairs.filter(
        F.col("width").between(*cup.width) & (F.col("rim_gap") <= max(cup.tolerance, RIMS_APART)) & (F.col("bottom.low") > 0) & (F.col("rim") > 0)
        & F.col("depth").between(*cup.depth) & (F.col("right_idx") + 1 + HANDLE_MIN <= F.col("last_idx"))
    ).withColumn("pair_id", F.concat_ws("_", "symbol", "start_idx", "right_idx"))
    handles = near_bars(pairs.drop("width", "trend", "trend_bars", "trend_pct", "prior_dir"), bars.select("symbol", "idx", F.col("low").alias("h_low"), F.col("high").alias("h_high"), F.col("date").alias("h_date")), "pair_id", F.col("right_idx") + 1, F.col("right_idx") + HANDLE_MAX, SHORT_CELL)
    so_far = Window.partitionBy("symbol", "pair_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    handles = handles.withColumns({"low_bar": F.min(F.struct(F.col("h_low").alias("low"), "idx")).over(so_far), "level": F.max("h_high").over(so_far), "end_idx": F.col("idx")}).drop("idx")
    decline, place = (F.col("rim") - F.col("low_bar.low")) / F.col("rim") * 100, (F.col("low_bar.low") - F.col("bottom.low")) / (F.col("rim") - F.col("bottom.low")) * 100
    handles = handles.filter(
        (F.col("end_idx") >= F.col("right_idx") + HANDLE_MIN) & (F.col("end_idx") - F.col("start_idx") + 1 <= cup.width[1]) & decline.between(*cup.handle_decline)
        & (place >= cup.handle_position) & (F.col("level") > 0) & (_gap_pct("level", "rim") <= max(cup.tolerance, RIMS_APART))
    ).withColumn("handle_id", F.concat_ws("_", "pair_id", "end_idx"))
    broken = confirmed_breakout(handles, bars, "handle_id", cup.search, cup.breakout)
    rows = [c for c in broken.columns if c not in ("symbol", "pair_id")]
    first = broken.groupBy("symbol", "pair_id").agg(F.min_by(F.struct(*rows), "end_idx").alias("x")).select("symbol", "x.*")
    starts = dates.select("symbol", F.col("idx").alias("start_idx"), F.col("date").alias("start_date"))
    score = F.lit(70) + F.when(F.col("rim_gap") <= cup.tolerance, 10).when(F.col("rim_gap") <= 5, 5).otherwise(0) + F.when(F.col("hit.volume_ok"), 10).otherwise(0)
    values = {
        "pattern_id": F.concat_ws("_", "symbol", F.lit(key), "start_idx", "end_idx"), "symbol": F.col("symbol"), "pattern_name": F.lit(key), "pattern_type": F.lit(cup.kind),
        "formation_start": F.col("start_date"), "formation_end": F.col("h_date"), "breakout_date": F.col("hit.date"), "breakout_idx": F.col("hit.idx"), "breakout_direction": F.lit("up"), "breakout_price": F.col("hit.close"),
        "target_price": F.col("hit.close") + F.greatest(F.lit(0.0), F.col("rim") - F.col("bottom.low")), "stop_loss_price": F.col("low_bar.low"), "confidence_score": score, "volume_confirmed": F.col("hit.volume_ok"),
        "pattern_height_pct": F.round("depth", 2), "pattern_width_bars": F.col("end_idx") - F.col("start_idx") + 1, "touch_count": F.lit(6),
        "pivot_indices": F.array("start_idx", "bottom.idx", "right_idx", "low_bar.idx", "end_idx"),
    }
    return first.join(starts, ["symbol", "start_idx"]).select(*[values[c].alias(c) for c in DETECTION])


def cups_with_handle(bars: DataFrame, raw: DataFrame, cup: Cup = Cup(), key: str = "cup_with_handle", spacing: int = 10, thinned: DataFrame | None = None) -> DataFrame:
    """Two rims of like height, a deep low between, and a small handle high in the cup, left upwards; the first handle that breaks out counts.

    ``thinned`` are the pivots of ``raw`` thinned to ``spacing``, if they are there already.
    """
    return _cups(bars, (thin(raw, spacing) if thinned is None else thinned).filter("ptype = 'H'"), key, cup, spacing)


def inverted_cups_with_handle(bars: DataFrame, raw: DataFrame, cup: Cup = Cup(), key: str = "cup_with_handle_inverted", spacing: int = 10, thinned: DataFrame | None = None) -> DataFrame:
    """Cups in the mirrored bars; all percentages are of mirrored prices, the prices of the result are those of ``bars``."""
    axis = stored(axes(bars))  # asked for with every use of the mirrored bars
    rims = (thin(raw, spacing) if thinned is None else thinned).filter("ptype = 'L'").join(axis, "symbol").withColumn("price", F.col("_axis") - F.col("price")).drop("_axis")
    found = with_pivot_prices(stored(_cups(mirrored(bars, axis), rims, key, cup, spacing, bars)), bars, 5)
    found = found.drop("breakout_price").join(bars.select("symbol", F.col("idx").alias("breakout_idx"), F.col("close").alias("breakout_price")), ["symbol", "breakout_idx"])
    rim, depth = (F.col("l0") + F.col("l2")) / 2, F.col("h1") - (F.col("l0") + F.col("l2")) / 2
    found = found.filter((F.col("l0") > 0) & (F.col("l2") > 0) & (rim > 0) & (depth > 0) & (F.col("breakout_price") > 0))
    changed = {"pattern_type": F.lit("continuation_bearish"), "breakout_direction": F.lit("down"), "target_price": F.col("breakout_price") - depth, "stop_loss_price": F.col("h3")}
    return found.withColumns(changed).select(*DETECTION)


def pipes(bars: DataFrame, raw: DataFrame, pipe: Pipe, bottom: bool = True, key: str | None = None) -> DataFrame:
    """Two raw lows (tops: highs) of like price with steep legs on both sides, left through the extreme between them.

    The height is a share of that extreme for bottoms, and of the middle of the pattern for tops.
    """
    key = key or ("pipe_bottoms" if bottom else "pipe_tops")
    w = Window.partitionBy("symbol").orderBy("idx")
    before, after = w.rowsBetween(-LEG, -1), w.rowsBetween(1, LEG)
    far = "high" if bottom else "low"
    side = F.struct(far, F.when(F.lit(bottom), -F.col("idx")).otherwise(F.col("idx")).alias("order"), F.col("idx").alias("at"))
    extreme = F.max if bottom else F.min
    legs = bars.select("symbol", "idx", extreme(side).over(before).alias("pre"), extreme(far).over(after).alias("post"))
    points = raw.filter(F.col("ptype") == ("L" if bottom else "H")).join(legs, ["symbol", "idx"]).withColumns({"i0": F.col("pre.at"), "f0": F.col(f"pre.{far}")})
    if bottom:
        into, out = (F.col("f0") - F.col("price")) / F.col("f0") * 100, (F.col("post") - F.col("price")) / F.col("price") * 100
    else:
        into, out = (F.col("price") - F.col("f0")) / F.col("f0") * 100, (F.col("price") - F.col("post")) / F.col("price") * 100
    steep = F.abs(degrees("i0", "f0", "idx", "price")).between(*pipe.angle)
    points = points.filter((F.col("price") > 0) & (F.col("f0") > 0) & (F.col("post") > 0) & into.between(*pipe.leg) & steep & (out >= pipe.leg[0])).select("symbol", "idx", "price", "date")
    points = stored(points)  # both ends of a pipe
    apart = max(1, pipe.separation[0], pipe.width[0] - 1), min(pipe.separation[1], pipe.width[1] - 1)
    first = prior_trend(points.select("symbol", F.col("idx").alias("start_idx"), F.col("price").alias("p0"), F.col("date").alias("start_date")).withColumns(_asked(pipe.trend)), bars).drop("trend", "trend_bars", "trend_pct", "prior_dir")
    second = points.select("symbol", "idx", F.col("price").alias("p1"), F.col("date").alias("end_date"))
    pairs = near_bars(first, second, "start_idx", F.col("start_idx") + apart[0], F.col("start_idx") + apart[1], SHORT_CELL).withColumnRenamed("idx", "end_idx")
    pairs = pairs.filter((F.col("p1") / F.col("p0")).between(*pipe.ratio)).withColumn("pair_id", F.concat_ws("_", "symbol", "start_idx", "end_idx"))
    pairs = stored(pairs)
    inside = near_bars(pairs.select("pair_id", "symbol", "start_idx", "end_idx"), bars.select("symbol", "idx", far), "pair_id", F.col("start_idx"), F.col("end_idx"), SHORT_CELL)
    between = inside.groupBy("symbol", "pair_id").agg(extreme(side).alias("between"))
    found = pairs.join(between, ["symbol", "pair_id"]).withColumns({"level": F.col(f"between.{far}"), "ends": (F.col("p0") + F.col("p1")) / 2})
    size = F.col("level") - F.col("ends") if bottom else F.col("ends") - F.col("level")
    found = found.withColumn("size", size).withColumn("height", F.col("size") / (F.col("level") if bottom else (F.col("ends") + F.col("level")) / 2) * 100)
    found = found.filter((F.col("level") > 0) & (F.col("size") > 0) & F.col("height").between(*pipe.height))
    found = confirmed_breakout(found, bars, "pair_id", PIPE_SEARCH, pipe.breakout, up=bottom)
    price = F.col("hit.close")
    values = {
        "pattern_id": F.concat_ws("_", "symbol", F.lit(key), "start_idx", "end_idx"), "symbol": F.col("symbol"), "pattern_name": F.lit(key), "pattern_type": F.lit("reversal_bullish" if bottom else "reversal_bearish"),
        "formation_start": F.col("start_date"), "formation_end": F.col("end_date"), "breakout_date": F.col("hit.date"), "breakout_idx": F.col("hit.idx"), "breakout_direction": F.lit("up" if bottom else "down"), "breakout_price": price,
        "target_price": price + F.col("size") if bottom else price - F.col("size"), "stop_loss_price": F.col("ends"), "confidence_score": F.lit(75) + F.when(F.col("hit.volume_ok"), 10).otherwise(0), "volume_confirmed": F.col("hit.volume_ok"),
        "pattern_height_pct": F.round("height", 2), "pattern_width_bars": F.col("end_idx") - F.col("start_idx") + 1, "touch_count": F.lit(2), "pivot_indices": F.array("start_idx", "between.at", "end_idx"),
    }
    return found.select(*[values[c].alias(c) for c in DETECTION])
