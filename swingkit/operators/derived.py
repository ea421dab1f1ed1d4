"""Chapter patterns: detections of a base pattern that meet a further test, under their own name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingkit.operators.sequences import near_bars

ADAM, EVE, TOLERANCE_PCT, SIDE = 3, 7, 2.0, 15


def derive(base: DataFrame, key: str, keep: Column | None = None, kind: str | None = None, of: list[str] | None = None) -> DataFrame:
    """Rows of ``base`` that pass ``keep``, renamed; ids stay unique by the new name in front. ``of`` are the columns to return."""
    out = base if keep is None else base.filter(F.coalesce(keep, F.lit(False)))
    values = {"pattern_id": F.concat_ws("_", "symbol", F.lit(key), "pattern_id"), "pattern_name": F.lit(key)} | ({"pattern_type": F.lit(kind)} if kind else {})
    return out.withColumns(values).select(of or base.columns)


def derive_all(base: DataFrame, cases: list[tuple[str, Column, str | None]], of: list[str] | None = None) -> DataFrame:
    """:func:`derive` for several (key, keep, kind) of which a row meets one at most, in one pass over ``base``."""
    name, kind = F.lit(None).cast("string"), F.col("pattern_type")
    for key, keep, own in reversed(cases):
        name = F.when(keep, key).otherwise(name)
        kind = F.when(keep, own).otherwise(kind) if own else kind
    out = base.withColumns({"_key": name, "_kind": kind}).filter("_key is not null")
    return out.withColumns({"pattern_id": F.concat_ws("_", "symbol", "_key", "pattern_id"), "pattern_name": F.col("_key"), "pattern_type": F.col("_kind")}).select(of or base.columns)


def with_pivot_prices(detections: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """``detections`` plus i0, h0, l0, i1, ...: position, high and low of the first ``n`` pivots' bars."""
    own = [F.get("pivot_indices", F.lit(k)) for k in range(n)]
    points = detections.select("symbol", "pattern_id", F.posexplode(F.slice("pivot_indices", 1, n)).alias("at", "idx")).join(bars.select("symbol", "idx", "high", "low"), ["symbol", "idx"])
    prices = points.groupBy("symbol", "pattern_id").agg(*[F.max(F.when(F.col("at") == k, F.col(c))).alias(f"{c[0]}{k}") for k in range(n) for c in ("high", "low")])
    return detections.withColumns({f"i{k}": i for k, i in enumerate(own)}).join(prices, ["symbol", "pattern_id"], "left")


def pct(a: str, b: str) -> Column:
    """Difference as a percentage of the smaller; infinite for a zero."""
    return F.coalesce(F.abs(F.col(a) - F.col(b)) / F.nullif(F.least(F.abs(a), F.abs(b)), F.lit(0.0)) * 100, F.lit(float("inf")))


def degrees(i0: str, p0: str, i1: str, p1: str) -> Column:
    """Angle of the percentage change a bar."""
    bars = F.greatest(F.lit(1), F.col(i1) - F.col(i0))
    return F.coalesce(F.degrees(F.atan((F.col(p1) - F.col(p0)) / F.nullif(F.col(p0), F.lit(0.0)) * 100 / bars)), F.lit(0.0))


def extreme_widths(points: DataFrame, bars: DataFrame, trough: bool = False) -> DataFrame:
    """symbol, idx and ``width``: bars around each point (symbol, idx) that stay within 2 % of its extreme, 15 a side at most."""
    own = bars.select("symbol", "idx", F.col("low" if trough else "high").alias("price"))
    named = points.select("symbol", "idx").distinct().join(own, ["symbol", "idx"]).select("symbol", F.col("idx").alias("at"), F.col("price").alias("top"))
    near = near_bars(named, own, "at", F.greatest(F.lit(0), F.col("at") - SIDE), F.col("at") + SIDE)
    limit = F.col("top") * (1 + TOLERANCE_PCT / 100) if trough else F.col("top") * (1 - TOLERANCE_PCT / 100)
    out = F.col("price") > limit if trough else F.col("price") < limit
    edge = near.groupBy("symbol", "at").agg(
        F.max(F.when(out & (F.col("idx") < F.col("at")), F.col("idx"))).alias("left_out"), F.min(F.when(out & (F.col("idx") > F.col("at")), F.col("idx"))).alias("right_out"), F.min("idx").alias("first"), F.max("idx").alias("last")
    )
    return edge.select("symbol", F.col("at").alias("idx"), (F.coalesce(F.col("right_out") - 1, "last") - F.coalesce(F.col("left_out") + 1, "first") + 1).alias("width"))


def width_class(width: Column) -> Column:
    return F.when(width <= ADAM, "A").when(width >= EVE, "E")


def adam_eve(doubles: DataFrame, bars: DataFrame, trough: bool = False) -> DataFrame:
    """Double tops or bottoms plus width0, width1 and ``variant`` (AA, AE, EA, EE or null) of their two extremes."""
    out = doubles.withColumns({"i0": F.get("pivot_indices", F.lit(0)), "i2": F.get("pivot_indices", F.lit(2))})
    points = out.select("symbol", F.col("i0").alias("idx")).unionByName(out.select("symbol", F.col("i2").alias("idx")))
    widths = extreme_widths(points, bars, trough)
    for k, c in ((0, "i0"), (1, "i2")):
        out = out.join(widths.toDF("symbol", c, f"width{k}"), ["symbol", c], "left")
    return out.withColumn("variant", F.concat(width_class(F.col("width0")), width_class(F.col("width1"))))


def double_variants(doubles: DataFrame, bars: DataFrame, name: str, trough: bool = False) -> DataFrame:
    """The four chapter patterns ``name``_adam_adam, ... of double tops or bottoms."""
    marked = adam_eve(doubles, bars, trough)
    word = {"A": "adam", "E": "eve"}
    return derive_all(marked, [(f"{name}_{word[a]}_{word[b]}", F.col("variant") == a + b, None) for a in "AE" for b in "AE"], doubles.columns)


def by_direction(base: DataFrame, up: str, down: str) -> DataFrame:
    """Two chapter patterns told apart by their breakout."""
    return derive_all(base, [(up, F.col("breakout_direction") == "up", None), (down, F.col("breakout_direction") == "down", None)])


def broadening_wedges(base: DataFrame, bars: DataFrame) -> DataFrame:
    """Both lines rise, or both fall, by over 0.2 degrees, and drift apart by over 5 %."""
    m = with_pivot_prices(base, bars, 6).withColumns({"up": degrees("i0", "h0", "i4", "h4"), "lo": degrees("i1", "l1", "i5", "l5")})
    wider = F.col("h4") - F.col("l5") > (F.col("h0") - F.col("l1")) * 1.05
    rising, falling = (F.col("up") > 0.2) & (F.col("lo") > 0.2) & wider & (F.col("up") > F.col("lo") + 0.1), (F.col("up") < -0.2) & (F.col("lo") < -0.2) & wider & (F.col("lo") < F.col("up") - 0.1)
    return derive_all(m, [("broadening_wedges_ascending", rising, None), ("broadening_wedges_descending", falling, None)], base.columns)


def wedges(base: DataFrame, bars: DataFrame) -> DataFrame:
    """Both lines fall and the breakout is up, or both rise and it is down."""
    m = with_pivot_prices(base, bars, 6).withColumns({"up": degrees("i0", "h0", "i4", "h4"), "lo": degrees("i1", "l1", "i5", "l5")})
    falling, rising = (F.col("up") < -0.2) & (F.col("lo") < -0.2) & (F.col("breakout_direction") == "up"), (F.col("up") > 0.2) & (F.col("lo") > 0.2) & (F.col("breakout_direction") == "down")
    return derive_all(m, [("wedges_falling", falling, "reversal_bullish"), ("wedges_rising", rising, "reversal_bearish")], base.columns)


def triangles(base: DataFrame, bars: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Level highs over rising lows, level lows under falling highs, or falling highs over rising lows, in that order."""
    m = with_pivot_prices(base, bars, 5)
    level, rise = (pct("h2", "h0") <= tolerance) & (pct("h4", "h0") <= tolerance), F.col("l3") > F.col("l1")
    fall = (F.col("h2") < F.col("h0")) & (F.col("h4") < F.col("h2"))
    m = m.withColumn("shape", F.when(level & rise, "ascending").when((pct("l3", "l1") <= tolerance) & fall, "descending").when(fall & rise, "symmetrical"))
    return derive_all(m, [(f"triangles_{s}", F.col("shape") == s, None) for s in ("ascending", "descending", "symmetrical")], base.columns)


def scallops(base: DataFrame, bars: DataFrame) -> DataFrame:
    """Told apart by the lows of the first and third pivot and by the breakout."""
    m = with_pivot_prices(base, bars, 3).withColumn("rises", F.col("l2") > F.col("l0"))
    names = {("scallops_ascending", True, "up"), ("scallops_ascending_inverted", True, "down"), ("scallops_descending", False, "down"), ("scallops_descending_inverted", False, "up")}
    return derive_all(m, [(k, (F.col("rises") == r) & (F.col("breakout_direction") == b), None) for k, r, b in sorted(names)], base.columns)


def complex_head_and_shoulders(base: DataFrame, bars: DataFrame, raw: DataFrame, plain: str, complex_: str, tolerance: float = 10.0, bottom: bool = False) -> DataFrame:
    """Complex where another raw pivot lies between the shoulders, near their level and 2 % away from the head; else plain."""
    c, t = ("l", "L") if bottom else ("h", "H")
    m = with_pivot_prices(base, bars, 5).withColumns({"level": (F.col(f"{c}0") + F.col(f"{c}4")) / 2, "head": F.col(f"{c}2")})
    pivots = raw.filter(F.col("ptype") == t).select("symbol", "idx", F.col("price").alias("p"))
    near = near_bars(m.select("pattern_id", "symbol", "i0", "i2", "i4", "level", "head"), pivots, "pattern_id", F.col("i0") + 1, F.col("i4") - 1)
    away = F.col("p") > F.col("head") * 1.02 if bottom else F.col("p") < F.col("head") * 0.98
    extra = near.filter((F.col("idx") != F.col("i2")) & away & (F.col("level") > 0) & (pct("p", "level") <= tolerance)).select("pattern_id").distinct().withColumn("extra", F.lit(True))
    marked = m.join(extra, "pattern_id", "left").withColumn("extra", F.coalesce("extra", F.lit(False)))
    return derive_all(marked, [(complex_, F.col("extra"), None), (plain, ~F.col("extra"), None)], base.columns)


def flags(base: DataFrame, bars: DataFrame) -> DataFrame:
    """High and tight: up after a rise of 100 % from the lowest low of the 60 bars before, with at most 20 % between its high and low."""
    first, last = F.array_min("pivot_indices").cast("int"), F.array_max("pivot_indices").cast("int")
    lean = base.select("pattern_id", "symbol", first.alias("a"), last.alias("b"))
    near = near_bars(lean, bars.select("symbol", "idx", "high", "low"), "pattern_id", F.greatest(F.lit(0), F.col("a") - 60), F.col("b"))
    sums = near.groupBy("pattern_id").agg(
        F.max(F.when(F.col("idx") >= F.col("a"), F.col("high"))).alias("top"), F.min(F.when(F.col("idx") >= F.col("a"), F.col("low"))).alias("bottom"),
        F.min(F.when(F.col("idx") <= F.col("a"), F.struct("low", "idx"))).alias("pole"), F.max("a").alias("a"),
    )
    m = base.join(sums, "pattern_id", "left")
    gain, drop = (F.col("top") - F.col("pole.low")) / F.col("pole.low") * 100, (F.col("top") - F.col("bottom")) / F.col("top") * 100
    tight = F.coalesce((F.col("breakout_direction") == "up") & (gain >= 100) & (F.col("a") - F.col("pole.idx") + 1 <= 60) & (drop <= 20), F.lit(False))
    return derive_all(m, [("flags_high_tight", tight, None), ("flags", ~tight, None)], base.columns)


def long_islands(base: DataFrame) -> DataFrame:
    """Islands of over 10 bars, and the rest; ``base`` was searched with 40 bars at most."""
    return derive_all(base, [("islands_long", F.col("pattern_width_bars") > 10, None), ("island_reversals", F.col("pattern_width_bars") <= 10, None)])


def axes(bars: DataFrame) -> DataFrame:
    """symbol and ``_axis``, its highest high plus lowest low."""
    return bars.groupBy("symbol").agg((F.max("high") + F.min("low")).alias("_axis"))


def mirrored(bars: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Bars with prices reflected in each symbol's highest high plus lowest low, so tops become bottoms; ``axis`` as of :func:`axes`, if it is there already."""
    out = bars.join(axes(bars) if axis is None else axis, "symbol")
    return out.withColumns({"open": F.col("_axis") - F.col("open"), "close": F.col("_axis") - F.col("close"), "high": F.col("_axis") - F.col("low"), "low": F.col("_axis") - F.col("high")}).drop("_axis")
