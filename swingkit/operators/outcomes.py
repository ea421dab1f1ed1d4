"""What happened after each breakout, from the bars after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingkit.operators.derived import adam_eve
from swingkit.operators.lookahead import FOUND, LONGEST, look_ahead

LOOKAHEAD, REVERSAL, RETEST_DAYS, RETEST_PCT = LONGEST, 20.0, 30, 1.0
LEVELS = ["breakout_level", "opposite_level", "boundary_price"]
RESULT = [
    "pattern_id", "symbol", "pattern_name", "breakout_date", "breakout_price", "breakout_direction", "target_price", "stop_loss_price", "bust_failure_5pct", "bust_failure_10pct", "bust_failure_date", "bust_failure_pct",
    "boundary_invalidated", "boundary_invalidation_date", "ultimate_price", "ultimate_date", "days_to_ultimate", "ultimate_stop_reason", "throwback_pullback_occurred", "throwback_pullback_date", "days_to_throwback_pullback",
    "retested_breakout_level", "retested_boundary_level", "target_achieved_intraday", "target_achieved_close", "target_achievement_date", "days_to_target", "max_favorable_excursion_pct", "max_adverse_excursion_pct", "evaluation_window_bars",
]


def breakout_positions(detections: DataFrame, bars: DataFrame) -> DataFrame:
    """Detections with a breakout_idx: the stored one where the symbol has such a bar, else that of the breakout date."""
    at = bars.select("symbol", F.col("idx").alias("breakout_idx"), F.lit(True).alias("_there"))
    by_date = bars.groupBy("symbol", F.col("date").alias("breakout_date")).agg(F.min("idx").alias("_by_date"))
    out = detections.join(at, ["symbol", "breakout_idx"], "left").join(by_date, ["symbol", "breakout_date"], "left")
    return out.withColumn("breakout_idx", F.when(F.col("_there"), F.col("breakout_idx")).otherwise(F.col("_by_date"))).drop("_there", "_by_date").select(detections.columns)


def direction() -> Column:
    """The stored direction, else up for bullish reversals and down for all other kinds."""
    return F.coalesce("breakout_direction", F.when(F.col("pattern_type") == "reversal_bullish", "up").otherwise("down"))


def pivot_levels(detections: DataFrame, bars: DataFrame, types: DataFrame, threshold_pct: float = 1.0) -> DataFrame:
    """breakout_level, opposite_level and boundary_price of each pattern_id and symbol; see :func:`with_levels`."""
    return with_levels(detections, bars, types, threshold_pct).select("symbol", "pattern_id", *LEVELS)


def with_levels(detections: DataFrame, bars: DataFrame, types: DataFrame, threshold_pct: float = 1.0, with_boundary: bool = True) -> DataFrame:
    """``detections`` plus breakout_level, opposite_level and boundary_price.

    ``types`` has pattern_name and types (the H and L of its pivots). Where they are known, the lines through the first
    and last high and low give both levels at the breakout; else the stop is the opposite level, else the extreme of the
    pivots; the breakout level falls back to the breakout price without its threshold. The boundary is the middle pivot
    of a double, the mean neckline of a head and shoulders, else the extreme of the pivots on the breakout's side, else the stop.
    Only the boundary asks for the pivots of a pattern that has a stop and no known types: without ``with_boundary`` it is null,
    and these meet no bars.
    """
    pivot = detections.join(F.broadcast(types), "pattern_name", "left")  # a row a pattern
    if not with_boundary:
        pivot = pivot.filter("types is not null or stop_loss_price is null")
    pivot = pivot.select("pattern_id", "symbol", "types", F.posexplode("pivot_indices").alias("at", "idx"))
    pivot = pivot.join(bars.select("symbol", "idx", "high", "low"), ["symbol", "idx"]).withColumn("t", F.substring("types", F.col("at") + 1, F.lit(1)))
    # Positions and prices side by side, not as structs, so that the sums are hashed and not sorted.
    own = lambda t: F.when(F.col("t") == t, F.col("idx"))
    ends = lambda t, price: [x.alias(f"{t}{n}{c}") for n, f, by in ((0, F.min, F.min_by), (1, F.max, F.max_by)) for c, x in (("idx", f(own(t))), ("p", by(price, own(t))))]
    price = F.when(F.col("t") == "H", F.col("high")).otherwise(F.col("low"))
    sums = pivot.groupBy("symbol", "pattern_id").agg(*ends("H", "high"), *ends("L", "low"), F.max("high").alias("top"), F.min("low").alias("bottom"), *[F.max(F.when(F.col("at") == k, price)).alias(f"p{k}") for k in (1, 3)])
    out = detections.join(sums, ["symbol", "pattern_id"], "left")
    line = lambda t: F.col(f"{t}0p") + (F.col(f"{t}1p") - F.col(f"{t}0p")) / F.greatest(F.lit(1), F.col(f"{t}1idx") - F.col(f"{t}0idx")) * (F.col("breakout_idx") - F.col(f"{t}0idx"))
    up = direction() == "up"
    extreme = F.when(up, F.col("bottom")).otherwise(F.col("top"))
    plain = F.when(up, F.col("breakout_price") / (1 + threshold_pct / 100)).otherwise(F.col("breakout_price") / (1 - threshold_pct / 100))
    named = F.when(F.col("pattern_name").like("double_%"), F.col("p1")).when(F.col("pattern_name").like("head_and_shoulders%"), (F.col("p1") + F.col("p3")) / 2)
    side = F.when(up, F.col("top")).otherwise(F.col("bottom"))
    return out.select(
        *[F.col(c) for c in detections.columns], F.coalesce(F.when(up, line("H")).otherwise(line("L")), plain).alias("breakout_level"), F.coalesce(F.when(up, line("L")).otherwise(line("H")), "stop_loss_price", extreme).alias("opposite_level"),
        (F.coalesce(named, side, "stop_loss_price") if with_boundary else F.lit(None).cast("double")).alias("boundary_price"),
    )


def evaluate(detections: DataFrame, bars: DataFrame, levels: DataFrame | None = None, lookahead: DataFrame | None = None, invalidation_pct: float = 0.0, overrides: DataFrame | None = None, with_boundary: bool = False, types: DataFrame | None = None) -> DataFrame:
    """One outcome row for each detection (of distinct pattern_id); never from a bar at or before the breakout.

    ``levels`` as of :func:`pivot_levels`, or ``types`` for those of :func:`with_levels`; ``lookahead`` (pattern_name, lookahead_bars), ``overrides`` (pattern_id,
    height, boundary) of single rows: another height moves the target, another boundary takes the place of the boundary
    price, and the opposite level, which decides invalidation, stays that of ``levels``. ``with_boundary`` adds the column
    boundary_price. A breakout without two later bars, or without a valid price, gives nulls.
    """
    own_levels = levels is None and types is not None
    out = breakout_positions(with_levels(detections, bars, types, with_boundary=with_boundary) if own_levels else detections, bars)
    if levels is not None:
        out = out.join(levels, [c for c in ("symbol", "pattern_id") if c in levels.columns], "left")
    elif not own_levels:
        out = out.withColumns({c: F.lit(None).cast("double") for c in LEVELS})
    out = out.join(F.broadcast(lookahead), "pattern_name", "left") if lookahead is not None else out.withColumn("lookahead_bars", F.lit(None).cast("int"))  # a row a pattern
    out = out.withColumns({"look": F.least(F.lit(LOOKAHEAD), F.coalesce("lookahead_bars", F.lit(LOOKAHEAD))), "way": F.when((direction() == "down") | (F.col("pattern_type") == "reversal_bearish"), -1).otherwise(1)})
    if overrides is not None:
        own = overrides.select("pattern_id", *[F.col(c) if c in overrides.columns else F.lit(None).cast("double").alias(c) for c in ("height", "boundary")])
        moved = F.coalesce(F.col("breakout_price") + F.col("way") * F.col("height"), "target_price")
        out = out.join(own, "pattern_id", "left").withColumns({"target_price": moved, "boundary_price": F.coalesce("boundary", "boundary_price")})
    fine = F.col("breakout_idx").isNotNull() & (F.col("breakout_price") > 0) & (F.col("breakout_price") < float("inf"))
    # The look-ahead hands on what is shown with it, so that nothing has to be joined again; a row that can't have one looks ahead by no bar.
    shown = [c for c in RESULT + ["boundary_price"] * with_boundary if c in out.columns and c not in ("pattern_id", "symbol", "target_price")] + ["opposite_level", "window"]
    asked = out.withColumns({"window": F.col("look"), "look": F.when(fine, F.col("look")).otherwise(0), "breakout_idx": F.when(fine, F.col("breakout_idx")).otherwise(0), "b_date": F.col("breakout_date"), "bp": F.col("breakout_price")})
    out = look_ahead(asked, bars, REVERSAL, RETEST_DAYS, RETEST_PCT, invalidation_pct, ["symbol", "target_price", "way", *shown])
    out = out.withColumns({c: F.when(F.col("bars") >= 2, F.col(c)) for c in FOUND})
    known = F.col("bars").isNotNull()
    bust5, bust10 = (F.col("favor") < 5) & (F.col("against") >= 5), (F.col("favor") < 10) & (F.col("against") >= 10)
    days = lambda c: F.datediff(c, "breakout_date")
    resumed = F.when(known, F.coalesce(F.col("any_level"), F.lit(False)) & ~F.coalesce(F.col("post") <= F.col("pre"), F.lit(False)))
    ultimate = F.col("way") * F.col("ultimate_signed")
    share = lambda v: F.round(F.greatest(F.lit(0.0), v / F.col("breakout_price") * 100), 2)
    worst = F.coalesce(F.col("worst_high") - F.col("breakout_price"), F.col("breakout_price") - F.col("worst_low"))
    values = {
        "breakout_direction": F.when(known, F.when(F.col("way") < 0, "down").otherwise("up")).otherwise(F.col("breakout_direction")), "bust_failure_5pct": bust5, "bust_failure_10pct": bust10,
        "bust_failure_date": F.when(bust5, F.col("against5")).when(bust10, F.col("against10")), "bust_failure_pct": F.when(bust5 | bust10, F.round("against", 2)),
        "boundary_invalidated": F.when(known & (F.col("opposite_level") > 0), F.col("invalid_date").isNotNull()), "boundary_invalidation_date": F.col("invalid_date"),
        "ultimate_price": ultimate, "ultimate_date": F.col("ultimate_date"), "days_to_ultimate": days("ultimate_date"), "ultimate_stop_reason": F.when(known, F.when(F.col("stop_idx").isNotNull(), "20pct_reversal").otherwise("end_of_window")),
        "throwback_pullback_occurred": resumed, "throwback_pullback_date": F.when(resumed, F.col("retest_date")), "days_to_throwback_pullback": F.when(resumed, days("retest_date")),
        "retested_breakout_level": F.when(F.col("retest_bars") > 0, F.col("any_bp")), "retested_boundary_level": F.when(F.col("retest_bars") > 0, F.col("any_level")),
        "target_achieved_intraday": F.col("hit"), "target_achieved_close": F.col("hit_close"), "target_achievement_date": F.col("target_date"), "days_to_target": days("target_date"),
        "max_favorable_excursion_pct": share(F.col("way") * (ultimate - F.col("breakout_price"))), "max_adverse_excursion_pct": share(worst), "evaluation_window_bars": F.coalesce("bars", "window").cast("int"),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in RESULT + ["boundary_price"] * with_boundary])


def with_variants(outcomes: DataFrame, detections: DataFrame, bars: DataFrame, name: str = "double_tops") -> DataFrame:
    """``outcomes`` plus variant, peak1_width_bars and peak2_width_bars of double tops; null for other patterns."""
    marked = adam_eve(detections.filter(F.col("pattern_name") == name), bars)
    return outcomes.join(marked.select("pattern_id", "variant", F.col("width0").alias("peak1_width_bars"), F.col("width1").alias("peak2_width_bars")), "pattern_id", "left")
