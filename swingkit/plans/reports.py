"""Statistics of runs, pattern and symbol reports, and audits, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swingkit.operators.asof import as_of
from swingkit.operators.medians import with_medians

DET_KEYS = ["pattern_id", "symbol", "pattern_name", "pattern_type", "formation_start", "formation_end", "pattern_height_pct", "pattern_width_bars", "confidence_score", "pivot_indices"]


def run_frame(detections: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Detections with their outcomes, where there are any."""
    own = [c for c in outcomes.columns if c not in detections.columns or c == "pattern_id"]
    return detections.join(outcomes.select(own), "pattern_id", "left")


def _rate(c: str) -> Column:
    return F.avg(F.col(c).cast("int")) * 100


def _mean(value: Column) -> Column:
    """The mean of a group. Whole hundredths, as excursions are, are summed as integers: the order of rows decides no last digit."""
    hundredths = F.rint(value * 100)
    whole = F.coalesce((F.abs(value) < 1e6) & (hundredths / 100 == value), F.lit(False))
    sums, rest, n = F.sum(F.when(whole, hundredths.cast("bigint"))), F.sum(F.when(~whole, value)), F.nullif(F.count(value), F.lit(0))
    return F.when(rest.isNull(), sums / (n * 100)).otherwise((F.coalesce(sums / 100, F.lit(0.0)) + rest) / n)


def _finite(c: str) -> Column:
    return _mean(F.when(F.abs(c) < 1e308, F.col(c)))


def run_stats(detections: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: counts, rates among rows where a flag is known, mean days and excursions."""
    seen = detections.agg(F.count("*").alias("detections_total"), F.count("breakout_date").alias("detections_with_breakout"))
    rates = {"bust_failure_rate_5pct": "bust_failure_5pct", "bust_failure_rate_10pct": "bust_failure_10pct", "boundary_invalidation_rate_pct": "boundary_invalidated", "throwback_pullback_rate_pct": "throwback_pullback_occurred", "target_achievement_rate_intraday_pct": "target_achieved_intraday", "target_achievement_rate_close_pct": "target_achieved_close"}
    done = outcomes.agg(F.count("*").alias("evaluations_total"), *[_rate(c).alias(n) for n, c in rates.items()], F.avg("days_to_ultimate").alias("avg_days_to_ultimate"), _finite("max_favorable_excursion_pct").alias("avg_mfe_pct"), _finite("max_adverse_excursion_pct").alias("avg_mae_pct"))
    return done.select(seen.select("detections_total").scalar().alias("detections_total"), seen.select("detections_with_breakout").scalar().alias("detections_with_breakout"), "*")


def stats_by(outcomes: DataFrame, by: str = "pattern_name") -> DataFrame:
    """Run statistics of every pattern, or variant."""
    return outcomes.groupBy(by).agg(
        F.count("*").alias("n"), _rate("throwback_pullback_occurred").alias("throwback_pullback_rate_pct"), _rate("target_achieved_intraday").alias("target_achievement_rate_intraday_pct"), _rate("bust_failure_5pct").alias("bust_failure_rate_5pct"),
        _rate("boundary_invalidated").alias("boundary_invalidation_rate_pct"), _finite("max_favorable_excursion_pct").alias("avg_mfe_pct"), _finite("max_adverse_excursion_pct").alias("avg_mae_pct"), F.avg("days_to_ultimate").alias("avg_days_to_ultimate"),
    )


def totals(outcomes: DataFrame) -> DataFrame:
    """One row over all outcomes: rates count an unknown flag as false; means and exact medians."""
    share = _share
    sums = outcomes.agg(
        F.count("*").alias("total"), share("bust_failure_5pct").alias("bust_5pct"), share("boundary_invalidated").alias("invalidated_pct"), share("throwback_pullback_occurred").alias("throwback_pct"), share("target_achieved_intraday").alias("target_pct"),
        share("retested_breakout_level").alias("retested_breakout_pct"), share("retested_boundary_level").alias("retested_boundary_pct"),
        share("bust_failure_10pct").alias("bust_10pct"), share("target_achieved_close").alias("target_close_pct"), F.avg("days_to_target").alias("mean_days_to_target"), F.avg("days_to_ultimate").alias("mean_days"),
        _mean(F.col("max_favorable_excursion_pct")).alias("mean_mfe"), _mean(F.col("max_adverse_excursion_pct")).alias("mean_mae"),
    )
    middles = {"median_days_to_target": "days_to_target", "median_days": "days_to_ultimate", "median_mfe": "max_favorable_excursion_pct", "median_mae": "max_adverse_excursion_pct"}
    return with_medians(sums, outcomes, [], {n: F.col(c) for n, c in middles.items()})


def _share(c: str) -> Column:
    """Percentage of all rows; an unknown flag counts as false."""
    return F.count_if(c) / F.count("*") * 100


def totals_by_pattern(outcomes: DataFrame) -> DataFrame:
    """The list aggregator's rates of every pattern: unknown flags count as false."""
    rates = {"bust_failure_rate_5pct": "bust_failure_5pct", "bust_failure_rate_10pct": "bust_failure_10pct", "boundary_invalidation_rate_pct": "boundary_invalidated", "target_achievement_intraday_pct": "target_achieved_intraday", "throwback_pullback_rate_pct": "throwback_pullback_occurred"}
    return outcomes.groupBy("pattern_name").agg(F.count("*").alias("n"), *[_share(c).alias(n) for n, c in rates.items()])


def stop_reasons(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("ultimate_stop_reason is not null").groupBy("ultimate_stop_reason").agg(F.count("*").alias("n"))


def with_regime(frame: DataFrame, index: DataFrame, anchor: str = "breakout_date", months: int = 18) -> DataFrame:
    """``frame`` plus ``market_regime``: bull if the index closed above its close ``months`` before the anchor, bear if not, null if unknown.

    Both closes are the last on or before their time, a date or a timestamp; see :func:`swingkit.operators.asof.as_of`. Only
    distinct anchors meet the index.
    """
    days = frame.select(F.col(anchor).alias("_day")).filter("_day is not null").distinct()
    past = F.col("_day") - F.expr(f"make_ym_interval(0, {months})")
    asked = days.select("_day", F.explode(F.array(F.struct(F.lit("now").alias("kind"), F.col("_day").alias("date")), F.struct(F.lit("then").alias("kind"), past.alias("date")))).alias("a")).select("_day", "a.*")
    found = as_of(asked, index.select(F.col("date").cast(asked.schema["date"].dataType).alias("date"), "close"), "date", "close")
    sides = found.groupBy("_day").agg(F.max(F.when(F.col("kind") == "now", F.col("close"))).alias("now"), F.max(F.when(F.col("kind") == "then", F.col("close"))).alias("then"))
    regime = sides.select(F.col("_day").alias(anchor), F.when(F.col("now") > F.col("then"), "bull").when(F.col("now") <= F.col("then"), "bear").alias("market_regime"))
    return frame.join(regime, anchor, "left")


def with_group(frame: DataFrame, dim: DataFrame, level: str = "pattern_key") -> DataFrame:
    """``frame`` plus ``pattern_group``: the pattern's key at a level of the metadata, its own name where that is unknown."""
    if level == "pattern_key":
        return frame.withColumn("pattern_group", F.col("pattern_name"))
    names = dim.select(F.col("pattern_key").alias("pattern_name"), F.col(level).alias("_g"))
    return frame.join(F.broadcast(names), "pattern_name", "left").withColumn("pattern_group", F.coalesce("_g", "pattern_name")).drop("_g")  # a row a pattern


def _report(frame: DataFrame, by: list[str], small_groups: bool = False) -> DataFrame:
    """Rates and medians of every group; ``small_groups`` hold few rows each, whose medians are found in one task."""
    shown = frame.filter("breakout_date is not null and breakout_price is not null")
    shown = shown.withColumns({"evaluated": F.col("evaluation_window_bars").isNotNull(), "breakout_direction": F.coalesce("breakout_direction", F.lit("unknown")), "market_regime": F.coalesce("market_regime", F.lit("unknown"))})
    own = lambda c: F.when(F.col("evaluated"), F.col(c))
    failed = lambda n: F.avg(F.when(own("max_favorable_excursion_pct").isNotNull(), (F.col("max_favorable_excursion_pct") < n).cast("int"))) * 100
    by = [*by, "breakout_direction", "market_regime"]
    middles = {"median_move_pct": own("max_favorable_excursion_pct"), "median_days_to_ultimate": own("days_to_ultimate")}
    sums = shown.groupBy(*by).agg(
        F.count("*").alias("n_confirmed"), F.count_if("evaluated").alias("n_evaluated"), (F.count_if("evaluated") / F.count("*") * 100).alias("eval_coverage_pct"),
        *[F.median(c).alias(n) for n, c in middles.items() if small_groups],
        *[(F.avg(own(c).cast("int")) * 100).alias(n) for n, c in (("throwback_pullback_rate_pct", "throwback_pullback_occurred"), ("target_hit_rate_intraday_pct", "target_achieved_intraday"), ("boundary_invalidation_rate_pct", "boundary_invalidated"), ("busted_5pct_rate_pct", "bust_failure_5pct"))],
        *[failed(n).alias(f"failure_lt_{n}pct_rate_pct") for n in (5, 10, 15)],
    )
    return sums if small_groups else with_medians(sums, shown, by, middles)


def pattern_report(frame: DataFrame) -> DataFrame:
    """Outcomes of confirmed detections by pattern group, direction and regime (see with_group, with_regime)."""
    return _report(frame, ["pattern_group"])


def ranked(report: DataFrame) -> DataFrame:
    """The report plus the rank by median move in each regime and direction; no rank without a median."""
    order = Window.partitionBy("market_regime", "breakout_direction", F.col("median_move_pct").isNull()).orderBy(F.desc("median_move_pct"), F.desc("n_evaluated"), F.desc("n_confirmed"), "pattern_group")
    return report.withColumn("rank_by_median_move", F.when(F.col("median_move_pct").isNotNull(), F.row_number().over(order)))


def symbol_performance(frame: DataFrame) -> DataFrame:
    """The pattern report of every symbol."""
    return _report(frame, ["symbol", "pattern_group"], small_groups=True)


def symbol_frequency(frame: DataFrame) -> DataFrame:
    """How often each pattern group occurs in each symbol and regime."""
    confirmed = F.col("breakout_date").isNotNull() & F.col("breakout_price").isNotNull()
    way = lambda d: F.count_if(confirmed & (F.coalesce("breakout_direction", F.lit("unknown")) == d)).alias(f"n_{d}")
    return frame.groupBy("symbol", "pattern_group", F.coalesce("market_regime", F.lit("unknown")).alias("market_regime")).agg(
        F.count("*").alias("n_detections"), F.count_if(confirmed).alias("n_confirmed"), F.count_if(confirmed & F.col("evaluation_window_bars").isNotNull()).alias("n_evaluated"), (F.count_if(confirmed) / F.count("*") * 100).alias("confirmed_pct"), way("up"), way("down"), way("unknown")
    )


def metadata_rollup(dim: DataFrame, level: str = "canonical_key") -> DataFrame:
    """Chapters, their ranges such as "1-3,7", names and kinds of every group of the metadata, and a display name."""
    group = F.coalesce(level, "pattern_key")
    order = Window.partitionBy("g").orderBy("chapter")
    runs = dim.select(group.alias("g"), "chapter").distinct().withColumn("run", F.col("chapter") - F.row_number().over(order))
    ranges = runs.groupBy("g", "run").agg(F.min("chapter").alias("a"), F.max("chapter").alias("b")).groupBy("g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda x: F.when(x["a"] == x["b"], x["a"].cast("string")).otherwise(F.concat_ws("-", x["a"], x["b"]))), ",").alias("chapter_ranges")
    )
    short = F.trim(F.regexp_extract("name", r"^([^(,]*)", 1))
    sums = dim.groupBy(group.alias("g")).agg(F.count("*").alias("n_patterns"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.array_join(F.array_sort(F.collect_set("name")), ";").alias("names"), F.countDistinct(short).alias("k"), F.min(short).alias("s"))
    return sums.join(ranges, "g").select(F.col("g").alias("pattern_group"), "n_patterns", "kinds", "names", "chapter_ranges", F.when(F.col("k") == 1, F.col("s")).otherwise(F.col("g")).alias("display_name"))


def sanity(detections: DataFrame) -> DataFrame:
    """Counts of impossible widths, heights and confidences by pattern."""
    return detections.groupBy("pattern_name").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.col("pattern_width_bars") <= 0, F.lit(True))).alias("bad_width"), F.count_if(F.coalesce(F.col("pattern_height_pct") <= 0, F.lit(True))).alias("bad_height"),
        F.count_if(F.coalesce(~F.col("confidence_score").between(0, 100), F.lit(True))).alias("bad_confidence"),
    )


def with_limits(dim: DataFrame, specs: DataFrame) -> DataFrame:
    """The metadata with the size limits of its spec: its own key's, else the mapped one's; ``limit_source`` says which."""
    g = "geometry_constraints"
    limits = specs.select("spec_key", F.struct(F.col(f"{g}.width_min_bars").alias("width_min"), F.col(f"{g}.width_max_bars").alias("width_max"), F.col(f"{g}.height_ratio_min").alias("height_min"), F.col(f"{g}.height_ratio_max").alias("height_max")).alias("limits"))
    own, mapped = limits.toDF("pattern_key", "own"), limits.toDF("spec_key", "mapped")
    out = dim.join(F.broadcast(own), "pattern_key", "left").join(F.broadcast(mapped), "spec_key", "left")  # a row a spec
    out = out.withColumn("limits", F.coalesce("own", "mapped")).withColumn("limit_source", F.when(F.col("own").isNotNull(), "own").when(F.col("mapped").isNotNull(), "mapped").otherwise("none"))
    return out.select(dim.columns + ["limit_source", "limits.*"])


def compliance(detections: DataFrame, limits: DataFrame) -> DataFrame:
    """Share of each pattern's detections outside its width or height limits, where both ends are known; the worst first."""
    names = limits.select(F.col("pattern_key").alias("pattern_name"), "limit_source", "width_min", "width_max", "height_min", "height_max")
    out = detections.join(F.broadcast(names), "pattern_name")  # a row a pattern
    outside = lambda c, lo, hi: F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(), ~F.col(c).between(F.col(lo), F.col(hi)))
    sums = out.groupBy("pattern_name", "limit_source").agg(
        F.count("*").alias("n"), (F.avg(outside("pattern_width_bars", "width_min", "width_max").cast("int")) * 100).alias("width_outside_pct"), (F.avg(outside("pattern_height_pct", "height_min", "height_max").cast("int")) * 100).alias("height_outside_pct")
    )
    return sums.orderBy(F.desc(F.greatest("width_outside_pct", "height_outside_pct")), "pattern_name")


def outcome_kpis(outcomes: DataFrame, min_evals: int = 50) -> DataFrame:
    """Medians and failure rates of patterns with enough outcomes."""
    move = F.col("max_favorable_excursion_pct")
    sums = outcomes.groupBy("pattern_name").agg(F.count("evaluation_window_bars").alias("n_evals"), *[(F.avg((move < n).cast("int")) * 100).alias(f"failure_lt_{n}_pct") for n in (5, 10)])
    sums = sums.filter(F.col("n_evals") >= min_evals)
    return with_medians(sums, outcomes, ["pattern_name"], {"median_move_pct": move, "median_days": F.col("days_to_ultimate")})


def compare_runs(calibration: DataFrame, validation: DataFrame) -> DataFrame:
    """Outcomes of two runs by pattern; a missing side counts 0."""
    n = lambda df, name: df.groupBy("pattern_name").agg(F.count("evaluation_window_bars").alias(name))
    return n(calibration, "n_calibration").join(n(validation, "n_validation"), "pattern_name", "full_outer").fillna(0)


def coverage(dim: DataFrame, specs: DataFrame, sets: DataFrame) -> DataFrame:
    """Patterns, groups, proxies and patterns with a spec, of every pattern set."""
    have = specs.select("spec_key").distinct().withColumn("_has", F.lit(True))
    full = sets.join(F.broadcast(dim.join(F.broadcast(have), "spec_key", "left")), "pattern_key", "left")  # a row a pattern
    return full.groupBy("pattern_set").agg(F.count("*").alias("n_patterns"), F.countDistinct("canonical_key").alias("n_groups"), F.count_if("proxy").alias("n_proxies"), F.count("_has").alias("n_with_spec"), F.count("variant").alias("n_variants"))


def case_bars(cases: DataFrame, bars: DataFrame, margin: int = 30) -> DataFrame:
    """The bars of each case from ``margin`` before its formation to ``margin`` after it."""
    from swingkit.operators.sequences import near_bars

    first, last = F.array_min("pivot_indices").cast("int"), F.array_max("pivot_indices").cast("int")
    lean = cases.select("pattern_id", "symbol", (first - margin).alias("a"), (last + margin).alias("b"))
    return near_bars(lean, bars.select("symbol", "idx", "date", "open", "high", "low", "close", "volume"), "pattern_id", F.greatest(F.lit(0), F.col("a")), F.col("b")).drop("a", "b")
