"""Queries of specs of one's own, of boundary prices and overrides, of reports at other levels, and of symbols in cells."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from swingkit.operators import cells, clean, outcomes, pivots, sequences, universe
from swingkit.plans import oracle as O
from swingkit.plans import outcome_sql as D
from swingkit.plans import report_queries as R
from swingkit.plans import reports
from swingkit.plans.base import ORACLE, bars_of, folder, pivots_of, query
from swingkit.plans.pattern_queries import detections_of, outcomes_of
from swingkit.sources import bars as source
from swingkit.sources import sinks, specs

# Specs of one's own: the rules of a cup's handle, a prior trend that any change meets, and specs read from files.

OWN = {
    "handle_of_a_cup": specs.spec("continuation_bullish", "HLHLHL", {4: "in_upper_third", 5: "near_cup_lip", 6: "shallow_decline"}, (10, 400), (2.0, 90.0), tolerance=8.0, breakout=("up", 1.0)),
    "broadening_formations_right_angled_descending": specs.SPECS["broadening_formations_right_angled_descending"] | {"prior_trend_requirements": {"direction": "any", "min_period_bars": 0, "min_change_pct": 0.0}},
}


def _own(spark, d, keys):
    return sequences.detect_sequences(bars_of(spark, d), pivots_of(spark, d), specs.pattern_spec(spark, {k: OWN[k] for k in keys}))


query("e4_handle_rules", O.sequences(["handle_of_a_cup"], OWN))(lambda spark, d: _own(spark, d, ["handle_of_a_cup"]))
query("f3_right_angled_descending_any_trend", O.sequences(["broadening_formations_right_angled_descending"], OWN))(lambda spark, d: _own(spark, d, ["broadening_formations_right_angled_descending"]))

_FILES = ["three_falling_peaks", "three_rising_valleys", "double_bottoms"]


@query("a3_specs_from_files", O.sequences(_FILES))
def _a3(spark, d):
    path = f"{folder(spark)}/specs-{uuid.uuid4().hex}"
    for key in _FILES:
        sinks.write_text(spark, json.dumps(specs.SPECS[key], indent=2), f"{path}/{key}_digitized.json")
    sinks.write_text(spark, "{}", f"{path}/notes.json")
    loaded = source.load_specs(spark, path).withColumn("spacing", F.lit(10))
    return sequences.detect_sequences(bars_of(spark, d), pivots_of(spark, d), loaded)


# Boundary prices, and other heights and boundaries for single detections.

_PIVOTS = """
pv AS (SELECT pattern_id, symbol, pattern_name, breakout_direction, stop_loss_price, string_split(pivot_indices, ',') AS i FROM det WHERE breakout_date IS NOT NULL AND breakout_price IS NOT NULL),
px AS (SELECT pattern_id, symbol, unnest(i) AS at, generate_subscripts(i, 1) AS pos FROM pv),
ends2 AS (SELECT p.pattern_id, max(x.high) AS top, min(x.low) AS bottom, max(x.low) FILTER (WHERE pos = 2) AS l2, max(x.high) FILTER (WHERE pos = 2) AS h2, max(x.low) FILTER (WHERE pos = 4) AS l4, max(x.high) FILTER (WHERE pos = 4) AS h4
  FROM px p JOIN ind x ON x.symbol = p.symbol AND x.idx = CAST(p.at AS BIGINT) GROUP BY 1),
bound AS (SELECT pattern_id, coalesce(CASE WHEN pattern_name IN ('double_tops', 'double_tops_built_in') THEN l2 WHEN pattern_name = 'double_bottoms' THEN h2 WHEN pattern_name IN ('head_and_shoulders_top', 'head_and_shoulders_top_built_in') THEN (l2 + l4) / 2
  WHEN pattern_name = 'head_and_shoulders_bottom' THEN (h2 + h4) / 2 END, CASE WHEN breakout_direction = 'up' THEN top ELSE bottom END, stop_loss_price) AS boundary_price FROM pv LEFT JOIN ends2 USING (pattern_id))"""


def _levels(spark, d):
    types = specs.pattern_spec(spark).select(F.col("spec_key").alias("pattern_name"), F.array_join("detection_signature.pivot_sequence", "").alias("types"))
    chosen = universe.confirmed(detections_of(spark, d))
    return chosen, outcomes.pivot_levels(chosen, bars_of(spark, d), types)


query("h11_boundary_prices", O.with_(f"{D.detections()},{_PIVOTS}", "SELECT pattern_id, round(boundary_price, 9) AS boundary_price FROM bound"))(lambda spark, d: _levels(spark, d)[1].select("pattern_id", "boundary_price"))

_HEIGHT, _BOUNDARY = "5 + breakout_idx % 7", "50 + breakout_idx % 11"
_WAY = "CASE WHEN breakout_direction = 'down' OR pattern_type = 'reversal_bearish' THEN -1 ELSE 1 END"
_MOVED = D.OUTCOMES.replace("base AS (SELECT *,", f"base AS (SELECT * REPLACE (CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN breakout_price + {_WAY} * ({_HEIGHT}) ELSE target_price END AS target_price),")


@query("h14_overrides", O.with_(f"{_MOVED},{_PIVOTS}", f"""SELECT pattern_id, round(r.target_price, 9) AS target_price, target_achieved_intraday, CAST(target_achievement_date AS VARCHAR) AS target_achievement_date, days_to_target, boundary_invalidated,
  round(CASE WHEN CAST(r.symbol AS BIGINT) % 3 = 0 THEN {_BOUNDARY.replace('breakout_idx', 'd.breakout_idx')} ELSE boundary_price END, 9) AS boundary_price FROM res r JOIN det d USING (pattern_id) JOIN bound USING (pattern_id)"""))
def _h14(spark, d):
    """Another height for the symbols of even number, another boundary for those divisible by three."""
    chosen, levels = _levels(spark, d)
    n = F.col("symbol").cast("bigint")
    given = chosen.select("pattern_id", F.when(n % 2 == 0, F.expr(_HEIGHT)).cast("double").alias("height"), F.when(n % 3 == 0, F.expr(_BOUNDARY)).cast("double").alias("boundary")).filter("height is not null or boundary is not null")
    out = outcomes.evaluate(chosen, bars_of(spark, d), levels, overrides=given, with_boundary=True)
    return out.select("pattern_id", "target_price", "target_achieved_intraday", "target_achievement_date", "days_to_target", "boundary_invalidated", "boundary_price")


# Reports at other levels, and what a random cap keeps.

_SHARE = "round(count(*) FILTER (WHERE {c}) / count(*) * 100, 9) AS {n}"
_RATES = {"bust_failure_rate_5pct": "bust_failure_5pct", "bust_failure_rate_10pct": "bust_failure_10pct", "boundary_invalidation_rate_pct": "boundary_invalidated", "target_achievement_intraday_pct": "target_achieved_intraday", "throwback_pullback_rate_pct": "throwback_pullback_occurred"}
query("j4_totals_by_pattern", O.with_(D.OUTCOMES, f"SELECT pattern_name, count(*) AS n, {', '.join(_SHARE.format(c=c, n=n) for n, c in _RATES.items())} FROM res GROUP BY 1"))(lambda spark, d: reports.totals_by_pattern(outcomes_of(spark, d)))

_BY_START = R.FRAME.replace("d.breakout_date - INTERVAL 18 MONTH", "d.formation_start - INTERVAL 18 MONTH").replace("f.breakout_date >= a.date", "f.formation_start >= a.date").replace("CASE WHEN breakout_date IS NULL THEN NULL", "CASE WHEN formation_start IS NULL THEN NULL")


@query("j6_regime_by_start", O.with_(_BY_START, "SELECT pattern_id, CAST(formation_start AS VARCHAR) AS formation_start, market_regime FROM frame"))
def _j6(spark, d):
    index = source.index_series(source.market_index(bars_of(spark, d)), "IDX")
    return reports.with_regime(detections_of(spark, d), index, "formation_start").select("pattern_id", "formation_start", "market_regime")


@query("j8_groups_by_spec", O.with_(R.FRAME, "SELECT coalesce(m.spec_key, f.pattern_name) AS pattern_group, count(*) AS n FROM frame f LEFT JOIN dim m ON m.pattern_key = f.pattern_name GROUP BY 1"))
def _j8(spark, d):
    return reports.with_group(detections_of(spark, d), specs.pattern_dim(spark), "spec_key").groupBy("pattern_group").agg(F.count("*").alias("n"))


@query("b12_cap_random_kept", O.with_(D.detections(), "SELECT symbol, least(2, count(*)) AS n_kept, least(2, count(*)) AS n_known FROM det GROUP BY 1"))
def _b12(spark, d):
    """How many detections of each symbol a random cap of 2 keeps, and how many of these there are: the choice itself is Spark's own."""
    found = detections_of(spark, d)
    kept = universe.cap(found, ["symbol"], 2, "random", 7)
    known = found.select("pattern_id", F.lit(1).alias("there")).distinct()
    return kept.join(known, "pattern_id", "left").groupBy("symbol").agg(F.countDistinct("pattern_id").alias("n_kept"), F.count("there").alias("n_known"))


# Positions by year, and windows over cells of 64 bars instead of whole symbols.


@query("c_indicators_in_cells", ORACLE["c_indicators"])
def _indicators_in_cells(spark, d):
    out = cells.in_cells(clean.clean(source.damaged(source.lineitem_bars(spark, d)), period="year"), clean.add_indicators, clean.REACH, 0, 64)
    return out.select("symbol", "idx", "typical_price", "true_range", "atr", "volume_ma", "volume_ratio", "return_pct", "range_pct")


@query("d1_pivots_in_cells", ORACLE["d1_pivots_intermediate"])
def _pivots_in_cells(spark, d):
    return cells.in_cells(bars_of(spark, d), pivots.pivots, pivots.NEARBY, pivots.NEARBY, 64)
