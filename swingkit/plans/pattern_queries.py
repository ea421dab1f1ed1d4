"""Queries of the bar-local detectors, of choosing and thinning detections, and of outcomes."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.operators import barlocal, cups_pipes, outcomes, overlap, sequences, universe
from swingkit.plans import oracle as O
from swingkit.plans import outcome_sql as D
from swingkit.plans.base import bars_of, kept, pivots_of, query, thinned_of
from swingkit.plans.cup_pipe_queries import CUP, PIPE
from swingkit.sources import specs

for _name, _detect, _sql in (
    ("f8_inside_day", barlocal.inside_days, O.INSIDE),
    ("f9_gaps", barlocal.gaps, O.GAPS),
    ("f10_islands", barlocal.islands, O.ISLANDS),
    ("f11_three_methods", barlocal.three_methods, O.THREE_METHODS),
    ("f14_spikes", barlocal.spikes, O.SPIKES),
    ("f15_dead_cat_bounce", barlocal.dead_cat_bounces, O.DEAD_CAT),
    ("f16_dead_cat_bounce_inverted", barlocal.inverted_dead_cats, O.INVERTED),
):
    query(_name, _sql)(lambda spark, d, f=_detect: f(bars_of(spark, d)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _kinds(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """How each kind of detector finds its detections."""
    bars, raw, thinned = bars_of(spark, sf_dir), lambda: pivots_of(spark, sf_dir), lambda: thinned_of(spark, sf_dir)
    tens = lambda: thinned().filter("spacing = 10").drop("spacing")
    local = (barlocal.inside_days, barlocal.gaps, barlocal.islands, barlocal.three_methods, barlocal.spikes, barlocal.dead_cat_bounces, barlocal.inverted_dead_cats)
    built_in = (sequences.detect_head_and_shoulders, sequences.detect_double_tops)
    marked = lambda df: df.withColumns({c: F.concat(c, F.lit("_built_in")) for c in ("pattern_id", "pattern_name")})
    return {
        "specs": lambda: sequences.detect_sequences(bars, raw(), specs.pattern_spec(spark), thinned()),
        "bar local": lambda: _union([detect(bars) for detect in local]),
        "built in": lambda: _union([marked(detect(bars, raw(), thinned=tens())) for detect in built_in]),
        "cups": lambda: cups_pipes.cups_with_handle(bars, raw(), CUP, thinned=tens()).unionByName(cups_pipes.inverted_cups_with_handle(bars, raw(), CUP, thinned=tens())),
        "pipes": lambda: cups_pipes.pipes(bars, raw(), PIPE).unionByName(cups_pipes.pipes(bars, raw(), PIPE, bottom=False)),
    }


def spec_detections_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of the specs alone, for patterns that are derived from one spec."""
    return kept(spark, sf_dir, "found specs", lambda: _kinds(spark, sf_dir)["specs"]())


def detections_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all specs and of all other detectors, kept for all that chooses among them or builds on them.

    The two built-in detectors are marked, as specs have their names. Every kind of detector writes a table of its own.
    """
    kinds = _kinds(spark, sf_dir)
    find = lambda kind: kept(spark, sf_dir, f"found {kind}", kinds[kind])
    # Most of a kind's time is planning, and none has stages for a whole cluster all the time, so their jobs run side by side.
    with ThreadPoolExecutor(len(kinds)) as pool:
        early = pool.submit(find, "bar local")  # needs no pivots, so it runs beside their thinning
        thinned_of(spark, sf_dir)
        found = {kind: pool.submit(find, kind) for kind in kinds if kind != "bar local"} | {"bar local": early}
        return _union([found[kind].result() for kind in kinds])


def _evaluated(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    types = specs.pattern_spec(spark).select(F.col("spec_key").alias("pattern_name"), F.array_join("detection_signature.pivot_sequence", "").alias("types"))
    bars, chosen = bars_of(spark, sf_dir), universe.confirmed(found)
    return outcomes.evaluate(chosen, bars, types=types)


def outcomes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of their confirmed breakouts."""
    return kept(spark, sf_dir, "outcomes", lambda: _evaluated(spark, sf_dir, detections_of(spark, sf_dir)))


def spec_outcomes_of(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Outcomes of the confirmed breakouts of one spec, without the other detectors."""
    return kept(spark, sf_dir, f"outcomes {key}", lambda: _evaluated(spark, sf_dir, spec_detections_of(spark, sf_dir).filter(F.col("pattern_name") == key)))


found_by = detections_of

_ID = "SELECT pattern_id FROM "

query("b7_anchor_dates", O.with_(D.detections(), _ID + "det WHERE coalesce(breakout_date, formation_end) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"))(lambda spark, d: universe.by_anchor(found_by(spark, d), "breakout_or_end", "1997-01-01", "1999-12-31").select("pattern_id"))
query("b8_confirmed", O.with_(D.detections(), _ID + "det WHERE breakout_date IS NOT NULL AND breakout_price IS NOT NULL AND pattern_name <> 'double_tops'"))(lambda spark, d: universe.confirmed(found_by(spark, d), ["double_tops"]).select("pattern_id"))
query("b9_min_price_scan", O.with_(D.detections(), _ID + "det WHERE breakout_price >= 100"))(lambda spark, d: universe.min_price(found_by(spark, d), 100).select("pattern_id"))
query("b9_min_price_report", O.with_(D.detections(), _ID + "det WHERE breakout_price IS NULL OR breakout_price >= 100"))(lambda spark, d: universe.min_price(found_by(spark, d), 100, True).select("pattern_id"))
query("b11_pattern_subset", O.with_(D.detections(), _ID + "det WHERE pattern_name IN ('three_falling_peaks', 'three_rising_valleys')"))(lambda spark, d: universe.of_patterns(found_by(spark, d), ["three_falling_peaks", "three_rising_valleys"], specs.pattern_dim(spark)).select("pattern_id"))
_FIRST = "row_number() OVER (PARTITION BY symbol ORDER BY coalesce(CAST(breakout_date AS VARCHAR), ''), confidence_score DESC, pattern_name, pattern_id)"
query("b12_cap_first", O.with_(D.detections(), f"{_ID}det QUALIFY {_FIRST} <= 3"))(lambda spark, d: universe.cap(found_by(spark, d), ["symbol"], 3, "first").select("pattern_id"))
_TOP = "row_number() OVER (PARTITION BY symbol, pattern_name ORDER BY confidence_score DESC, coalesce(CAST(breakout_date AS VARCHAR), ''), pattern_id)"
query("b12_cap_top_confidence", O.with_(D.detections(), f"{_ID}det QUALIFY {_TOP} <= 1"))(lambda spark, d: universe.cap(found_by(spark, d), ["symbol", "pattern_name"], 1, "top_confidence").select("pattern_id"))
query("b12_cap_random")(lambda spark, d: universe.cap(found_by(spark, d), ["symbol"], 2, "random", 7).select("pattern_id"))
_CASES = "row_number() OVER (PARTITION BY pattern_name, breakout_direction ORDER BY confidence_score DESC, pattern_width_bars DESC, pattern_id)"
query("b13_top_cases", O.with_(D.detections(), f"SELECT pattern_id, {_CASES} AS case_rank FROM det WHERE breakout_direction IS NOT NULL QUALIFY case_rank <= 3"))(lambda spark, d: universe.top_cases(found_by(spark, d)).select("pattern_id", "case_rank"))

_TEXT = ["bust_failure_date", "boundary_invalidation_date", "ultimate_date", "throwback_pullback_date", "target_achievement_date", "breakout_date"]
_ROUND = ["breakout_price", "target_price", "stop_loss_price", "bust_failure_pct", "ultimate_price", "max_favorable_excursion_pct", "max_adverse_excursion_pct"]
_RES = "SELECT * REPLACE (" + ", ".join([*(f"CAST({c} AS VARCHAR) AS {c}" for c in _TEXT), *(f"round({c}, 9) AS {c}" for c in _ROUND), "CAST(evaluation_window_bars AS BIGINT) AS evaluation_window_bars"]) + ") FROM res"


query("h_outcomes", O.with_(D.OUTCOMES, _RES))(outcomes_of)


def _greedy(order: str) -> str:
    """The greedy choice row by row, over the detections of each symbol in order."""
    ctes = f"""{D.detections()},
o AS (SELECT pattern_id, symbol, CAST(split_part(pivot_indices, ',', 1) AS BIGINT) AS lo, CAST(split_part(pivot_indices, ',', -1) AS BIGINT) AS hi, row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS k FROM det),
walk AS (SELECT symbol, k, [pattern_id] AS kept, [{{'lo': lo, 'hi': hi}}] AS spans FROM o WHERE k = 1
  UNION ALL SELECT symbol, k, CASE WHEN clash THEN kept ELSE list_append(kept, pattern_id) END, CASE WHEN clash THEN spans ELSE list_append(spans, {{'lo': lo, 'hi': hi}}) END
  FROM (SELECT o.symbol, o.k, o.pattern_id, o.lo, o.hi, w.kept, w.spans, len(list_filter(w.spans, lambda s: NOT (o.hi < s.lo OR s.hi < o.lo))) > 0 AS clash FROM walk w JOIN o ON o.symbol = w.symbol AND o.k = w.k + 1))"""
    return O.with_(ctes, "SELECT unnest(kept) AS pattern_id FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k DESC) = 1)")


_LENGTH = "CAST(split_part(pivot_indices, ',', -1) AS BIGINT) - CAST(split_part(pivot_indices, ',', 1) AS BIGINT)"
query("i1_overlap_scan", _greedy(f"{_LENGTH} DESC, breakout_date IS NOT NULL DESC, confidence_score DESC, pattern_name, pattern_id"))(lambda spark, d: overlap.resolve_overlaps(found_by(spark, d), "scan").select("pattern_id"))
query("i2_overlap_report", _greedy("pattern_width_bars DESC, confidence_score DESC, pattern_name, pattern_id"))(lambda spark, d: overlap.resolve_overlaps(found_by(spark, d), "report").select("pattern_id"))
