"""Queries of the reports, the metadata and the result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.operators import clean
from swingkit.plans import oracle as O
from swingkit.plans import outcome_sql as D
from swingkit.plans import reports
from swingkit.plans.base import bars_of, folder, kept, query
from swingkit.plans.pattern_queries import detections_of, outcomes_of
from swingkit.sources import bars as source
from swingkit.sources import merged, sinks, specs


def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, detections and outcomes."""
    return bars_of(spark, sf_dir), detections_of(spark, sf_dir), outcomes_of(spark, sf_dir)


def frame_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with outcomes, regime and group."""

    def make() -> DataFrame:
        _, found, out = results(spark, sf_dir)
        return grouped(spark, in_regimes(spark, sf_dir, reports.run_frame(found, out)))

    return kept(spark, sf_dir, "frame", make)


def in_regimes(spark: SparkSession, sf_dir: str, frame: DataFrame) -> DataFrame:
    """``frame`` with the regime at its breakouts."""
    return reports.with_regime(frame, source.index_series(source.market_index(bars_of(spark, sf_dir)), "IDX"))


def grouped(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """``frame`` with the groups of its patterns."""
    return reports.with_group(frame, specs.pattern_dim(spark), "canonical_key")


def _values(rows: list[tuple], names: str) -> str:
    text = ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {text}) AS v({names}))"


_DIM = "dim AS " + _values(specs.metadata_rows(), "pattern_key, part, chapter, name, spec_key, canonical_key, variant, kind, proxy")
_LIMITS = [(k, s["geometry_constraints"]["width_min_bars"], s["geometry_constraints"]["width_max_bars"], s["geometry_constraints"]["height_ratio_min"], s["geometry_constraints"]["height_ratio_max"]) for k, s in specs.SPECS.items()]
_SPEC = "spec AS " + _values(_LIMITS, "spec_key, width_min, width_max, height_min, height_max")
_REGIME = """
idxs AS (SELECT date, round(sum(CAST(round(close * 100) AS BIGINT)) / count(*)::DOUBLE / 100, 4) AS close FROM pos GROUP BY date),
fr0 AS (SELECT d.*, r.* EXCLUDE (pattern_id, symbol, pattern_name, breakout_date, breakout_price, breakout_direction, target_price, stop_loss_price), d.breakout_date - INTERVAL 18 MONTH AS past FROM det d LEFT JOIN res r USING (pattern_id)),
fr1 AS (SELECT f.*, a.close AS now FROM fr0 f ASOF LEFT JOIN idxs a ON f.breakout_date >= a.date),
fr2 AS (SELECT f.*, b.close AS old FROM fr1 f ASOF LEFT JOIN idxs b ON f.past >= b.date),
frame AS (SELECT f.*, CASE WHEN breakout_date IS NULL THEN NULL WHEN now > old THEN 'bull' WHEN now <= old THEN 'bear' END AS market_regime, coalesce(m.canonical_key, f.pattern_name) AS pattern_group FROM fr2 f LEFT JOIN dim m ON m.pattern_key = f.pattern_name)"""
FRAME = f"{D.OUTCOMES},{_DIM},{_REGIME}"
_A = "avg(CAST({c} AS INTEGER)) * 100"
_r = lambda e, n: f"round({e}, 9) AS {n}"


def _report_sql(by: str) -> str:
    flags = {"throwback_pullback_rate_pct": "throwback_pullback_occurred", "target_hit_rate_intraday_pct": "target_achieved_intraday", "boundary_invalidation_rate_pct": "boundary_invalidated", "busted_5pct_rate_pct": "bust_failure_5pct"}
    parts = [_r(_A.format(c=c), n) for n, c in flags.items()] + [_r(_A.format(c=f"(max_favorable_excursion_pct < {n})"), f"failure_lt_{n}pct_rate_pct") for n in (5, 10, 15)]
    return f"""SELECT {by}, breakout_direction, coalesce(market_regime, 'unknown') AS market_regime, count(*) AS n_confirmed, count(evaluation_window_bars) AS n_evaluated, round(count(evaluation_window_bars) / count(*) * 100, 9) AS eval_coverage_pct,
  round(median(max_favorable_excursion_pct), 9) AS median_move_pct, round(median(days_to_ultimate), 9) AS median_days_to_ultimate, {', '.join(parts)} FROM frame WHERE breakout_date IS NOT NULL GROUP BY {by}, breakout_direction, coalesce(market_regime, 'unknown')"""


_STATS = [("throwback_pullback_rate_pct", "throwback_pullback_occurred"), ("target_achievement_rate_intraday_pct", "target_achieved_intraday"), ("bust_failure_rate_5pct", "bust_failure_5pct"), ("boundary_invalidation_rate_pct", "boundary_invalidated")]
_MEANS = "round(avg(max_favorable_excursion_pct), 9) AS avg_mfe_pct, round(avg(max_adverse_excursion_pct), 9) AS avg_mae_pct, round(avg(days_to_ultimate), 9) AS avg_days_to_ultimate"
_RATES = ", ".join(_r(_A.format(c=c), n) for n, c in _STATS)

query("j1_run_stats", O.with_(D.OUTCOMES, f"""SELECT (SELECT count(*) FROM det) AS detections_total, (SELECT count(breakout_date) FROM det) AS detections_with_breakout, count(*) AS evaluations_total, {_RATES}, {_r(_A.format(c='bust_failure_10pct'), 'bust_failure_rate_10pct')},
  {_r(_A.format(c='target_achieved_close'), 'target_achievement_rate_close_pct')}, {_MEANS} FROM res"""))(lambda spark, d: reports.run_stats(*results(spark, d)[1:]))
query("j2_stats_by_pattern", O.with_(D.OUTCOMES, f"SELECT pattern_name, count(*) AS n, {_RATES}, {_MEANS} FROM res GROUP BY pattern_name"))(lambda spark, d: reports.stats_by(outcomes_of(spark, d)))
_SHARES = {"bust_5pct": "bust_failure_5pct", "invalidated_pct": "boundary_invalidated", "throwback_pct": "throwback_pullback_occurred", "target_pct": "target_achieved_intraday", "retested_breakout_pct": "retested_breakout_level", "retested_boundary_pct": "retested_boundary_level", "bust_10pct": "bust_failure_10pct", "target_close_pct": "target_achieved_close"}
_MM = ", ".join(f"round(avg({c}), 9) AS mean_{n}, round(median({c}), 9) AS median_{n}" for n, c in (("days", "days_to_ultimate"), ("days_to_target", "days_to_target"), ("mfe", "max_favorable_excursion_pct"), ("mae", "max_adverse_excursion_pct")))
query("j4_totals", O.with_(D.OUTCOMES, f"SELECT count(*) AS total, {', '.join(f'round(count(*) FILTER (WHERE {c}) / count(*) * 100, 9) AS {n}' for n, c in _SHARES.items())}, {_MM} FROM res"))(lambda spark, d: reports.totals(outcomes_of(spark, d)))
query("j5_stop_reasons", O.with_(D.OUTCOMES, "SELECT ultimate_stop_reason, count(*) AS n FROM res WHERE ultimate_stop_reason IS NOT NULL GROUP BY 1"))(lambda spark, d: reports.stop_reasons(outcomes_of(spark, d)))
query("j6_market_regime", O.with_(FRAME, "SELECT pattern_id, CAST(breakout_date AS VARCHAR) AS breakout_date, market_regime FROM frame"))(lambda spark, d: in_regimes(spark, d, detections_of(spark, d)).select("pattern_id", "breakout_date", "market_regime"))
query("j8_pattern_groups", O.with_(FRAME, "SELECT pattern_group, count(*) AS n FROM frame GROUP BY 1"))(lambda spark, d: grouped(spark, detections_of(spark, d)).groupBy("pattern_group").agg(F.count("*").alias("n")))
query("j9_pattern_report", O.with_(FRAME, _report_sql("pattern_group")))(lambda spark, d: reports.pattern_report(frame_of(spark, d)))
query("j10_ranked_report", O.with_(f"{FRAME}, rep AS ({_report_sql('pattern_group')})", "SELECT *, CASE WHEN median_move_pct IS NOT NULL THEN row_number() OVER (PARTITION BY market_regime, breakout_direction, median_move_pct IS NULL ORDER BY median_move_pct DESC, n_evaluated DESC, n_confirmed DESC, pattern_group) END AS rank_by_median_move FROM rep"))(lambda spark, d: reports.ranked(reports.pattern_report(frame_of(spark, d))))
_CONF = "breakout_date IS NOT NULL AND breakout_price IS NOT NULL"
query("j12_symbol_frequency", O.with_(FRAME, f"""SELECT symbol, pattern_group, coalesce(market_regime, 'unknown') AS market_regime, count(*) AS n_detections, count(*) FILTER (WHERE {_CONF}) AS n_confirmed, count(*) FILTER (WHERE {_CONF} AND evaluation_window_bars IS NOT NULL) AS n_evaluated,
  round(count(*) FILTER (WHERE {_CONF}) / count(*) * 100, 9) AS confirmed_pct, count(*) FILTER (WHERE breakout_direction = 'up') AS n_up, count(*) FILTER (WHERE breakout_direction = 'down') AS n_down, count(*) FILTER (WHERE {_CONF} AND breakout_direction IS NULL) AS n_unknown FROM frame GROUP BY ALL"""))(lambda spark, d: reports.symbol_frequency(frame_of(spark, d)))
query("j13_symbol_performance", O.with_(FRAME, _report_sql("symbol, pattern_group")))(lambda spark, d: reports.symbol_performance(frame_of(spark, d)))
query("j14_sanity", O.with_(D.detections(), "SELECT pattern_name, count(*) AS n, count(*) FILTER (WHERE pattern_width_bars <= 0) AS bad_width, count(*) FILTER (WHERE pattern_height_pct <= 0) AS bad_height, count(*) FILTER (WHERE confidence_score NOT BETWEEN 0 AND 100) AS bad_confidence FROM det GROUP BY 1"))(lambda spark, d: reports.sanity(detections_of(spark, d)))
_NARROW = ", lim AS (SELECT pattern_key, CASE WHEN o.spec_key IS NOT NULL THEN 'own' WHEN m.spec_key IS NOT NULL THEN 'mapped' ELSE 'none' END AS limit_source, coalesce(o.width_min, m.width_min) AS width_min, coalesce(o.width_max, m.width_max) / 2 AS width_max, coalesce(o.height_min, m.height_min) AS height_min, coalesce(o.height_max, m.height_max) / 4 AS height_max FROM dim LEFT JOIN spec o ON o.spec_key = dim.pattern_key LEFT JOIN spec m ON m.spec_key = dim.spec_key)"


@query("j15_spec_compliance", O.with_(f"{D.detections()},{_DIM},{_SPEC}{_NARROW}", """SELECT pattern_name, limit_source, count(*) AS n, round(avg(CAST(pattern_width_bars NOT BETWEEN width_min AND width_max AS INTEGER)) * 100, 9) AS width_outside_pct, round(avg(CAST(pattern_height_pct NOT BETWEEN height_min AND height_max AS INTEGER)) * 100, 9) AS height_outside_pct
  FROM det JOIN lim ON pattern_key = pattern_name GROUP BY 1, 2"""))
def _j15(spark, d):
    limits = reports.with_limits(specs.pattern_dim(spark), specs.pattern_spec(spark))
    narrow = limits.withColumns({"width_max": F.col("width_max") / 2, "height_max": F.col("height_max") / 4})
    return reports.compliance(detections_of(spark, d), narrow)


query("j16_outcome_kpis", O.with_(D.OUTCOMES, f"SELECT pattern_name, count(*) AS n_evals, round(median(max_favorable_excursion_pct), 9) AS median_move_pct, round(median(days_to_ultimate), 9) AS median_days, {', '.join(_r(_A.format(c=f'(max_favorable_excursion_pct < {n})'), f'failure_lt_{n}_pct') for n in (5, 10))} FROM res GROUP BY 1 HAVING count(*) >= 10"))(lambda spark, d: reports.outcome_kpis(outcomes_of(spark, d), 10))


@query("j17_compare_runs", O.with_(D.OUTCOMES, """SELECT coalesce(a.pattern_name, b.pattern_name) AS pattern_name, coalesce(a.n, 0) AS n_calibration, coalesce(b.n, 0) AS n_validation FROM (SELECT pattern_name, count(*) AS n FROM res WHERE breakout_date < DATE '1998-01-01' GROUP BY 1) a
  FULL JOIN (SELECT pattern_name, count(*) AS n FROM res WHERE breakout_date >= DATE '1998-01-01' GROUP BY 1) b ON a.pattern_name = b.pattern_name"""))
def _j17(spark, d):
    out = outcomes_of(spark, d)
    return reports.compare_runs(out.filter("breakout_date < date '1998-01-01'"), out.filter("breakout_date >= date '1998-01-01'"))


_CASE = """, cs AS (SELECT * FROM det WHERE breakout_direction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pattern_name, breakout_direction ORDER BY confidence_score DESC, pattern_width_bars DESC, pattern_id) <= 1)"""


@query("j20_case_bars", O.with_(D.detections() + _CASE, "SELECT c.pattern_id, x.symbol, x.idx, CAST(x.date AS VARCHAR) AS date, round(x.open, 9) AS open, round(x.high, 9) AS high, round(x.low, 9) AS low, round(x.close, 9) AS close, x.volume FROM cs c JOIN ind x ON x.symbol = c.symbol AND x.idx BETWEEN CAST(split_part(c.pivot_indices, ',', 1) AS BIGINT) - 30 AND CAST(split_part(c.pivot_indices, ',', -1) AS BIGINT) + 30"))
def _j20(spark, d):
    from swingkit.operators.universe import top_cases

    bars, found = bars_of(spark, d), detections_of(spark, d)
    return reports.case_bars(top_cases(found, 1), bars)


@query("j21_detections_by_pattern", O.with_(D.detections(), "SELECT pattern_name, count(*) AS n FROM det GROUP BY 1"))
def _j21(spark, d):
    detections_of(spark, d).createOrReplaceTempView("pattern_detections")
    return spark.sql("SELECT pattern_name, count(*) AS n FROM pattern_detections GROUP BY pattern_name")


# Result tables: written, read again, and compared with what went in.


# A run in three batches that overlap: a later batch replaces what an earlier one wrote under the same id, and leaves the rest.
_AGAIN = """(SELECT * REPLACE (confidence_score + CASE WHEN pattern_name IN ('gaps', 'islands') AND CAST(symbol AS BIGINT) % 3 <> 1 THEN 3 WHEN CAST(symbol AS BIGINT) % 3 <> 0 THEN 2 ELSE 1 END AS confidence_score) FROM det)"""


@query("a5_detections_table", O.with_(D.detections(), O.DETECTION_SELECT.format(source=_AGAIN)))
def _a5(spark, d):
    found, path = detections_of(spark, d), f"{folder(spark)}/detections-{uuid.uuid4().hex}"
    third = F.col("symbol").cast("bigint") % 3
    surer = lambda df, n: df.withColumn("confidence_score", F.col("confidence_score") + n)
    merged.merge_detections(found, "other", path)
    merged.merge_detections(surer(found.filter(third < 2).unionByName(found.filter(third < 2)), 1), "run", path)
    merged.merge_detections(surer(found.filter(third > 0), 2), "run", path)
    merged.merge_detections(surer(found.filter(F.col("pattern_name").isin("gaps", "islands") & (third != 1)), 3), "run", path)
    return merged.read_merged(spark, path, "run").select(found.columns)


@query("a11_run_frame", O.with_(D.OUTCOMES, "SELECT d.pattern_id, d.symbol, d.pattern_name, round(r.ultimate_price, 9) AS ultimate_price, r.days_to_ultimate FROM det d LEFT JOIN res r USING (pattern_id)"))
def _a11(spark, d):
    _, found, out = results(spark, d)
    path = f"{folder(spark)}/outcomes-{uuid.uuid4().hex}"
    merged.merge_outcomes(out, "run", path)
    merged.merge_outcomes(out.filter("breakout_direction = 'up'"), "run", path)
    return reports.run_frame(found, merged.read_merged(spark, path, "run").drop("run_id")).select("pattern_id", "symbol", "pattern_name", "ultimate_price", "days_to_ultimate")


_CONFIG = '{"lookahead":"252","min_rows":"200"}'


@query("a7_run_registry", O.with_(f"{O.BARS},{O.DAMAGED}", f"""SELECT 'run' AS run_id, count(*) AS symbols_planned, count(*) - count(*) FILTER (WHERE bad) AS symbols_scanned, count(*) FILTER (WHERE bad) AS symbols_failed, '{_CONFIG}' AS config_json, substr(md5('{_CONFIG}'), 1, 8) AS config_hash
  FROM (SELECT symbol, count(*) FILTER (WHERE least(open, high, low, close) > 0 AND NOT isnan(open) AND close IS NOT NULL) = 0 OR count(DISTINCT date) < count(*) OR count(*) < 290 AS bad FROM damaged GROUP BY symbol)"""))
def _a7(spark, d):
    bars = source.damaged(source.lineitem_bars(spark, d))
    return sinks.run_row(spark, "run", {"min_rows": 200, "lookahead": 252}, bars, clean.quarantine(bars, 290))


@query("a12_saved_bars", O.with_(O.CLEAN_BARS, "SELECT symbol, idx, CAST(date AS VARCHAR) AS date, round(close, 9) AS close, round(atr, 9) AS atr FROM ind"))
def _a12(spark, d):
    path = f"{folder(spark)}/bars-{uuid.uuid4().hex}"
    sinks.write_by_symbol(bars_of(spark, d), path, 8)
    return sinks.open_by_symbol(spark, path, 8).select("symbol", "idx", "date", "close", "atr")
