"""Queries of pattern sets and their metadata, of a run's statistics and settings, and of double-top variants."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.operators import outcomes
from swingkit.plans import oracle as O
from swingkit.plans import outcome_sql as D
from swingkit.plans import reports
from swingkit.plans.base import ORACLE, QUERIES, bars_of, folder, query
from swingkit.plans.pattern_queries import detections_of, outcomes_of, spec_detections_of, spec_outcomes_of
from swingkit.sources import sinks, specs

_FOUND = D.detections()


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of detections by pattern."""
    return detections_of(spark, sf_dir).groupBy("pattern_name").agg(F.count("*").alias("n_detections"))


# The expected values are written out here, so that the metadata table is held against something else than itself.
_SETS = """(VALUES ('chapters_53', 53, 28, 0, 44, 10), ('strict_53', 53, 28, 0, 44, 10), ('event', 2, 2, 2, 0, 0), ('all_55', 55, 30, 2, 44, 10), ('strict_55', 55, 30, 2, 44, 10), ('digitized', 31, 11, 0, 8, 0))
  AS s(pattern_set, n_patterns, n_groups, n_proxies, n_with_spec, n_variants)"""
_LONG = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_patterns", "n_groups", "n_proxies", "n_with_spec", "n_variants"))
_CHAPTERS = """('broadening_bottoms', 'broadening_formations_right_angled_ascending', 'broadening_formations_right_angled_descending', 'broadening_tops', 'bump_and_run_reversal_bottoms', 'cup_with_handle', 'cup_with_handle_inverted',
  'flags', 'gaps', 'pennants', 'pipe_bottoms', 'pipe_tops', 'rounding_tops', 'three_falling_peaks', 'three_rising_valleys', 'triple_bottoms', 'triple_tops')"""
_DIGITIZED = """('broadening_bottoms', 'broadening_formations_right_angled_ascending', 'broadening_formations_right_angled_descending', 'broadening_tops', 'broadening_wedges', 'bump_and_run_reversal', 'cup_with_handle', 'diamond_bottom', 'diamond_top',
  'double_bottoms', 'double_tops', 'flags', 'gaps', 'head_and_shoulders_bottom', 'head_and_shoulders_top', 'horn_bottoms_tops', 'inside_day', 'islands', 'measured_move_down_up', 'pennants', 'pipe_bottoms', 'rectangle_bottoms_tops',
  'rising_falling_three_methods', 'rounding_bottoms_tops', 'scallop_ascending_descending', 'spike_formation', 'three_falling_peaks', 'three_rising_valleys', 'triangles', 'triple_bottoms_tops', 'wedges_ascending_descending')"""
_IN = f"""CASE WHEN pattern_set = 'event' THEN pattern_name LIKE 'dead_cat%' WHEN pattern_set = 'digitized' THEN pattern_name IN {_DIGITIZED}
  WHEN pattern_name LIKE 'dead_cat%' THEN pattern_set IN ('all_55', 'strict_55') ELSE pattern_name IN {_CHAPTERS} END"""


@query("j18_pattern_sets", O.with_(_FOUND, f"SELECT s.* REPLACE ({_LONG}), (SELECT count(*) FROM det WHERE {_IN}) AS n_detections FROM {_SETS}"))
def _j18(spark, d):
    sets = specs.pattern_sets(spark)
    found = sets.join(_found(spark, d), sets["pattern_key"] == F.col("pattern_name")).groupBy("pattern_set").agg(F.sum("n_detections").alias("n_detections"))
    return reports.coverage(specs.pattern_dim(spark), specs.pattern_spec(spark), sets).join(found, "pattern_set", "left").fillna(0, ["n_detections"])


_GROUPS = """(VALUES ('broadening_bottoms', 1, 'chart', 'Broadening Bottoms', '1', 'Broadening Bottoms'), ('broadening_tops', 1, 'chart', 'Broadening Tops', '4', 'Broadening Tops'),
  ('broadening_formations_right_angled_ascending', 1, 'chart', 'Broadening Formations, Right-Angled and Ascending', '2', 'Broadening Formations'),
  ('broadening_formations_right_angled_descending', 1, 'chart', 'Broadening Formations, Right-Angled and Descending', '3', 'Broadening Formations'),
  ('broadening_wedges', 2, 'chart', 'Broadening Wedges, Ascending;Broadening Wedges, Descending', '5-6', 'Broadening Wedges'),
  ('bump_and_run_reversal', 2, 'chart', 'Bump-and-Run Reversal Bottoms;Bump-and-Run Reversal Tops', '7-8', 'bump_and_run_reversal'),
  ('cup_with_handle', 2, 'chart', 'Cup with Handle;Cup with Handle (Inverted)', '9-10', 'Cup with Handle'),
  ('diamond_bottom', 1, 'chart', 'Diamond Bottoms', '11', 'Diamond Bottoms'), ('diamond_top', 1, 'chart', 'Diamond Tops', '12', 'Diamond Tops'),
  ('double_bottoms', 4, 'chart', 'Double Bottoms, Adam & Adam;Double Bottoms, Adam & Eve;Double Bottoms, Eve & Adam;Double Bottoms, Eve & Eve', '13-16', 'Double Bottoms'),
  ('double_tops', 4, 'chart', 'Double Tops, Adam & Adam;Double Tops, Adam & Eve;Double Tops, Eve & Adam;Double Tops, Eve & Eve', '17-20', 'Double Tops'),
  ('flags', 2, 'chart', 'Flags;Flags, High and Tight', '21-22', 'Flags'), ('gaps', 1, 'chart', 'Gaps', '23', 'Gaps'),
  ('head_and_shoulders_bottom', 2, 'chart', 'Head-and-Shoulders Bottoms;Head-and-Shoulders Bottoms (Complex)', '24-25', 'Head-and-Shoulders Bottoms'),
  ('head_and_shoulders_top', 2, 'chart', 'Head-and-Shoulders Tops;Head-and-Shoulders Tops (Complex)', '26-27', 'Head-and-Shoulders Tops'),
  ('horn_bottoms_tops', 2, 'chart', 'Horn Bottoms;Horn Tops', '28-29', 'horn_bottoms_tops'), ('islands', 2, 'chart', 'Island Reversals;Islands, Long', '30-31', 'islands'),
  ('measured_move_down_up', 2, 'chart', 'Measured Move Down;Measured Move Up', '32-33', 'measured_move_down_up'), ('pennants', 1, 'chart', 'Pennants', '34', 'Pennants'),
  ('pipe_bottoms', 2, 'chart', 'Pipe Bottoms;Pipe Tops', '35-36', 'pipe_bottoms'), ('rectangle_bottoms_tops', 2, 'chart', 'Rectangle Bottoms;Rectangle Tops', '37-38', 'rectangle_bottoms_tops'),
  ('rounding_bottoms_tops', 2, 'chart', 'Rounding Bottoms;Rounding Tops', '39-40', 'rounding_bottoms_tops'),
  ('scallop_ascending_descending', 4, 'chart', 'Scallops, Ascending;Scallops, Ascending (Inverted);Scallops, Descending;Scallops, Descending (Inverted)', '41-44', 'Scallops'),
  ('three_falling_peaks', 1, 'chart', 'Three Falling Peaks', '45', 'Three Falling Peaks'), ('three_rising_valleys', 1, 'chart', 'Three Rising Valleys', '46', 'Three Rising Valleys'),
  ('triangles', 3, 'chart', 'Triangles, Ascending;Triangles, Descending;Triangles, Symmetrical', '47-49', 'Triangles'),
  ('wedges_ascending_descending', 2, 'chart', 'Wedges, Falling;Wedges, Rising', '52-53', 'Wedges'),
  ('dead_cat_bounce', 1, 'event', 'Dead-Cat Bounce', '54', 'Dead-Cat Bounce'), ('dead_cat_bounce_inverted', 1, 'event', 'Dead-Cat Bounce (Inverted)', '55', 'Dead-Cat Bounce')) AS g(pattern_group, n_patterns, kinds, names, chapter_ranges, display_name)"""


@query("j11_metadata_rollup", O.with_(_FOUND, f"SELECT g.* REPLACE (CAST(n_patterns AS BIGINT) AS n_patterns), f.n_detections FROM {_GROUPS} JOIN (SELECT pattern_name, count(*) AS n_detections FROM det GROUP BY 1) f ON f.pattern_name = g.pattern_group"))
def _j11(spark, d):
    return reports.metadata_rollup(specs.pattern_dim(spark)).join(_found(spark, d).withColumnRenamed("pattern_name", "pattern_group"), "pattern_group")


# Chapter patterns of other names than their base, and the queries of those that a further test tells apart.
_RENAMED = {"bump_and_run_reversal": "bump_and_run_reversal_tops", "diamond_bottom": "diamond_bottoms", "diamond_top": "diamond_tops", "rounding_bottoms_tops": "rounding_bottoms"}
_TESTED = ["g3_broadening_wedges", "g7_double_bottoms", "g8_double_tops", "g9_flags", "g10_head_and_shoulders_bottoms", "g10_head_and_shoulders_tops", "g11_horns", "g12_islands", "g13_measured_moves", "g15_rectangles", "g17_scallops", "g19_triangles", "g21_wedges"]
_NEW_NAME = "CASE pattern_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _RENAMED.items()) + " ELSE pattern_name END"
_WHOLE = "".join(f" UNION ALL SELECT pattern_name FROM ({ORACLE[name]})" for name in _TESTED)


@query("g22_all_55", O.with_(D.detections(), f"SELECT pattern_name, count(*) AS n FROM (SELECT {_NEW_NAME} AS pattern_name FROM det WHERE (pattern_name IN {_CHAPTERS} AND pattern_name <> 'flags') OR pattern_name LIKE 'dead_cat%' OR pattern_name IN ({', '.join(repr(k) for k in _RENAMED)}){_WHOLE}) GROUP BY 1"))
def _g22(spark, d):
    """The patterns of one set by name: the scan's own and the derived ones, as many of the 55 as occur."""
    own = detections_of(spark, d).filter("pattern_name <> 'flags'").select(F.expr(_NEW_NAME).alias("pattern_name"))  # flags are told apart below
    found = functools.reduce(DataFrame.unionByName, [own, *(QUERIES[name](spark, d).select("pattern_name") for name in _TESTED)])
    wanted = specs.pattern_sets(spark).filter("pattern_set = 'all_55'").select(F.col("pattern_key").alias("pattern_name"))
    return found.join(F.broadcast(wanted), "pattern_name", "left_semi").groupBy("pattern_name").agg(F.count("*").alias("n"))  # a row a pattern


# Double tops with their variant.

_VARIANTS = f"""{D.OUTCOMES},
dt AS (SELECT r.*, CAST(split_part(d.pivot_indices, ',', 1) AS BIGINT) AS pa, CAST(split_part(d.pivot_indices, ',', 3) AS BIGINT) AS pb FROM res r JOIN det d USING (pattern_id) WHERE r.pattern_name = 'double_tops'),
pts AS (SELECT DISTINCT symbol, unnest([pa, pb]) AS at FROM dt),
pw AS (SELECT p.symbol, p.at, CAST(coalesce(min(b.idx) FILTER (WHERE b.idx > p.at AND b.high < t.high * 0.98::DOUBLE) - 1, max(b.idx)) - coalesce(max(b.idx) FILTER (WHERE b.idx < p.at AND b.high < t.high * 0.98::DOUBLE) + 1, min(b.idx)) + 1 AS BIGINT) AS w
  FROM pts p JOIN ind t ON t.symbol = p.symbol AND t.idx = p.at JOIN ind b ON b.symbol = p.symbol AND b.idx BETWEEN p.at - 15 AND p.at + 15 GROUP BY p.symbol, p.at),
vt AS (SELECT dt.*, x.w AS w1, y.w AS w2, CASE WHEN x.w <= 3 THEN 'A' WHEN x.w >= 7 THEN 'E' END || CASE WHEN y.w <= 3 THEN 'A' WHEN y.w >= 7 THEN 'E' END AS variant FROM dt JOIN pw x ON x.symbol = dt.symbol AND x.at = pa JOIN pw y ON y.symbol = dt.symbol AND y.at = pb)"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the double tops, which are detections of one spec, with their variant."""
    return outcomes.with_variants(spec_outcomes_of(spark, sf_dir, "double_tops"), spec_detections_of(spark, sf_dir), bars_of(spark, sf_dir))


@query("h13_double_top_outcomes", O.with_(_VARIANTS, "SELECT pattern_id, variant, w1 AS peak1_width_bars, w2 AS peak2_width_bars, round(max_favorable_excursion_pct, 9) AS max_favorable_excursion_pct FROM vt"))
def _h13(spark, d):
    return _variants(spark, d).select("pattern_id", "variant", "peak1_width_bars", "peak2_width_bars", "max_favorable_excursion_pct")


_MEANS = """count(*) AS n, round(avg(max_favorable_excursion_pct), 9) AS avg_mfe_pct, round(avg(max_adverse_excursion_pct), 9) AS avg_mae_pct, round(avg(CAST(bust_failure_5pct AS INTEGER)) * 100, 9) AS bust_failure_rate_5pct,
  round(avg(CAST(target_achieved_intraday AS INTEGER)) * 100, 9) AS target_achievement_rate_intraday_pct"""


@query("j3_outcomes_by_variant", O.with_(_VARIANTS, f"SELECT coalesce(variant, 'unknown') AS variant, {_MEANS} FROM vt GROUP BY 1"))
def _j3(spark, d):
    """Statistics of each variant; those without one, which the run statistics leave out and the list aggregator counts, are ``unknown``."""
    stats = reports.stats_by(_variants(spark, d).withColumn("variant", F.coalesce("variant", F.lit("unknown"))), "variant")
    return stats.select("variant", "n", "avg_mfe_pct", "avg_mae_pct", "bust_failure_rate_5pct", "target_achievement_rate_intraday_pct")


@query("j21_mfe_by_variant", O.with_(_VARIANTS, "SELECT variant, count(*) AS n, round(avg(max_favorable_excursion_pct), 9) AS avg_mfe FROM vt WHERE variant IS NOT NULL GROUP BY 1"))
def _j21(spark, d):
    _variants(spark, d).createOrReplaceTempView("post_breakout_results")
    return spark.sql("SELECT variant, count(*) AS n, avg(max_favorable_excursion_pct) AS avg_mfe FROM post_breakout_results WHERE variant IS NOT NULL GROUP BY variant")


# Statistics and settings of a run, written and read again.


@query("a8_run_statistics", O.with_(D.OUTCOMES, f"SELECT 'run' AS run_id, 'by_pattern' AS \"table\", pattern_name, {_MEANS} FROM res GROUP BY pattern_name"))
def _a8(spark, d):
    path, stats = f"{folder(spark)}/statistics-{uuid.uuid4().hex}", reports.stats_by(outcomes_of(spark, d))
    sinks.write_statistics({"by_pattern": stats.limit(1)}, "other", path)
    sinks.write_statistics({"by_pattern": stats.limit(1)}, "run", path)
    sinks.write_statistics({"by_pattern": stats}, "run", path)
    rows = spark.read.parquet(path).filter("run_id = 'run'")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return rows.select("run_id", "table", F.from_json("row_json", schema).alias("x")).select("run_id", "table", "x.pattern_name", "x.n", "x.avg_mfe_pct", "x.avg_mae_pct", "x.bust_failure_rate_5pct", "x.target_achievement_rate_intraday_pct")


@query("a10_run_config", O.with_(O.BARS, "SELECT 'second' AS run_id, unnest(['last_date', 'n_symbols']) AS name, unnest([CAST(max(date) AS VARCHAR), CAST(count(DISTINCT symbol) AS VARCHAR)]) AS value FROM bars"))
def _a10(spark, d):
    """The settings of the newest of two runs, one of which has no valid text."""
    seen = bars_of(spark, d).agg(F.to_json(F.struct(F.max("date").cast("string").alias("last_date"), F.countDistinct("symbol").cast("string").alias("n_symbols"))).alias("config_json"))
    runs = seen.select(F.lit("second").alias("run_id"), F.lit(2).alias("created_at"), "config_json").unionByName(seen.select(F.lit("first").alias("run_id"), F.lit(1).alias("created_at"), F.lit("none").alias("config_json")))
    return sinks.run_config(runs)


@query("a13_json_report", O.with_(D.OUTCOMES, f"SELECT pattern_name, {_MEANS} FROM res GROUP BY pattern_name"))
def _a13(spark, d):
    path, stats = f"{folder(spark)}/report-{uuid.uuid4().hex}", reports.stats_by(outcomes_of(spark, d))
    sinks.write_json(stats, path)
    return spark.read.schema(stats.schema).json(path).select("pattern_name", "n", "avg_mfe_pct", "avg_mae_pct", "bust_failure_rate_5pct", "target_achievement_rate_intraday_pct")
