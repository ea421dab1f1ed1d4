"""The patterns of the whole set under their own names: detections, outcomes and statistics."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.operators import outcomes, universe
from swingkit.plans import oracle as O
from swingkit.plans import outcome_sql as D
from swingkit.plans import report_queries as R
from swingkit.plans import reports
from swingkit.plans.base import ORACLE, bars_of, kept, query
from swingkit.plans.derived_queries import _NAME, _WIDE, CHAPTERS
from swingkit.plans.pattern_queries import _RES, detections_of
from swingkit.plans.run_queries import _CHAPTERS, _NEW_NAME, _RENAMED, _TESTED
from swingkit.sources import specs


def chapters_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all patterns of the set by their chapter names, kept for what builds on them."""

    def make() -> DataFrame:
        found = detections_of(spark, sf_dir)
        own = found.filter("pattern_name <> 'flags'").withColumn("pattern_name", F.expr(_NEW_NAME))  # flags are told apart by a further test
        wanted = specs.pattern_sets(spark).filter("pattern_set = 'all_55'").select(F.col("pattern_key").alias("pattern_name"))
        rows = functools.reduce(DataFrame.unionByName, [own, *(CHAPTERS[name](spark, sf_dir).select(found.columns) for name in _TESTED)])
        return rows.join(F.broadcast(wanted), "pattern_name", "left_semi").select(found.columns)  # a row a pattern

    return kept(spark, sf_dir, "chapters", make)


def chapter_outcomes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of their confirmed breakouts; the lines of a pattern are those of its own spec, or of the one that it is mapped to."""

    def make() -> DataFrame:
        known = specs.pattern_spec(spark).select("spec_key", F.array_join("detection_signature.pivot_sequence", "").alias("types"))
        own = known.toDF("pattern_key", "own_types")
        types = specs.pattern_dim(spark).join(own, "pattern_key", "left").join(known, "spec_key", "left").select(F.col("pattern_key").alias("pattern_name"), F.coalesce("own_types", "types").alias("types")).filter("types is not null")
        bars, chosen = bars_of(spark, sf_dir), universe.confirmed(chapters_of(spark, sf_dir))
        return outcomes.evaluate(chosen, bars, types=types)

    return kept(spark, sf_dir, "chapter outcomes", make)


_LIST = ", ".join(D._COLUMNS)
_CAST = ", ".join(f"CAST({c} AS DATE) AS {c}" if c in D._DATES else c for c in D._COLUMNS if c not in ("pattern_id", "pattern_name"))
_PLAIN = _WIDE
for _c in ("breakout_price", "target_price", "stop_loss_price"):
    _PLAIN = _PLAIN.replace(f"round({_c}, 9) AS {_c}", _c)
_PARTS = " UNION ALL ".join(f"SELECT pattern_id, pattern_name, pattern_type FROM ({ORACLE[name]})" for name in _TESTED if name != "g12_islands")
_CHAP = f"""
parts AS ({_PARTS}),
chap AS (SELECT {_LIST.replace('pattern_name', f'{_NEW_NAME} AS pattern_name')}, breakout_level FROM det WHERE (pattern_name IN {_CHAPTERS} AND pattern_name <> 'flags') OR pattern_name LIKE 'dead_cat%' OR pattern_name IN ({', '.join(map(repr, _RENAMED))})
  UNION ALL SELECT c.pattern_id, b.symbol, c.pattern_name, c.pattern_type, {', '.join('b.' + c for c in D._COLUMNS[4:])}, b.breakout_level FROM parts c JOIN det b ON b.pattern_id = substr(c.pattern_id, strpos(c.pattern_id, '_' || c.pattern_name || '_') + length(c.pattern_name) + 2)
  UNION ALL SELECT {_LIST}, NULL::DOUBLE FROM (SELECT symbol || '_' || {_NAME} || '_' || pattern_id AS pattern_id, {_NAME} AS pattern_name, {_CAST} FROM ({_PLAIN})))"""
CHAPTER_OUTCOMES = f"{D.detections()},{_CHAP}{D.OUTCOMES.removeprefix(D.detections()).replace('FROM det WHERE breakout_date', 'FROM chap WHERE breakout_date')}"

query("h_chapter_outcomes", O.with_(CHAPTER_OUTCOMES, _RES))(chapter_outcomes_of)
query("j2_stats_by_chapter", O.with_(CHAPTER_OUTCOMES, f"SELECT pattern_name, count(*) AS n, {R._RATES}, {R._MEANS} FROM res GROUP BY pattern_name"))(lambda spark, d: reports.stats_by(chapter_outcomes_of(spark, d)))
query("f17_scan_by_chapter", O.with_(f"{D.detections()},{_CHAP}", "SELECT pattern_name, count(*) AS n, count(breakout_date) AS n_confirmed FROM chap GROUP BY pattern_name"))(
    lambda spark, d: chapters_of(spark, d).groupBy("pattern_name").agg(F.count("*").alias("n"), F.count("breakout_date").alias("n_confirmed"))
)
