"""Queries of the derived chapter patterns and of the metadata tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.operators import barlocal, derived, sequences
from swingkit.plans import oracle as O
from swingkit.plans import outcome_sql as D
from swingkit.plans import reports
from swingkit.plans.base import bars_of, pivots_of, query
from swingkit.plans.pattern_queries import detections_of, spec_detections_of
from swingkit.plans.report_queries import _DIM, _SPEC
from swingkit.sources import specs


def base_of(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Detections of one spec."""
    return spec_detections_of(spark, sf_dir).filter(F.col("pattern_name") == key)


#: The detections of the chapter patterns that a further test tells apart, by the name of their query.
CHAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def chapter(name: str, sql: str):
    """Registers a query of chapter patterns; it shows their names, CHAPTERS has the whole rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        CHAPTERS[name] = f
        query(name, sql)(lambda spark, d: f(spark, d).select("pattern_id", "pattern_name", "pattern_type"))
        return f

    return keep


def _sql(key: str, cases: list[tuple[str, str, str | None]], extra: str = "", join: str = "") -> str:
    """SQL of several (name, condition, kind) over the detections of a spec; conditions see p1, i1, ... and ``join``."""
    n = len(specs.SPECS[key]["detection_signature"]["pivot_sequence"])
    columns = ", ".join(f"m.p{k}, m.i{k}" for k in range(1, n + 1))
    ctes = f"{O.PIVOTED},{O.thinned(specs.SPACING.get(key, 10))},{O.sequence_detections(key, 's')}, x AS (SELECT s.*, {columns} FROM s JOIN s_m m ON m.symbol = s.symbol AND m.d1 = s.formation_start AND m.d{n} = s.formation_end){extra}"
    parts = [f"SELECT x.symbol || '_{name}_' || x.pattern_id AS pattern_id, '{name}' AS pattern_name, {f'{chr(39)}{kind}{chr(39)}' if kind else 'x.pattern_type'} AS pattern_type FROM x {join} WHERE {test}" for name, test, kind in cases]
    return O.with_(ctes, " UNION ALL ".join(parts))


def _deg(a: int, b: int) -> str:
    return f"degrees(atan((p{b} - p{a}) / p{a} * 100 / greatest(1, i{b} - i{a})))"


def _pct(a: str, b: str) -> str:
    return f"abs({a} - {b}) / least(abs({a}), abs({b})) * 100"


_UP, _LO, _WIDER = _deg(1, 5), _deg(2, 6), "p5 - p6 > (p1 - p2) * 1.05::DOUBLE"
chapter("g3_broadening_wedges", _sql("broadening_wedges", [("broadening_wedges_ascending", f"{_UP} > 0.2 AND {_LO} > 0.2 AND {_WIDER} AND {_UP} > {_LO} + 0.1", None), ("broadening_wedges_descending", f"{_UP} < -0.2 AND {_LO} < -0.2 AND {_WIDER} AND {_LO} < {_UP} - 0.1", None)]))(
    lambda spark, d: derived.broadening_wedges(base_of(spark, d, "broadening_wedges"), bars_of(spark, d))
)
chapter("g21_wedges", _sql("wedges_ascending_descending", [("wedges_falling", f"{_UP} < -0.2 AND {_LO} < -0.2 AND breakout_direction = 'up'", "reversal_bullish"), ("wedges_rising", f"{_UP} > 0.2 AND {_LO} > 0.2 AND breakout_direction = 'down'", "reversal_bearish")]))(
    lambda spark, d: derived.wedges(base_of(spark, d, "wedges_ascending_descending"), bars_of(spark, d))
)
_LEVEL, _RISE, _FALL = f"({_pct('p3', 'p1')} <= 3 AND {_pct('p5', 'p1')} <= 3)", "p4 > p2", "(p3 < p1 AND p5 < p3)"
_ASC, _DESC = f"({_LEVEL} AND {_RISE})", f"({_pct('p4', 'p2')} <= 3 AND {_FALL})"
chapter("g19_triangles", _sql("triangles", [("triangles_ascending", _ASC, None), ("triangles_descending", f"NOT {_ASC} AND {_DESC}", None), ("triangles_symmetrical", f"NOT {_ASC} AND NOT {_DESC} AND {_FALL} AND {_RISE}", None)]))(
    lambda spark, d: derived.triangles(base_of(spark, d, "triangles"), bars_of(spark, d))
)
chapter("g17_scallops", _sql("scallop_ascending_descending", [("scallops_ascending", "p3 > p1 AND breakout_direction = 'up'", None), ("scallops_ascending_inverted", "p3 > p1 AND breakout_direction = 'down'", None), ("scallops_descending", "p3 <= p1 AND breakout_direction = 'down'", None), ("scallops_descending_inverted", "p3 <= p1 AND breakout_direction = 'up'", None)]))(
    lambda spark, d: derived.scallops(base_of(spark, d, "scallop_ascending_descending"), bars_of(spark, d))
)
for _name, _key, _up, _down in (("g11_horns", "horn_bottoms_tops", "horn_bottoms", "horn_tops"), ("g13_measured_moves", "measured_move_down_up", "measured_move_up", "measured_move_down"), ("g15_rectangles", "rectangle_bottoms_tops", "rectangle_bottoms", "rectangle_tops")):
    chapter(_name, _sql(_key, [(_up, "breakout_direction = 'up'", None), (_down, "breakout_direction = 'down'", None)]))(lambda spark, d, key=_key, up=_up, down=_down: derived.by_direction(base_of(spark, d, key), up, down))
for _key in ("broadening_bottoms", "broadening_tops", "pennants"):
    chapter(f"g1_{_key}", _sql(_key, [(_key, "TRUE", None)]))(lambda spark, d, key=_key: derived.derive(base_of(spark, d, key), key))


def _widths(extreme: str, beyond: str) -> str:
    """Width of the extremes i1 and i3 of every detection: the bars around them up to the first beyond the limit, 15 a side."""
    out = ""
    for k in (1, 3):
        out += f""", w{k} AS (SELECT x.pattern_id, coalesce(min(b.idx) FILTER (WHERE b.idx > x.i{k} AND b.{extreme} {beyond}) - 1, max(b.idx)) - coalesce(max(b.idx) FILTER (WHERE b.idx < x.i{k} AND b.{extreme} {beyond}) + 1, min(b.idx)) + 1 AS w
  FROM x JOIN ind b ON b.symbol = x.symbol AND b.idx BETWEEN x.i{k} - 15 AND x.i{k} + 15 GROUP BY x.pattern_id)""".format(k=k).replace("TOP", f"x.p{k}")
    return out


def _variants(name: str) -> list[tuple[str, str, None]]:
    test = {"adam": "<= 3", "eve": ">= 7"}
    return [(f"{name}_{a}_{b}", f"w1.w {test[a]} AND w3.w {test[b]}", None) for a in test for b in test]


_JOIN = "JOIN w1 ON w1.pattern_id = x.pattern_id JOIN w3 ON w3.pattern_id = x.pattern_id"
chapter("g8_double_tops", _sql("double_tops", _variants("double_tops"), _widths("high", "< TOP * 0.98::DOUBLE"), _JOIN))(lambda spark, d: derived.double_variants(base_of(spark, d, "double_tops"), bars_of(spark, d), "double_tops"))
chapter("g7_double_bottoms", _sql("double_bottoms", _variants("double_bottoms"), _widths("low", "> TOP * 1.02::DOUBLE"), _JOIN))(lambda spark, d: derived.double_variants(base_of(spark, d, "double_bottoms"), bars_of(spark, d), "double_bottoms", True))
for _key, _t, _away, _bottom in (("head_and_shoulders_top", "H", "r.price < x.p3 * 0.98::DOUBLE", False), ("head_and_shoulders_bottom", "L", "r.price > x.p3 * 1.02::DOUBLE", True)):
    _exists = f"EXISTS (SELECT 1 FROM raw r WHERE r.symbol = x.symbol AND r.ptype = '{_t}' AND r.idx > x.i1 AND r.idx < x.i5 AND r.idx <> x.i3 AND {_away} AND {_pct('r.price', '((x.p1 + x.p5) / 2)')} <= 10)"
    chapter(f"g10_{_key}s", _sql(_key, [(f"{_key}s_complex", _exists, None), (f"{_key}s", f"NOT {_exists}", None)]))(
        lambda spark, d, key=_key, bottom=_bottom: derived.complex_head_and_shoulders(base_of(spark, d, key), bars_of(spark, d), pivots_of(spark, d), f"{key}s", f"{key}s_complex", bottom=bottom)
    )
_POLE = """, form AS (SELECT x.pattern_id, max(b.high) AS top, min(b.low) AS bottom FROM x JOIN ind b ON b.symbol = x.symbol AND b.idx BETWEEN x.i1 AND x.i4 GROUP BY 1),
pole AS (SELECT x.pattern_id, min(b.low) AS low, arg_min(b.idx, b.low * 1000000 + b.idx) AS spot FROM x JOIN ind b ON b.symbol = x.symbol AND b.idx BETWEEN x.i1 - 60 AND x.i1 GROUP BY 1)"""
_TIGHT = "coalesce(breakout_direction = 'up' AND (top - low) / low * 100 >= 100 AND i1 - spot + 1 <= 60 AND (top - bottom) / top * 100 <= 20, FALSE)"
chapter("g9_flags", _sql("flags", [("flags_high_tight", _TIGHT, None), ("flags", f"NOT {_TIGHT}", None)], _POLE, "JOIN form ON form.pattern_id = x.pattern_id JOIN pole ON pole.pattern_id = x.pattern_id"))(lambda spark, d: derived.flags(base_of(spark, d, "flags"), bars_of(spark, d)))
_WIDE = O.ISLANDS.replace("x.idx < e.idx + 20", "x.idx < e.idx + 40").replace("islands", "islands_base")
_NAME = "CASE WHEN pattern_width_bars > 10 THEN 'islands_long' ELSE 'island_reversals' END"
chapter("g12_islands", f"SELECT symbol || '_' || {_NAME} || '_' || pattern_id AS pattern_id, {_NAME} AS pattern_name, pattern_type FROM ({_WIDE})")(lambda spark, d: derived.long_islands(barlocal.islands(bars_of(spark, d), max_bars=40, key="islands_base")))


@query("e15_mirrored_bars", O.with_(O.CLEAN_BARS, "SELECT symbol, idx, round(a - open, 9) AS open, round(a - low, 9) AS high, round(a - high, 9) AS low, round(a - close, 9) AS close FROM (SELECT *, max(high) OVER (PARTITION BY symbol) + min(low) OVER (PARTITION BY symbol) AS a FROM ind)"))
def _e15(spark, d):
    return derived.mirrored(bars_of(spark, d)).select("symbol", "idx", "open", "high", "low", "close")


@query("e13_peak_widths", O.with_(f"{O.PIVOTED}", """SELECT p.symbol, p.idx, CAST(coalesce(min(b.idx) FILTER (WHERE b.idx > p.idx AND b.high < p.price * 0.98::DOUBLE) - 1, max(b.idx)) - coalesce(max(b.idx) FILTER (WHERE b.idx < p.idx AND b.high < p.price * 0.98::DOUBLE) + 1, min(b.idx)) + 1 AS BIGINT) AS width
  FROM raw p JOIN ind b ON b.symbol = p.symbol AND b.idx BETWEEN p.idx - 15 AND p.idx + 15 WHERE p.ptype = 'H' GROUP BY p.symbol, p.idx"""))
def _e13(spark, d):
    return derived.extreme_widths(pivots_of(spark, d).filter("ptype = 'H'"), bars_of(spark, d))


@query("j19_pattern_limits", O.with_(f"{D.detections()},{_DIM},{_SPEC}", """SELECT d.pattern_name, count(*) AS n, any_value(dim.canonical_key) AS canonical_key, any_value(s.width_min) AS width_min, any_value(s.width_max) AS width_max, round(any_value(s.height_max), 9) AS height_max
  FROM det d LEFT JOIN dim ON dim.pattern_key = d.pattern_name LEFT JOIN spec s ON s.spec_key = d.pattern_name GROUP BY 1"""))
def _j19(spark, d):
    found = detections_of(spark, d).groupBy("pattern_name").agg(F.count("*").alias("n"))
    dim = specs.pattern_dim(spark).select(F.col("pattern_key").alias("pattern_name"), "canonical_key")
    limits = reports.with_limits(found.select("pattern_name", F.col("pattern_name").alias("pattern_key"), F.col("pattern_name").alias("spec_key"), "n"), specs.pattern_spec(spark))
    return limits.join(F.broadcast(dim), "pattern_name", "left").select("pattern_name", "n", "canonical_key", "width_min", "width_max", "height_max")  # a row a pattern


# Patterns of two specs, and counts over all detectors.


def _several(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    chosen = specs.pattern_spec(spark, {k: specs.SPECS[k] for k in keys})
    return sequences.detect_sequences(bars_of(spark, sf_dir), pivots_of(spark, sf_dir), chosen)


for _name, _keys in (
    ("f4_rounding_bottoms_and_tops", ["rounding_bottoms_tops", "rounding_tops"]), ("f5_triple_bottoms_and_tops", ["triple_bottoms", "triple_tops"]),
    ("g4_bump_and_run", ["bump_and_run_reversal", "bump_and_run_reversal_bottoms"]), ("g6_diamonds", ["diamond_bottom", "diamond_top"]),
):
    query(_name, O.sequences(_keys))(lambda spark, d, keys=_keys: _several(spark, d, keys))


@query("f17_scan_counts", O.with_(D.detections(), "SELECT pattern_name, count(*) AS n, count(breakout_date) AS n_confirmed FROM det GROUP BY pattern_name"))
def _f17(spark, d):
    return detections_of(spark, d).groupBy("pattern_name").agg(F.count("*").alias("n"), F.count("breakout_date").alias("n_confirmed"))


_V3 = """, w AS (SELECT s.pattern_id, CASE WHEN w1.w <= 3 THEN 'A' WHEN w1.w >= 7 THEN 'E' END || CASE WHEN w3.w <= 3 THEN 'A' WHEN w3.w >= 7 THEN 'E' END AS variant, s.breakout_date FROM s JOIN w1 USING (pattern_id) JOIN w3 USING (pattern_id))"""


@query("j3_double_tops_by_variant", O.with_(_sql("double_tops", [("k", "TRUE", None)], _widths("high", "< TOP * 0.98::DOUBLE") + _V3).split("WITH RECURSIVE ", 1)[1].rsplit("\nSELECT", 1)[0], "SELECT coalesce(variant, 'unknown') AS variant, count(*) AS n, count(breakout_date) AS n_confirmed FROM w GROUP BY 1"))
def _j3(spark, d):
    marked = derived.adam_eve(base_of(spark, d, "double_tops"), bars_of(spark, d))
    return marked.groupBy(F.coalesce("variant", F.lit("unknown")).alias("variant")).agg(F.count("*").alias("n"), F.count("breakout_date").alias("n_confirmed"))


@query("j11_group_names", O.with_(f"{D.detections()},{_DIM}", """SELECT coalesce(m.canonical_key, d.pattern_name) AS pattern_group, count(*) AS n, min(m.chapter) AS first_chapter, max(m.chapter) AS last_chapter, count(DISTINCT m.name) AS n_names FROM det d LEFT JOIN dim m ON m.canonical_key = d.pattern_name OR m.pattern_key = d.pattern_name GROUP BY 1"""))
def _j11(spark, d):
    dim = specs.pattern_dim(spark)
    by_name = dim.withColumn("pattern_name", F.explode(F.array_distinct(F.array("canonical_key", "pattern_key")))).select("pattern_name", "canonical_key", "chapter", "name")
    counted = detections_of(spark, d).groupBy("pattern_name").agg(F.count("*").alias("n")).join(F.broadcast(by_name), "pattern_name", "left")  # at most two rows a pattern
    chapters = [F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"), F.countDistinct("name").alias("n_names")]
    return counted.groupBy(F.coalesce("canonical_key", "pattern_name").alias("pattern_group")).agg(F.sum("n").alias("n"), *chapters)


@query("a4_spec_aliases", O.with_(f"{O.BARS},{_DIM},{_SPEC}", "SELECT dim.pattern_key, coalesce(o.spec_key, m.spec_key) AS used_spec, (SELECT count(DISTINCT symbol) FROM bars) AS n_symbols FROM dim LEFT JOIN spec o ON o.spec_key = dim.pattern_key LEFT JOIN spec m ON m.spec_key = dim.spec_key"))
def _a4(spark, d):
    known = specs.pattern_spec(spark).select("spec_key")
    own, mapped = known.select(F.col("spec_key").alias("pattern_key"), F.col("spec_key").alias("own")), known.select("spec_key", F.col("spec_key").alias("mapped"))
    out = specs.pattern_dim(spark).join(F.broadcast(own), "pattern_key", "left").join(F.broadcast(mapped), "spec_key", "left")  # a row a spec
    return out.select("pattern_key", F.coalesce("own", "mapped").alias("used_spec"), bars_of(spark, d).agg(F.countDistinct("symbol").alias("n")).scalar().alias("n_symbols"))
