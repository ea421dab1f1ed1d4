"""Pattern specs and metadata as tables.

Numbers of specs without a published default are this package's own, from common definitions of the shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The fields of a spec that are used, nested as in a spec file.
SPEC_SCHEMA = (
    "pattern_type string, "
    "detection_signature struct<pivot_sequence: array<string>, pivot_order: string, mandatory_pivots: array<struct<position: int, constraint: string, variant: string>>>, "
    "geometry_constraints struct<width_min_bars: int, width_max_bars: int, height_ratio_min: double, height_ratio_max: double, near_equal_tolerance_pct: double, "
    "depth_ratio_tolerance_pct: double, breakout_search_bars: int>, "
    "prior_trend_requirements struct<direction: string, min_period_bars: int, min_change_pct: double>, "
    "breakout_confirmation struct<breakout_direction: string, breakout_threshold_pct: double, volume_required: boolean, volume_multiplier_min: double>, "
    "post_breakout_measurement struct<lookahead_bars: int>"
)


def spec(kind: str, sequence: str, rules: dict[int, str] | None = None, width=(21, 210), height=(6.0, 80.0), tolerance=3.0, trend=("any", 0, 0.0), breakout=("both", 1.0), search=40, order="alternating", lookahead=None) -> dict:
    return {
        "pattern_type": kind,
        "detection_signature": {"pivot_sequence": list(sequence), "pivot_order": order, "mandatory_pivots": [{"position": k, "constraint": r, "variant": None} for k, rs in (rules or {}).items() for r in rs.split("&")]},
        "geometry_constraints": {"width_min_bars": width[0], "width_max_bars": width[1], "height_ratio_min": height[0], "height_ratio_max": height[1], "near_equal_tolerance_pct": tolerance, "depth_ratio_tolerance_pct": 15.0, "breakout_search_bars": search},
        "prior_trend_requirements": {"direction": trend[0], "min_period_bars": trend[1], "min_change_pct": trend[2]},
        "breakout_confirmation": {"breakout_direction": breakout[0], "breakout_threshold_pct": breakout[1], "volume_required": False, "volume_multiplier_min": 1.3},
        "post_breakout_measurement": {"lookahead_bars": lookahead},
    }


_ANY, _UP, _DOWN = ("any", 21, 10.0), ("up", 21, 10.0), ("down", 21, 10.0)
_LOWER, _HIGHER, _EQUAL = "lower_than_previous", "higher_than_previous", "near_equal"

#: Specs of pivot sequences. The first five are the fixed values that the chapter set embeds.
SPECS: dict[str, dict] = {
    "broadening_formations_right_angled_ascending": spec("continuation_both", "LHLHLH", {3: _EQUAL, 5: _EQUAL, 4: _HIGHER, 6: _HIGHER}, tolerance=2.0, trend=_ANY, search=60),
    "broadening_formations_right_angled_descending": spec("continuation_both", "HLHLHL", {3: _EQUAL, 5: _EQUAL, 4: _LOWER, 6: _LOWER}, tolerance=2.0, trend=_ANY, search=60),
    "broadening_wedges": spec("continuation_both", "HLHLHL", width=(21, 180), tolerance=2.0, trend=_ANY, search=60),
    "three_falling_peaks": spec("reversal_bearish", "HLHLH", {3: _LOWER, 5: _LOWER}, (42, 270), trend=_UP, breakout=("down", 1.0)),
    "three_rising_valleys": spec("reversal_bullish", "LHLHL", {3: _HIGHER, 5: _HIGHER}, (42, 270), trend=_DOWN, breakout=("up", 1.0)),
    "broadening_bottoms": spec("continuation_both", "LHLHL", {3: _LOWER, 5: _LOWER, 4: _HIGHER}, trend=_DOWN),
    "broadening_tops": spec("continuation_both", "HLHLH", {3: _HIGHER, 5: _HIGHER, 4: _LOWER}, trend=_UP),
    "bump_and_run_reversal": spec("reversal_bearish", "LHLHL", {4: "must_be_highest", 3: _HIGHER}, (30, 260), breakout=("down", 1.0)),
    "diamond_bottom": spec("continuation_both", "HLHLHL", {3: _HIGHER, 4: "must_be_lowest", 5: _LOWER, 6: _HIGHER}, trend=_DOWN),
    "diamond_top": spec("continuation_both", "LHLHLH", {3: _LOWER, 4: "must_be_highest", 5: _HIGHER, 6: _LOWER}, trend=_UP),
    "double_bottoms": spec("reversal_bullish", "LHL", {3: _EQUAL}, (21, 180), (5.0, 80.0), trend=_DOWN, breakout=("up", 1.0)),
    "double_tops": spec("reversal_bearish", "HLH", {3: _EQUAL}, (21, 180), (5.0, 80.0), trend=_UP, breakout=("down", 1.0)),
    "flags": spec("continuation_both", "HLHL", {3: _LOWER, 4: _LOWER}, (5, 30), (2.0, 30.0), trend=("any", 10, 10.0), breakout=("depends_on_prior_trend", 1.0)),
    "head_and_shoulders_bottom": spec("reversal_bullish", "LHLHL", {3: "must_be_lowest", 5: "near_equal_to_position_1", 4: _EQUAL}, (42, 270), tolerance=10.0, trend=_DOWN, breakout=("up", 1.0)),
    "head_and_shoulders_top": spec("reversal_bearish", "HLHLH", {3: "must_be_highest", 5: "near_equal_to_position_1", 4: _EQUAL}, (42, 270), tolerance=10.0, trend=_UP, breakout=("down", 1.0)),
    "horn_bottoms_tops": spec("continuation_both", "LHL", {3: _EQUAL}, (3, 30), (2.0, 60.0), tolerance=2.0),
    "measured_move_down_up": spec("continuation_both", "HLHL", {3: "must_be_between"}, (21, 210)),
    "pennants": spec("continuation_both", "HLHL", {3: _LOWER, 4: _HIGHER}, (5, 30), (2.0, 30.0), trend=("any", 10, 10.0), breakout=("depends_on_prior_trend", 1.0)),
    "rectangle_bottoms_tops": spec("continuation_both", "HLHLH", {3: _EQUAL, 5: _EQUAL, 4: _EQUAL}, tolerance=3.0),
    "rounding_bottoms_tops": spec("reversal_bullish", "HLHLH", {2: "not_highest", 5: "not_lowest"}, (42, 400), trend=("down", 21, 5.0), breakout=("up", 1.0)),
    "rounding_tops": spec("reversal_bearish", "LHLHL", {2: "not_lowest", 5: "not_highest"}, (42, 400), trend=("up", 21, 5.0), breakout=("down", 1.0)),
    "bump_and_run_reversal_bottoms": spec("reversal_bullish", "HLHLH", {4: "must_be_lowest", 3: _LOWER}, (30, 260), breakout=("up", 1.0)),
    "scallop_ascending_descending": spec("continuation_both", "LHLH", {3: "must_be_between"}, (21, 210)),
    "triangles": spec("continuation_both", "HLHLH", {}, (21, 210), (4.0, 80.0)),
    "triple_bottoms": spec("reversal_bullish", "LHLHL", {3: _EQUAL, 5: _EQUAL}, (30, 270), trend=_DOWN, breakout=("up", 1.0)),
    "triple_tops": spec("reversal_bearish", "HLHLH", {3: _EQUAL, 5: _EQUAL}, (30, 270), trend=_UP, breakout=("down", 1.0)),
    "wedges_ascending_descending": spec("continuation_both", "HLHLHL", {}, (21, 210), (4.0, 80.0)),
}

#: Bars between pivots where they aren't 10, by spec.
SPACING = {"flags": 2, "pennants": 2, "horn_bottoms_tops": 2, "diamond_bottom": 3, "diamond_top": 3, "rounding_bottoms_tops": 4, "rounding_tops": 4}

# Key, part, chapter, name, spec and variant of the chapter patterns (part 1) and the event patterns (part 2).
PATTERNS = [
    ("broadening_bottoms", 1, 1, "Broadening Bottoms", "broadening_bottoms", None),
    ("broadening_formations_right_angled_ascending", 1, 2, "Broadening Formations, Right-Angled and Ascending", "broadening_formations_right_angled_ascending", None),
    ("broadening_formations_right_angled_descending", 1, 3, "Broadening Formations, Right-Angled and Descending", "broadening_formations_right_angled_descending", None),
    ("broadening_tops", 1, 4, "Broadening Tops", "broadening_tops", None),
    ("broadening_wedges_ascending", 1, 5, "Broadening Wedges, Ascending", "broadening_wedges", "ascending"),
    ("broadening_wedges_descending", 1, 6, "Broadening Wedges, Descending", "broadening_wedges", "descending"),
    ("bump_and_run_reversal_bottoms", 1, 7, "Bump-and-Run Reversal Bottoms", "bump_and_run_reversal", None),
    ("bump_and_run_reversal_tops", 1, 8, "Bump-and-Run Reversal Tops", "bump_and_run_reversal", None),
    ("cup_with_handle", 1, 9, "Cup with Handle", "cup_with_handle", None),
    ("cup_with_handle_inverted", 1, 10, "Cup with Handle (Inverted)", "cup_with_handle", None),
    ("diamond_bottoms", 1, 11, "Diamond Bottoms", "diamond_bottom", None),
    ("diamond_tops", 1, 12, "Diamond Tops", "diamond_top", None),
    ("double_bottoms_adam_adam", 1, 13, "Double Bottoms, Adam & Adam", "double_bottoms", "AA"),
    ("double_bottoms_adam_eve", 1, 14, "Double Bottoms, Adam & Eve", "double_bottoms", "AE"),
    ("double_bottoms_eve_adam", 1, 15, "Double Bottoms, Eve & Adam", "double_bottoms", "EA"),
    ("double_bottoms_eve_eve", 1, 16, "Double Bottoms, Eve & Eve", "double_bottoms", "EE"),
    ("double_tops_adam_adam", 1, 17, "Double Tops, Adam & Adam", "double_tops", "AA"),
    ("double_tops_adam_eve", 1, 18, "Double Tops, Adam & Eve", "double_tops", "AE"),
    ("double_tops_eve_adam", 1, 19, "Double Tops, Eve & Adam", "double_tops", "EA"),
    ("double_tops_eve_eve", 1, 20, "Double Tops, Eve & Eve", "double_tops", "EE"),
    ("flags", 1, 21, "Flags", "flags", None),
    ("flags_high_tight", 1, 22, "Flags, High and Tight", "flags", None),
    ("gaps", 1, 23, "Gaps", "gaps", None),
    ("head_and_shoulders_bottoms", 1, 24, "Head-and-Shoulders Bottoms", "head_and_shoulders_bottom", None),
    ("head_and_shoulders_bottoms_complex", 1, 25, "Head-and-Shoulders Bottoms (Complex)", "head_and_shoulders_bottom", None),
    ("head_and_shoulders_tops", 1, 26, "Head-and-Shoulders Tops", "head_and_shoulders_top", None),
    ("head_and_shoulders_tops_complex", 1, 27, "Head-and-Shoulders Tops (Complex)", "head_and_shoulders_top", None),
    ("horn_bottoms", 1, 28, "Horn Bottoms", "horn_bottoms_tops", None),
    ("horn_tops", 1, 29, "Horn Tops", "horn_bottoms_tops", None),
    ("island_reversals", 1, 30, "Island Reversals", "islands", None),
    ("islands_long", 1, 31, "Islands, Long", "islands", None),
    ("measured_move_down", 1, 32, "Measured Move Down", "measured_move_down_up", None),
    ("measured_move_up", 1, 33, "Measured Move Up", "measured_move_down_up", None),
    ("pennants", 1, 34, "Pennants", "pennants", None),
    ("pipe_bottoms", 1, 35, "Pipe Bottoms", "pipe_bottoms", None),
    ("pipe_tops", 1, 36, "Pipe Tops", "pipe_bottoms", None),
    ("rectangle_bottoms", 1, 37, "Rectangle Bottoms", "rectangle_bottoms_tops", None),
    ("rectangle_tops", 1, 38, "Rectangle Tops", "rectangle_bottoms_tops", None),
    ("rounding_bottoms", 1, 39, "Rounding Bottoms", "rounding_bottoms_tops", None),
    ("rounding_tops", 1, 40, "Rounding Tops", "rounding_bottoms_tops", None),
    ("scallops_ascending", 1, 41, "Scallops, Ascending", "scallop_ascending_descending", None),
    ("scallops_ascending_inverted", 1, 42, "Scallops, Ascending (Inverted)", "scallop_ascending_descending", None),
    ("scallops_descending", 1, 43, "Scallops, Descending", "scallop_ascending_descending", None),
    ("scallops_descending_inverted", 1, 44, "Scallops, Descending (Inverted)", "scallop_ascending_descending", None),
    ("three_falling_peaks", 1, 45, "Three Falling Peaks", "three_falling_peaks", None),
    ("three_rising_valleys", 1, 46, "Three Rising Valleys", "three_rising_valleys", None),
    ("triangles_ascending", 1, 47, "Triangles, Ascending", "triangles", None),
    ("triangles_descending", 1, 48, "Triangles, Descending", "triangles", None),
    ("triangles_symmetrical", 1, 49, "Triangles, Symmetrical", "triangles", None),
    ("triple_bottoms", 1, 50, "Triple Bottoms", "triple_bottoms_tops", None),
    ("triple_tops", 1, 51, "Triple Tops", "triple_bottoms_tops", None),
    ("wedges_falling", 1, 52, "Wedges, Falling", "wedges_ascending_descending", None),
    ("wedges_rising", 1, 53, "Wedges, Rising", "wedges_ascending_descending", None),
    ("dead_cat_bounce", 2, 54, "Dead-Cat Bounce", None, None),
    ("dead_cat_bounce_inverted", 2, 55, "Dead-Cat Bounce (Inverted)", None, None),
]
EVENTS = [key for key, part, *_ in PATTERNS if part == 2]


def metadata_rows() -> list[tuple]:
    """pattern_key, part, chapter, name, spec_key, canonical_key, variant, kind and proxy of the 55 patterns; a pattern without a spec is a proxy."""
    return [
        (key, part, chapter, name, spec_key, spec_key or key, variant, "chart" if part == 1 else "event", spec_key is None)
        for key, part, chapter, name, spec_key, variant in PATTERNS
    ]


METADATA_SCHEMA = "pattern_key string, part int, chapter int, name string, spec_key string, canonical_key string, variant string, kind string, proxy boolean"


def pattern_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(metadata_rows(), METADATA_SCHEMA)


def pattern_spec(spark: SparkSession, specs: dict[str, dict] | None = None) -> DataFrame:
    """One row for each spec, nested as in a spec file, with its pivot spacing."""
    rows = [{"spec_key": k, "spacing": SPACING.get(k, 10), **v} for k, v in (SPECS if specs is None else specs).items()]
    return spark.createDataFrame(rows, f"spec_key string, spacing int, {SPEC_SCHEMA}")


#: Patterns of the sets; the strict set is the chapter set of patterns with a spec.
PATTERN_SETS = {
    "chapters_53": lambda r: r[7] == "chart",
    "strict_53": lambda r: r[7] == "chart" and r[4] is not None,
    "event": lambda r: r[7] == "event",
    "all_55": lambda r: True,
    "strict_55": lambda r: r[7] == "event" or r[4] is not None,
}


def pattern_sets(spark: SparkSession) -> DataFrame:
    """pattern_set and pattern_key of every pattern of every set."""
    rows = [(s, r[0]) for s, test in PATTERN_SETS.items() for r in metadata_rows() if test(r)]
    only = ["inside_day", "rising_falling_three_methods", "spike_formation"]
    rows += [("digitized", k) for k in sorted({r[4] for r in metadata_rows() if r[4]} | set(only))]
    return spark.createDataFrame(rows, "pattern_set string, pattern_key string")
