"""Chart patterns as sequences of pivots: windows, constraints, boundary lines, breakouts, and the detectors made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swingkit.operators.pivots import numbered, thin, thin_all
from swingkit.sources.sinks import stored

#: Bars of one cell of the breakout search; a search of n bars covers n // CELL + 2 cells at most and meets all bars of these.
CELL = 32
#: The same where few bars are searched.
SHORT_CELL = 8

DETECTION = [
    "pattern_id", "symbol", "pattern_name", "pattern_type", "formation_start", "formation_end", "breakout_date", "breakout_idx", "breakout_direction", "breakout_price",
    "target_price", "stop_loss_price", "confidence_score", "volume_confirmed", "pattern_height_pct", "pattern_width_bars", "touch_count", "pivot_indices",
]

#: Whether the pivot ``c`` at ``m.position`` of the window ``win`` meets the rule ``m.constraint``; other rules hold.
_RULES = """
forall(mandatory, m -> m.position is null or m.position < 1 or m.position > size(win) or coalesce(case
  when m.constraint = 'near_equal' then pct_diff(CUR.price, coalesce(SAME.price, get(win, 0).price)) <= tolerance
  when m.constraint like 'near_equal_to_position_%' then pct_diff(CUR.price, try_element_at(win, try_cast(substring_index(m.constraint, '_', -1) as int)).price) <= tolerance
  when m.constraint in ('lower_than_previous', 'lower_than_previous_low', 'lower_than_previous_L') then CUR.price < SAME.price
  when m.constraint in ('higher_than_previous', 'higher_than_previous_high', 'higher_than_previous_H') then CUR.price > SAME.price
  when m.constraint = 'lower_than_previous_high' then CUR.price < try_element_at(filter(slice(win, 1, m.position - 1), p -> p.ptype = 'H'), -1).price
  when m.constraint = 'higher_than_previous_low' then CUR.price > try_element_at(filter(slice(win, 1, m.position - 1), p -> p.ptype = 'L'), -1).price
  when m.constraint = 'must_be_lowest' then CUR.price <= lower
  when m.constraint = 'must_be_highest' then CUR.price >= upper
  when m.constraint = 'not_lowest' then CUR.price > lower
  when m.constraint = 'not_highest' then CUR.price < upper
  when m.constraint = 'must_be_between' and m.position > 1 and m.position < size(win) then
    if(CUR.ptype = 'L', CUR.price < least(get(win, m.position - 2).price, get(win, m.position).price), CUR.price > greatest(get(win, m.position - 2).price, get(win, m.position).price))
  when m.constraint = 'in_upper_third' and size(win) >= 4 then CUR.price >= get(win, 1).price + (get(win, 2).price - get(win, 1).price) * (2D / 3D)
  when m.constraint = 'near_cup_lip' and size(win) >= 3 then pct_diff(CUR.price, get(win, 2).price) <= tolerance
  when m.constraint = 'shallow_decline' and size(win) >= 6 then (get(win, 4).price - CUR.price) / nullif(get(win, 4).price, 0D) * 100 <= depth_tolerance
  end, true))
"""


def rules_hold() -> Column:
    """All mandatory constraints of a window; needs win, mandatory, tolerance, depth_tolerance, upper and lower."""
    text = _RULES.replace("SAME", "try_element_at(filter(slice(win, 1, m.position - 1), p -> p.ptype = CUR.ptype), -1)").replace("CUR", "get(win, m.position - 1)")
    while (at := text.find("pct_diff(")) >= 0:  # pct_diff(a, b) is |a - b| as a percentage of the smaller of |a| and |b|
        depth, cuts, k = 0, [], at + len("pct_diff")
        while True:
            if text[k] == "(":
                depth += 1
                if depth == 1:
                    start = k + 1
            elif text[k] == ")":
                depth -= 1
                if not depth:
                    break
            elif text[k] == "," and depth == 1:
                cuts.append(k)
            k += 1
        a, b = text[start : cuts[0]], text[cuts[0] + 1 : k]
        text = f"{text[:at]}coalesce(abs({a} - {b}) / nullif(least(abs({a}), abs({b})), 0D) * 100, double('infinity')){text[k + 1:]}"
    return F.expr(text)


def flat_specs(specs: DataFrame) -> DataFrame:
    """The specs' fields side by side, with the defaults of missing ones."""
    g, t, b = "geometry_constraints", "prior_trend_requirements", "breakout_confirmation"
    or_else = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0.0)) if isinstance(d, float) else F.col(c), F.lit(d))
    return specs.select(
        "spec_key", "spacing", F.coalesce("pattern_type", F.lit("unknown")).alias("pattern_type"),
        F.array_join(F.filter("detection_signature.pivot_sequence", lambda x: x.isin("H", "L")), "").alias("types"),
        F.coalesce(F.col("detection_signature.pivot_order"), F.lit("alternating")).isin("alternating", "sequential_trend_following", "alternating_required").alias("thinned"),
        F.coalesce(F.col("detection_signature.mandatory_pivots"), F.array()).alias("mandatory"),
        F.col(f"{g}.width_min_bars").alias("width_min"), F.col(f"{g}.width_max_bars").alias("width_max"), F.col(f"{g}.height_ratio_min").alias("height_min"), F.col(f"{g}.height_ratio_max").alias("height_max"),
        or_else(f"{g}.near_equal_tolerance_pct", 3.0).alias("tolerance"), or_else(f"{g}.depth_ratio_tolerance_pct", 15.0).alias("depth_tolerance"), F.coalesce(F.nullif(F.col(f"{g}.breakout_search_bars"), F.lit(0)), F.lit(40)).alias("search"),
        F.lower(or_else(f"{t}.direction", "any")).alias("trend"), or_else(f"{t}.min_period_bars", 0).alias("trend_bars"), F.coalesce(F.col(f"{t}.min_change_pct"), F.lit(0.0)).alias("trend_pct"),
        F.lower(or_else(f"{b}.breakout_direction", "")).alias("breaks"), (or_else(f"{b}.breakout_threshold_pct", 1.0) / 100).alias("threshold"),
        or_else(f"{b}.volume_required", False).alias("volume_required"), or_else(f"{b}.volume_multiplier_min", 1.3).alias("volume_min"),
    )


def windows(pivots: DataFrame, n: int) -> DataFrame:
    """symbol, k and ``win``: every n following pivots, with their types as one string."""
    w = Window.partitionBy("symbol").orderBy("k").rowsBetween(0, n - 1)
    found = pivots.select("symbol", "k", F.collect_list(F.struct("idx", "date", "price", "ptype")).over(w).alias("win")).filter(F.size("win") == n)
    return found.withColumn("types", F.array_join(F.transform("win", lambda p: p["ptype"]), ""))


def prior_trend(matches: DataFrame, bars: DataFrame) -> DataFrame:
    """Matches whose closes before ``start_idx`` move as asked, with ``prior_dir`` (null where no trend is asked)."""
    on = (F.col("trend_bars") > 0) & (F.col("trend_pct") > 0)
    closes = bars.select("symbol", "idx", "close")
    first, last = closes.toDF("symbol", "from_idx", "c0"), closes.toDF("symbol", "start_idx", "c1")
    out = matches.withColumn("from_idx", F.col("start_idx") - F.col("trend_bars")).join(first, ["symbol", "from_idx"], "left").join(last, ["symbol", "start_idx"], "left")
    out = out.withColumn("change", F.when(F.col("c0") > 0, (F.col("c1") - F.col("c0")) / F.col("c0") * 100))
    held = F.when(F.col("trend") == "up", F.col("change") >= F.col("trend_pct")).when(F.col("trend") == "down", F.col("change") <= -F.col("trend_pct")).otherwise(F.abs("change") >= F.col("trend_pct"))
    way = F.when(F.col("trend").isin("up", "down"), F.col("trend")).otherwise(F.when(F.col("change") >= 0, "up").otherwise("down"))
    return out.filter(~on | F.coalesce(held, F.lit(False))).withColumn("prior_dir", F.when(on, way)).drop("from_idx", "c0", "c1", "change")


def directions() -> Column:
    """Breakout directions in the order in which they are tried."""
    one = lambda d: F.array(F.lit(d))
    both = F.array(F.lit("up"), F.lit("down"))
    follows = F.col("breaks").isin("same_as_flagpole", "depends_on_prior_trend") & F.col("prior_dir").isNotNull()
    kind = F.lower("pattern_type")
    return F.when(kind == "reversal_bearish", one("down")).when(kind == "reversal_bullish", one("up")).when(F.col("breaks").isin("up", "down"), F.array("breaks")).when(follows, F.array("prior_dir")).otherwise(both)


def line_at(line: str, idx: Column) -> Column:
    return F.col(f"{line}.price0") + F.col(f"{line}.slope") * (idx - F.col(f"{line}.idx0"))


def boundary(ptype: str) -> Column:
    """The line through the first and the last pivot of a type of ``win``, flat through a single one."""
    own = F.filter("win", lambda p: p["ptype"] == ptype)
    first, last = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(-1))
    slope = F.when(F.size(own) >= 2, (last["price"] - first["price"]) / F.greatest(F.lit(1), last["idx"] - first["idx"])).otherwise(0.0)
    return F.struct(first["idx"].alias("idx0"), first["price"].alias("price0"), slope.alias("slope"))


def near_bars(matches: DataFrame, bars: DataFrame, key: str, first: Column, last: Column, cell: int = CELL) -> DataFrame:
    """Every match with the bars of its symbol whose idx is from ``first`` to ``last``; joined by cells of ``cell`` bars, best about half as many as are searched."""
    m = matches.withColumns({"_first": first, "_last": last}).filter("_last >= _first")
    m = m.withColumn("_cell", F.explode(F.expr(f"sequence(_first div {cell}, _last div {cell})")))
    b = bars.withColumn("_cell", F.expr(f"cast(idx as bigint) div {cell}"))
    return m.join(b, ["symbol", "_cell"]).filter("idx between _first and _last").drop("_first", "_last", "_cell")


def find_breakout(matches: DataFrame, bars: DataFrame) -> DataFrame:
    """Matches plus ``hit``: the first bar within ``search`` bars after ``end_idx`` whose close is beyond an allowed line.

    hit is (idx, rank, direction, price, volume_ok, date), or null. Up wins over down on one bar. Matches are stored, as both
    the search and its result need them.
    """
    matches = stored(matches)
    lean = matches.select("match_id", "symbol", "end_idx", "search", "upper_line", "lower_line", "ways", "threshold", "volume_required", "volume_min")
    joined = near_bars(lean, bars.select("symbol", "idx", "date", "close", "volume_ratio"), "match_id", F.col("end_idx") + 1, F.col("end_idx") + F.col("search"))
    volume_ok = F.coalesce(F.col("volume_ratio") >= F.col("volume_min"), F.lit(False))
    up = F.array_contains("ways", "up") & (F.col("close") > line_at("upper_line", F.col("idx")) * (1 + F.col("threshold")))
    down = F.array_contains("ways", "down") & (F.col("close") < line_at("lower_line", F.col("idx")) * (1 - F.col("threshold")))
    hits = joined.filter((F.col("close") > 0) & (up | down) & (volume_ok | ~F.col("volume_required"))).groupBy("symbol", "match_id").agg(
        F.min(F.struct("idx", F.when(up, 0).otherwise(1).alias("rank"), F.when(up, "up").otherwise("down").alias("direction"), F.col("close").alias("price"), volume_ok.alias("volume_ok"), "date")).alias("hit")
    )
    return matches.join(hits, ["symbol", "match_id"], "left")


def detect_sequences(bars: DataFrame, raw: DataFrame, specs: DataFrame, thinned: DataFrame | None = None) -> DataFrame:
    """Detections of all pivot-sequence specs (see :func:`swingkit.sources.specs.pattern_spec`) over all symbols.

    ``bars`` has the indicators, ``raw`` the pivots, ``thinned`` their :func:`thin_all` for the specs' spacings at least, if it is
    there already. A match without a breakout is kept, with nulls.
    """
    flat = flat_specs(specs)
    flat = flat.withColumn("spacing", F.when(F.col("thinned"), F.col("spacing")).otherwise(0)).filter("types <> ''")
    shapes = flat.groupBy("spacing").agg(F.max(F.length("types")).alias("n")).collect()  # a row a spacing
    spaced = [r.spacing for r in shapes if r.spacing]
    table = None
    if spaced:
        table = thin_all(raw, spaced) if thinned is None else thinned.filter(F.col("spacing").isin(spaced))
    if len(spaced) < len(shapes) or not shapes:
        whole = numbered(raw).withColumn("spacing", F.lit(0))
        table = table.unionByName(whole) if spaced else whole
    # One window as long as the longest sequence; a spec takes its first pivots.
    ahead = Window.partitionBy("symbol", "spacing").orderBy("k").rowsBetween(0, max((r.n for r in shapes), default=1) - 1)
    long = table.select("symbol", "spacing", "k", F.collect_list(F.struct("idx", "date", "price", "ptype")).over(ahead).alias("win"))
    long = long.withColumn("all_types", F.array_join(F.transform("win", lambda p: p["ptype"]), ""))
    found = long.join(F.broadcast(flat), "spacing").filter(F.startswith("all_types", "types")).withColumn("win", F.slice("win", 1, F.length("types"))).drop("all_types")  # a row a spec
    prices = lambda t: F.transform(F.filter("win", lambda p: p["ptype"] == t), lambda p: p["price"])
    found = found.withColumns({"upper": F.array_max(prices("H")), "lower": F.array_min(prices("L")), "start_idx": F.get("win", F.lit(0))["idx"], "end_idx": F.try_element_at("win", F.lit(-1))["idx"]})
    found = found.withColumns({"width": F.col("end_idx") - F.col("start_idx") + 1, "height": (F.col("upper") - F.col("lower")) / ((F.col("upper") + F.col("lower")) / 2) * 100})
    bound = lambda c, lo, hi: F.coalesce(F.col(c) >= F.col(lo), F.lit(True)) & F.coalesce(F.col(c) <= F.col(hi), F.lit(True))
    # Rows of their own, so that the rules see the window's numbers and don't work them out again for every use.
    made = ["win", "upper", "lower", "start_idx", "end_idx", "width", "height"]
    found = found.select(*[c for c in found.columns if c not in made], F.inline(F.array(F.struct(*made))))
    found = found.filter(bound("width", "width_min", "width_max") & bound("height", "height_min", "height_max")).filter(rules_hold())
    found = prior_trend(found, bars).withColumns({"upper_line": boundary("H"), "lower_line": boundary("L"), "ways": directions(), "match_id": F.concat_ws("_", "symbol", "spec_key", "k", "start_idx", "end_idx")})
    found = found.withColumn("span", line_at("upper_line", F.col("start_idx")) - line_at("lower_line", F.col("start_idx"))).filter("span > 0")
    found = find_breakout(found, bars)
    up = F.col("hit.direction") == "up"
    at = F.col("hit.idx")
    return found.select(
        F.concat_ws("_", "symbol", "spec_key", "start_idx", "end_idx").alias("pattern_id"), "symbol", F.col("spec_key").alias("pattern_name"), "pattern_type",
        F.get("win", F.lit(0))["date"].alias("formation_start"), F.try_element_at("win", F.lit(-1))["date"].alias("formation_end"), F.col("hit.date").alias("breakout_date"), at.alias("breakout_idx"),
        F.col("hit.direction").alias("breakout_direction"), F.col("hit.price").alias("breakout_price"),
        F.when(up, F.col("hit.price") + F.col("span")).otherwise(F.col("hit.price") - F.col("span")).alias("target_price"),
        F.when(up, line_at("lower_line", at)).otherwise(line_at("upper_line", at)).alias("stop_loss_price"),
        (F.lit(70) + F.when(F.col("hit.volume_ok"), 10).otherwise(0) + F.when(at.isNotNull(), 10).otherwise(0)).alias("confidence_score"),
        F.coalesce("hit.volume_ok", F.lit(False)).alias("volume_confirmed"), F.round("height", 2).alias("pattern_height_pct"), F.col("width").alias("pattern_width_bars"),
        F.size("win").alias("touch_count"), F.transform("win", lambda p: p["idx"]).alias("pivot_indices"),
    )


def _built_in(bars: DataFrame, thinned: DataFrame, n: int, name: str, keep: Column, level: Column, top: Column, stop: Column, score: Column, height: Column, breakout_score: int) -> DataFrame:
    """The two built-in reversal tops: a window of alternating pivots from a high, a breakdown below ``level`` in 19 bars."""
    types = "HLHLH"[:n]
    at = bars.select("symbol", "idx", F.col("volume").alias("v"))
    found = windows(thinned, n).filter(F.col("types") == types)
    found = found.withColumns({f"p{i}": F.get("win", F.lit(i))["price"] for i in range(n)} | {f"i{i}": F.get("win", F.lit(i))["idx"] for i in range(n)})
    found = found.withColumns({"start_idx": F.col("i0"), "end_idx": F.col(f"i{n - 1}"), "width": F.col(f"i{n - 1}") - F.col("i0") + 1, "trend": F.lit("up"), "trend_bars": F.lit(42), "trend_pct": F.lit(15.0)}).filter(keep)
    found = prior_trend(found, bars)
    for i in range(0, n, 2):
        found = found.join(at.toDF("symbol", f"i{i}", f"v{i}"), ["symbol", f"i{i}"], "left")
    flat = F.struct(F.lit(0).alias("idx0"), level.alias("price0"), F.lit(0.0).alias("slope"))
    found = found.withColumns(
        {"match_id": F.concat_ws("_", "symbol", "k"), "search": F.lit(19), "upper_line": flat, "lower_line": flat, "ways": F.array(F.lit("down")), "threshold": F.lit(0.01), "volume_required": F.lit(False), "volume_min": F.lit(1.3)}
    )
    found = find_breakout(found, bars)
    price = F.col("hit.price")
    return found.select(
        F.concat_ws("_", "symbol", F.lit(name), "start_idx", "end_idx").alias("pattern_id"), "symbol", F.lit(name).alias("pattern_name"), F.lit("reversal_bearish").alias("pattern_type"),
        F.get("win", F.lit(0))["date"].alias("formation_start"), F.try_element_at("win", F.lit(-1))["date"].alias("formation_end"), F.col("hit.date").alias("breakout_date"), F.col("hit.idx").alias("breakout_idx"), F.col("hit.direction").alias("breakout_direction"),
        price.alias("breakout_price"), (price - (top - level)).alias("target_price"), F.when(price.isNotNull(), stop).alias("stop_loss_price"),
        F.least(F.lit(100), score + F.when(price.isNotNull(), breakout_score).otherwise(0)).alias("confidence_score"), F.coalesce("hit.volume_ok", F.lit(False)).alias("volume_confirmed"),
        F.round(height, 2).alias("pattern_height_pct"), F.col("width").alias("pattern_width_bars"), F.lit(n).alias("touch_count"), F.transform("win", lambda p: p["idx"]).alias("pivot_indices"),
    )


def _gap(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) / F.least(a, b) * 100


def _steps(value: Column, *steps: tuple[float, int]) -> Column:
    out = F.when(value <= steps[0][0], steps[0][1])
    for limit, points in steps[1:]:
        out = out.when(value <= limit, points)
    return out.otherwise(0)


def detect_double_tops(bars: DataFrame, raw: DataFrame, min_confidence: int = 60, thinned: DataFrame | None = None) -> DataFrame:
    """Two highs within 3 %, a low at least 5 % below, 21 to 180 bars, after a rise of 15 % in 42 bars."""
    top = (F.col("p0") + F.col("p2")) / 2
    height = (top - F.col("p1")) / top * 100
    keep = (_gap("p0", "p2") <= 3.0) & (F.col("p1") < F.col("p0")) & (F.col("p1") < F.col("p2")) & F.col("width").between(21, 180) & (height >= 5)
    volume = F.when((F.col("v0") != 0) & (F.col("v2") != 0), F.when(F.col("v2") < F.col("v0"), 15).otherwise(5)).otherwise(0)
    score = F.lit(50) + _steps(_gap("p0", "p2"), (1, 15), (2, 10), (3, 5)) + volume
    return _built_in(bars, thin(raw, 10) if thinned is None else thinned, 3, "double_tops", keep, F.col("p1"), top, top * 1.03, score, height, 20).filter(F.col("confidence_score") >= min_confidence)


def detect_head_and_shoulders(bars: DataFrame, raw: DataFrame, min_confidence: int = 60, thinned: DataFrame | None = None) -> DataFrame:
    """A highest head between shoulders within 10 % over a neckline within 5 %, 42 to 270 bars, after a rise of 15 % in 42 bars."""
    neck = (F.col("p1") + F.col("p3")) / 2
    keep = (F.col("p2") > F.col("p0")) & (F.col("p2") > F.col("p4")) & (_gap("p0", "p4") <= 10.0) & F.col("width").between(42, 270) & (_gap("p1", "p3") <= 5.0)
    known = (F.col("v0") != 0) & (F.col("v4") != 0)
    volume = F.when(known & (F.col("v2") != 0) & (F.col("v0") > F.col("v2")) & (F.col("v2") > F.col("v4")), 10).when(known & (F.col("v4") < F.col("v0")), 5).otherwise(0)
    score = F.lit(50) + _steps(_gap("p0", "p4"), (3, 15), (5, 10), (10, 5)) + _steps(_gap("p1", "p3"), (2, 10), (5, 5)) + volume
    return _built_in(bars, thin(raw, 10) if thinned is None else thinned, 5, "head_and_shoulders_top", keep, neck, F.col("p2"), F.col("p2") * 1.02, score, (F.col("p2") - neck) / F.col("p2") * 100, 15).filter(F.col("confidence_score") >= min_confidence)
