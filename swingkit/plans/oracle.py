"""DuckDB SQL of the registered queries, put together from named subqueries."""

from __future__ import annotations

from swingkit.sources.specs import SPACING, SPECS

BARS = """
t AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_quantity, CAST(l_shipdate AS DATE) AS d,
    greatest(10000 + sum(CAST(round(l_extendedprice * 100) AS BIGINT) % 401 - 200) OVER w, 100) / 100::DOUBLE AS px, row_number() OVER w AS rn
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
bars AS (SELECT symbol, DATE '1995-01-01' + CAST(b * {days} AS INTEGER) AS date, arg_min(px, rn) AS open, max(px) AS high, min(px) AS low, arg_max(px, rn) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, CAST(floor(datediff('day', DATE '1995-01-01', d) / {days}.0) AS BIGINT) AS b FROM t) GROUP BY symbol, b)""".format(days=7)

POSITIONED = """
pos AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date, open, high, low, close, volume) - 1 AS idx FROM {source})"""

DAMAGED = """
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k FROM bars),
d1 AS (SELECT * REPLACE (CASE WHEN k % 97 = 5 THEN low ELSE high END AS high, CASE WHEN k % 97 = 5 THEN high ELSE low END AS low) FROM k),
damaged AS (SELECT symbol, date, CASE WHEN k % 107 = 13 THEN 'NaN'::DOUBLE WHEN k % 83 = 2 THEN low * 0.95::DOUBLE ELSE open END AS open, high, CASE WHEN k % 103 = 11 THEN 0::DOUBLE ELSE low END AS low,
    CASE WHEN k % 101 = 7 THEN NULL WHEN k % 89 = 3 THEN high * 1.05::DOUBLE ELSE close END AS close, CASE WHEN k % 19 = 4 THEN 0 ELSE volume END AS volume FROM d1)"""

FLAGGED = """
f1 AS (SELECT *, open IS NULL OR isnan(open) OR high IS NULL OR isnan(high) OR low IS NULL OR isnan(low) OR close IS NULL OR isnan(close) AS was_null FROM damaged),
f2 AS (SELECT *, NOT was_null AND high < low AS was_swapped FROM f1),
f3 AS (SELECT * REPLACE (CASE WHEN was_swapped THEN low ELSE high END AS high, CASE WHEN was_swapped THEN high ELSE low END AS low) FROM f2),
f4 AS (SELECT *, NOT was_null AND (least(greatest(open, low), high) <> open OR least(greatest(close, low), high) <> close) AS was_clamped FROM f3),
f5 AS (SELECT * REPLACE (CASE WHEN was_null THEN open ELSE least(greatest(open, low), high) END AS open, CASE WHEN was_null THEN close ELSE least(greatest(close, low), high) END AS close) FROM f4),
flagged AS (SELECT *, NOT was_null AND (least(open, high, low, close) <= 0 OR isinf(open) OR isinf(high) OR isinf(low) OR isinf(close)) AS not_positive FROM f5)"""

INDICATORS = """
i1 AS (SELECT *, (high + low + close) / 3 AS typical_price, lag(close) OVER w AS pc FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
i2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range, (close - pc) / nullif(pc, 0) * 100 AS return_pct, (high - low) / nullif(close, 0) * 100 AS range_pct, nullif(volume, 0) AS traded FROM i1),
i3 AS (SELECT *, CASE WHEN count(true_range) OVER w14 = 14 THEN avg(true_range) OVER w14 END AS atr, CASE WHEN count(traded) OVER w20 = 20 THEN avg(traded) OVER w20 END AS volume_ma FROM i2
  WINDOW w14 AS (PARTITION BY symbol ORDER BY idx ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING)),
ind AS (SELECT *, volume / nullif(volume_ma, 0) AS volume_ratio FROM i3)"""


def pivots(k: int = 5) -> str:
    w = "PARTITION BY symbol ORDER BY idx ROWS BETWEEN"
    return f"""
p1 AS (SELECT *, count(*) OVER b AS nb, count(*) OVER a AS na, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la, min(low) OVER c AS near_low, max(high) OVER c AS near_high FROM ind
  WINDOW b AS ({w} {k} PRECEDING AND 1 PRECEDING), a AS ({w} 1 FOLLOWING AND {k} FOLLOWING), c AS ({w} 5 PRECEDING AND 5 FOLLOWING)),
raw AS (SELECT symbol, idx, date, high AS price, 'H' AS ptype, {k} AS strength FROM p1 WHERE nb = {k} AND na = {k} AND high > hb AND high > ha AND (atr IS NULL OR atr <= 0 OR high - near_low >= atr * 0.5)
  UNION ALL SELECT symbol, idx, date, low, 'L', {k} FROM p1 WHERE nb = {k} AND na = {k} AND low < lb AND low < la AND (atr IS NULL OR atr <= 0 OR near_high - low >= atr * 0.5))"""


def thinned(spacing: int = 10) -> str:
    s = spacing
    return f"""
g{s} AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY idx, ptype) AS run FROM (SELECT *, CASE WHEN ptype = lag(ptype) OVER (PARTITION BY symbol ORDER BY idx, ptype) THEN 0 ELSE 1 END AS new FROM raw)),
m{s} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx, ptype) - 1 AS k FROM (SELECT * FROM g{s} QUALIFY row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN ptype = 'H' THEN -price ELSE price END, idx) = 1)),
r{s} AS (SELECT symbol, k, 0::BIGINT AS slot, idx, date, price, ptype FROM m{s} WHERE k = 0
  UNION ALL SELECT symbol, k, slot + CAST(act = 2 AS BIGINT), CASE WHEN act > 0 THEN i2 ELSE idx END, CASE WHEN act > 0 THEN d2 ELSE date END, CASE WHEN act > 0 THEN p2 ELSE price END, CASE WHEN act > 0 THEN t2 ELSE ptype END
  FROM (SELECT m.symbol, m.k, r.slot, r.idx, r.date, r.price, r.ptype, m.idx AS i2, m.date AS d2, m.price AS p2, m.ptype AS t2,
      CASE WHEN m.ptype = r.ptype THEN CASE WHEN (m.ptype = 'H' AND m.price > r.price) OR (m.ptype = 'L' AND m.price < r.price) THEN 1 ELSE 0 END WHEN m.idx - r.idx < {s} THEN 0 ELSE 2 END AS act
    FROM r{s} r JOIN m{s} m ON m.symbol = r.symbol AND m.k = r.k + 1)),
thin{s} AS (SELECT symbol, slot AS k, idx, date, price, ptype FROM (SELECT * FROM r{s} QUALIFY row_number() OVER (PARTITION BY symbol, slot ORDER BY k DESC) = 1))"""


CLEAN_BARS = f"{BARS},{POSITIONED.format(source='bars')},{INDICATORS}"
PIVOTED = f"{CLEAN_BARS},{pivots()}"


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


DETECTION_SELECT = """
SELECT pattern_id, symbol, pattern_name, pattern_type, CAST(formation_start AS VARCHAR) AS formation_start, CAST(formation_end AS VARCHAR) AS formation_end, CAST(breakout_date AS VARCHAR) AS breakout_date,
  CAST(breakout_idx AS BIGINT) AS breakout_idx, breakout_direction, round(breakout_price, 9) AS breakout_price, round(target_price, 9) AS target_price, round(stop_loss_price, 9) AS stop_loss_price,
  CAST(confidence_score AS BIGINT) AS confidence_score, volume_confirmed, pattern_height_pct, CAST(pattern_width_bars AS BIGINT) AS pattern_width_bars, CAST(touch_count AS BIGINT) AS touch_count, pivot_indices
FROM {source}"""


def rule(constraint: str, pos: int, types: str, tolerance: float, depth: float = 15.0) -> str:
    """The condition of one mandatory pivot over the columns p1, p2, ... of a window."""
    cur, n = f"p{pos}", len(types)
    before = [k for k in range(pos - 1, 0, -1)]
    same = next((f"p{k}" for k in before if types[k - 1] == types[pos - 1]), None)
    diff = lambda a, b: f"coalesce(abs({a} - {b}) / nullif(least(abs({a}), abs({b})), 0) * 100, 1e308)"
    every = lambda t, f: f"{f}({', '.join(f'p{k}' for k in range(1, n + 1) if types[k - 1] == t)})"
    if constraint == "near_equal":
        return f"{diff(cur, same or 'p1')} <= {tolerance}"
    if constraint.startswith("near_equal_to_position_"):
        return f"{diff(cur, 'p' + constraint.rsplit('_', 1)[1])} <= {tolerance}"
    if constraint.startswith(("lower_than_previous", "higher_than_previous")):
        return "TRUE" if same is None else f"{cur} {'<' if constraint[0] == 'l' else '>'} {same}"
    if constraint == "must_be_between":
        return f"{cur} < least(p{pos - 1}, p{pos + 1})" if types[pos - 1] == "L" else f"{cur} > greatest(p{pos - 1}, p{pos + 1})"
    if constraint == "in_upper_third":
        return f"{cur} >= p2 + (p3 - p2) * (2::DOUBLE / 3::DOUBLE)" if n >= 4 else "TRUE"
    if constraint == "near_cup_lip":
        return f"{diff(cur, 'p3')} <= {tolerance}" if n >= 3 else "TRUE"
    if constraint == "shallow_decline":
        return f"coalesce((p5 - {cur}) / nullif(p5, 0) * 100 <= {depth}, TRUE)" if n >= 6 else "TRUE"
    sign, t, f = {"must_be_lowest": ("<=", "L", "least"), "must_be_highest": (">=", "H", "greatest"), "not_lowest": (">", "L", "least"), "not_highest": ("<", "H", "greatest")}[constraint]
    return f"{cur} {sign} {every(t, f)}"


def sequence_detections(key: str, name: str = "det", search: str = "ind", own: dict | None = None) -> str:
    """Subqueries that end in ``name``, the detections of one spec (``own``, or that of the key); ``ind`` and ``thin<spacing>`` come before."""
    s = own or SPECS[key]
    types, g, t, b = "".join(s["detection_signature"]["pivot_sequence"]), s["geometry_constraints"], s["prior_trend_requirements"], s["breakout_confirmation"]
    n, spacing, kind = len(types), SPACING.get(key, 10), s["pattern_type"]
    highs, lows = ([k for k in range(1, n + 1) if types[k - 1] == x] for x in "HL")
    leads = ", ".join(f"lead(idx, {k}) OVER w AS i{k + 1}, lead(price, {k}) OVER w AS p{k + 1}, lead(ptype, {k}) OVER w AS t{k + 1}, lead(date, {k}) OVER w AS d{k + 1}" for k in range(n))
    match = " AND ".join(f"t{k} = '{x}'" for k, x in enumerate(types, 1))
    rules = " AND ".join(["TRUE", *(rule(m["constraint"], m["position"], types, g["near_equal_tolerance_pct"]) for m in s["detection_signature"]["mandatory_pivots"])])
    asked = t["min_period_bars"] > 0 and t["min_change_pct"] > 0
    change = f"(c1.close - c0.close) / c0.close * 100"
    trend = {"up": f"{change} >= {t['min_change_pct']}", "down": f"{change} <= -{t['min_change_pct']}"}.get(t["direction"], f"abs({change}) >= {t['min_change_pct']}")
    prior = f"'{t['direction']}'" if t["direction"] in ("up", "down") else f"CASE WHEN {change} >= 0 THEN 'up' ELSE 'down' END"
    joins = f"JOIN ind c0 ON c0.symbol = b.symbol AND c0.idx = b.i1 - {t['min_period_bars']} JOIN ind c1 ON c1.symbol = b.symbol AND c1.idx = b.i1 WHERE c0.close > 0 AND {trend}" if asked else ""
    slope = lambda ks: f"(p{ks[-1]} - p{ks[0]}) / greatest(1, i{ks[-1]} - i{ks[0]})" if len(ks) > 1 else "0.0::DOUBLE"
    breaks = b["breakout_direction"]
    one = "down" if kind == "reversal_bearish" else "up" if kind == "reversal_bullish" else breaks if breaks in ("up", "down") else None
    follows = breaks in ("same_as_flagpole", "depends_on_prior_trend") and asked
    can = lambda d: str(one == d).upper() if one else f"m.prior_dir = '{d}'" if follows else "TRUE"
    thr = b["breakout_threshold_pct"] / 100
    upper, lower = (f"(m.p{ks[0]} + m.{u}_slope * (x.idx - m.i{ks[0]}))" for ks, u in ((highs, "up"), (lows, "lo")))
    return f"""
{name}_w AS (SELECT symbol, k, {leads} FROM thin{spacing} WINDOW w AS (PARTITION BY symbol ORDER BY k)),
{name}_b AS (SELECT *, i{n} - i1 + 1 AS width, greatest({', '.join(f'p{k}' for k in highs)}) AS hi, least({', '.join(f'p{k}' for k in lows)}) AS lo FROM {name}_w WHERE {match} AND {rules}),
{name}_t AS (SELECT b.*, {prior if asked else "NULL"} AS prior_dir, {slope(highs)} AS up_slope, {slope(lows)} AS lo_slope FROM {name}_b b {joins}),
{name}_m AS (SELECT *, (hi - lo) / ((hi + lo) / 2) * 100 AS height, (p{highs[0]} + up_slope * (i1 - i{highs[0]})) - (p{lows[0]} + lo_slope * (i1 - i{lows[0]})) AS span FROM {name}_t
  WHERE width BETWEEN {g['width_min_bars']} AND {g['width_max_bars']} AND (hi - lo) / ((hi + lo) / 2) * 100 BETWEEN {g['height_ratio_min']} AND {g['height_ratio_max']}),
{name}_h AS (SELECT m.symbol, m.k, x.idx, x.date, x.close, coalesce(x.volume_ratio >= {b['volume_multiplier_min']}, FALSE) AS vol, CASE WHEN {can('up')} AND x.close > {upper} * {1 + thr}::DOUBLE THEN 'up' ELSE 'down' END AS way, {upper} AS up_at, {lower} AS lo_at
  FROM {name}_m m JOIN {search} x ON x.symbol = m.symbol AND x.idx > m.i{n} AND x.idx <= m.i{n} + {g['breakout_search_bars']}
  WHERE ({can('up')} AND x.close > {upper} * {1 + thr}::DOUBLE) OR ({can('down')} AND x.close < {lower} * {1 - thr}::DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY m.symbol, m.k ORDER BY x.idx) = 1),
{name} AS (SELECT m.symbol || '_{key}_' || i1 || '_' || i{n} AS pattern_id, m.symbol, '{key}' AS pattern_name, '{kind}' AS pattern_type, d1 AS formation_start, d{n} AS formation_end, h.date AS breakout_date, h.idx AS breakout_idx, h.way AS breakout_direction,
    h.close AS breakout_price, CASE WHEN h.way = 'up' THEN h.close + span ELSE h.close - span END AS target_price, CASE WHEN h.way = 'up' THEN lo_at ELSE up_at END AS stop_loss_price, CASE WHEN h.way = 'up' THEN up_at ELSE lo_at END AS breakout_level,
    70 + CASE WHEN h.vol THEN 10 ELSE 0 END + CASE WHEN h.idx IS NOT NULL THEN 10 ELSE 0 END AS confidence_score, coalesce(h.vol, FALSE) AS volume_confirmed, round(height, 2) AS pattern_height_pct, width AS pattern_width_bars, {n} AS touch_count,
    {" || ',' || ".join(f"i{k}" for k in range(1, n + 1))} AS pivot_indices
  FROM {name}_m m LEFT JOIN {name}_h h ON h.symbol = m.symbol AND h.k = m.k WHERE span > 0)"""


def sequences(keys: list[str], own: dict[str, dict] | None = None) -> str:
    """SQL of the detections of several specs, maybe of ``own`` ones."""
    spacings = "".join("," + thinned(s) for s in sorted({SPACING.get(k, 10) for k in keys}))
    parts = ",".join(sequence_detections(k, f"s{j}", own=(own or {}).get(k)) for j, k in enumerate(keys))
    union = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(len(keys)))
    return with_(f"{PIVOTED}{spacings},{parts}, found AS ({union})", DETECTION_SELECT.format(source="found"))


def built_in(name: str) -> str:
    """The double top or the head and shoulders top."""
    n = 3 if name == "double_tops" else 5
    leads = ", ".join(f"lead(idx, {k}) OVER w AS i{k}, lead(price, {k}) OVER w AS p{k}, lead(ptype, {k}) OVER w AS t{k}, lead(date, {k}) OVER w AS d{k}" for k in range(n))
    match = " AND ".join(f"t{k} = '{x}'" for k, x in enumerate("HLHLH"[:n]))
    gap = lambda a, b: f"abs({a} - {b}) / least({a}, {b}) * 100"
    if n == 3:
        level, top, stop, height, points = "p1", "(p0 + p2) / 2", "(p0 + p2) / 2 * 1.03", "((p0 + p2) / 2 - p1) / ((p0 + p2) / 2) * 100", 20
        keep = f"{gap('p0', 'p2')} <= 3 AND p1 < p0 AND p1 < p2 AND i2 - i0 + 1 BETWEEN 21 AND 180 AND {height} >= 5"
        score = f"50 + CASE WHEN {gap('p0', 'p2')} <= 1 THEN 15 WHEN {gap('p0', 'p2')} <= 2 THEN 10 ELSE 5 END + CASE WHEN v0 <> 0 AND v2 <> 0 THEN CASE WHEN v2 < v0 THEN 15 ELSE 5 END ELSE 0 END"
    else:
        level, top, stop, height, points = "(p1 + p3) / 2", "p2", "p2 * 1.02", "(p2 - (p1 + p3) / 2) / p2 * 100", 15
        keep = f"p2 > p0 AND p2 > p4 AND {gap('p0', 'p4')} <= 10 AND i4 - i0 + 1 BETWEEN 42 AND 270 AND {gap('p1', 'p3')} <= 5"
        score = (
            f"50 + CASE WHEN {gap('p0', 'p4')} <= 3 THEN 15 WHEN {gap('p0', 'p4')} <= 5 THEN 10 ELSE 5 END + CASE WHEN {gap('p1', 'p3')} <= 2 THEN 10 ELSE 5 END"
            " + CASE WHEN v0 <> 0 AND v2 <> 0 AND v4 <> 0 AND v0 > v2 AND v2 > v4 THEN 10 WHEN v0 <> 0 AND v4 <> 0 AND v4 < v0 THEN 5 ELSE 0 END"
        )
    volumes = " ".join(f"JOIN ind y{k} ON y{k}.symbol = b.symbol AND y{k}.idx = b.i{k}" for k in range(0, n, 2))
    last = f"i{n - 1}"
    ctes = f"""{PIVOTED},{thinned(10)},
w0 AS (SELECT symbol, k, {leads} FROM thin10 WINDOW w AS (PARTITION BY symbol ORDER BY k)),
w1 AS (SELECT b.*, {', '.join(f'y{k}.volume AS v{k}' for k in range(0, n, 2))}, {level} AS level FROM (SELECT * FROM w0 WHERE {match} AND {keep}) b {volumes} JOIN ind c0 ON c0.symbol = b.symbol AND c0.idx = b.i0 - 42
  WHERE c0.close > 0 AND (y0.close - c0.close) / c0.close * 100 >= 15),
hit AS (SELECT m.symbol, m.k, x.idx, x.date, x.close, coalesce(x.volume_ratio >= 1.3, FALSE) AS vol FROM w1 m JOIN ind x ON x.symbol = m.symbol AND x.idx > m.{last} AND x.idx <= m.{last} + 19 WHERE x.close < m.level * 0.99::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY m.symbol, m.k ORDER BY x.idx) = 1),
found AS (SELECT m.symbol || '_{name}_' || i0 || '_' || {last} AS pattern_id, m.symbol, '{name}' AS pattern_name, 'reversal_bearish' AS pattern_type, d0 AS formation_start, d{n - 1} AS formation_end, h.date AS breakout_date, h.idx AS breakout_idx,
    CASE WHEN h.idx IS NOT NULL THEN 'down' END AS breakout_direction, h.close AS breakout_price, h.close - ({top} - level) AS target_price, CASE WHEN h.idx IS NOT NULL THEN {stop} END AS stop_loss_price,
    least(100, {score} + CASE WHEN h.idx IS NOT NULL THEN {points} ELSE 0 END) AS confidence_score, coalesce(h.vol, FALSE) AS volume_confirmed, round({height}, 2) AS pattern_height_pct, {last} - i0 + 1 AS pattern_width_bars, {n} AS touch_count,
    {" || ',' || ".join(f"i{k}" for k in range(n))} AS pivot_indices FROM w1 m LEFT JOIN hit h ON h.symbol = m.symbol AND h.k = m.k)"""
    return with_(ctes, DETECTION_SELECT.format(source="found") + " WHERE confidence_score >= 60")


_L = "lag({c}, {n}) OVER w AS {c}{k}"


def bar_local(inner: str, window: str, where: str, columns: str) -> str:
    """Detections of one bar-local pattern: columns by windows, a condition, and the detection's columns."""
    ctes = f"{CLEAN_BARS}, b AS (SELECT *, {window} FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY idx)), c AS (SELECT * {inner} FROM b), found AS (SELECT symbol, {columns} FROM c WHERE {where})"
    return with_(ctes, DETECTION_SELECT.format(source="found"))


def columns(key: str, kind: str, start: str, end: str, **values: str) -> str:
    given = {
        "pattern_id": f"symbol || '_{key}_' || ({start}) || '_' || ({end})", "pattern_name": f"'{key}'", "pattern_type": f"'{kind}'", "volume_confirmed": "FALSE", "target_price": "NULL::DOUBLE", "stop_loss_price": "NULL::DOUBLE",
        "formation_start": "date", "formation_end": "date", "breakout_date": "date", "breakout_idx": "idx", "breakout_price": "close",
    } | values
    return ", ".join(f"{v} AS {k}" for k, v in given.items())


BOTH = "continuation_both"
INSIDE = bar_local(
    ", CASE WHEN c1 > high * 1.005::DOUBLE THEN 'up' WHEN c1 < low * 0.995::DOUBLE THEN 'down' END AS w1, CASE WHEN c2 > high * 1.005::DOUBLE THEN 'up' WHEN c2 < low * 0.995::DOUBLE THEN 'down' END AS w2",
    "lag(high) OVER w AS h0, lag(low) OVER w AS l0, lag(date) OVER w AS d0, lead(close) OVER w AS c1, lead(close, 2) OVER w AS c2, lead(date) OVER w AS d1, lead(date, 2) OVER w AS d2",
    "high < h0 AND low > l0 AND high > low AND coalesce(w1, w2) IS NOT NULL",
    columns("inside_day", BOTH, "idx - 1", "idx", formation_start="d0", breakout_date="CASE WHEN w1 IS NOT NULL THEN d1 ELSE d2 END", breakout_idx="CASE WHEN w1 IS NOT NULL THEN idx + 1 ELSE idx + 2 END", breakout_direction="coalesce(w1, w2)",
            breakout_price="CASE WHEN w1 IS NOT NULL THEN c1 ELSE c2 END", target_price="CASE WHEN w1 IS NOT NULL THEN c1 ELSE c2 END + CASE WHEN coalesce(w1, w2) = 'up' THEN high - low ELSE low - high END", stop_loss_price="CASE WHEN coalesce(w1, w2) = 'up' THEN low ELSE high END",
            confidence_score="70", pattern_height_pct="round((high - low) / ((high + low) / 2) * 100, 2)", pattern_width_bars="2", touch_count="2", pivot_indices="(idx - 1) || ',' || idx"),
)


def gap_columns(least: float) -> tuple[str, str]:
    window = "lag(high) OVER w AS h0, lag(low) OVER w AS l0"
    inner = f", CASE WHEN low > h0 * {1 + least / 100}::DOUBLE THEN 'up' WHEN high < l0 * {1 - least / 100}::DOUBLE THEN 'down' END AS gap"
    return window, inner


_G = gap_columns(0.1)
GAPS = bar_local(
    _G[1], _G[0], "gap IS NOT NULL",
    columns("gaps", BOTH, "idx", "idx", breakout_direction="gap", target_price="CASE WHEN gap = 'up' THEN close + (low - h0) ELSE close - (l0 - high) END", stop_loss_price="CASE WHEN gap = 'up' THEN h0 ELSE l0 END", confidence_score="65",
            pattern_height_pct="round(CASE WHEN gap = 'up' THEN (low - h0) / ((low + h0) / 2) ELSE (l0 - high) / ((l0 + high) / 2) END * 100, 3)", pattern_width_bars="1", touch_count="1", pivot_indices="(idx - 1) || ',' || idx"),
)
SPIKES = bar_local(
    "", "lag(close) OVER w AS c0", "c0 > 0 AND (high - low) / c0 >= 0.03::DOUBLE",
    columns("spike_formation", BOTH, "idx", "idx", breakout_direction="CASE WHEN close >= open THEN 'up' ELSE 'down' END", target_price="CASE WHEN close >= open THEN close + (high - low) ELSE close - (high - low) END", stop_loss_price="CASE WHEN close >= open THEN low ELSE high END",
            confidence_score="70", pattern_height_pct="round((high - low) / c0 * 100, 2)", pattern_width_bars="1", touch_count="1", pivot_indices="CAST(idx AS VARCHAR)"),
)
_M = " AND ".join(f"high{k} <= high1 AND low{k} >= low1 AND abs(close{k} - open{k}) <= abs(close1 - open1) * 0.5::DOUBLE" for k in (2, 3, 4))
THREE_METHODS = bar_local(
    ", CASE WHEN close1 > open1 AND close > open AND close > close1 THEN 'up' WHEN close1 < open1 AND close < open AND close < close1 THEN 'down' END AS way, coalesce(nullif(atr1, 0), atr) AS a",
    ", ".join(_L.format(c=c, n=5 - k, k=k) for k in range(1, 5) for c in ("open", "close", "high", "low", "date")) + ", lag(atr, 4) OVER w AS atr1",
    f"way IS NOT NULL AND a > 0 AND abs(close1 - open1) >= 1.5 * a AND abs(close - open) >= 1.5 * a AND high1 > low1 AND {_M}",
    columns("rising_falling_three_methods", BOTH, "idx - 4", "idx", formation_start="date1", breakout_direction="way", target_price="CASE WHEN way = 'up' THEN close + (high1 - low1) ELSE close - (high1 - low1) END", stop_loss_price="CASE WHEN way = 'up' THEN low1 ELSE high1 END",
            confidence_score="80", pattern_height_pct="round((high1 - low1) / ((high1 + low1) / 2) * 100, 2)", pattern_width_bars="5", touch_count="5", pivot_indices="(idx - 4) || ',' || (idx - 3) || ',' || (idx - 2) || ',' || (idx - 1) || ',' || idx"),
)
INVERTED = bar_local(
    ", (close - c0) / c0 * 100 AS move", "count(*) OVER (PARTITION BY symbol) AS n, lag(close) OVER w AS c0, lag(high) OVER w AS h0, lag(date) OVER w AS d0, lead(high) OVER w AS high2, lead(low) OVER w AS low2, lead(close) OVER w AS close2, lead(date) OVER w AS date2",
    "n >= 10 AND c0 > 0 AND move >= 5 AND high2 > high AND low2 > low AND close2 > 0",
    columns("dead_cat_bounce_inverted", "event_bearish", "idx", "idx + 1", formation_start="d0", formation_end="date2", breakout_date="date2", breakout_idx="idx + 1", breakout_direction="'down'", breakout_price="close2",
            confidence_score="60 + CASE WHEN low > h0 THEN 10 ELSE 0 END + CASE WHEN move >= 10 THEN 10 ELSE 0 END + CASE WHEN volume_ratio >= 2 THEN 10 ELSE 0 END", volume_confirmed="low > h0", pattern_height_pct="round(move, 2)", pattern_width_bars="3", touch_count="3",
            pivot_indices="(idx - 1) || ',' || idx || ',' || (idx + 1)"),
)
DEAD_CAT = with_(
    f"""{CLEAN_BARS},
b AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, lag(high) OVER w AS h0, lag(low) OVER w AS l0, min(low) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS bottom, max(high) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 5 FOLLOWING AND 25 FOLLOWING) AS peak
  FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
s AS (SELECT b.symbol, b.idx, b.date, b.h0, b.l0, b.high, b.volume_ratio, b.bottom, min(x.idx) AS low_idx, (b.h0 - b.bottom) / b.h0 * 100 AS fall FROM b JOIN b x ON x.symbol = b.symbol AND x.idx BETWEEN b.idx AND b.idx + 8 AND x.low = b.bottom
  WHERE b.n >= 50 AND b.idx >= 1 AND b.idx < b.n - 2 AND b.h0 > 0 AND (b.h0 - b.bottom) / b.h0 * 100 >= 15 GROUP BY ALL),
p AS (SELECT s.*, l.peak, min(x.idx) AS peak_idx, (l.peak - s.bottom) / s.bottom * 100 AS rise FROM s JOIN b l ON l.symbol = s.symbol AND l.idx = s.low_idx JOIN b x ON x.symbol = s.symbol AND x.idx BETWEEN s.low_idx + 5 AND s.low_idx + 25 AND x.high = l.peak GROUP BY ALL),
q AS (SELECT p.*, x.date AS peak_date, x.close AS peak_close FROM p JOIN b x ON x.symbol = p.symbol AND x.idx = p.peak_idx WHERE rise BETWEEN 15 AND 35 QUALIFY row_number() OVER (PARTITION BY p.symbol, p.low_idx, p.peak_idx ORDER BY p.idx) = 1),
found AS (SELECT symbol, """
    + columns("dead_cat_bounce", "event_bearish", "idx", "peak_idx", formation_end="peak_date", breakout_date="peak_date", breakout_idx="peak_idx", breakout_direction="'down'", breakout_price="peak_close",
              confidence_score="65 + CASE WHEN high < l0 THEN 10 ELSE 0 END + CASE WHEN fall >= 25 THEN 5 ELSE 0 END + CASE WHEN rise >= 25 THEN 5 ELSE 0 END + CASE WHEN volume_ratio >= 2 THEN 10 ELSE 0 END", volume_confirmed="high < l0", pattern_height_pct="round(fall, 2)",
              pattern_width_bars="peak_idx - idx + 1", touch_count="4", pivot_indices="(idx - 1) || ',' || idx || ',' || low_idx || ',' || peak_idx")
    + " FROM q)",
    DETECTION_SELECT.format(source="found"),
)
_I = gap_columns(0.5)
ISLANDS = with_(
    f"""{CLEAN_BARS}, b0 AS (SELECT *, {_I[0]} FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY idx)), b AS (SELECT * {_I[1]} FROM b0),
pairs AS (SELECT e.symbol, e.idx AS i, x.idx AS j, e.gap AS way, e.date AS d1, x.date AS d2, x.close AS c2, max(r.high) AS top, min(r.low) AS bottom FROM b e JOIN b x ON x.symbol = e.symbol AND x.idx > e.idx AND x.idx < e.idx + 20 AND e.gap <> x.gap
  JOIN b r ON r.symbol = e.symbol AND r.idx >= e.idx AND r.idx < x.idx GROUP BY ALL HAVING max(r.high) > min(r.low)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY j) = 1)),
walk AS (SELECT symbol, k, i, j, TRUE AS keep, j AS upto FROM firsts WHERE k = 1 UNION ALL SELECT f.symbol, f.k, f.i, f.j, f.i > w.upto, CASE WHEN f.i > w.upto THEN f.j ELSE w.upto END FROM walk w JOIN firsts f ON f.symbol = w.symbol AND f.k = w.k + 1),
found AS (SELECT f.symbol, """
    + columns("islands", "reversal_both", "f.i", "f.j", formation_start="d1", formation_end="d2", breakout_date="d2", breakout_idx="f.j", breakout_direction="CASE WHEN way = 'up' THEN 'down' ELSE 'up' END", breakout_price="c2",
              target_price="CASE WHEN way = 'up' THEN c2 - (top - bottom) ELSE c2 + (top - bottom) END", stop_loss_price="CASE WHEN way = 'up' THEN top ELSE bottom END", confidence_score="75", pattern_height_pct="round((top - bottom) / ((top + bottom) / 2) * 100, 2)",
              pattern_width_bars="f.j - f.i + 1", touch_count="2", pivot_indices="f.i || ',' || f.j").replace("symbol ||", "f.symbol ||")
    + " FROM firsts f JOIN walk w ON w.symbol = f.symbol AND w.k = f.k WHERE w.keep)",
    DETECTION_SELECT.format(source="found"),
)
