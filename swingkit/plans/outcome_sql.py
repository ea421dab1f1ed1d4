"""DuckDB SQL of the detections of all detectors and of their outcomes."""

from __future__ import annotations

import re

from swingkit.plans import oracle as O
from swingkit.plans.cup_pipe_queries import CUP, PIPE, cup_sql, pipe_sql
from swingkit.sources.specs import SPACING, SPECS

_COLUMNS = ["pattern_id", "symbol", "pattern_name", "pattern_type", "formation_start", "formation_end", "breakout_date", "breakout_idx", "breakout_direction", "breakout_price", "target_price", "stop_loss_price", "confidence_score",
            "volume_confirmed", "pattern_height_pct", "pattern_width_bars", "touch_count", "pivot_indices"]
_DATES = ("formation_start", "formation_end", "breakout_date")


def _others() -> list[str]:
    """The detections of the detectors without a spec, with the columns of those with one."""
    cast = ", ".join(f"CAST({c} AS DATE) AS {c}" if c in _DATES else c for c in _COLUMNS)
    marked = cast.replace("pattern_id", "pattern_id || '_built_in' AS pattern_id").replace("pattern_name", "pattern_name || '_built_in' AS pattern_name")
    exact = lambda sql: re.sub(r"round\((breakout_price|target_price|stop_loss_price), 9\) AS \1", r"\1", sql)
    plain = [O.INSIDE, O.GAPS, O.ISLANDS, O.THREE_METHODS, O.SPIKES, O.DEAD_CAT, O.INVERTED, cup_sql(CUP), cup_sql(CUP, True), pipe_sql(PIPE), pipe_sql(PIPE, False)]
    return [f"SELECT {cast}, NULL::DOUBLE AS breakout_level FROM ({exact(sql)})" for sql in plain] + [f"SELECT {marked}, NULL::DOUBLE AS breakout_level FROM ({exact(O.built_in(name))})" for name in ("head_and_shoulders_top", "double_tops")]


def detections() -> str:
    """Subqueries up to ``det``, the detections of every spec and of every other detector."""
    spacings = "".join("," + O.thinned(s) for s in sorted({SPACING.get(k, 10) for k in SPECS}))
    parts = ",".join(O.sequence_detections(k, f"s{j}") for j, k in enumerate(SPECS))
    own = [f"SELECT {', '.join(_COLUMNS)}, breakout_level FROM s{j}" for j in range(len(SPECS))]
    return f"{O.PIVOTED}{spacings},{parts}, det AS ({' UNION ALL '.join(own + _others())})"


OUTCOMES = f"""{detections()},
base AS (SELECT *, CASE WHEN breakout_direction = 'down' OR pattern_type = 'reversal_bearish' THEN -1 ELSE 1 END AS way FROM det WHERE breakout_date IS NOT NULL),
ends AS (SELECT b.pattern_id, max(x.high) AS top, min(x.low) AS bottom FROM (SELECT pattern_id, symbol, unnest(string_split(pivot_indices, ',')) AS i FROM base WHERE stop_loss_price IS NULL) b JOIN ind x ON x.symbol = b.symbol AND x.idx = CAST(b.i AS BIGINT) GROUP BY 1),
after1 AS (SELECT b.pattern_id, b.way, b.breakout_price AS bp, b.breakout_date AS bd, coalesce(b.breakout_level, b.breakout_price / CASE WHEN b.breakout_direction = 'up' THEN 1.01::DOUBLE ELSE 0.99::DOUBLE END) AS lv,
    coalesce(b.stop_loss_price, CASE WHEN b.breakout_direction = 'up' THEN e.bottom ELSE e.top END) AS op, b.target_price AS tp, x.idx, x.date, x.high, x.low, x.close,
    CASE WHEN way < 0 THEN x.low ELSE x.high END AS best, CASE WHEN way < 0 THEN x.high ELSE x.low END AS worst FROM base b LEFT JOIN ends e USING (pattern_id) JOIN ind x ON x.symbol = b.symbol AND x.idx > b.breakout_idx AND x.idx <= b.breakout_idx + 252),
after2 AS (SELECT *, way * max(way * best) OVER (PARTITION BY pattern_id ORDER BY idx) AS run, CASE WHEN way < 0 THEN high >= lv * 0.99::DOUBLE ELSE low <= lv * 1.01::DOUBLE END AND date <= bd + 30 AS touch, CASE WHEN way < 0 THEN high >= bp * 0.99::DOUBLE ELSE low <= bp * 1.01::DOUBLE END AND date <= bd + 30 AS touch_bp FROM after1),
after3 AS (SELECT *, min(CASE WHEN (run - bp) * way > 0 AND (run - worst) * way > 0 AND abs(worst - run) / run * 100 >= 20 THEN idx END) OVER (PARTITION BY pattern_id) AS stop, min(CASE WHEN touch THEN idx END) OVER (PARTITION BY pattern_id) AS ret FROM after2),
sums AS (SELECT pattern_id, count(*) AS bars, any_value(stop) AS stop, any_value(op) AS op, greatest(0, max(way * (close - bp) / bp * 100)) AS favor, max(-way * (close - bp) / bp * 100) AS against, min(date) FILTER (WHERE -way * (close - bp) / bp * 100 >= 5) AS a5, min(date) FILTER (WHERE -way * (close - bp) / bp * 100 >= 10) AS a10,
    min(date) FILTER (WHERE op > 0 AND way * (close - op) <= 0) AS inv, arg_min(date, idx) FILTER (WHERE idx <= coalesce(stop, idx) AND best = run) AS skip, max(way * best) FILTER (WHERE idx <= coalesce(stop, idx)) AS ult,
    count(*) FILTER (WHERE date <= bd + 30) AS near_bars, bool_or(touch_bp) AS any_bp, bool_or(touch) AS any_lv, min(date) FILTER (WHERE idx = ret) AS ret_date, max(way * best) FILTER (WHERE idx <= ret) AS pre, max(way * best) FILTER (WHERE idx > ret) AS post,
    min(date) FILTER (WHERE way * (best - tp) >= 0) AS t_date, bool_or(way * (best - tp) >= 0) AS hit, bool_or(way * (close - tp) >= 0) AS hit_close, max(high) FILTER (WHERE way < 0) AS wh, min(low) FILTER (WHERE way > 0) AS wl FROM after3 GROUP BY pattern_id HAVING count(*) >= 2),
ult AS (SELECT a.pattern_id, min(a.date) AS ud FROM after3 a JOIN sums s USING (pattern_id) WHERE a.idx <= coalesce(a.stop, a.idx) AND a.way * a.best = s.ult GROUP BY a.pattern_id),
res AS (SELECT b.pattern_id, b.symbol, b.pattern_name, b.breakout_date, b.breakout_price, CASE WHEN bars IS NOT NULL THEN CASE WHEN way < 0 THEN 'down' ELSE 'up' END ELSE b.breakout_direction END AS breakout_direction, b.target_price, b.stop_loss_price,
    favor < 5 AND against >= 5 AS bust_failure_5pct, favor < 10 AND against >= 10 AS bust_failure_10pct, CASE WHEN favor < 5 AND against >= 5 THEN a5 WHEN favor < 10 AND against >= 10 THEN a10 END AS bust_failure_date,
    CASE WHEN (favor < 5 AND against >= 5) OR (favor < 10 AND against >= 10) THEN round(against, 2) END AS bust_failure_pct, CASE WHEN bars IS NOT NULL AND ult.op > 0 THEN inv IS NOT NULL END AS boundary_invalidated, inv AS boundary_invalidation_date,
    way * ult.ult AS ultimate_price, ud AS ultimate_date, datediff('day', b.breakout_date, ud) AS days_to_ultimate, CASE WHEN bars IS NOT NULL THEN CASE WHEN stop IS NOT NULL THEN '20pct_reversal' ELSE 'end_of_window' END END AS ultimate_stop_reason,
    CASE WHEN bars IS NOT NULL THEN any_lv AND NOT coalesce(post <= pre, FALSE) END AS throwback_pullback_occurred, CASE WHEN any_lv AND NOT coalesce(post <= pre, FALSE) THEN ret_date END AS throwback_pullback_date,
    CASE WHEN any_lv AND NOT coalesce(post <= pre, FALSE) THEN datediff('day', b.breakout_date, ret_date) END AS days_to_throwback_pullback, CASE WHEN near_bars > 0 THEN any_bp END AS retested_breakout_level, CASE WHEN near_bars > 0 THEN any_lv END AS retested_boundary_level,
    hit AS target_achieved_intraday, hit_close AS target_achieved_close, t_date AS target_achievement_date, datediff('day', b.breakout_date, t_date) AS days_to_target, round(greatest(0, way * (way * ult.ult - b.breakout_price) / b.breakout_price * 100), 2) AS max_favorable_excursion_pct,
    round(greatest(0, coalesce(wh - b.breakout_price, b.breakout_price - wl) / b.breakout_price * 100), 2) AS max_adverse_excursion_pct, coalesce(bars, 252) AS evaluation_window_bars
  FROM base b LEFT JOIN (SELECT s.*, u.ud FROM sums s JOIN ult u USING (pattern_id)) ult USING (pattern_id))"""
