"""Queries of cups with a handle and pipes, and the joins of bars that they are held against."""

from __future__ import annotations

from swingkit.operators import cups_pipes
from swingkit.operators.cups_pipes import Breakout, Cup, Pipe
from swingkit.plans import oracle as O
from swingkit.plans.base import bars_of, pivots_of, query

#: Limits under which the walk of the bars has cups and pipes at all; the defaults of :class:`Cup` and :class:`Pipe` are the pattern's own.
CUP = Cup(width=(30, 200), depth=(8.0, 45.0), handle_decline=(0.5, 20.0), handle_position=30.0, trend=("any", 10, 2.0), breakout=Breakout(closes=2))
PIPE = Pipe(width=(2, 20), separation=(2, 15), leg=(0.5, 40.0), angle=(5.0, 90.0), height=(1.0, 60.0), trend=("any", 10, 2.0), breakout=Breakout(closes=2))


def _num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def _within(value: str, limits: tuple) -> str:
    return f"({value}) BETWEEN {_num(limits[0])} AND {_num(limits[1])}"


def _trend(trend: tuple[str, int, float], start: str) -> str:
    """A test of the closes of ``cb`` up to ``start``."""
    way, bars, pct = trend
    if not bars or not pct:
        return "TRUE"
    change = "(c1.close - c0.close) / c0.close * 100"
    held = {"up": f"{change} >= {_num(pct)}", "down": f"{change} <= {_num(-pct)}"}.get(way, f"abs({change}) >= {_num(pct)}")
    return f"EXISTS (SELECT 1 FROM cb c0 JOIN cb c1 ON c1.symbol = c0.symbol AND c1.idx = {start} WHERE c0.symbol = a.symbol AND c0.idx = {start} - {bars} AND c0.close > 0 AND {held})"


def _breakout(source: str, key: str, search: int, rule: Breakout, up: bool) -> str:
    """``hit``: the first bar beyond ``lvl`` after ``e`` whose next closes are beyond it too."""
    sign, limit = (">", f"lvl * (1 + {_num(rule.threshold_pct / 100)})") if up else ("<", f"lvl * (1 - {_num(rule.threshold_pct / 100)})")
    closes = f"NOT EXISTS (SELECT 1 FROM cb y WHERE y.symbol = m.symbol AND y.idx BETWEEN x.idx AND x.idx + {rule.closes - 1} AND NOT (y.close {sign} {limit}))"
    return f"""hit AS (SELECT m.*, x.idx AS bi, x.date AS bd, x.close AS bp, coalesce(x.volume_ratio >= {rule.volume_min}, FALSE) AS vol FROM {source} m JOIN cb x ON x.symbol = m.symbol AND x.idx > m.e AND x.idx <= m.e + {search} WHERE {closes}
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY x.idx) = 1)"""


_GAP = "abs({a} - {b}) / least(abs({a}), abs({b})) * 100"


def cup_sql(cup: Cup, inverted: bool = False) -> str:
    key = "cup_with_handle_inverted" if inverted else "cup_with_handle"
    m = (lambda c: f"axis - {c}") if inverted else (lambda c: c)
    low, high = (m("high"), m("low")) if inverted else ("low", "high")
    hard = max(cup.tolerance, 10.0)
    ctes = f"""{O.PIVOTED},{O.thinned(10)},
ax AS (SELECT symbol, max(high) + min(low) AS axis, max(idx) AS last FROM ind GROUP BY symbol),
cb AS (SELECT i.symbol, idx, date, {low} AS low, {high} AS high, {m('close')} AS close, volume_ratio, i.low AS low_, i.high AS high_, i.close AS close_ FROM ind i JOIN ax USING (symbol)),
rims AS (SELECT t.symbol, t.idx, t.date, {m('t.price')} AS price, last FROM thin10 t JOIN ax USING (symbol) WHERE ptype = '{'L' if inverted else 'H'}'),
pr AS (SELECT a.symbol, a.date AS sd, a.last, a.idx AS s, b.idx AS r, {_GAP.format(a='a.price', b='b.price')} AS gap, (a.price + b.price) / 2 AS rim FROM rims a JOIN rims b ON a.symbol = b.symbol AND b.idx > a.idx
  WHERE b.idx - a.idx + 1 BETWEEN {cup.width[0]} AND {cup.width[1]} AND b.idx + 6 <= a.last AND {_trend(cup.trend, 'a.idx')}),
bt AS (SELECT pr.*, x.low AS bottom, x.idx AS bottom_idx FROM pr JOIN cb x ON x.symbol = pr.symbol AND x.idx BETWEEN s AND r WHERE gap <= {_num(hard)} QUALIFY row_number() OVER (PARTITION BY pr.symbol, s, r ORDER BY x.low, x.idx) = 1),
dp AS (SELECT *, (rim - bottom) / rim * 100 AS depth FROM bt WHERE bottom > 0 AND rim > 0 AND {_within('(rim - bottom) / rim * 100', cup.depth)}),
hn AS (SELECT d.*, x.idx AS e, x.date AS ed, (SELECT min(y.low) FROM cb y WHERE y.symbol = d.symbol AND y.idx > d.r AND y.idx <= x.idx) AS hl, (SELECT max(y.high) FROM cb y WHERE y.symbol = d.symbol AND y.idx > d.r AND y.idx <= x.idx) AS lvl
  FROM dp d JOIN cb x ON x.symbol = d.symbol AND x.idx BETWEEN d.r + 5 AND d.r + 20 AND x.idx - d.s + 1 <= {cup.width[1]}),
hk AS (SELECT * FROM hn WHERE {_within('(rim - hl) / rim * 100', cup.handle_decline)} AND (hl - bottom) / (rim - bottom) * 100 >= {_num(cup.handle_position)} AND lvl > 0 AND {_GAP.format(a='lvl', b='rim')} <= {_num(hard)}),
{_breakout('hk', 'm.symbol, s, r, e', cup.search, cup.breakout, True)},
one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY symbol, s, r ORDER BY e) = 1),
lo AS (SELECT o.*, (SELECT min(y.idx) FROM cb y WHERE y.symbol = o.symbol AND y.idx > o.r AND y.idx <= o.e AND y.low = o.hl) AS hi FROM one o),
og AS (SELECT l.*, (SELECT y.close_ FROM cb y WHERE y.symbol = l.symbol AND y.idx = l.bi) AS close_, ((SELECT y.low_ FROM cb y WHERE y.symbol = l.symbol AND y.idx = l.s) + (SELECT y.low_ FROM cb y WHERE y.symbol = l.symbol AND y.idx = l.r)) / 2 AS rim_,
  (SELECT max(y.high_) FROM cb y WHERE y.symbol = l.symbol AND y.idx BETWEEN l.s AND l.r) AS top_, (SELECT max(y.high_) FROM cb y WHERE y.symbol = l.symbol AND y.idx BETWEEN l.r + 1 AND l.e) AS handle_ FROM lo l),
found AS (SELECT symbol || '_{key}_' || s || '_' || e AS pattern_id, symbol, '{key}' AS pattern_name, '{'continuation_bearish' if inverted else cup.kind}' AS pattern_type, sd AS formation_start, ed AS formation_end, bd AS breakout_date, bi AS breakout_idx,
  '{'down' if inverted else 'up'}' AS breakout_direction, {'close_' if inverted else 'bp'} AS breakout_price, {'close_ - (top_ - rim_)' if inverted else 'bp + (rim - bottom)'} AS target_price, {'handle_' if inverted else 'hl'} AS stop_loss_price,
  70 + CASE WHEN gap <= {_num(cup.tolerance)} THEN 10 WHEN gap <= 5 THEN 5 ELSE 0 END + CASE WHEN vol THEN 10 ELSE 0 END AS confidence_score, vol AS volume_confirmed, round(depth, 2) AS pattern_height_pct, e - s + 1 AS pattern_width_bars, 6 AS touch_count,
  s || ',' || bottom_idx || ',' || r || ',' || hi || ',' || e AS pivot_indices FROM og{' WHERE top_ > rim_' if inverted else ''})"""
    return O.with_(ctes, O.DETECTION_SELECT.format(source="found"))


def pipe_sql(pipe: Pipe, bottom: bool = True) -> str:
    key, far, pick, order = ("pipe_bottoms", "high", "max", "DESC") if bottom else ("pipe_tops", "low", "min", "ASC")
    into, out, size, height = (
        ("(f0 - price) / f0 * 100", "(post - price) / price * 100", "lvl - ends", "(lvl - ends) / lvl * 100")
        if bottom
        else ("(price - f0) / f0 * 100", "(price - post) / price * 100", "ends - lvl", "(ends - lvl) / ((ends + lvl) / 2) * 100")
    )
    ctes = f"""{O.PIVOTED},
cb AS (SELECT * FROM ind),
pt0 AS (SELECT p.symbol, p.idx, p.date, p.price, x.{far} AS f0, x.idx AS i0, (SELECT {pick}(y.{far}) FROM cb y WHERE y.symbol = p.symbol AND y.idx BETWEEN p.idx + 1 AND p.idx + 3) AS post
  FROM raw p JOIN cb x ON x.symbol = p.symbol AND x.idx BETWEEN p.idx - 3 AND p.idx - 1 WHERE p.ptype = '{'L' if bottom else 'H'}' QUALIFY row_number() OVER (PARTITION BY p.symbol, p.idx ORDER BY x.{far} {order}, x.idx) = 1),
pt AS (SELECT * FROM pt0 WHERE price > 0 AND f0 > 0 AND post > 0 AND {_within(into, pipe.leg)} AND {out} >= {_num(pipe.leg[0])} AND {_within('abs(degrees(atan((price - f0) / f0 * 100 / greatest(1, idx - i0))))', pipe.angle)}),
pr AS (SELECT a.symbol, a.date AS sd, b.date AS ed, a.idx AS s, b.idx AS e, (a.price + b.price) / 2 AS ends FROM pt a JOIN pt b ON a.symbol = b.symbol AND b.idx > a.idx
  WHERE b.idx - a.idx + 1 BETWEEN {pipe.width[0]} AND {pipe.width[1]} AND b.idx - a.idx BETWEEN {pipe.separation[0]} AND {pipe.separation[1]} AND {_within('b.price / a.price', pipe.ratio)} AND {_trend(pipe.trend, 'a.idx')}),
lv AS (SELECT pr.*, x.{far} AS lvl, x.idx AS li FROM pr JOIN cb x ON x.symbol = pr.symbol AND x.idx BETWEEN s AND e QUALIFY row_number() OVER (PARTITION BY pr.symbol, s, e ORDER BY x.{far} {order}, x.idx) = 1),
ht AS (SELECT *, {size} AS size, {height} AS height FROM lv WHERE lvl > 0 AND {size} > 0 AND {_within(height, pipe.height)}),
{_breakout('ht', 'm.symbol, s, e', 30, pipe.breakout, bottom)},
found AS (SELECT symbol || '_{key}_' || s || '_' || e AS pattern_id, symbol, '{key}' AS pattern_name, '{'reversal_bullish' if bottom else 'reversal_bearish'}' AS pattern_type, sd AS formation_start, ed AS formation_end, bd AS breakout_date, bi AS breakout_idx,
  '{'up' if bottom else 'down'}' AS breakout_direction, bp AS breakout_price, bp {'+' if bottom else '-'} size AS target_price, ends AS stop_loss_price, 75 + CASE WHEN vol THEN 10 ELSE 0 END AS confidence_score, vol AS volume_confirmed,
  round(height, 2) AS pattern_height_pct, e - s + 1 AS pattern_width_bars, 2 AS touch_count, s || ',' || li || ',' || e AS pivot_indices FROM hit)"""
    return O.with_(ctes, O.DETECTION_SELECT.format(source="found"))


query("f6_cup_with_handle", cup_sql(CUP))(lambda spark, d: cups_pipes.cups_with_handle(bars_of(spark, d), pivots_of(spark, d), CUP))
query("f7_cup_with_handle_inverted", cup_sql(CUP, True))(lambda spark, d: cups_pipes.inverted_cups_with_handle(bars_of(spark, d), pivots_of(spark, d), CUP))
query("f12_pipe_bottoms", pipe_sql(PIPE))(lambda spark, d: cups_pipes.pipes(bars_of(spark, d), pivots_of(spark, d), PIPE))
query("f13_pipe_tops", pipe_sql(PIPE, False))(lambda spark, d: cups_pipes.pipes(bars_of(spark, d), pivots_of(spark, d), PIPE, bottom=False))


def _both(first: str, second: str) -> str:
    return f"SELECT * FROM ({first}) UNION ALL SELECT * FROM ({second})"


@query("g5_cups", _both(cup_sql(CUP), cup_sql(CUP, True)))
def _g5(spark, d):
    bars, raw = bars_of(spark, d), pivots_of(spark, d)
    return cups_pipes.cups_with_handle(bars, raw, CUP).unionByName(cups_pipes.inverted_cups_with_handle(bars, raw, CUP))


@query("g14_pipes", _both(pipe_sql(PIPE), pipe_sql(PIPE, False)))
def _g14(spark, d):
    bars, raw = bars_of(spark, d), pivots_of(spark, d)
    return cups_pipes.pipes(bars, raw, PIPE).unionByName(cups_pipes.pipes(bars, raw, PIPE, bottom=False))
