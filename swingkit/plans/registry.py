"""The registered queries of this package and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.operators import clean, pivots, sequences, universe
from swingkit.plans import oracle as O
from swingkit.plans.base import ORACLE, QUERIES, bars_of, pivots_of, query
from swingkit.sources import bars as source
from swingkit.sources import specs as spec_tables

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three falling peaks and three rising valleys over 3-day bars."""
    bars = clean.add_indicators(clean.clean(source.lineitem_bars(spark, sf_dir, 3)))
    keys = ("three_falling_peaks", "three_rising_valleys")
    return sequences.detect_sequences(bars, pivots.pivots(bars), spec_tables.pattern_spec(spark, {k: spec_tables.SPECS[k] for k in keys}))


# Sources, filters and cleaning.

_B = "symbol, CAST(date AS VARCHAR) AS date, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume"


@query("a1_load_bars", O.with_(O.BARS, f"SELECT {_B} FROM bars WHERE symbol IN ('1', '2', '7') AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def _a1(spark, d):
    return source.select_bars(source.lineitem_bars(spark, d), ["1", "2", "7"], "1996-01-01", "1998-12-31")


_INDEX = ", idxs AS (SELECT date, round(sum(CAST(round(close * 100) AS BIGINT)) / count(*)::DOUBLE / 100, 4) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY date)"


@query("a2_index_series", O.with_(O.BARS + _INDEX, "SELECT CAST(date AS VARCHAR) AS date, round(close, 9) AS close FROM idxs"))
def _a2(spark, d):
    return source.index_series(source.market_index(source.lineitem_bars(spark, d)), "IDX")


@query("a9_quarantine", O.with_(f"{O.BARS},{O.DAMAGED}", """SELECT symbol, reason, n_rows FROM (SELECT symbol, count(*) AS n_rows, CASE WHEN count(*) FILTER (WHERE least(open, high, low, close) > 0 AND NOT isnan(open) AND close IS NOT NULL) = 0 THEN 'no_valid_price' WHEN count(DISTINCT date) < count(*) THEN 'duplicate_dates' WHEN count(*) < 290 THEN 'too_few_rows' END AS reason FROM damaged GROUP BY symbol) WHERE reason IS NOT NULL"""))
def _a9(spark, d):
    return clean.quarantine(source.damaged(source.lineitem_bars(spark, d)), 290)


@query("b1_min_rows", O.with_(O.BARS, f"SELECT {_B} FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 290)"))
def _b1(spark, d):
    return universe.with_enough_bars(source.lineitem_bars(spark, d), 290)


@query("b2_min_rows_after_cleaning", O.with_(f"{O.BARS},{O.DAMAGED},{O.FLAGGED}", "SELECT symbol, count(*) AS n FROM flagged WHERE NOT was_null AND NOT not_positive GROUP BY symbol HAVING count(*) >= 275"))
def _b2(spark, d):
    return universe.with_enough_bars(clean.clean(source.damaged(source.lineitem_bars(spark, d))), 275).groupBy("symbol").agg(F.count("*").alias("n"))


@query("b3_drop_index_symbols", O.with_(O.BARS, "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol"))
def _b3(spark, d):
    bars = source.lineitem_bars(spark, d)
    both = bars.unionByName(source.market_index(bars))
    return universe.without_indices(both, spark.createDataFrame([("IDX",)], "index_code string")).groupBy("symbol").agg(F.count("*").alias("n"))


_MEMBERS = ", mem AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS index_code FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("b4_universe", O.with_(O.BARS + _MEMBERS, "SELECT symbol, count(*) AS n FROM bars WHERE symbol IN (SELECT ticker FROM mem WHERE index_code IN ('ASIA', 'EUROPE')) GROUP BY symbol"))
def _b4(spark, d):
    return universe.members_of(source.lineitem_bars(spark, d), source.region_membership(spark, d), ["ASIA", "EUROPE"]).groupBy("symbol").agg(F.count("*").alias("n"))


@query("b5_first_symbols", O.with_(O.BARS, f"SELECT {_B} FROM bars WHERE symbol IN (SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 5)"))
def _b5(spark, d):
    return universe.first_symbols(source.lineitem_bars(spark, d), 5)


@query("b6_date_window", O.with_(f"{O.BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS n, count(*) OVER (PARTITION BY symbol) AS c FROM bars WHERE date <= DATE '1998-06-30'), s AS (SELECT *, coalesce(min(CASE WHEN date >= DATE '1997-01-01' THEN n END) OVER (PARTITION BY symbol), c) AS f FROM n)", f"SELECT {_B} FROM s WHERE n >= f - 30"))
def _b6(spark, d):
    return universe.date_window(source.lineitem_bars(spark, d), "1997-01-01", "1998-06-30", 30)


@query("c_clean", O.with_(f"{O.BARS},{O.DAMAGED},{O.FLAGGED}, kept AS (SELECT * FROM flagged WHERE NOT was_null AND NOT not_positive),{O.POSITIONED.format(source='kept')}", f"SELECT {_B}, idx FROM pos"))
def _c(spark, d):
    return clean.clean(source.damaged(source.lineitem_bars(spark, d)))


@query("c6_cleaning_stats", O.with_(f"{O.BARS},{O.DAMAGED},{O.FLAGGED}", """SELECT symbol, count(*) AS input_rows, count(*) FILTER (WHERE was_null) AS removed_null, count(*) FILTER (WHERE was_swapped) AS fixed_high_low, count(*) FILTER (WHERE was_clamped) AS fixed_open_close, count(*) FILTER (WHERE not_positive) AS removed_non_positive, count(*) FILTER (WHERE NOT was_null AND NOT not_positive AND volume = 0) AS zero_volume, count(*) FILTER (WHERE NOT was_null AND NOT not_positive) AS output_rows FROM flagged GROUP BY symbol"""))
def _c6(spark, d):
    return clean.cleaning_stats(source.damaged(source.lineitem_bars(spark, d)))


_IND = ["typical_price", "true_range", "atr", "volume_ma", "volume_ratio", "return_pct", "range_pct"]


@query("c_indicators", O.with_(f"{O.BARS},{O.DAMAGED},{O.FLAGGED}, kept AS (SELECT * FROM flagged WHERE NOT was_null AND NOT not_positive),{O.POSITIONED.format(source='kept')},{O.INDICATORS}", f"SELECT symbol, idx, {', '.join(f'round({c}, 9) AS {c}' for c in _IND)} FROM ind"))
def _c7(spark, d):
    return clean.add_indicators(clean.clean(source.damaged(source.lineitem_bars(spark, d)))).select("symbol", "idx", *_IND)


# Pivots.

for _level, _k in pivots.LEVELS.items():
    query(f"d1_pivots_{_level}", O.with_(f"{O.CLEAN_BARS},{O.pivots(_k)}", "SELECT symbol, idx, CAST(date AS VARCHAR) AS date, round(price, 9) AS price, ptype, CAST(strength AS BIGINT) AS strength FROM raw"))(lambda spark, d, level=_level: pivots.pivots(bars_of(spark, d), level))


@query("d4_merge_runs", O.with_(f"{O.PIVOTED},{O.thinned(1)}", "SELECT symbol, idx, round(price, 9) AS price, ptype FROM m1"))
def _d4(spark, d):
    return pivots.merge_runs(pivots_of(spark, d)).select("symbol", "idx", "price", "ptype")


for _s in (2, 3, 4, 10):
    query(f"d5_thin_{_s}", O.with_(f"{O.PIVOTED},{O.thinned(_s)}", f"SELECT symbol, k, idx, round(price, 9) AS price, ptype FROM thin{_s}"))(lambda spark, d, s=_s: pivots.thin(pivots_of(spark, d), s).select("symbol", "k", "idx", "price", "ptype"))


@query("d6_alternating_prefixes", O.with_(f"{O.PIVOTED},{O.thinned(1)}", "SELECT symbol, idx, k + 1 AS n, array_to_string(list(idx) OVER (PARTITION BY symbol ORDER BY k), ',') AS idxs FROM thin1 QUALIFY k >= 4"))
def _d6(spark, d):
    return pivots.alternating_prefixes(pivots_of(spark, d))


@query("d8_price_predicates", O.with_(f"{O.PIVOTED},{O.thinned(10)}", "SELECT symbol, k, coalesce(abs(price - p2) / nullif(least(price, p2), 0) * 100 <= 0.5, FALSE) AS equal, coalesce(abs(price - p2) / nullif(least(price, p2), 0) * 100 <= 1.5, FALSE) AS near FROM (SELECT *, lead(price, 2) OVER (PARTITION BY symbol ORDER BY k) AS p2 FROM thin10)"))
def _d8(spark, d):
    from pyspark.sql import Window

    out = pivots.thin(pivots_of(spark, d)).withColumn("p2", F.lead("price", 2).over(Window.partitionBy("symbol").orderBy("k")))
    return out.select("symbol", "k", pivots.prices_near(F.col("price"), F.col("p2"), 0.5).alias("equal"), pivots.prices_near(F.col("price"), F.col("p2")).alias("near"))


# Detectors.

query("f1_double_tops", O.built_in("double_tops"))(lambda spark, d: sequences.detect_double_tops(bars_of(spark, d), pivots_of(spark, d)))
query("f2_head_and_shoulders_top", O.built_in("head_and_shoulders_top"))(lambda spark, d: sequences.detect_head_and_shoulders(bars_of(spark, d), pivots_of(spark, d)))


def detect(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    bars = bars_of(spark, sf_dir)
    return sequences.detect_sequences(bars, pivots_of(spark, sf_dir), spec_tables.pattern_spec(spark, {k: spec_tables.SPECS[k] for k in keys}))


query("f3_pivot_sequences", O.sequences(list(spec_tables.SPECS)))(lambda spark, d: detect(spark, d, list(spec_tables.SPECS)))
for _key in list(spec_tables.SPECS)[:5]:
    query(f"f3_{_key}", O.sequences([_key]))(lambda spark, d, key=_key: detect(spark, d, [key]))


from swingkit.plans import chapter_queries, cup_pipe_queries, derived_queries, pattern_queries, report_queries, run_queries, variant_queries  # noqa: E402, F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
