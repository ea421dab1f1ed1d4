"""Swing highs and lows, and their thinning to alternating pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swingkit.operators import chain

#: Bars on each side of a swing.
LEVELS = {"minor": 3, "intermediate": 5, "major": 10}
ATR_SHARE, NEARBY = 0.5, 5


def pivots(bars: DataFrame, level: str = "intermediate") -> DataFrame:
    """symbol, idx, date, price, ptype (H or L) and strength of every swing that is large enough.

    A swing's price is strictly beyond all of the level's bars on both sides, and at least half an ATR from the other
    extreme of the 5 bars around it (where the ATR is known).
    """
    k = LEVELS[level]
    w = Window.partitionBy("symbol").orderBy("idx")
    before, after, near = w.rowsBetween(-k, -1), w.rowsBetween(1, k), w.rowsBetween(-NEARBY, NEARBY)
    whole = (F.count("high").over(before) == k) & (F.count("high").over(after) == k)
    large = lambda size: F.coalesce(F.col("atr") <= 0, F.lit(True)) | (size >= F.col("atr") * ATR_SHARE)
    marked = bars.select(
        "symbol", "idx", "date", "high", "low", "atr",
        (whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)) & large(F.col("high") - F.min("low").over(near))).alias("is_high"),
        (whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)) & large(F.max("high").over(near) - F.col("low"))).alias("is_low"),
    ).filter("is_high or is_low")
    both = F.filter(F.array(F.struct(F.col("is_high").alias("ok"), F.lit("H").alias("ptype"), F.col("high").alias("price")), F.struct(F.col("is_low").alias("ok"), F.lit("L").alias("ptype"), F.col("low").alias("price"))), lambda x: x["ok"])
    return marked.withColumn("p", F.explode(both)).select("symbol", "idx", "date", F.col("p.price").alias("price"), F.col("p.ptype").alias("ptype"), F.lit(k).alias("strength"))


def merge_runs(found: DataFrame) -> DataFrame:
    """The most extreme pivot (the first, if tied) of every run of one type."""
    w = Window.partitionBy("symbol").orderBy("idx", "ptype")
    runs = found.withColumn("new", F.coalesce((F.col("ptype") != F.lag("ptype").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    signed = F.when(F.col("ptype") == "H", F.col("price")).otherwise(-F.col("price"))
    best = F.max_by(F.struct("idx", "date", "price", "ptype", "strength"), F.struct(signed, -F.col("idx")))
    return runs.groupBy("symbol", "run").agg(best.alias("p")).select("symbol", "p.*")


def thin(found: DataFrame, spacing: int = 10) -> DataFrame:
    """Alternating pivots at least ``spacing`` bars apart, with their number ``k`` in the symbol."""
    return thin_all(found, [spacing]).drop("spacing")


def thin_all(found: DataFrame, spacings: list[int], segment: int = chain.SEGMENT) -> DataFrame:
    """:func:`thin` for several spacings in one plan, with the column ``spacing``.

    In order, a pivot that is too close to the last kept one is dropped unless it is stronger, and of two of one type the
    more extreme stays. So the next kept pivot depends on the last one alone, and since the types take turns it is among the
    2 x spacing + 1 that follow: a window finds every pivot's successor, and :func:`chain.followed` the ones that are met.
    A pivot that its successor replaces isn't kept.
    """
    order = Window.partitionBy("symbol").orderBy("idx", "rank")
    ranked = merge_runs(found).withColumn("rank", F.when(F.col("ptype") == "H", 0).otherwise(1)).withColumn("k", F.row_number().over(order) - 1)
    ahead = F.collect_list(F.struct("k", "idx", "ptype", "price", "strength")).over(order.rowsBetween(1, 2 * max(spacings) + 1))
    asked = ranked.withColumn("ahead", ahead).withColumn("spacing", F.explode(F.lit(spacings)))

    def beyond(p: Column) -> Column:
        return F.when(F.col("ptype") == "H", p["price"] > F.col("price")).otherwise(p["price"] < F.col("price"))

    def replaces(p: Column) -> Column:
        return F.when(p["ptype"] == F.col("ptype"), beyond(p)).otherwise((p["idx"] - F.col("idx") < F.col("spacing")) & (p["strength"] > F.col("strength")))

    follows = lambda p: (p["ptype"] != F.col("ptype")) & (p["idx"] - F.col("idx") >= F.col("spacing"))
    # Most successors are among the first few, so the rest are looked at only where they have none.
    among = lambda n: F.get(F.filter(F.slice("ahead", 1, n), lambda p: replaces(p) | follows(p)), F.lit(0))
    asked = asked.withColumn("next", F.coalesce(among(4), among(2 * F.col("spacing") + 1)))
    kept = F.col("next").isNull() | follows(F.col("next"))
    nodes = asked.select("symbol", "spacing", "k", F.col("next.k").alias("nxt"), F.struct("idx", "date", "price", "ptype", "strength", "rank", kept.alias("kept")).alias("value"))
    met = chain.followed(nodes, ["symbol", "spacing"], segment).select("symbol", "spacing", "value.*").filter("kept")
    again = Window.partitionBy("symbol", "spacing").orderBy("idx", "rank")
    return met.select("symbol", "spacing", (F.row_number().over(again) - 1).alias("k"), "idx", "date", "price", "ptype", "strength")


def numbered(found: DataFrame) -> DataFrame:
    """Raw pivots with their number ``k`` in the symbol, a high before a low of the same bar."""
    return found.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("idx", "ptype")) - 1)


def alternating_prefixes(found: DataFrame, least: int = 5) -> DataFrame:
    """For every pivot from the ``least``-th kept on, the alternating sequence up to it: symbol, idx, n and idxs."""
    thinned = thin(found, 1)
    w = Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return thinned.select("symbol", "idx", (F.col("k") + 1).alias("n"), F.collect_list("idx").over(w).alias("idxs")).filter(F.col("n") >= least)


def prices_near(a, b, tolerance_pct: float = 1.5):
    """Whether two price columns differ by at most the tolerance, as a share of the smaller; never for a zero."""
    return F.coalesce(F.abs(a - b) / F.nullif(F.least(a, b), F.lit(0.0)) * 100 <= tolerance_pct, F.lit(False))
