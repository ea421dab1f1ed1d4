"""Greedy resolution of detections whose bars overlap."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swingkit.sources.sinks import stored


class Disjoint:
    """Intervals that don't touch each other, in order."""

    def __init__(self) -> None:
        self.lows: list[int] = []
        self.highs: list[int] = []

    def add(self, low: int, high: int) -> bool:
        """Adds an interval unless it touches one that is there: the last that begins at or before its end."""
        at = bisect_right(self.lows, high)
        if at and self.highs[at - 1] >= low:
            return False
        self.lows.insert(at, low)
        self.highs.insert(at, high)
        return True


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of symbol, part and choice; one part's chosen intervals are held at a time."""
    at, chosen = None, Disjoint()
    for batch in batches:
        ids = []
        for symbol, part, low, high, pattern_id in zip(batch["symbol"], batch["part"], batch["lo"], batch["hi"], batch["id"], strict=True):
            if (symbol, part) != at:
                at, chosen = (symbol, part), Disjoint()
            if chosen.add(low, high):
                ids.append((symbol, pattern_id))
        yield pd.DataFrame(ids, columns=["symbol", "pattern_id"])


def resolve_overlaps(detections: DataFrame, policy: str = "scan") -> DataFrame:
    """Detections left when, in order, each one is kept unless its pivots' interval touches a kept one of its symbol.

    Order of ``scan``: longest interval, confirmed, highest confidence, name, id; of ``report``: widest, highest
    confidence, name, id. Rows without pivots stay. ``none`` keeps all.

    A sweep over each symbol's intervals, with the greatest end so far, cuts it into parts that don't touch; an interval
    that is a part of its own stays. The rows of other parts stream through in their order of choice, and a search in the
    part's chosen intervals decides on each.
    """
    if policy == "none":
        return detections
    low, high = F.array_min("pivot_indices").cast("int"), F.array_max("pivot_indices").cast("int")
    confirmed = (F.col("breakout_date").isNotNull() & F.col("breakout_price").isNotNull()).cast("int")
    confidence = F.coalesce("confidence_score", F.lit(0))
    order = [-(high - low), -confirmed, -confidence] if policy == "scan" else [-F.coalesce("pattern_width_bars", F.lit(0)), -confidence]
    keys = [c.alias(f"o{k}") for k, c in enumerate([*order, F.col("pattern_name")])]
    bound = detections.filter(low.isNotNull()).select("symbol", *keys, F.col("pattern_id").alias("id"), low.alias("lo"), high.alias("hi"))
    sweep = Window.partitionBy("symbol").orderBy("lo", "hi", "id")
    before = F.max("hi").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    parts = bound.withColumn("new", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(sweep)).withColumn("alone", (F.col("new") == 1) & F.coalesce(F.lead("lo").over(sweep) > F.col("hi"), F.lit(True)))
    parts = stored(parts)
    names = [f"o{k}" for k in range(len(keys))]
    met = parts.filter("not alone").repartition("symbol", "part").sortWithinPartitions("symbol", "part", *names, "id", "lo", "hi")
    chosen = met.select("symbol", "part", "lo", "hi", "id").mapInPandas(_choose, "symbol string, pattern_id string")
    kept = parts.filter("alone").select("symbol", F.col("id").alias("pattern_id")).unionByName(chosen)
    return detections.join(kept, ["symbol", "pattern_id"], "left_semi").unionByName(detections.filter(low.isNull()))
