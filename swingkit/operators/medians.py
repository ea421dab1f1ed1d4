"""Exact medians of groups of any size.

``F.median`` holds every distinct value of a group in one task. Here an approximate percentile, whose error in rank is bounded,
first brackets each group's middle; then one pass counts what lies below and above the bracket and the values inside it. Both
passes aggregate before they shuffle, and only the bracket's values, a share of ``2 * MARGIN / ACCURACY`` of a group, meet in a task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Percentiles are off by at most 1 / ACCURACY of a group's rows; the bracket is MARGIN times that on both sides.
ACCURACY, MARGIN = 10_000, 10
#: Groups (times columns) whose brackets are broadcast; beyond that the join is shuffled.
MOST_GROUPS = 10_000


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal to each other, with the left table's keys."""
    named = {k: f"_right_{k}" for k in keys}
    pairs = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()))
    return left.join(right.withColumnsRenamed(named), pairs, how).drop(*named.values())


def medians(frame: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """``by`` and the exact median of each of ``columns`` under its name, a row for every group that has a value of any.

    Nulls of a column take no part; a column without values has no median. Null keys are a group. Without ``by``: one row, always.
    The median of an even number of values is the mean of the middle two; NaN counts as the greatest value. The brackets are worked out at once.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("_of"), c.cast("double").alias("_x")) for name, c in columns.items()])
    values = frame.select(*by, F.inline(pairs)).filter("_x is not null")
    keys = [*by, "_of"]
    ends = [F.lit(0.5 - MARGIN / ACCURACY), F.lit(0.5 + MARGIN / ACCURACY)]
    brackets = values.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", F.array(*ends), F.lit(ACCURACY)).alias("_p"))
    few = brackets.limit(MOST_GROUPS + 1).collect()
    if len(few) <= MOST_GROUPS:
        brackets = F.broadcast(frame.sparkSession.createDataFrame(few, brackets.schema))
    inside = joined(values, brackets, keys).select(*keys, "_n", "_x", F.col("_p")[0].alias("_a"), F.col("_p")[1].alias("_b"))
    side = F.when(F.col("_x") < F.col("_a"), -1).when(F.col("_x") > F.col("_b"), 1).otherwise(0)
    inside = inside.withColumns({"_side": side, "_v": F.when(side == 0, F.col("_x"))})
    counts = inside.groupBy(*keys, "_n", "_side", "_v").agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))

    def at(rank: Column) -> Column:
        # Of the rows beside the bracket only the nearest one's value is known.
        known = F.when((F.col("_side") == -1) & (rank < F.col("_upto")) | (F.col("_side") == 1) & (rank > F.col("_before") + 1), F.raise_error(F.lit("a bracket missed its median")).cast("double"))
        value = known.when(F.col("_side") == -1, F.col("_most")).otherwise(F.col("_least"))
        return F.max(F.when((F.col("_before") < rank) & (rank <= F.col("_upto")), value))

    middle = ranked.groupBy(*keys).agg(at(F.floor((F.col("_n") + 1) / 2)).alias("_lower"), at(F.floor(F.col("_n") / 2) + 1).alias("_upper"))
    middle = middle.withColumn("_m", F.when(F.col("_lower") == F.col("_upper"), F.col("_lower")).otherwise(F.col("_lower") / 2 + F.col("_upper") / 2))
    return middle.groupBy(*by).agg(*[F.max(F.when(F.col("_of") == name, F.col("_m"))).alias(name) for name in columns])


def with_medians(sums: DataFrame, frame: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """Aggregates ``sums`` of ``frame`` by ``by``, plus the medians of its groups."""
    found = medians(frame, by, columns)
    if not by:
        row = found.select(F.struct(*columns)).scalar()
        return sums.select("*", *[row[c].alias(c) for c in columns])
    return joined(sums, found, by, "left")
