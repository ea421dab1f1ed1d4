"""The last value of a series on or before a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of time that the series is cut into.
CELLS = 256


def as_of(asked: DataFrame, series: DataFrame, at: str, value: str, cells: int = CELLS) -> DataFrame:
    """``asked`` plus ``value``: that of the last row of ``series`` whose ``at`` is on or before its own; null where there is none.

    ``at`` is a date or timestamp in both. The series' quantiles cut time into ranges, and rows meet in the range of their
    time; the value at a range's start, that of the last range before it with a row, comes from a list of at most
    ``cells`` values. Rows of the series without a value are left out; of several at one time the greatest counts. Many asked
    rows of one time should be made one before.
    """
    known = series.select(at, F.col(value).alias("_value")).filter(F.col(at).isNotNull() & F.col("_value").isNotNull())
    seconds = F.col(at).cast("timestamp").cast("double")
    bounds = sorted(set(known.select(seconds.alias("t")).approxQuantile("t", [k / cells for k in range(1, cells)], 0.001))) if cells > 1 else []
    cell = F.size(F.filter(F.lit(bounds), lambda b: b <= seconds)) if bounds else F.lit(0)
    lasts = dict(known.groupBy(cell.alias("cell")).agg(F.max_by("_value", F.struct(at, "_value"))).collect())  # at most a row a range
    carried: list = [None]
    for k in range(len(bounds)):
        carried.append(lasts.get(k, carried[-1]))
    kind = series.schema[value].dataType

    def start(k: Column) -> Column:
        return F.get(F.array(*(F.lit(v).cast(kind) for v in carried)), k)

    rows = asked.select(F.col(at).alias("_at"), F.struct(*asked.columns).alias("_row"), F.lit(1).alias("_kind"), cell.alias("_cell"))
    both = rows.unionByName(known.select(F.col(at).alias("_at"), F.lit(0).alias("_kind"), cell.alias("_cell"), "_value"), allowMissingColumns=True)
    upto = Window.partitionBy("_cell").orderBy("_at", "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.coalesce(F.last("_value", ignorenulls=True).over(upto), start(F.col("_cell")))).filter("_kind = 1")
    return found.select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_found")).alias(value))
