"""Symbols too long for one task: positions and windows over parts of a symbol.

:func:`positioned` numbers a symbol's bars by period, and :func:`in_cells` applies any transform with windows over a symbol to cells
of consecutive positions, each with copies of the bars beside it that its windows reach. Results are those of the whole symbol.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swingkit.operators.medians import joined

#: Positions of a cell.
CELL = 4096


def positioned(bars: DataFrame, order: list[str], period: str = "year") -> DataFrame:
    """``bars`` with ``idx``, 0 to N - 1 in each symbol in the order of ``date`` (nulls first) and then ``order``.

    Bars are numbered within the symbol's period (a unit of ``date_trunc``), after the count of all earlier ones; only the counts, a
    row a period, meet by symbol. Equal rows get their numbers in any order.
    """
    dealt = bars.withColumn("_period", F.date_trunc(period, "date"))
    counts = dealt.groupBy("symbol", "_period").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("symbol").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("symbol", "_period", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("symbol", "_period").orderBy("date", *order)) - 1
    out = joined(dealt.withColumn("_number", number), offsets, ["symbol", "_period"])
    return out.withColumn("idx", (F.col("_before") + F.col("_number")).cast("int")).drop("_period", "_number", "_before")


def in_cells(bars: DataFrame, transform: Callable[[DataFrame], DataFrame], before: int, after: int, cell: int = CELL) -> DataFrame:
    """``transform(bars)`` for a transform that partitions by ``symbol``, keeps ``symbol`` and ``idx``, and looks at most ``before``
    positions back and ``after`` ahead.

    The symbol that the transform sees is the pair of symbol and cell, so every window is over a cell and its margins. A bar is
    copied to each cell whose margin it lies in, and what the transform gives for copies is dropped.
    """
    first, last = F.greatest(F.lit(0), F.floor((F.col("idx") - after) / cell)), F.floor((F.col("idx") + before) / cell)
    dealt = bars.withColumn("_cell", F.explode(F.sequence(first, last)))
    dealt = dealt.withColumn("symbol", F.struct("symbol", F.col("_cell").alias("cell"))).drop("_cell")
    out = transform(dealt)
    return out.filter(F.floor(F.col("idx") / cell) == F.col("symbol.cell")).withColumn("symbol", F.col("symbol.symbol"))
