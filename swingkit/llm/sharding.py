"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``cells`` positions, and a row belongs to the first point at or
after the position of its key. A shard keeps its rows in ring order up to its capacity; the rows beyond it go on
clockwise, past full shards, to the first shards with room. Capacities differ by at most one row, so the balance is
exact, and a row leaves its own shard only if that shard overflows.

Only counts a cell (at most ``cells`` rows, whatever the input) decide the walk: rows are ranked within their cell by
one shuffle of narrow rows, and joined with the bounded table of the pieces that the walk has cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swingkit.llm.common import checkpointed, table

SHARDS, VNODES, CELLS = 24, 64, 1 << 14

#: The walk over the arcs, twice round: what a shard can't keep is offered clockwise, the oldest overflow first.
_WALK = """
aggregate(
  concat(arcs, transform(arcs, x -> named_struct('arc', x.arc, 'shard', x.shard, 'spilt', 0L))),
  named_struct('waiting', 0L, 'done', 0L, 'room', room,
               'cuts', cast(array() as array<struct<lo: bigint, shard: int, slot: bigint>>)),
  (acc, x) -> named_struct(
    'waiting', acc.waiting + x.spilt - least(acc.waiting + x.spilt, get(acc.room, x.shard)),
    'done', acc.done + least(acc.waiting + x.spilt, get(acc.room, x.shard)),
    'room', transform(acc.room, (r, i) -> if(i = x.shard, r - least(acc.waiting + x.spilt, r), r)),
    'cuts', if(least(acc.waiting + x.spilt, get(acc.room, x.shard)) > 0,
               concat(acc.cuts, array(named_struct('lo', acc.done, 'shard', x.shard,
                                                   'slot', get(caps, x.shard) - get(acc.room, x.shard)))),
               acc.cuts)),
  acc -> acc.cuts)
"""


def ring(spark: SparkSession, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """One row for each of the ``cells`` positions: ``cell``, ``arc`` (0 is the first after the start) and ``shard``."""
    points = (
        spark.range(shards * vnodes)
        .select(
            (F.col("id") % shards).cast("int").alias("shard"),
            F.pmod(F.xxhash64(F.concat_ws("#", F.lit("shard"), F.col("id") % shards, F.expr(f"id div {shards}"))), F.lit(cells)).alias("cell"),
        )
        .groupBy("cell")
        .agg(F.min("shard").alias("shard"))
    )
    clockwise = Window.orderBy("cell")
    return (
        spark.range(cells)
        .withColumnRenamed("id", "cell")
        .join(points, "cell", "left")
        .withColumn("arc", F.count("shard").over(clockwise.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("shard", F.last("shard", ignorenulls=True).over(Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("shard", F.coalesce("shard", F.first("shard").over(clockwise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    )


def place(rows: DataFrame, key: str, order: list[str], shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """``rows`` plus ``shard`` (int), ``slot`` (long, gapless from 0 in a shard) and ``moved`` (not in its own shard).

    Null keys are spread by the ``order`` columns. Rows of equal key and ``order`` columns take consecutive ranks in
    any order. Columns of these three names are replaced. An empty table stays empty.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("shard", "slot", "moved")]
    spread = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string"))).otherwise(F.xxhash64(*(order or [key])))
    placed = checkpointed(
        rows.select(F.struct(*kept).alias("row"), spread.alias("hash"), F.struct(key, *order).alias("tie")).withColumn("cell", F.pmod("hash", F.lit(cells)))
    )
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = (
        ring(spark, shards, vnodes, cells)
        .join(placed.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("in_arc", F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("before", F.coalesce(F.sum("n").over(whole), F.lit(0)))
    )
    by_cell = checkpointed(by_cell)
    total = by_cell.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    capacity = (F.expr(f"{total} div {shards}") + F.when(F.col("shard") < total % shards, 1).otherwise(0)).cast("long")
    home = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    arcs = (
        by_cell.groupBy("arc", "shard")
        .agg(F.sum("n").alias("n"))
        .withColumn("slot", F.coalesce(F.sum("n").over(home), F.lit(0)))
        .withColumn("own", F.greatest(F.lit(0), F.least(F.col("n"), capacity - F.col("slot"))))
        .withColumn("spilt", F.col("n") - F.col("own"))
        .withColumn("spilt_before", F.coalesce(F.sum("spilt").over(Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    loads = (
        spark.range(shards).select(F.col("id").cast("int").alias("shard")).withColumn("cap", capacity)
        .join(arcs.groupBy("shard").agg(F.sum("own").alias("own")), "shard", "left")
        .agg(F.array_sort(F.collect_list(F.struct("shard", "cap", (F.col("cap") - F.coalesce("own", F.lit(0))).alias("room")))).alias("s"))
        .select(F.col("s.cap").alias("caps"), F.col("s.room").alias("room"))
    )
    cuts = (
        arcs.agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "spilt"))).alias("arcs"))
        .select("arcs", loads.select("caps").scalar().alias("caps"), loads.select("room").scalar().alias("room"))
        .selectExpr(f"inline({_WALK})")
    )
    # The starts of the arcs' overflow and of the accepted runs, in one order, cut it into pieces that have one of each.
    in_order = Window.orderBy("lo", "kind").rowsBetween(Window.unboundedPreceding, 0)
    starts = arcs.filter("spilt > 0").select(
        F.col("spilt_before").alias("lo"), F.lit(0).alias("kind"), F.struct("arc", "own", F.col("spilt_before").alias("at"), "spilt").alias("a"), F.lit(None).cast("struct<lo: bigint, shard: int, slot: bigint>").alias("c")
    )
    pieces = (
        starts.unionByName(cuts.select("lo", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["a"].dataType).alias("a"), F.struct("lo", "shard", "slot").alias("c")))
        .withColumn("a", F.last("a", ignorenulls=True).over(in_order))
        .withColumn("c", F.last("c", ignorenulls=True).over(in_order))
        .withColumn("hi", F.lead("lo").over(Window.orderBy("lo", "kind")))
        .withColumn("hi", F.least(F.coalesce("hi", F.col("a.at") + F.col("a.spilt")), F.col("a.at") + F.col("a.spilt")))
        .filter("hi > lo")
        .select(
            F.col("a.arc").alias("arc"),
            (F.col("a.own") + F.col("lo") - F.col("a.at")).alias("from"),
            (F.col("a.own") + F.col("hi") - F.col("a.at")).alias("to"),
            F.col("c.shard").alias("shard"),
            (F.col("c.slot") + F.col("lo") - F.col("c.lo")).alias("slot"),
            F.lit(True).alias("moved"),
        )
        .unionByName(arcs.filter("own > 0").select("arc", F.lit(0).cast("long").alias("from"), F.col("own").alias("to"), "shard", "slot", F.lit(False).alias("moved")))
    )
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("hash", "tie")) - 1)
    return (
        ranked.join(F.broadcast(by_cell.select("cell", "arc", "in_arc")), "cell")  # at most `cells` rows
        .withColumn("rank", F.col("rank") + F.col("in_arc"))
        .join(F.broadcast(pieces.alias("p")), (F.col("p.arc") == by_cell["arc"]) & (F.col("rank") >= F.col("p.from")) & (F.col("rank") < F.col("p.to")))  # a few pieces for each point of the ring
        .select("row.*", F.col("p.shard").cast("int").alias("shard"), (F.col("p.slot") + F.col("rank") - F.col("p.from")).cast("long").alias("slot"), F.col("p.moved"))
    )


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards under the law ``rows``: counts at most one apart.

    A null text counts as 8 bytes and as the CRC of no bytes.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    return place(sized, "doc_id", ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved"
    )
