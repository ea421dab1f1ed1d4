"""Steps of which each is found from the last one alone, in groups of any length.

A greedy pass over a symbol (thinned pivots, islands that skip ahead) is a walk over a graph in which every row knows its
successor. The rows of a group are cut into segments of ``SEGMENT``. A segment works out where it is left for each row at
which it can be entered; a walk over these few entries finds those that are met, and each segment then lists its own
rows from there. No row holds more than a segment, or the entries of one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swingkit.sources.sinks import stored

SEGMENT = 256
#: The successor of a last row.
END = (1 << 62) - 1


def followed(nodes: DataFrame, group: list[str], segment: int = SEGMENT) -> DataFrame:
    """The ``group`` columns and the ``value`` of all rows that are met from a group's first row on.

    ``nodes`` has the group, ``k`` (0, 1, ... without a gap), ``nxt`` (the next row's k, greater than k; null, or a k that no row
    has, at an end) and ``value``.
    """
    at = lambda k: F.expr(f"{k} div {segment}")
    rows = nodes.select(*group, F.col("k").cast("bigint").alias("k"), F.coalesce(F.col("nxt").cast("bigint"), F.lit(END)).alias("nxt"), "value")
    node = F.struct(at("k").alias("seg"), F.struct("k", "nxt", "value").alias("node"), F.when(F.col("k") == 0, F.lit(0).cast("bigint")).alias("entry"))
    entry = F.when((F.col("nxt") < END) & (at("nxt") > at("k")), F.struct(at("nxt").alias("seg"), F.lit(None).cast(rows.select(F.struct("k", "nxt", "value")).schema[0].dataType).alias("node"), F.col("nxt").alias("entry")))
    both = rows.select(*group, F.explode(F.array_compact(F.array(node, entry))).alias("x")).select(*group, "x.*")
    folded = both.groupBy(*group, "seg").agg(F.array_sort(F.collect_list("node"), lambda a, b: (a["k"] - b["k"]).cast("int")).alias("nodes"), F.collect_set("entry").alias("entries"))
    folded = stored(folded)  # both the hops and the rows that are met come of it
    inside, following = f"cur - seg * {segment} < size(nodes)", f"get(nodes, cast(cur - seg * {segment} as int)).nxt"
    left = F.expr(f"transform(entries, e -> struct(e as entry, aggregate(nodes, e, (cur, x) -> if({inside}, {following}, cur)) as exit))")
    hops = folded.select(*group, F.explode(left).alias("hop")).groupBy(*group).agg(F.array_sort(F.collect_list("hop")).alias("hops"))
    met = F.expr("aggregate(hops, struct(0L as cur, cast(array() as array<bigint>) as met), (a, h) -> if(h.entry = a.cur, struct(h.exit as cur, array_append(a.met, h.entry) as met), a), a -> a.met)")
    entered = hops.select(*[F.col(g).alias(f"_{g}") for g in group], F.explode(met).alias("entry")).withColumn("_seg", at("entry"))
    same = F.col("seg") == F.col("_seg")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    whole = folded.drop("entries").join(entered, same)
    inside, here = f"a.cur - seg * {segment} < size(nodes)", f"cast(a.cur - seg * {segment} as int)"
    own = F.expr(f"aggregate(nodes, struct(entry as cur, cast(array() as array<int>) as met), (a, x) -> if({inside}, struct(get(nodes, {here}).nxt as cur, array_append(a.met, {here}) as met), a), a -> a.met)")
    return whole.select(*group, "nodes", F.explode(own).alias("place")).select(*group, F.get("nodes", F.col("place"))["value"].alias("value"))
