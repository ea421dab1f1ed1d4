"""Exact top-k inner products by block-at-a-time pruning.

Rows are put in an order in which neighbours are alike (their nearest of a few centres fitted on a bounded sample, then
vec_id), cut into ranges of about ``CELL_VALUES`` components, and a range into blocks of ``BLOCK`` with the largest and smallest value
of every dimension (the terms). The summed maxima of a query bound what a range or a block can score.

First every query visits the range of its best bound, which gives it a k-th score to beat. Then it goes only to the
ranges whose bound reaches that score, and in a range it goes through the blocks, the best bound first, scoring them
through their forward index until the bounds fall below its k-th score. Rows stay where they are: queries travel to the
ranges, streaming past one range's bounded matrix at a time, and a range that very many queries need is copied once for
every ``RANGE_QUERIES`` of them. The bounds of ranges are worked out in blocks of ranges and queries too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swingkit.llm.common import bounded, checkpointed, small_batches, table

K, STEP = 5, 50
CELL_VALUES, BLOCK = 1 << 19, 128
#: Queries for which one copy of a range is made, and queries and ranges whose bounds are one task's work.
RANGE_QUERIES, GROUP_QUERIES, GROUP_RANGES = 262_144, 8192, 8192
#: Rows of the sample that centres are fitted on, the centres at most, and the rounds of fitting.
SAMPLE, CENTRES, ROUNDS = 4096, 128, 6
#: Up to so many ranges are broadcast with their numbers of queries; more are joined by a shuffle.
MOST_RANGES = 500_000
_EXACT = 2.0**53


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, floor(256 x) of every component; null vectors and those with a null or non-finite component are left out."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(fine & F.col(key).isNotNull()).select(F.col(key).alias("vec_id"), whole.alias("v"))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the rows of ``a`` and ``b``: in doubles where all sums stay below 2**53, else in 64-bit integers."""
    most = float(np.abs(a.astype(float)).sum(axis=1).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What each query can score at most among rows between ``low`` and ``high``; above the true maximum by rounding at most."""
    q = queries.astype(float)
    found = np.maximum(q, 0) @ high.astype(float).T + np.minimum(q, 0) @ low.astype(float).T
    return np.where(np.abs(found) < _EXACT, found, found + np.abs(found) * 1e-12)


class Range:
    """The rows of one range in blocks, with the extremes of every block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK) -> None:
        self.ids, self.rows, self.block = ids, rows, block
        starts = range(0, len(ids), block)
        self.high = np.array([rows[s : s + block].max(axis=0) for s in starts])
        self.low = np.array([rows[s : s + block].min(axis=0) for s in starts])
        self.scored = self.met = 0  # (query, block) pairs that were scored, and all that were met

    def best(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, vec_id and score of every query's k best rows other than those of its own id, ties to the smaller id.

        Rows that score less than the query's ``floor`` may be missing.
        """
        upper = bounds(queries, self.high, self.low)
        visit = np.argsort(-upper, axis=1, kind="stable")
        n, none = len(queries), np.iinfo(np.int64).min
        top_scores, top_ids = np.full((n, k), none), np.full((n, k), np.iinfo(np.int64).max)
        everyone, open_ = np.arange(n), np.ones(n, bool)
        self.met += upper.size
        for step in range(upper.shape[1]):
            now = visit[:, step]
            open_ &= upper[everyone, now] >= np.maximum(top_scores[:, -1], floor)  # an equal score may have a smaller id
            if not open_.any():
                break
            for b in np.unique(now[open_]):
                q = np.flatnonzero(open_ & (now == b))
                self.scored += len(q)
                own = self.ids[b * self.block : (b + 1) * self.block]
                scores = products(queries[q], self.rows[b * self.block : (b + 1) * self.block])
                beside = query_ids[q][:, None] == own
                all_scores = np.concatenate([top_scores[q], np.where(beside, none, scores)], axis=1)
                all_ids = np.concatenate([top_ids[q], np.where(beside, np.iinfo(np.int64).max, own)], axis=1)
                best = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
                top_scores[q], top_ids[q] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
        found = top_ids != np.iinfo(np.int64).max
        return np.repeat(everyone, found.sum(axis=1)), top_ids[found], top_scores[found]


def centres(rows: DataFrame, n_rows: int) -> dict[int, np.ndarray]:
    """For each width, a chain of up to CENTRES points fitted by Lloyd's rounds on a sample of at most SAMPLE rows by hash of vec_id."""
    order = F.xxhash64("vec_id")
    some = rows.filter(F.pmod(order, F.lit(max(1, n_rows // (4 * SAMPLE)))) == 0).orderBy(order).limit(SAMPLE).select("v").toPandas()["v"]
    out = {}
    for width in {len(v) for v in some} - {0}:
        points = np.stack([v for v in some if len(v) == width]).astype(float)
        now = points[:: max(1, len(points) // CENTRES)][:CENTRES]
        for _ in range(ROUNDS):
            near = nearest(points, now)
            now = np.stack([points[near == c].mean(axis=0) if (near == c).any() else now[c] for c in range(len(now))])
        out[width] = chain(now)
    return out


def chain(points: np.ndarray) -> np.ndarray:
    """The points, each followed by the nearest of those left, so that ranges of several centres hold like rows."""
    order, left = [0], list(range(1, len(points)))
    while left:
        order.append(left.pop(int(nearest(points[order[-1:]], points[left])[0])))
    return points[order]


def nearest(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.argmin((to * to).sum(axis=1) - 2 * points @ to.T, axis=1)


def placed(rows: DataFrame, cell_values: int = CELL_VALUES) -> DataFrame:
    """Every row with the ``range`` that it lies in and its ``width``, in a table of one partition a range."""
    spark = rows.sparkSession
    totals = rows.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("values")).first()
    held = spark.sparkContext.broadcast(centres(rows, totals["n"]))

    def centre(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            widths, out = batch.map(len).to_numpy(), np.zeros(len(batch), np.int32)
            for width in set(widths.tolist()) & set(held.value):
                out[widths == width] = nearest(np.stack(batch[widths == width].to_list()).astype(float), held.value[width])
            yield pd.Series(out)

    ranges = max(1, -(-(totals["values"] or 0) // cell_values))
    # The last key splits rows of one id; it is fixed by the input's partitions.
    keyed = rows.select("vec_id", "v", F.size("v").alias("width"), F.pandas_udf(centre, "int")("v").alias("centre"), F.monotonically_increasing_id().alias("_n"))
    return checkpointed(keyed.repartitionByRange(ranges, "width", "centre", "vec_id", "_n").select(F.spark_partition_id().alias("range"), "width", "vec_id", "v"))


def extremes(ranges: DataFrame) -> DataFrame:
    """The greatest and least value of every dimension in each range: range, width, high, low."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (cell, width), own in batch.groupby(["range", "width"]):
                v = matrix(own["v"])
                yield pd.DataFrame({"range": [cell], "width": [width], "high": [v.max(axis=0)], "low": [v.min(axis=0)]})

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        return own.head(1).assign(high=[np.stack(own["high"]).max(axis=0)], low=[np.stack(own["low"]).min(axis=0)])

    schema = "range int, width int, high array<long>, low array<long>"
    return ranges.select("range", "width", "v").mapInPandas(parts, schema).groupBy("range", "width").applyInPandas(whole, schema)


def reached(queries: DataFrame, summaries: DataFrame, n_queries: int, n_ranges: int, first: bool) -> DataFrame:
    """qid and range of what a query's bound lets it visit: the range of the best bound (``first``), or all but its
    ``first`` one whose bounds reach its ``floor``. Ranges and queries meet in groups of bounded size."""
    sides = (max(1, -(-n_queries // GROUP_QUERIES)), max(1, -(-n_ranges // GROUP_RANGES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    columns = ["qid", "width", "v"] if first else ["qid", "width", "v", "floor", "first"]
    left = queries.select(*columns, dealt("qid", sides[0]).alias("a"), every(sides[1]).alias("b"))
    right = summaries.select("*", every(sides[0]).alias("a"), dealt("range", sides[1]).alias("b"))

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"qid": [], "range": [], "bound": []})
        upper, qid, cell = bounds(matrix(q["v"]), matrix(r["high"]), matrix(r["low"])), q["qid"].to_numpy(), r["range"].to_numpy()
        if first:
            best = upper.argmax(axis=1)
            return pd.DataFrame({"qid": qid, "range": cell[best], "bound": upper.max(axis=1)})
        i, j = np.nonzero((upper >= q["floor"].to_numpy()[:, None]) & (q["first"].to_numpy()[:, None] != cell))
        return pd.DataFrame({"qid": qid[i], "range": cell[j], "bound": upper[i, j]})

    keys = ["a", "b", "width"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "qid long, range int, bound double")
    return found.groupBy("qid").agg(F.max_by("range", "bound").alias("range")) if first else found.select("qid", "range")


def visited(ranges: DataFrame, queries: DataFrame, pairs: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """qid, query_id, vec_id and score of the best that every query (qid, vec_id, width, v, floor) finds in its ranges (qid, range)."""
    asked = pairs.join(queries, "qid").select("range", "width", "qid", "vec_id", "floor", "v")
    copies = bounded(checkpointed(asked.groupBy("range", "width").agg(F.ceil(F.count("*") / RANGE_QUERIES).cast("int").alias("copies"))), MOST_RANGES)
    keys = ["range", "width", "copy"]
    rows = ranges.join(copies, ["range", "width"]).select("range", "width", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("qid"), "vec_id", F.lit(0).cast("long").alias("floor"), "v")
    right = asked.join(copies, ["range", "width"]).select("range", "width", F.pmod(F.xxhash64("qid"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "qid", "vec_id", "floor", "v")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, vectors, cell = None, [], [], None
        for batch in batches:
            for key, own in batch.groupby([*keys, "kind"], sort=False):
                if key[:3] != at:
                    at, ids, vectors, cell = key[:3], [], [], None
                if key[3] == 0:
                    ids.append(own["vec_id"].to_numpy()), vectors.append(matrix(own["v"]))
                    continue
                if cell is None:
                    ids, vectors = np.concatenate(ids), np.concatenate(vectors)
                    order = np.argsort(ids, kind="stable")
                    cell, vectors = Range(ids[order], vectors[order], block), []
                place, vec_id, score = cell.best(own["vec_id"].to_numpy(), matrix(own["v"]), own["floor"].to_numpy(), k)
                yield pd.DataFrame({"qid": own["qid"].to_numpy()[place], "query_id": own["vec_id"].to_numpy()[place], "vec_id": vec_id, "score": score})

    both = rows.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return both.mapInPandas(search, "qid long, query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, cell_values: int = CELL_VALUES, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows of each query; both have ``vec_id`` and ``v``.

    A query's own are the rows of its vec_id, however many; every query row has ranks of its own, so those of a repeated id
    appear once for each of its rows. Vectors meet only vectors of their width. Scores are 64-bit integers; components
    beyond that range are held at its ends, and sums beyond it wrap.
    """
    small_batches(rows.sparkSession, 4096)
    ranges = placed(rows, cell_values)
    least = F.lit(np.iinfo(np.int64).min).cast("long")
    asked = checkpointed(queries.select("vec_id", "v", F.size("v").alias("width")).withColumn("qid", F.monotonically_increasing_id()))
    summaries = checkpointed(extremes(ranges))
    sizes = asked.count(), summaries.count()
    first = checkpointed(reached(asked, summaries, *sizes, first=True))
    begun = checkpointed(visited(ranges, asked.withColumn("floor", least), first, k, block))
    floors = begun.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    left = asked.join(first.withColumnRenamed("range", "first"), "qid").join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", least))
    rest = visited(ranges, left.drop("first"), reached(left, summaries, *sizes, first=False), k, block)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return begun.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_block_max_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of every query (vec_id divisible by 50) among all other rows of ``embeddings``."""
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % STEP == 0))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER () AS n FROM e) q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
