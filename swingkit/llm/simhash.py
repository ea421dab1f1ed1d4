"""Near-duplicates by SimHash fingerprints linked through BK-trees.

Equal fingerprints are one node. Two fingerprints that differ in at most ``RADIUS`` bits agree in one of ``RADIUS + 1``
bands, so each band value is a shard: its fingerprints go, sorted, to one task, which inserts them one by one into a
BK-tree (children keyed by their Hamming distance to the parent), follows only the edges within the radius, and keeps a
spanning set of the links. A shard of more than ``MOST`` fingerprints is dealt again in the same way by the bits outside
its band, so every tree stays small. The trees are shuffled with their shard rather than broadcast, since all trees
together grow with the corpus.

The links become components by alternating star contraction over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.llm.common import checkpointed, dropped, kept, small_batches, table

SHINGLE, SEED, RADIUS = 3, 42, 2
#: First bit and width of each band; RADIUS + 1 of them.
BANDS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a shard that make one tree; those of a larger one make a tree for each value of each band of the other bits.
MOST = 2048
_BLOCK = 1 << 15
#: Edges of one node beyond which its smallest neighbour is broadcast: at least the first, and edges divided by the second.
HUB, MOST_HUBS = 64, 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint; 0 without a word. Fewer words than a shingle are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(len(words) - shingle + 1, 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        first = ends[at : min(at + _BLOCK, n)]
        last = ends[at + shingle : at + shingle + len(first)] or [len(joined) + 1]
        h = np.array([digest(joined[i : j - 1], SEED) for i, j in zip(first, last, strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


class BKTree:
    """Distinct integers; each node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius + 1:
                todo += [k for e, k in edges.items() if d - radius <= e <= d + radius]
            else:
                todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found

    def insert(self, value: int) -> int:
        new = len(self.values)
        if new:
            at = 0
            while True:
                edges, d = self.children[at], (self.values[at] ^ value).bit_count()
                if d not in edges:
                    edges[d] = new
                    break
                at = edges[d]
        self.values.append(value)
        self.children.append({})
        return new


def spanning_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs of ``values`` (distinct, signed) that connect all that chains of links within the radius connect."""
    tree, root, links = BKTree(), [], []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for v in values:
        near = tree.within(v & (1 << 64) - 1, radius)
        new = tree.insert(v & (1 << 64) - 1)
        root.append(new)
        for k in near:
            if (a := top(k)) != (b := top(new)):
                root[a] = b
                links.append((values[k], v))
    return links


def _tree_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of every shard; the rows of a shard follow one another, maybe over several batches."""
    shard, held = None, []
    for batch in batches:
        keys, fps = batch["shard"].to_numpy(), batch["fp"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        out = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if keys[i] != shard:
                out += spanning_links(held)
                shard, held = keys[i], []
            held += fps[i:j].tolist()
        if out:
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    if out := spanning_links(held):
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _bits(value: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND((1 << width) - 1)


def _sub_shards(shard: Column) -> Column:
    """The sub-shards of a fingerprint in a shard: the values of RADIUS + 1 bands of the bits outside the shard's own band."""
    out = F.array().cast("array<long>")
    for k, (at, width) in enumerate(BANDS):
        turned = F.shiftrightunsigned("fp", (at + width) % 64).bitwiseOR(F.shiftleft("fp", (64 - at - width) % 64))
        cuts = [(64 - width) * i // (RADIUS + 1) for i in range(RADIUS + 2)]
        own = [-1 - ((shard * (RADIUS + 1) + i) * (1 << 16) + _bits(turned, x, y - x)) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
        out = F.when(shard % len(BANDS) == k, F.array(*own)).otherwise(out)
    return out


def links(fingerprints: DataFrame, most: int = MOST) -> DataFrame:
    """Links ``a``, ``b`` between the distinct ``fp`` of a table that connect all within RADIUS bits."""
    bands = F.array(*(_bits(F.col("fp"), at, width) * len(BANDS) + k for k, (at, width) in enumerate(BANDS)))
    shards = fingerprints.select("fp", F.explode(bands).alias("shard"))
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = F.when(F.col("n") <= most, F.array("shard")).otherwise(_sub_shards(F.col("shard")))
    shared = shards.join(sizes, "shard").select("fp", F.explode(dealt).alias("shard"))
    return shared.repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp").mapInPandas(_tree_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the component's least node) for every node of the edges ``a``, ``b`` that isn't a root.

    Large-star and small-star steps until every node has one edge, to a node that has none of its own. Each step writes a
    table in the shared folder and deletes the one before it. The least neighbours of nodes with very many edges, of which
    there are at most ``2 * MOST_HUBS``, are broadcast, so that their edges needn't meet in one task.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
        now, path = kept(df.filter("u <> v").distinct(), "edges")
        if before:
            dropped(spark, before)
        return now, path

    def with_least(now: DataFrame) -> DataFrame:
        least = now.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hubs = F.broadcast(least.filter(F.col("n") > hub).select("u", "m"))
        others = least.filter(F.col("n") <= hub).select("u", "m")
        return now.join(hubs, "u").unionByName(now.join(hubs, "u", "left_anti").join(others, "u"))

    now, path = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    hub = max(HUB, now.count() // MOST_HUBS)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now, path = stored(with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), path)
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        now, path = stored(with_least(now).select(F.explode(ends).alias("e")).select("e.*"), path)
        twice = now.groupBy("u").count().filter("count > 1").select("u")
        if twice.unionByName(now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi")).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of ``docs``: the key, ``fp`` (long) and ``component_id``, the least key that its links reach.

    Rows of equal key stay rows of their own; a null key is never the least unless a component has no other.
    """
    small_batches(docs.sparkSession)

    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(x) for x in batch], dtype="int64")

    marked = checkpointed(docs.select(F.col(key).alias("_key"), F.pandas_udf(fingerprints, "long")(F.col(text)).alias("fp")))
    nodes, _ = kept(marked.groupBy("fp").agg(F.min("_key").alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("_key").alias(key), "fp", "component_id")


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
