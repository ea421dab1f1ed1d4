"""Near-duplicates by the Jaccard similarity of word shingles: SimHash, BK-trees, and a check of the whole sets.

Two sets of a similarity of at least ``LEAST`` share an element among the first fifth or so of each in any order that
holds for all sets (prefix filter). The order puts shingles that a sample shows to be common last; that only saves work,
any order finds the same pairs. So every shingle of a prefix is a shard. In a shard the sets within ``RADIUS`` bits of
their SimHash fingerprints of ``BITS`` bits and of fitting sizes are found, by a BK-tree in shards of up to ``MOST`` sets
and by rows of a matrix in larger ones, and each set names the least that chains of such sets lead to: a row for a set,
not for a pair. What these rows connect is a group, and the whole sets of a group are held against one another exactly.
Sets of a similarity of 0.8 differ in about a seventh of the bits (39, with a deviation of 6) and in 48 at most on average
(four elements and one more), unlike ones in 128 with a deviation of 8.

Nothing grows faster than the texts on disk: a prefix goes through a shuffle as packed bytes, only elements that sets of
fitting sizes share meet fingerprints, and a text goes to the task of its group once. A group of more than ``BLOCK`` sets
is cut into blocks that have a few pivots in common; after that only the sets which aren't linked to most of their group
meet all its blocks. Shingles are compared as 64-bit hashes, and equal sets are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingkit.llm.common import bounded, dropped, kept, small_batches
from swingkit.llm.simhash import BKTree, components

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Sets of a shard that make a tree at most, sets of a block of a larger group, and pivots of one, about.
MOST, BLOCK, PIVOTS = 64, 2048, 16
#: Texts of the sample that shows common shingles, how often they are in it, and how many are put last at most.
SAMPLE, OFTEN, MOST_COMMON = 20_000, 3, 200_000
#: Up to so many nodes to compare are broadcast; more are joined by a shuffle.
MOST_NODES = 1_000_000
#: Bits of a fingerprint and of the difference that is searched within.
BITS, RADIUS = 256, 84
#: Elements that a task packs at a time, elements of a bucket, and nodes or links that a task remembers in order not to repeat them.
PACKED, BUCKET, REMEMBERED = 500_000, 500_000, 500_000
#: Steps of a doubling in which sizes are packed.
_STEPS = 256
_BLOCK = 1 << 15


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles; none without a word. Fewer words than a shingle are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(len(words) - shingle + 1, 1)
    last = ends[shingle : shingle + n] or [len(joined) + 1]
    return np.unique(np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip(ends[:n], last, strict=True)), np.uint64, n).view(np.int64))


def fingerprint(found: np.ndarray) -> bytes:
    """The SimHash of a set of hashes: the majority of their bits, and of those of three more hashes of each."""
    counts, n = np.zeros(BITS, np.int64), len(found)
    for at in range(0, n, _BLOCK):
        one = found[at : at + _BLOCK].view(np.uint64)
        two = (one ^ (one >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        two ^= two >> np.uint64(32)
        more = [two * np.uint64(0xBF58476D1CE4E5B9)]
        for factor in (0x94D049BB133111EB, 0xD6E8FEB86659FD93):
            two = (two ^ (two >> np.uint64(31))) * np.uint64(factor)
            more.append(two ^ (two >> np.uint64(30)))
        counts += np.unpackbits(np.stack([one, *more], axis=1).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def need(size: int, least: float = LEAST) -> int:
    """Elements of a set of ``size`` that it shares at least with any set of that similarity."""
    return math.ceil(least * size - 1e-9)


def prefix(found: np.ndarray, common: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The first elements of a sorted set, the sorted ``common`` ones last; two similar sets share one of theirs."""
    if len(common):
        last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~last], found[last]])
    return found[: len(found) - need(len(found), least) + 1]


def spanning_links(nodes: list[int], sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Pairs of ``nodes`` of similar sets that connect all that chains of similar sets connect.

    Each set that is reached is held against all that aren't yet, so no pair inside a component is met twice.
    """
    vocabulary, flat = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    there = np.zeros(len(vocabulary), np.int32)
    left, todo, out = np.arange(len(nodes)), [], []
    rest = flat
    while len(left) or todo:
        if not todo:
            todo, left, rest = [int(left[0])], left[1:], rest[sizes[left[0]] :]
        if not len(left):
            break
        at = todo.pop()
        own = flat[ends[at] - sizes[at] : ends[at]]
        there[own] = 1
        both = np.add.reduceat(there[rest], np.cumsum(sizes[left]) - sizes[left])
        there[own] = 0
        hit = both >= least * (sizes[left] + sizes[at] - both) - 1e-9
        if hit.any():
            out += [(nodes[at], nodes[k]) for k in left[hit].tolist()]
            todo += left[hit].tolist()
            rest, left = rest[np.repeat(~hit, sizes[left])], left[~hit]
    return out


def near_groups(sizes: np.ndarray, prints: np.ndarray, least: float = LEAST, radius: int = RADIUS) -> np.ndarray:
    """For each row of fingerprints (four words of 64 bits) the first that chains of near ones of fitting sizes lead to."""
    first, left, todo, start = np.arange(len(sizes)), np.arange(len(sizes)), [], 0
    rest, size = prints, sizes
    while len(left):
        if not todo:
            start, left, rest, size = int(left[0]), left[1:], rest[1:], size[1:]
            todo = [start]
            continue
        at = todo.pop()
        hit = np.bitwise_count(rest ^ prints[at]).sum(axis=1, dtype=np.int64) <= radius
        hit &= np.minimum(size, sizes[at]) >= least * np.maximum(size, sizes[at]) - 1e-9
        if hit.any():
            first[left[hit]] = start
            todo += left[hit].tolist()
            left, rest, size = left[~hit], rest[~hit], size[~hit]
    return first


def _tree_groups(sizes: list[int], prints: list[bytes], least: float, radius: int) -> list[int]:
    """The same as :func:`near_groups` by a BK-tree."""
    tree, first = BKTree(), []

    def top(k: int) -> int:
        while first[k] != k:
            first[k] = first[first[k]]
            k = first[k]
        return k

    for k, (n, own) in enumerate(zip(sizes, prints, strict=True)):
        value = int.from_bytes(own, "little")
        first.append(k)
        for j in tree.within(value, radius):
            if min(n, sizes[j]) >= least * max(n, sizes[j]) - 1e-9:
                a, b = sorted((top(j), top(k)))
                first[b] = a
        tree.insert(value)
    return [top(k) for k in range(len(first))]


def _candidates(batches: Iterator[pd.DataFrame], least: float, most: int, radius: int) -> Iterator[pd.DataFrame]:
    """Each node of a shard with the first that near ones connect it to; the rows of a shard follow one another, maybe over several batches."""
    shard, nodes, sizes, prints, told = None, [], [], [], set()

    def ended() -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        if len(nodes) <= most:
            first = _tree_groups(sizes, prints, least, radius)
        else:
            first = near_groups(np.array(sizes, np.int64), np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1), least, radius).tolist()
        new = {(nodes[k], node) for k, node in zip(first, nodes, strict=True) if nodes[k] != node} - told
        if len(told) > REMEMBERED:
            told.clear()
        told.update(new)
        return list(new)

    for batch in batches:
        out = []
        for key, node, n, own in zip(*(batch[c].tolist() for c in ("token", "node", "n", "print")), strict=True):
            if key != shard:
                out += ended()
                shard, nodes, sizes, prints = key, [], [], []
            nodes.append(node), sizes.append(n), prints.append(own)
        if out:
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    if out := ended():
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _packed(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """The elements of the prefixes with their nodes and rounded sizes, as bytes by bucket; a task gives a node once, if it remembers it."""
    seen, nodes, sizes, found, held = set(), [], [], [], 0

    def flushed() -> pd.DataFrame:
        lengths = [len(x) for x in found]
        tokens = np.concatenate(found)
        bucket = (tokens.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, tokens = bucket[order], tokens[order]
        node = np.repeat(np.array(nodes, np.int64), lengths)[order]
        size = np.repeat(np.floor(_STEPS * np.log2(sizes)).astype(np.uint16), lengths)[order]
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        data = [tokens[i:j].tobytes() + node[i:j].tobytes() + size[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"bucket": bucket[cuts[:-1]], "data": data})

    for batch in batches:
        for node, n, own in zip(batch["node"].tolist(), batch["n"].tolist(), batch["prefix"], strict=True):
            if node in seen:
                continue
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.add(node), nodes.append(node), sizes.append(n), found.append(own)
            held += len(own)
            if held >= PACKED:
                yield flushed()
                nodes, sizes, found, held = [], [], [], 0
    if found:
        yield flushed()


def _shared(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """The elements and nodes of a bucket whose element is that of another node of a size that may fit; a bucket's rows follow one another."""
    gap, bucket, parts = math.ceil(_STEPS * math.log2(1 / least)) + 1, None, []

    def ended() -> Iterator[pd.DataFrame]:
        counts = [len(x) // 18 for x in parts]
        tokens, nodes, sizes = (np.concatenate([np.frombuffer(x, kind, n, at * n) for x, n in zip(parts, counts, strict=True)]) for kind, at in ((np.int64, 0), (np.int64, 8), (np.uint16, 16)))
        order = np.lexsort((nodes, sizes, tokens))
        tokens, nodes, sizes = tokens[order], nodes[order], sizes[order].astype(np.int64)
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
        tokens, nodes, sizes = tokens[new], nodes[new], sizes[new]
        fits = (tokens[1:] == tokens[:-1]) & (sizes[1:] - sizes[:-1] <= gap)
        stays = np.r_[False, fits] | np.r_[fits, False]
        tokens, nodes = tokens[stays], nodes[stays]
        for at in range(0, len(tokens), PACKED):
            yield pd.DataFrame({"token": tokens[at : at + PACKED], "node": nodes[at : at + PACKED]})

    for batch in batches:
        for key, data in zip(batch["bucket"].tolist(), batch["data"], strict=True):
            if key != bucket:
                if parts:
                    yield from ended()
                bucket, parts = key, []
            parts.append(data)
    if parts:
        yield from ended()


def _block_links(batches: Iterator[pd.DataFrame], shingle: int, least: float) -> Iterator[pd.DataFrame]:
    """Links of every shard; the rows of a shard follow one another, maybe over several batches."""
    shard, nodes, sets = None, [], []
    for batch in batches:
        out = []
        for key, node, text in zip(batch["shard"].tolist(), batch["node"].tolist(), batch["text"], strict=True):
            if key != shard:
                out += spanning_links(nodes, sets, least)
                shard, nodes, sets = key, [], []
            nodes.append(node), sets.append(shingles(text, shingle))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    if out := spanning_links(nodes, sets, least):
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def candidates(nodes: DataFrame, prefixes: DataFrame, least: float = LEAST, most: int = MOST, radius: int = RADIUS) -> DataFrame:
    """Edges ``a``, ``b`` that connect all nodes which may be similar. ``nodes``: node, n, print; ``prefixes``: node, n, prefix, a node maybe often."""
    filled = prefixes.filter("n > 0").select("node", "n", "prefix")
    elements = filled.agg(F.sum(F.size("prefix").cast("long"))).first()[0] or 0
    buckets = max(4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + elements // BUCKET)
    packed = filled.mapInPandas(lambda it: _packed(it, buckets), "bucket long, data binary")
    shared = packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(lambda it: _shared(it, least), "token long, node long")
    shards = shared.join(nodes.select("node", "n", "print"), "node").repartition("token").sortWithinPartitions("token", "node")
    return shards.select("token", "node", "n", "print").mapInPandas(lambda it: _candidates(it, least, most, radius), "a long, b long")


def links(groups: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that connect all similar nodes of a group. ``groups``: node, root (of nodes that aren't roots); ``nodes``: node, h; ``texts``: h (a hash of the text), text."""

    def confirmed(wanted: DataFrame) -> DataFrame:
        """Links within every shard of ``wanted``: node, shards."""
        found = bounded(nodes.select("node", "h").join(wanted, "node"), MOST_NODES)
        once = texts.join(found, "h").groupBy("node").agg(F.first("text").alias("text"), F.first("shards").alias("shards"))
        dealt = once.select(F.explode("shards").alias("shard"), "node", "text").repartition("shard").sortWithinPartitions("shard", "node")
        return dealt.mapInPandas(lambda it: _block_links(it, shingle, least), "a long, b long")

    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members, _ = kept(members.join(members.groupBy("root").agg(F.count(F.lit(1)).alias("c")), "root"), "members")

    def parts(rows: Column) -> Column:
        return F.ceil(rows / block).cast("int")

    def all_of(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    own, blocks = F.xxhash64("node"), parts(F.col("c"))
    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("c") / PIVOTS)) == 0
    places = F.when(blocks == 1, F.array(F.lit(0))).when(pivot, all_of(blocks)).otherwise(F.array(F.pmod(own, blocks).cast("int")))
    first, _ = kept(confirmed(members.select("node", F.transform(places, lambda i: F.xxhash64("root", i)).alias("shards"))), "links")
    large = members.filter(F.col("c") > block)
    if large.isEmpty():
        return first

    # What is linked to most of its group needn't meet the rest of that again; each other node meets all nodes: a grid of blocks of all and blocks of the others.
    linked = components(first).withColumnRenamed("root", "_top")
    at = large.join(linked, "node", "left").select("node", "root", "c", F.coalesce("_top", "node").alias("top"))
    tops = at.groupBy("root", "top").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max(F.struct("n", "top")).alias("most"), F.sum("n").alias("all"))
    at = at.join(tops, "root").withColumn("others", F.col("all") - F.col("most.n")).filter("others > 0")
    i, j, columns = F.pmod(own, blocks).cast("int"), F.pmod(own, parts(F.col("others"))).cast("int"), parts(F.col("others"))
    row = F.transform(all_of(columns), lambda k: F.xxhash64("root", i, k))
    column = F.transform(all_of(blocks), lambda k: F.xxhash64("root", k, j))
    shards = F.when(F.col("top") == F.col("most.top"), row).otherwise(F.array_union(row, column))
    return first.unionByName(confirmed(at.select("node", shards.alias("shards"))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, most: int = MOST, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """One row for each of ``docs``: the key, ``h`` (xxhash64 of the text), ``node`` and ``root`` (long; one root a component) and ``component_id``.

    Rows link whose sets of shingles have a Jaccard similarity of at least ``least``; texts without a word are equal.
    ``component_id`` is the least key that a row's links reach, null only if all of them are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))

    def starts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([prefix(shingles(x, shingle), np.empty(0, np.int64), least) for x in batch], dtype=object)

    every = 1 + rows.count() // SAMPLE
    sample = rows.select("text").distinct().filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    tokens = sample.select(F.explode(F.pandas_udf(starts, "array<long>")("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    often = tokens.filter(F.col("c") >= OFTEN).orderBy(F.desc("c"), "token").limit(MOST_COMMON).select("token").toPandas()  # at most MOST_COMMON
    common = spark.sparkContext.broadcast(np.sort(often["token"].to_numpy(np.int64)))

    def mark(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [shingles(x, shingle) for x in batch]
            yield pd.DataFrame({
                "node": np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64),
                "n": np.array([len(s) for s in found], np.int64), "prefix": pd.Series([prefix(s, common.value, least) for s in found], dtype=object),
                "print": pd.Series([fingerprint(s) for s in found], dtype=object),
            })

    whole, path = kept(rows.withColumn("m", F.pandas_udf(mark, "node long, n long, prefix array<long>, print binary")("text")).select("_key", F.xxhash64("text").alias("h"), "m.*"), "whole", merged=False)
    marked, _ = kept(whole.drop("prefix"), "marked")
    nodes, _ = kept(marked.groupBy("node").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.first("print").alias("print")), "nodes")
    groups = components(candidates(nodes, whole, least, most, radius))
    dropped(spark, path)
    texts = rows.select(F.xxhash64("text").alias("h"), "text")
    roots = components(links(groups, nodes, texts, shingle, least, block))
    rooted = marked.groupBy("node").agg(F.min("_key").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return marked.join(named, "node").select(F.col("_key").alias(key), "h", "node", "root", "component_id")
