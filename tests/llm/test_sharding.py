from collections import Counter, defaultdict

from pyspark.sql import functions as F

from swingkit.llm import sharding


def brute(spark, keys, shards, vnodes, cells):
    """The ring walked key by key."""
    ring = {r.cell: (r.arc, r.shard) for r in sharding.ring(spark, shards, vnodes, cells).collect()}
    n = len(keys)
    hashed = spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.xxhash64(F.col("k").cast("string")).alias("h")).collect()
    order = sorted((r.h % cells, r.h, r.k) for r in hashed)
    arcs = sorted(set(ring.values()))
    room = {s: n // shards + (s < n % shards) for s in range(shards)}
    placed, spilt = defaultdict(list), defaultdict(list)
    for cell, _, k in order:
        arc, s = ring[cell]
        if room[s]:
            room[s] -= 1
            placed[s].append(k)
        else:
            spilt[arc].append(k)
    waiting = []
    for arc, s in arcs * 2:
        waiting += spilt.pop(arc, [])
        while waiting and room[s]:
            room[s] -= 1
            placed[s].append(waiting.pop(0))
    return {k: (s, i) for s, ks in placed.items() for i, k in enumerate(ks)}


def test_same_as_a_walk_key_by_key(spark):
    keys = list(range(0, 700, 3))
    rows = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, shard string")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.place(rows, "doc_id", [], 5, 4, 64).collect()}
    assert got == brute(spark, keys, 5, 4, 64)


def test_balance_and_movement(spark):
    rows = spark.range(2001).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.shard for r in sharding.place(rows, "doc_id", [], 24).collect()}
    b = {r.doc_id: r.shard for r in sharding.place(rows, "doc_id", [], 25).collect()}
    assert set(Counter(a.values()).values()) <= {83, 84} and len(set(a.values())) == 24
    assert sum(a[k] != b[k] for k in a) < 0.25 * len(a)


def test_nulls_repeats_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a")] * 5 + [(7, "b")] * 9 + [(8, None)], "doc_id long, t string")
    got = sharding.place(rows, "doc_id", ["t"], 4, 4, 64).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [3, 4, 4, 4]
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.place(rows.limit(0), "doc_id", ["t"], 4, 4, 64).count() == 0
