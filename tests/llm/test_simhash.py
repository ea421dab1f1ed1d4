import re

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from swingkit.llm import simhash

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    return value - (1 << 64) if value >> 63 else value


def brute_roots(values, radius=2):
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {v: top(v) for v in values}


def test_fingerprints():
    for t in [None, "", "  ", "A", "One two", "ÄB cd\x0bef\x1cg h", "a b c d " * 30, "É x Y z " * 9000]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), unique=True, max_size=40))
def test_tree_finds_all_within_the_radius(values):
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for q in range(0, 256, 17):
        assert sorted(tree.values[k] for k in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def cluster(n=60):
    """A chain of fingerprints two bits apart, a ball of near ones, and strangers."""
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 8)]
    chain = [base[0]]
    for k in range(n):
        chain.append(chain[-1] ^ (1 << (2 * k % 63)) ^ (1 << ((2 * k + 1) % 63)))
    ball = [base[1] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a + 1, 12)]
    return sorted({*chain, *ball, *base})


def test_links_and_components(spark):
    values = cluster()
    expected = {v: r for v, r in brute_roots(values).items() if v != r}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for most in (simhash.MOST, 3, 0):  # with one tree a shard, with some shards dealt again, and with all
        got = {r.node: r.root for r in simhash.components(simhash.links(fps, most)).collect()}
        assert got == expected


def test_whole_table_against_all_pairs(spark):
    got = simhash.op3_simhash_bktree(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    fp = {i: brute_fingerprint(t) for i, t in zip(docs.doc_id[:120], docs.text[:120])}
    whole = dict(zip(got.doc_id, got.fingerprint))
    assert all(int(whole[i], 16) == v & (1 << 64) - 1 for i, v in fp.items())
    values = {int(f, 16) for f in whole.values()}
    roots = brute_roots(sorted(values))
    least = {}
    for i, f in whole.items():
        r = roots[int(f, 16)]
        least[r] = min(least.get(r, i), i)
    assert all(least[roots[int(f, 16)]] == c for f, c in zip(got.fingerprint, got.component_id)) and len(got) == len(docs)


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(3, "x y z w", 1), (1, "x y z w", 2), (None, "x y z w", 3), (5, None, 4), (4, "", 5), (4, "", 5)], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, 1), (1, 1), (None, 1), (5, 4), (4, 4), (4, 4)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
