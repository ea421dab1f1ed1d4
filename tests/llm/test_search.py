import math
import re
from collections import Counter

import numpy as np
import pytest

from swingkit.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score long", "item_id long, text string, rank int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t, *_ in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text, *_ in items:
        scores = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **limits):
    got = search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def some_docs(n, seed=0):
    rng = np.random.default_rng(seed)
    draw = lambda: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 200)
    return [(i, draw(), i) for i in range(n)], [(i, draw(), 0) for i in range(12)]


def test_terms_are_those_of_the_pattern():
    for text in ("", "AÀ b-c_d'e f’g 1,2\x00\x7fz", "日本　x\U0001f600", "é" * 5):
        n, c = search.term_counts(text.encode())
        assert (n, {t.decode(): k for t, k in c.items()}) == (len(terms(text)), dict(Counter(terms(text))))
    long_text = "Ab,c " * 1_000_000 + "d" * 3_000_000
    n, c = search.term_counts(long_text.encode())
    assert n == 2_000_001 and c[b"ab"] == 1_000_000 and c[b"d" * 3_000_000] == 1


@pytest.mark.parametrize("limits", [{}, {"chunk_postings": 300, "sample": 20}, {"k": 3, "chunk_postings": 2000}])
def test_against_brute_force(spark, limits):
    docs, items = some_docs(400)
    assert found(spark, docs, items, **limits) == brute(docs, items, limits.get("k", 20))


def test_ties_repeats_nulls_and_traps(spark):
    """Sixty equal texts, repeated ids and items, null ids, texts and items, words in all documents and in none."""
    docs = [(100 - i, "same words here", 0) for i in range(60)] + [(7, "same thing", 0)] * 3 + [(None, "same words here", 0), (None, "rare", 0), (1, None, 0), (2, "", 0), (3, " .,- ", 0), (4, "Same SAME words " * 9, 0)]
    items = [(1, "same words", 0), (1, "same words", 0), (None, "WORDS words here", 0), (2, None, 0), (3, "", 0), (4, "absent", 0), (5, "rare absent", 0), (6, "thing", 0)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, chunk_postings=40, sample=8) == brute(docs, items)


def test_empty_tables_and_a_very_long_text(spark):
    docs, items = some_docs(30, 1)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None, 0)], items) == []
    docs.append((1000, "w1 w2 w3 x " * 300_000, 0))
    assert found(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = some_docs(80, 2)
    monkeypatch.setattr(search, "BLOCK_BYTES", 700)
    assert found(spark, docs, items) == brute(docs, items)


def test_bounds_leave_documents_unscored():
    """Two groups of documents of unlike words: an item of one group's words scores few of the other."""
    rng = np.random.default_rng(5)
    own = [np.sort(rng.choice(40, 12, replace=False)) + 40 * (i // 1000) for i in range(2000)]
    sizes = np.array([len(t) for t in own])
    tfs = rng.integers(1, 9, sizes.sum())
    chunk = search.Chunk(80, np.array([60] * 2000), sizes, np.concatenate(own).astype(np.int32), tfs, 2000, 120_000)
    best = search.Best(20)
    best.ids = list(range(2000))
    chunk.search(np.array([1, 2]), np.array([500, 900]), best)
    whole = np.zeros(2000, np.int64)
    np.add.at(whole, chunk.doc[chunk.start[1] : chunk.start[2]], 500 * chunk.impact[chunk.start[1] : chunk.start[2]].astype(np.int64))
    np.add.at(whole, chunk.doc[chunk.start[2] : chunk.start[3]], 900 * chunk.impact[chunk.start[2] : chunk.start[3]].astype(np.int64))
    assert [(s, i) for s, _, i in best.rows] == sorted((-int(s), i) for i, s in enumerate(whole))[:20]
    assert chunk.met == 2000 and chunk.scored < 700
