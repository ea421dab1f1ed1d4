from collections import defaultdict

import numpy as np
import pandas as pd
import zlib
from tokenizers import Tokenizer

import public_tokenizers
from swingkit.llm import packing

SF = "/root/testdata/sf0.01"


def check(rows, ids_of, window):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, ps in docs.items():
        ids, at = ids_of[k], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for ps in sequences.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= window
    return sum(n for ps in sequences.values() for _, n in ps) / (window * len(sequences))


def test_whole_table(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(docs.doc_id, docs.text)}
    rows = packing.op7_nnls_packing(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(ids)
    assert check(rows, ids, packing.WINDOW) > 0.97


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "<|endoftext|>x", 4: "y " * 9000}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, length int")
    rows = packing.pack(packing.pieces(docs, packing.default_path())).collect()
    check(rows, {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}, packing.WINDOW)
    twice = packing.pack(packing.pieces(docs.union(docs), packing.default_path())).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == 2 * len(rows)
    assert packing.pack(packing.pieces(docs.limit(0), packing.default_path())).count() == 0


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(3)
    for n in (1, 50, 5000):
        counts = np.bincount(rng.integers(1, 1024, n), minlength=1025)
        used = np.zeros(1025, int)
        for combination, repeats in packing.plan(counts):
            assert sum(combination) <= 1024 and repeats > 0
            np.add.at(used, combination, repeats)
        assert (used == counts).all()


def test_least_squares_meets_a_histogram_that_combinations_make():
    columns = packing.combinations(np.arange(1, 12), 12)
    counts = np.zeros(13)
    for row, x in zip(columns[:6], [3, 1, 4, 1, 5, 9]):
        np.add.at(counts, row, x)
    counts[0] = 0
    x = packing.least_squares(columns, counts, 3000)
    fit = sum(np.bincount(columns[:, k], x, 13) for k in range(3))
    assert (x >= 0).all() and np.abs(fit - counts)[1:].max() < 0.05


def test_more_than_a_million_spaces(spark):
    texts = {1: "a" + " " * 1_200_000 + "b", 2: "x" + "\n" * 1_100_000, 3: " " * 150_000 + "<|endoftext|>" + "\t \u3000" * 400_000 + "\nword", 4: "y\x1c" + "\r\n" * 60_000 + "." + " " * 100_001 + "z"}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs, packing.default_path())).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check(rows, {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}, packing.WINDOW)


def test_no_combination_is_left_out():
    for window in (12, 40, 2048):
        found = {tuple(x) for x in packing.combinations(np.arange(1, window), window).tolist()}
        pairs = {(window - b, b, 0) for b in range(1, window // 2 + 1)}
        triples = sum(1 for c in range(1, window // 3 + 1) for b in range(c, (window - c) // 2 + 1) if window - b - c >= b)
        assert pairs <= found and len(found) == len(pairs) + triples
