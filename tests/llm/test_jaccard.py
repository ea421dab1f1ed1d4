from contextlib import suppress
from pathlib import Path
from threading import Event, Thread

import numpy as np
import pandas as pd

import corpus_pipeline
from swingkit.llm import jaccard
from swingkit.llm.common import table

SF = "/root/testdata/sf0.01"


def brute_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(texts):
    """Each key's least key over chains of pairs of Jaccard 0.8 or more."""
    sets, root = {k: brute_shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (both := len(x & y)) >= 0.8 * (len(x) + len(y) - both):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {k: top(k) for k in keys}


def made(n=90):
    """Edited copies of one text, some of copies, two common passages in other texts, and short ones."""
    rng, words = np.random.default_rng(7), [f"w{k}" for k in range(400)]
    base, passage = rng.choice(words, 120).tolist(), rng.choice(words, 60).tolist()
    out = {}
    for k in range(n):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 8)):
            text[at] = "edit" + str(rng.integers(1000))
        out[k] = " ".join(text)
        out[1000 + k] = " ".join(passage + rng.choice(words, int(rng.integers(3, 40))).tolist())
    return out | {2000: "", 2001: None, 2002: "a b", 2003: "A  b", 2004: "a b c d e f", 2005: "b c d e f a"}


def test_links_are_those_of_brute_force(spark):
    texts = made()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts)
    for most, block in ((jaccard.MOST, jaccard.BLOCK), (1000, 1000), (1, 1000), (8, 20)):
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, most=most, block=block).collect()}
        assert got == want


def test_stage_keeps_one_of_every_group_of_brute_force(spark):
    docs = table(spark, SF, "documents")
    held = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    want = brute_components(dict(zip(held.doc_id, held.text)))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).select("doc_id").collect()) == sorted(set(want.values()))


def test_an_edited_copy_goes(spark):
    text = " ".join(f"word{k}" for k in range(100))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text.replace("word50", "other"), "en", "s", 1), (3, text.replace("word5", "other"), "en", "s", 1)], table(spark, SF, "documents").schema)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()) == [1, 3]


def on_disk(spark):
    """Bytes of shuffles and of tables in the shared folder."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [Path(blocks.apply(k).getPath()) for k in range(blocks.size())] + [p for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if p.is_file()]
    return sum(p.stat().st_size for p in files if p.exists())


def test_many_copies_of_a_long_text_take_little_disk(spark):
    """No set is written once for each element that it shares."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 10**9, 1500)]
    texts = {}
    for k in range(100):
        text = list(base)
        for at in rng.integers(0, 1500, 15):
            text[at] = f"edit{rng.integers(10**9)}"
        texts[k] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen, ended = [on_disk(spark)], Event()

    def watch():
        while not ended.wait(0.2):
            with suppress(OSError):  # a file may go meanwhile
                seen.append(on_disk(spark))

    watcher = Thread(target=watch)
    watcher.start()
    try:
        assert {r.component_id for r in jaccard.near_duplicates(docs).collect()} == {0}
    finally:
        ended.set(), watcher.join()
    assert max(seen) - seen[0] < 8 * sum(map(len, texts.values()))


def test_chains_over_blocks(spark):
    """Groups of more than a block that only chains of similar texts connect, and some that break."""
    words = [f"w{k}" for k in np.random.default_rng(5).permutation(2000)]
    chain = lambda at, step, n: {at + k: " ".join(words[at + step * k : at + step * k + 60]) for k in range(n)}
    texts = chain(0, 5, 45) | chain(500, 7, 30) | chain(900, 3, 60) | {1500 + k: f"{' '.join(words[1500:1590])} own{k} text{k}" for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts)
    assert 30 < len(set(want.values())) < 40
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, most=20, block=7).collect()} == want


def test_trees_and_rows_find_the_same_groups():
    rng = np.random.default_rng(11)
    starts = rng.integers(0, 256, (20, 32), np.uint8)
    prints = np.array([starts[k % 20] ^ np.packbits(rng.random(256) < 0.17) for k in range(150)], np.uint8)
    sizes = rng.integers(40, 70, 150)
    got = jaccard.near_groups(sizes, prints.view(np.uint64), radius=75)
    assert got.tolist() == jaccard._tree_groups(sizes.tolist(), [x.tobytes() for x in prints], jaccard.LEAST, 75)
    assert 20 < len(set(got.tolist())) < 150


def test_shared_elements_of_fitting_sizes_are_kept():
    rows = [(5, 10, [-7, 1, 2]), (6, 12, [-7, 3]), (7, 40, [1, 3, 9]), (5, 10, [-7, 1, 2]), (8, 50, [9, 2**62])]
    frame = pd.DataFrame([(a, n, np.array(x, np.int64)) for a, n, x in rows], columns=["node", "n", "prefix"])
    packed = pd.concat([*jaccard._packed(iter([frame[:3]]), 4), *jaccard._packed(iter([frame[3:]]), 4)]).sort_values("bucket")
    got = pd.concat(jaccard._shared(iter([packed[:2], packed[2:]]), 0.8))
    assert sorted(zip(got.token.tolist(), got.node.tolist())) == [(-7, 5), (-7, 6), (9, 7), (9, 8)]


def test_fingerprints_of_similar_sets_are_within_the_radius():
    rng = np.random.default_rng(13)
    for n, more in ((4, 1), (8, 2), (40, 10), (400, 100)):
        for _ in range(300):
            both = rng.integers(-(2**63), 2**63 - 1, n + more)
            a, b = (int.from_bytes(jaccard.fingerprint(np.sort(x)), "little") for x in (both, both[:n]))
            assert (a ^ b).bit_count() <= jaccard.RADIUS
