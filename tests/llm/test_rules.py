import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from swingkit.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    spans = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


TEXTS = [
    None, "", "  \n\t ", "one", "a b c d e f g h " * 2, "a " * 40, "x y\nx y\n \n\nx y\r\n", "é #*$%&|<>   z\x0bq\x1cr",
    " ".join(f"w{i % 11}" for i in range(60)), " ".join(f"w{i}" for i in range(50)) + "\n" + " ".join(f"w{i}" for i in range(12)),
    "the quick brown fox " + " ".join(map(str, range(30))) + " a b c d e f g h i " + " ".join(map(str, range(40, 60))) + " a b c d e f g h i", "lorem " * 20000,
]


def test_base_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.base_counts(rules.hashed_words(docs)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def grams(text):
    h = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)
    one = [h(w.encode()) for w in WORD.findall(text or "")]
    two = [h(b.to_bytes(8, "little"), h(a.to_bytes(8, "little"))) for a, b in zip(one, one[1:])]
    marks = [h(m.encode(), h(b"mark")) for m in re.findall(r"[^\w\s]+", text or "")]
    return [signed(x) % rules.BUCKETS for x in one + two + marks]


def test_ratio_against_brute_force(spark):
    texts = ["good words here again", "good words there", "junk ### junk", None, "", "good ### words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    raw, target = np.ones(rules.BUCKETS), np.ones(rules.BUCKETS)
    for i, t in enumerate(texts):
        for g in grams(t):
            raw[g] += 1
            target[g] += i in (0, 1)
    weights = np.rint((np.log(target / target.sum()) - np.log(raw / raw.sum())) * rules.UNIT)
    for r in rules.apply_rules(docs, labels).collect():
        g = grams(texts[r.doc_id])
        assert r.llr is None if not g else abs(r.llr - weights[g].sum() / len(g) / rules.UNIT) < 1e-9
        assert not r.kept


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in rules.apply_rules(docs, labels).collect()] == [True]
    assert rules.apply_rules(docs.filter(F.lit(False)), labels).count() == 0
