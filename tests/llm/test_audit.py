import itertools
import math
import random

import pytest

from swingkit.llm import audit


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_steps_of_every_order_against_the_masks(n):
    names, rng = "ABCDE"[:n], random.Random(n)
    counts = {m: (rng.randint(1, 9), rng.randint(0, 3), rng.randint(0, 2)) for m in range(1 << n) if rng.random() < 0.6}
    rows = audit.audit_rows(counts, names)
    assert {r[0] for r in rows} == {"".join(p) for p in itertools.permutations(names)} and len(rows) == n * math.factorial(n)
    total = lambda holds, w=0: sum(x[w] for m, x in counts.items() if holds(m))
    removed = dict.fromkeys(names, 0)
    for order, step, kept, goes, redundant, alone, good, toxic, _ in rows:
        bits = [1 << names.index(c) for c in order]
        bit, prior = bits[step - 1], sum(bits[: step - 1])
        here = lambda m: m & bit and not m & prior  # noqa: B023, E731
        assert (kept, goes, good, toxic) == (total(lambda m: not m & (prior | bit)), total(here), total(here, 1), total(here, 2))  # noqa: B023
        assert (redundant, alone) == (total(lambda m: m & bit and m & prior), total(lambda m: m == bit))  # noqa: B023
        removed[order[step - 1]] += goes
    assert all(r[-1] == removed[r[0][r[1] - 1]] for r in rows)


def test_every_order_is_one_swap_away_and_diagrams_share():
    for n in range(1, 7):
        order, met = list(range(n)), [tuple(range(n))]
        for k in audit.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            met.append(tuple(order))
        assert len(met) == len(set(met)) == math.factorial(n)
    same = audit.Diagram(5, {m: (2, 1, 0) for m in range(32)})
    assert len(same.below) == 1 + 1 + 5  # empty, one leaf, one node a level
    for k in audit.adjacent_swaps(5):
        same.swap(k)
    assert same.weight[same.root] == (64, 32, 0)


def test_masks_copies_and_labels(spark):
    long_text = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, long_text, "en", "x"), (2, long_text, "de", "x"), (2, long_text, "de", "x"), (None, long_text, None, "x"),  # 1 passes all, 2 is a copy twice, null is no copy
        (3, None, "", "y"), (4, "", None, "y"), (4, "", "en", "y"),  # texts that count as equal
        (5, "A b " * 100, "en", "z"), (6, "a\u00a0b #", "en", "z"), (7, " \t\n", "fr", "z"),
        (8, " ".join(["é"] * 99 + [f"v{i}" for i in range(101)]), "fr", "z"), (9, " ".join(["é"] * 101 + [f"v{i}" for i in range(99)]), "fr", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string")
    masks = audit.with_copies(audit.failure_masks(docs, audit.text_failures), 16)
    got = sorted((r.key or 0, r.part, r["mask"]) for r in masks.collect())
    assert got == [(0, "", 0), (1, "en", 0), (2, "de", 16), (2, "de", 16), (3, "", 1), (4, "", 17), (4, "en", 17), (5, "en", 6), (6, "en", 9), (7, "fr", 1), (8, "fr", 0), (9, "fr", 0)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    counts = {(r.part, r["mask"]): (r.n, r.good, r.toxic) for r in audit.mask_counts(masks, labels).collect()}
    assert counts[("en", 0)] == (1, 1, 1) and counts[("de", 16)] == (2, 0, 2) and counts[("", 0)] == (1, 0, 0) and counts[("", 1)] == (1, 0, 0)
    whole = audit.audit(audit.mask_counts(masks, labels), "ABCDE").collect()
    assert len(whole) == 4 * 600
    assert all(r.kept == sum(n for (p, m), (n, *_) in counts.items() if p == r.part and m == 0) for r in whole if r.step == 5)
    assert sum(r.toxic_lost for r in whole if r.part == "de" and r.filter_order == "EABCD") == 2


def test_half_distinct_words_pass_and_fewer_fail(spark):
    texts = [" ".join(["x"] * (200 - d) + [f"v{i}" for i in range(d)]) for d in (98, 99, 100)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert [r["mask"] for r in audit.failure_masks(docs, audit.text_failures).orderBy("key").collect()] == [2, 0, 0]


def test_no_rows_and_bad_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = audit.mask_counts(audit.with_copies(audit.failure_masks(docs, audit.text_failures), 16), labels)
    assert audit.audit(counts, "ABCDE").count() == 0
    for names in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            audit.audit(counts, names)
