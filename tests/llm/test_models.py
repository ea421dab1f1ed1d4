"""Quality and language: small cases by hand, and held-out accuracy on the driver's tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from swingkit.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_descent_reaches_the_margin():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 4]), np.array([3, 5])]
    model = quality.fit_rows(rows, np.array([1, 1, 0, 0], bool), 8)
    assert [model.margin(x) > 0 for x in rows] == [True, True, False, False]
    assert 0 <= model.score(rows[3]) < model.score(rows[0]) <= 1


def test_one_class_and_no_rows():
    assert quality.fit_rows([np.array([1])], np.array([1]), 8).score(np.array([2])) > 0.9
    assert quality.fit_rows([], np.array([]), 8).score(np.array([2])) == 0.5


def test_features_of_odd_texts():
    assert len(quality.features(None)) == len(quality.features(" \n")) == 0
    assert set(quality.features("ab cd")) < set(quality.features("ab cd cd"))
    assert len(quality.features("x" * 300_000)) == 2


def test_quality_on_held_out_labels(spark):
    got = quality.op4_nbsvm_quality(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    both = got.merge(labels, on="doc_id").query("held_out")
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (both["predicted"] == both["quality"]).mean() > 0.93


def test_quality_with_clashing_columns_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "fine words", 2), (None, None, 3), (1, "fine words", 4)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 3 and out[0].score == out[2].score


def test_code_lengths_are_of_a_distribution():
    counts = pd.DataFrame([("xx", int(g), int(n)) for g, n in zip(*np.unique(language.grams(language.normal_bytes("abracadabra abra")), return_counts=True))], columns=["lang", "gram", "n"])
    trees = language.grow(counts)
    size = int(trees.symbol.max()) + 1
    rng, most = np.random.default_rng(1), size - 1
    # Known contexts, and those with symbols that were never met beside each other.
    for context in [*np.unique(trees.seen[1].keys // size), *rng.integers(0, size**3, 50), most, most * size**2 + most * size + most]:
        assert np.isclose(np.exp2(-np.array([bits_after(trees, int(context) * size + s, size) for s in range(size)])).sum(axis=0), 1, atol=1e-9)


def bits_after(trees, gram, size):
    """Code length of the last of four symbols in every language."""
    one, k = np.ones(1, int), len(trees.langs)
    at = lambda costs, key: costs.sums(np.array([key]), one, k)
    return trees.base[gram % size**2] + at(trees.seen[0], gram % size**3) + at(trees.escapes[0], gram % size**3 // size) + at(trees.seen[1], gram) + at(trees.escapes[1], gram // size)


def dictionary_bits(samples, lang, text):
    """Code length by the definition: counts by context in dictionaries, method C escapes, exclusion."""
    order = language.ORDER
    learnt = {name: [bytes(order) + language.normal_bytes(t).tobytes() for t in texts] for name, texts in samples.items()}
    alphabet = {0, 32, *b"".join(x for texts in learnt.values() for x in texts)}
    counts = {name: Counter((x[i - k : i], x[i]) for x in texts for i in range(order, len(x)) for k in range(order + 1)) for name, texts in learnt.items()}
    after = {name: defaultdict(dict) for name in counts}
    for name, found in counts.items():
        for (context, byte), n in found.items():
            after[name][context][byte] = n
    total = Counter()
    for found in counts.values():
        for (context, _), n in found.items():
            total[context] += n

    def chance(context, byte):
        if context is None:
            return 1 / (len(alphabet) + 1)
        shorter = context[1:] if context else None
        own = after[lang].get(context, {})
        if not own or len(context) == order and total[context] < language.LEAST:
            return chance(shorter, byte)
        n, kinds = sum(own.values()), len(own)
        rest = sum(chance(shorter, b) for b in [*alphabet, -1] if b not in own)
        return own[byte] / (n + kinds) if byte in own else kinds / (n + kinds) * chance(shorter, byte) / rest

    raw = bytes(order) + language.normal_bytes(text).tobytes()
    raw = [b if b in alphabet else -1 for b in raw]
    known = [b if b >= 0 else 255 for b in raw]
    return -sum(math.log2(chance(bytes(known[i - order : i]), raw[i])) for i in range(order, len(raw)))


def test_code_lengths_against_dictionaries():
    samples = {"aa": ["abracadabra abra", "the cat sat on the mat", "the"], "bb": ["der rabe aß das gras", "das abra"]}
    rows = [(lang, int(g)) for lang, texts in samples.items() for t in texts for g in language.grams(language.normal_bytes(t))]
    counts = pd.DataFrame(rows, columns=["lang", "gram"]).value_counts().reset_index(name="n")
    trees = language.grow(counts)
    for text in ("abra", "the rabe!", "mat 12 sat", "ß", "zzz qabrat", "the the the"):
        assert np.allclose(trees.lengths(text), [dictionary_bits(samples, lang, text) for lang in ("aa", "bb")], rtol=1e-9)


def test_a_hundred_languages_keep_their_own_contexts():
    """Languages of letters of their own: held-out texts are told apart, and a language with a document keeps its contexts beside those with 30."""
    rng = random.Random(7)
    words = {f"l{k:03}": ["".join(chr(rng.randrange(97, 123) if k % 2 else 0x400 + 5 * (k % 40) + rng.randrange(30)) for _ in range(rng.randrange(2, 8))) for _ in range(150)] for k in range(100)}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    rows = []
    for k, lang in enumerate(words):
        raw = np.concatenate([language.grams(language.normal_bytes(text(lang, 200))) for _ in range(1 if k < 10 else 30)])
        gram, n = np.unique(raw, return_counts=True)
        rows.append(pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n}))
    counts = pd.concat(rows, ignore_index=True)
    trees = language.grow(counts)
    assert sum(trees.predict(text(lang, 40))[0] == lang for lang in words) == 100
    # Entries grow with what was seen, not with all pairs of context and language.
    assert len(trees.seen[1].bits) <= len(counts) and len(trees.seen[0].bits) <= len(counts)
    alone = language.grow(counts[counts["lang"] == "l003"])
    for costs, own in zip((*trees.seen, *trees.escapes), (*alone.seen, *alone.escapes)):
        assert (costs.lang == 3).sum() >= len(own.bits) > 0


def test_language_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "the cat and the dog", "en", 1), (1, "the cat and the dog", "en", 2), (1, "der hund und die katze", "de", 3), (None, "and then the end", "en", 4), (2, None, "en", 5)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, found int")
    out = language.identify(docs, language.fit(docs)).collect()
    assert sorted({(r.text, r.lang_pred, r.found) for r in out}, key=str) == sorted({(t, "und" if t is None else lang, n) for _, t, lang, n in rows}, key=str)
    assert language.identify(docs.limit(0), language.fit(docs)).count() == 0


def test_descent_against_a_plain_solver():
    """The dual's weights minimise |w|^2 / 2 + cost * sum of squared hinges, as plain gradient steps do."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, rng.integers(1, 6))) for _ in range(40)]
    good = rng.random(40) < 0.5
    model = quality.descend(rows, good, 12, epochs=3000)
    counts = np.ones((2, 12))
    for x, y in zip(rows, good):
        counts[int(y), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    features = np.array([[ratio[j] if j in x else 0.0 for j in range(12)] + [1.0] for x in rows])
    sign, w = np.where(good, 1.0, -1.0), np.zeros(13)
    for _ in range(40_000):
        w -= 0.002 * (w - 2 * quality.COST * features.T @ (sign * np.maximum(0, 1 - sign * (features @ w))))
    assert np.allclose([model.margin(x) for x in rows], features @ w, atol=1e-4)


def test_quality_of_no_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, 0), (2, "", 0), (3, None, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert [r.score for r in quality.score(docs.limit(0), model).collect()] == []
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.fit(docs.limit(0), labels).score(np.array([], int)) == 0.5


@pytest.mark.parametrize(("text", "und"), [(None, True), ("", True), ("12 !?", True), ("the and", False), ("a" * 600_000, False)])
def test_und_is_for_texts_without_a_letter(text, und):
    counts = pd.DataFrame([(lang, int(g), 1) for lang, t in (("aa", "the and of"), ("bb", "der die das")) for g in language.grams(language.normal_bytes(t))], columns=["lang", "gram", "n"])
    lang, score = language.grow(counts).predict(text)
    assert (lang == "und") == und and 0 <= score <= 1 and (score == 0) == und


def test_pieces_of_a_long_text_add_up(monkeypatch):
    counts = pd.DataFrame([("aa", int(g), 1) for g in language.grams(language.normal_bytes("the and of"))], columns=["lang", "gram", "n"])
    trees = language.grow(counts)
    whole = trees.lengths("of the and " * 50)
    monkeypatch.setattr(language, "PIECE", 7)
    assert np.allclose(whole, trees.lengths("of the and " * 50))


def test_language_on_held_out_documents(spark):
    got = language.op2_ppm_language(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    both = got.merge(docs, on="doc_id").query("held_out")
    assert len(got) == 1000 and (both["lang"] == both["lang_pred"]).mean() > 0.97


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    out = language.identify(docs, language.fit(docs)).collect()
    assert [r.lang_pred for r in out] == ["und", "und"]
