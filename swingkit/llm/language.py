"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ``ORDER`` bytes, counted over its sample. A byte that a context has
seen costs its share of the context's count plus its number of distinct bytes; one that it hasn't costs the escape
(the distinct bytes' share) and is then predicted by the context shorter by a byte, without the bytes already ruled out.
The statistics are frozen, so the code length of a byte depends on its context alone. A byte costs what it costs after its
preceding byte, plus, for the context of two bytes and then of three, either the escape or what having seen the byte saves. Only
what a language has seen has an entry, so a text's code length in every language is a sum over its distinct grams. The shortest code wins.

Letters are lower-cased and every run of other ASCII bytes counts as one space: digits and marks, which say little of a
language, are no part of the code. The trees are learnt from at most ``SAMPLE`` documents of each language, drawn by a hash
of id and text; a language adds an entry for each of its distinct grams and contexts and at most 0.5 MB of shortest contexts.
Every text is scored whole, its code length summed in doubles.

Equal texts are one document of the sample. A null or blank text, or one without a letter, is ``und``; so is any text if
nothing could be learnt. Of languages with codes of equal length the first by name wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swingkit.llm.common import bounded, id_remainder, small_batches, table, unused

ORDER = 3
#: Documents of each language to learn from at most.
SAMPLE = 400
#: Contexts of full length with fewer bytes than this are left to their shorter context.
LEAST = 3
#: Bytes that are looked up at once.
PIECE = 1 << 18
#: Languages whose numbers of rows are broadcast.
MOST_LANGS = 10_000
UNKNOWN = "und"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_bytes(text: str | None) -> np.ndarray:
    """Lower-cased bytes with single spaces for all that isn't a letter in ASCII, a space in front."""
    raw = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS), np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    return raw[keep]


def grams(raw: np.ndarray) -> np.ndarray:
    """For every byte a number of its ``ORDER`` preceding bytes (zeros before the first) and itself."""
    padded = np.concatenate([np.zeros(ORDER, np.uint8), raw]).astype(np.uint32)
    return (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]


@dataclass
class Costs:
    """Bits of grams or contexts in the languages that have met them: entries of one key lie together."""

    keys: np.ndarray  # distinct, ascending
    start: np.ndarray  # first entry of each key, and the number of entries
    lang: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Costs:
        """From the keys and bits of every language."""
        key = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in parts]])
        order = np.argsort(key, kind="stable")
        keys, start = np.unique(key[order], return_index=True)
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        return Costs(keys, np.append(start, len(key)), lang[order], np.concatenate([np.zeros(0), *[b for _, b in parts]])[order])

    def sums(self, keys: np.ndarray, times: np.ndarray, langs: int) -> np.ndarray:
        """The sum of the bits of ``keys``, each as often as ``times`` says, in every language."""
        if not len(self.keys):
            return np.zeros(langs)
        row = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        met = self.keys[row] == keys
        row, times = row[met], times[met]
        n = self.start[row + 1] - self.start[row]
        at = np.repeat(self.start[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.lang[at], self.bits[at] * np.repeat(times, n), langs)


@dataclass
class Trees:
    """Bits of every byte after every context in every language: a base after one byte, and what longer contexts change."""

    langs: list[str]
    symbol: np.ndarray  # of each byte; the last symbol stands for all bytes that no tree has seen
    base: np.ndarray  # pairs of symbols, languages
    escapes: tuple[Costs, Costs]  # by context of two and of three symbols
    seen: tuple[Costs, Costs]  # by gram of three and of four symbols

    def lengths(self, text: str | None) -> np.ndarray:
        """Code length in bits of the whole text in each language."""
        n, k, total = int(self.symbol.max()) + 1, len(self.langs), np.zeros(len(self.langs))
        s = np.concatenate([np.full(ORDER, self.symbol[0], np.int64), self.symbol[normal_bytes(text)]])
        for at in range(0, len(s) - ORDER, PIECE):
            p = s[at : at + PIECE + ORDER]
            four, times = np.unique(((p[:-3] * n + p[1:-2]) * n + p[2:-1]) * n + p[3:], return_counts=True)
            three, place = np.unique(four % n**3, return_inverse=True)
            often = np.bincount(place, times)
            total += often @ self.base[three % n**2]
            total += self.seen[0].sums(three, often, k) + self.escapes[0].sums(three // n, often, k)
            total += self.seen[1].sums(four, times, k) + self.escapes[1].sums(four // n, times, k)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the shortest code (ties: the first by name) and its share of the likelihood."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.lengths(text)
        share = np.exp2(bits.min() - bits)
        return self.langs[int(bits.argmin())], float(1 / share.sum())


def _escaped(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities of rows of counts, each with the row of the shorter context's probabilities."""
    seen = counts > 0
    n, distinct = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
    left = np.where(seen, 0.0, below)
    rest = left.sum(axis=1, keepdims=True)
    whole = n + distinct
    escape = np.where(rest > 0, distinct / np.maximum(whole, 1), 0.0)
    own = np.where(rest > 0, counts / np.maximum(whole, 1), counts / np.maximum(n, 1))
    return np.where(n > 0, own + escape * left / np.maximum(rest, 1e-300), below)


def grow(counts: pd.DataFrame) -> Trees:
    """The trees of a table of ``lang``, ``gram`` (see :func:`grams`) and ``n``."""
    langs = sorted(counts["lang"].unique())
    gram = counts["gram"].to_numpy(np.int64)
    parts = [(gram >> shift) & 255 for shift in (24, 16, 8, 0)]
    known = np.unique(np.concatenate([[0, 32], *parts])) if len(gram) else np.array([0, 32])
    size = len(known) + 1
    symbol = np.full(256, size - 1, np.int64)
    symbol[known] = np.arange(size - 1)
    a, b, c, s = (symbol[p] for p in parts)
    four, n = ((a * size + b) * size + c) * size + s, counts["n"].to_numpy(np.float64)
    contexts, place = np.unique(four // size, return_inverse=True)
    contexts = contexts[np.bincount(place, n, len(contexts)) >= LEAST] if len(gram) else contexts
    base, escapes, seen = np.empty((size * size, len(langs))), ([], []), ([], [])
    for k, lang in enumerate(langs):
        mine = (counts["lang"] == lang).to_numpy()
        own, w = four[mine], n[mine]
        p0 = _escaped(np.bincount(own % size, w, size)[None, :], np.full((1, size), 1 / size))
        p1 = _escaped(np.bincount(own % size**2, w, size * size).reshape(size, size), np.broadcast_to(p0, (size, size)))
        base[:, k] = -np.log2(p1.ravel())
        three, place = np.unique(own % size**3, return_inverse=True)
        cost, escape, saved = _longer(three, np.bincount(place, w, len(three)), base[three % size**2, k], size)
        escapes[0].append(escape)
        seen[0].append((three, saved))
        own, order = np.unique(own, return_index=True)
        often = np.isin(own // size, contexts)
        own, order = own[often], order[often]
        _, escape, saved = _longer(own, w[order], cost[place[order]], size)
        escapes[1].append(escape)
        seen[1].append((own, saved))
    return Trees(langs, symbol, base, tuple(map(Costs.of, escapes)), tuple(map(Costs.of, seen)))


def _longer(grams: np.ndarray, n: np.ndarray, shorter: np.ndarray, size: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Of distinct grams with their counts and their bits after the shorter context: their bits after the longer one, the bits
    that the longer contexts' escapes add, and what the grams' own bits differ from escape and shorter context."""
    context, place = np.unique(grams // size, return_inverse=True)
    kinds, whole = np.bincount(place, minlength=len(context)), np.bincount(place, n, len(context))
    # The symbol of unseen bytes has been met after no context, so something is always left to escape to.
    left = 1 - np.bincount(place, np.exp2(-shorter), len(context))
    escape = np.log2((whole + kinds) * left / kinds)
    bits = np.log2((whole + kinds)[place] / n)
    return bits, (context, escape), bits - escape[place] - shorter


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Trees:
    """Learn the trees from rows with a text and a language, at most ``sample`` of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(F.col(key).cast("string"), text).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # About four times the sample by hash, so that no language brings all its rows to one task.
    part = F.greatest(F.lit(1), F.floor(F.col("n") / (4 * sample)))
    few = rows.join(bounded(rows.groupBy("lang").agg(F.count("*").alias("n")), MOST_LANGS), "lang").filter(F.pmod("h", part) == 0)
    once = few.groupBy("lang", "h").agg(F.first("text").alias("text"))
    drawn = once.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                gram, n = np.unique(np.concatenate([grams(normal_bytes(x)) for x in texts]), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": gram.astype(np.int64), "n": n.astype(np.int64)})

    small_batches(spark)
    counts = (
        drawn.select("lang", "text")
        .mapInPandas(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    return grow(counts.toPandas())  # distinct grams of a bounded sample


def identify(docs: DataFrame, trees: Trees, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and its score; columns of these names are replaced. ``und`` has score 0."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = held.value
        for batch in texts:
            yield pd.DataFrame([known.predict(x) for x in batch], columns=["lang", "score"])

    found, name = F.pandas_udf(predict, "lang string, score double")(F.col(text)), unused(docs, "found")
    return docs.withColumn(name, found).withColumns({lang: F.col(name)["lang"], score: F.col(name)["score"]}).drop(name)


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
