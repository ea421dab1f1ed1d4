"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into words by the vocabulary's split pattern, worked out on arrays of code points. The symbols of all
words that a task hasn't met lie in one flat array; in each round the pairs of neighbours are looked up by binary search
over the sorted pair keys of the merge table, and every word merges all its pairs of its lowest rank, from the left.
A word without a known pair is done. Words of more than ``LONG`` bytes take rounds of one rank over all of them instead,
which look up only the pairs beside the last merges, so that a word's cost doesn't grow with its square. Decoding gathers the bytes of the tokens from one flat array.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.llm.common import small_batches, table

#: Words that an encoder remembers before it starts anew.
REMEMBERED = 400_000
#: Bytes of a word from which on its places are kept by rank.
LONG = 1024
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_NEVER = np.iinfo(np.int64).max


def _byte_signs() -> list[str]:
    """The printable sign that a byte-level vocabulary writes for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _kinds() -> np.ndarray:
    """White space, letter, number or other for every code point."""
    signs = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, signs):
            shift = 0x800 if m.start() >= 0xD800 else 0
            kinds[m.start() + shift : m.end() + (0x800 if m.end() > 0xD800 else 0)] = kind
    kinds[0xD800:0xE000] = _OTHER
    return kinds


class Vocabulary:
    """The tables of a byte-level BPE file of the tokenizers library (``path``)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, merges = file["model"]["vocab"], file["model"]["merges"]
        signs = _byte_signs()
        self.of_byte = np.array([ids[s] for s in signs], np.int64)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.width = max([*ids.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order].astype(np.uint32 if self.width < 1 << 16 else np.int64), order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        byte = {s: b for b, s in enumerate(signs)}
        spelt = [b""] * self.width
        for token, i in ids.items():
            spelt[i] = bytes(byte[s] for s in token)
        for token, i in self.special.items():
            spelt[i] = token.encode()
        self.lengths = np.array([len(s) for s in spelt], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.spelling = np.frombuffer(b"".join(spelt), np.uint8)
        self.kinds = _kinds()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The words that the split pattern gives; a special token in the text is a word of its own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._words(text)
        parts = self.cut.split(text)
        return [w for k, p in enumerate(parts) if p for w in ([p] if k % 2 else self._words(p))]

    def _words(self, text: str) -> list[str]:
        n = len(text)
        if not n:
            return []
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[points]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        # The last white space before a word stands alone, or is the word's first sign if it is a plain space.
        after = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
        start[after - 1] = True
        start[after] = points[after - 1] != 32
        for p in np.flatnonzero(points == 39):
            # A lone apostrophe that begins a word takes the letters of a short ending.
            if p + 1 < n and start[p] and kind[p + 1] == _LETTER and start[p + 1] and (p == 0 or points[p - 1] != 32):
                took = 1 if text[p + 1] in "stmd" else 2 if text[p + 1 : p + 3] in ("re", "ve", "ll") else 0
                if took:
                    start[p + 1] = False
                    if p + 1 + took < n and kind[p + 1 + took] == _LETTER:
                        start[p + 1 + took] = True
        cuts = np.flatnonzero(start).tolist()
        return [text[i:j] for i, j in zip(cuts, [*cuts[1:], n], strict=True)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's number of ids."""
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._merge_short(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        parts = self._merge_short([words[k] for k in short]), self._merge_long([words[k] for k in long])
        sizes = np.empty(len(words), np.int64)
        sizes[short], sizes[long] = parts[0][1], parts[1][1]
        order = np.argsort([*short, *long], kind="stable")
        both, own = np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]])
        return both[_runs((np.cumsum(own) - own)[order], own[order])], sizes

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair among the sorted keys, and its rank, or a rank beyond all."""
        key = (left * self.width + right).astype(self.keys.dtype)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def _merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`merge`: the places of the pairs of each rank are kept, and a round merges those of the lowest rank."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n, word = len(ids), np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[np.cumsum(sizes) - 1] = n
        before[np.cumsum(sizes) - sizes] = -1
        there, waiting, ranks = np.ones(n, bool), {}, []

        def wait(places: np.ndarray) -> None:
            _, rank = self._look_up(ids[places], ids[after[places]])
            places, rank = places[rank < _NEVER], rank[rank < _NEVER]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    r = int(rank[i])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(places[i:j])

        wait(np.flatnonzero(after < n))
        while ranks:
            rank = heapq.heappop(ranks)
            spots = np.sort(np.concatenate(waiting.pop(rank)))
            spots = spots[there[spots]]
            spots = spots[after[spots] < n]
            at, now = self._look_up(ids[spots], ids[after[spots]])
            spots, at = spots[now == rank], at[now == rank]
            taken = _every_second(spots, after[spots])
            spots, at = spots[taken], at[taken]
            if not len(spots):
                continue
            gone = after[spots]
            ids[spots], there[gone] = self.merged[at], False
            after[spots] = after[gone]
            inside = spots[after[spots] < n]
            before[after[inside]] = inside
            left = before[spots]
            wait(np.unique(np.concatenate([left[left >= 0], inside])))
        return ids[there].astype(np.int32), np.bincount(word[there], minlength=len(words))

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at, rank = self._look_up(ids, np.append(ids[1:], 0))
        rank[np.append(word[:-1] != word[1:], True)[: len(ids)]] = _NEVER
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            ended = best == _NEVER
            hit = (rank == best) & ~ended
            spots = np.flatnonzero(hit)
            spots = spots[_every_second(spots, spots + 1)]
            ids[spots] = self.merged[at[spots]]
            keep = ~ended
            keep[spots + 1] = False
            if ended.any():
                done.append((word[ended], ids[ended]))
            place = (np.cumsum(keep) - 1)[spots]
            ids, word, at, rank = ids[keep], word[keep], at[keep], rank[keep]
            # Only the pairs on both sides of a merge are new.
            new = np.zeros(len(ids), bool)
            new[place] = True
            new[place[place > 0] - 1] = True
            fresh = np.flatnonzero(new)
            beside = np.minimum(fresh + 1, len(ids) - 1)
            at[fresh], found = self._look_up(ids[fresh], ids[beside])
            rank[fresh] = np.where((word[fresh] == word[beside]) & (beside > fresh), found, _NEVER)
        if not done:
            return np.empty(0, np.int32), sizes
        word, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
        return ids[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; ids outside the vocabulary are skipped, broken UTF-8 becomes U+FFFD."""
        ids = ids[(ids >= 0) & (ids < self.width)]
        return self.spelling[_runs(self.starts[ids], self.lengths[ids])].tobytes().decode("utf-8", "replace")


def _every_second(spots: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which pairs (first places, second places) to merge: of a row in which each begins where the one before ends, every second."""
    fresh = np.ones(len(spots), bool)
    fresh[1:] = after[:-1] != spots[1:]
    places = np.arange(len(fresh))
    return (places - np.maximum.accumulate(np.where(fresh, places, 0))) % 2 == 0


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes batches of texts and remembers the ids of words."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.remembered = vocabulary, remembered
        self._forget()

    def _forget(self) -> None:
        special = self.vocabulary.special
        self.place = _Places({w: k for k, w in enumerate(special)})
        self.ids = np.array(list(special.values()), np.int32)
        self.starts, self.sizes = np.arange(len(special)), np.ones(len(special), np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of each text's first id and of the end."""
        if len(self.place) > self.remembered:
            self._forget()
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += self.vocabulary.words(text or "")
            ends.append(len(words))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if new := self.place.take_new():
            ids, sizes = self.vocabulary.merge([w.encode("utf-8", "replace") for w in new])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        sizes = self.sizes[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.array(ends)]
        return self.ids[_runs(self.starts[at], sizes)], offsets


class _Places(dict):
    """Numbers words as they come, and remembers which are new."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` plus the array of token ids of every whole text, as the library gives without extra tokens; null: none."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(held.value)
        for batch in batches:
            found, offsets = encoder.encode(batch.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))

    return docs.withColumn(ids, F.arrow_udf(encode, "array<int>")(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` plus the text of every array of ids; null: the empty text. Special tokens are spelt out."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, ends = batch.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.array(batch.value_lengths().fill_null(0)))
            yield pa.array([held.value.decode(flat[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)], pa.string())

    return docs.withColumn(text, F.arrow_udf(decode, "string")(F.col(ids)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def joined(ids: str) -> Column:
    """The decimal ids with commas between."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Number and digest of every document's token ids, and the digest of the text decoded from them."""
    path = path or default_path()
    found = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
