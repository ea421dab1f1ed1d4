"""Ranked lexical search by best-first document intervals over range-maximum sparse tables.

Documents become counts of the terms that the items ask for. They are laid out so that neighbours are alike (their most
frequent term, then length) and cut into chunks of bounded size. A chunk has a posting list for every term, in document
order, with a sparse table of range maxima over the lists' impacts. An item starts with the interval of all documents of
a chunk: each of its terms' lists answers with the greatest impact in the interval, and the sum bounds every document
there. The interval of the greatest bound is taken, the document of its greatest impact is scored exactly and splits it
in two, whose bounds are answered anew. Intervals of ``LEAF`` documents or fewer are scored whole. A search ends as soon
as no interval left can reach the item's k-th score.

The k-th scores of a bounded sample of the documents are the floor that all other chunks start from. A task keeps the
``k`` best of every item over its chunks, and a window ranks what the tasks have found.

Items are worked off in blocks of bounded size, each over all documents.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swingkit.llm.common import dropped, kept, small_batches, table

K = 20
#: Documents of an interval that is scored whole, and postings of a chunk.
LEAF, CHUNK_POSTINGS = 32, 1 << 20
#: Bytes of item text in one block of items, and bytes of a document that are cut into terms at once.
BLOCK_BYTES, PIECE = 16 << 20, 1 << 20
#: Documents of the sample that the floors come from.
SAMPLE = 4096

#: ASCII letters and digits and all bytes of longer characters make terms; A-Z are lower-cased, all else separates.
_TERM_BYTES = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def term_counts(text: bytes) -> tuple[int, Counter]:
    """The number of terms of a UTF-8 text, with repeats, and how often each occurs."""
    body, at, n, found = text.translate(_TERM_BYTES), 0, 0, Counter()
    while at < len(body):
        upto = body.find(b" ", at + PIECE)
        upto = len(body) if upto < 0 else upto
        terms = body[at:upto].split()
        n += len(terms)
        found.update(terms)
        at = upto
    return n, found


def counted(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``n`` (terms with repeats), ``top`` (most frequent known term), ``terms`` and ``tfs`` of every document with a term."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            ids, lengths, tops, terms, tfs = [], [], [], [], []
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                n, found = term_counts(body.as_py() or b"")
                if n:
                    own = sorted((known[t], tf) for t, tf in found.items() if t in known)
                    ids.append(doc_id.as_py()), lengths.append(n), terms.append([t for t, _ in own]), tfs.append([tf for _, tf in own])
                    tops.append(max(own, key=lambda x: (x[1], -x[0]), default=(-1, 0))[0])
            whole = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(tops, pa.int32()), pa.array(terms, whole), pa.array(tfs, whole)], ["doc_id", "n", "top", "terms", "tfs"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, top int, terms array<int>, tfs array<int>")


class Chunk:
    """Posting lists of a run of documents, side by side in one array, with a sparse table of the places of range maxima."""

    def __init__(self, n_terms: int, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, n_words: int) -> None:
        m = 75 + (25 * lengths.astype(np.int64) * n_docs) // n_words
        doc = np.repeat(np.arange(len(lengths)), sizes)
        order = np.argsort(terms, kind="stable")
        tfs, self.doc, self.docs = tfs[order].astype(np.int64), doc[order].astype(np.int32), len(lengths)
        self.impact = ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[self.doc])).astype(np.int32)  # below 1,000,000
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.place = terms[order].astype(np.int64) * self.docs + self.doc
        self.best = [np.arange(len(doc), dtype=np.int32)]
        half = 1
        while 2 * half <= np.diff(self.start).max(initial=0):
            a, b = self.best[-1][:-half], self.best[-1][half:]
            self.best.append(np.where(self.impact[b] > self.impact[a], b, a))
            half *= 2
        self.met = self.scored = 0  # documents of all items, and those that were scored

    def _greatest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the greatest impacts of the non-empty ranges."""
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int32)
        for j in set(level.tolist()):
            at = level == j
            a, b = self.best[j][lo[at]], self.best[j][hi[at] - (1 << j)]
            out[at] = np.where(self.impact[b] > self.impact[a], b, a)
        return out

    def _interval(self, first: int, end: int, lo: np.ndarray, hi: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple | None:
        """An interval with its bound (negated, for the heap) and the document that splits it; None without a posting."""
        full = hi > lo
        if not full.any():
            return None
        lo, hi, terms, weights = lo[full], hi[full], terms[full], weights[full]
        at = self._greatest(lo, hi)
        most = weights * self.impact[at]
        return -int(most.sum()), first, end, int(self.doc[at[most.argmax()]]), lo, hi, terms, weights

    def _whole(self, first: int, end: int, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of the documents from ``first`` up to ``end``."""
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        scores = np.zeros(end - first, np.int64)
        np.add.at(scores, self.doc[at] - first, np.repeat(weights, size) * self.impact[at])
        return scores

    def search(self, terms: np.ndarray, weights: np.ndarray, keep: Best) -> None:
        """Offers ``keep`` every document that can be among its best."""
        self.met += self.docs
        root = self._interval(0, self.docs, self.start[terms], self.start[terms + 1], terms, weights)
        heap = [root] if root and -root[0] >= keep.floor else []
        while heap and -heap[0][0] >= keep.floor:  # an equal score may have a smaller doc_id
            _, first, end, middle, lo, hi, terms, weights = heappop(heap)
            if end - first <= LEAF:
                scores = self._whole(first, end, lo, hi, weights)
                self.scored += end - first
                for d in np.flatnonzero(scores >= keep.floor).tolist():
                    keep.offer(int(scores[d]), first + d)
                continue
            wanted = terms * self.docs + middle
            cut = np.searchsorted(self.place, wanted)
            has = cut < hi
            has[has] = self.place[cut[has]] == wanted[has]
            self.scored += 1
            keep.offer(int((weights[has] * self.impact[cut[has]]).sum()), middle)
            for part in ((first, middle, lo, cut), (middle + 1, end, cut + has, hi)):
                found = self._interval(*part, terms, weights)
                if found and -found[0] >= keep.floor:
                    heappush(heap, found)


class Best:
    """The k best (score, document) of one item, equal scores by doc_id with null ones last, and the least score that can still matter."""

    def __init__(self, k: int, floor: int = 1) -> None:
        self.k, self.floor, self.rows, self.ids = k, floor, [], []

    def offer(self, score: int, doc: int) -> None:
        if score >= self.floor:
            own = self.ids[doc]
            insort(self.rows, (-score, own is None, own or 0))
            if len(self.rows) >= self.k:
                del self.rows[self.k :]
                self.floor = max(self.floor, -self.rows[-1][0])


def found_in(rows: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], floors: dict[int, int], stats: tuple[int, int, int], k: int, chunk_postings: int) -> DataFrame:
    """qid, doc_id and score of the best of each partition of ``rows``, in chunks of at most about ``chunk_postings``.

    ``items``: qid, terms and weights; ``stats``: numbers of known terms, of documents and of all their terms.
    """
    n_terms, n_docs, n_words = stats
    held = rows.sparkSession.sparkContext.broadcast((items, floors))  # of one block of items

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = held.value
        best = {qid: Best(k, max(1, least.get(qid, 1))) for qid, _, _ in asked}
        waiting, size = [], 0

        def work() -> None:
            if not waiting:
                return
            whole = pa.Table.from_batches(waiting).combine_chunks()
            lists = whole.column("terms").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            chunk = Chunk(n_terms, whole.column("n").to_numpy(), sizes, lists.flatten().to_numpy(), whole.column("tfs").combine_chunks().flatten().to_numpy(), n_docs, n_words)
            ids = whole.column("doc_id").to_pylist()
            for qid, terms, weights in asked:
                best[qid].ids = ids
                chunk.search(terms, weights, best[qid])

        for batch in batches:
            waiting.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= chunk_postings:
                work()
                waiting, size = [], 0
        work()
        out = [(qid, None if null else doc, -score) for qid, b in best.items() for score, null, doc in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["qid", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "qid long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, items: list[tuple[int, Counter]], k: int = K, chunk_postings: int = CHUNK_POSTINGS, sample: int = SAMPLE) -> DataFrame:
    """qid, rank, doc_id and score of the ``k`` best of ``docs`` (doc_id, text) for the items (qid, counts of terms) of one block."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in items for t in own}))}
    index, path = kept(counted(docs, vocabulary), "terms")
    n_docs, n_words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most a row for each term of the block
    asked = []
    for qid, own in items:
        pairs = [(vocabulary[t], reps * weight(n_docs, df[vocabulary[t]])) for t, reps in own.items() if vocabulary[t] in df]
        asked.append((qid, *(np.array([p[j] for p in pairs if p[1]], np.int64) for j in (0, 1))))
    stats, postings = (len(vocabulary), n_docs, n_words), sum(df.values())
    dealt = F.pmod(F.xxhash64("doc_id", "n"), F.lit(max(1, n_docs // sample)))
    some = found_in(index.filter(dealt == 0).limit(2 * sample).repartition(spark.sparkContext.defaultParallelism), asked, {}, stats, k, chunk_postings)
    floors = {r.qid: r.score for r in ranked(some, k).filter(F.col("rank") == k).collect()}  # a row an item
    keyed = index.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(max(-(-postings // chunk_postings), spark.sparkContext.defaultParallelism), "top", "n", "doc_id", "_n").sortWithinPartitions("top", "n", "doc_id", "_n")
    best, best_path = kept(ranked(found_in(keyed, asked, floors, stats, k, chunk_postings), k), "best")
    dropped(spark, path)
    return best


def search(docs: DataFrame, items: DataFrame, k: int = K, item: str = "item_id", text: str = "text", **limits: int) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of every item with a score above 0.

    Null texts have no terms; a null doc_id comes after all others of its score. Rows of one doc_id are documents of
    their own, and rows of one item_id are items of their own with ranks of their own. Without documents or items there
    are no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, _ = kept(items.select(F.col(item).alias("item_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("qid")), "items")
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "text").collect()  # about BLOCK_BYTES
        best = search_block(docs, [(r.qid, term_counts(bytes(r.text))[1]) for r in own], k, **limits)
        found = best if found is None else found.unionByName(best)
    return found.join(rows.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")


def op13_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``documents`` for every ``benchmark`` item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT count(*) AS nd, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0
), q AS (
  SELECT i, item_id, term, count(*) AS reps FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, nd
), x AS (
  SELECT i, item_id, r, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(terms) * nd) // l))))) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM x JOIN d USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 20
"""
