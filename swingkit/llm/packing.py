"""Packing by non-negative least squares.

Documents are cut at every ``WINDOW`` tokens; full windows are sequences of their own, and the rests make a histogram of
at most ``WINDOW`` lengths. Pairs and triples of lengths that fill a window exactly are the columns of a non-negative
least-squares problem against that histogram; the rounded solution says how often each combination repeats, and what it
leaves is packed greedily, the longest first. The plan depends on the histogram alone, so its size is bounded by the
window, whatever the corpus; a rest finds its sequence by its rank among the rests of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swingkit.llm.bpe import Encoder, Vocabulary, default_path
from swingkit.llm.common import checkpointed, small_batches, table

WINDOW, END = 1024, 0
#: Rests of one length, and full windows, are ranked in so many parts each.
PARTS, FULL_PARTS = 128, 8192
STEPS = 400


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """The pieces of every document's ids and its ``end`` id: the key, start, length, ids_crc32 and doc_tokens.

    ``path`` is a byte-level BPE file of the tokenizers library; the ids are those of :mod:`swingkit.llm.bpe`, which are the
    library's. A null text is empty and still has its ``end``.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in batches:
            found, ends = encoder.encode(batch.column(1).to_pylist())
            row, start, length, crc, total = [], [], [], [], []
            for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                ids = np.append(found[i:j], end).astype("<u4")
                for at in range(0, len(ids), window):
                    own = ids[at : at + window]
                    row.append(k), start.append(at), length.append(len(own)), crc.append(zlib.crc32(own)), total.append(len(ids))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(cut, schema).withColumnRenamed("_key", key)


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All rows of three lengths (0 for none), the longest first, that fill the window exactly: about a twelfth of its square at most."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    c = window - a - b
    fine = (a >= b) & (b >= c) & (c >= 0) & (a < window)
    a, b, c = a[fine], b[fine], c[fine]
    inside = there[c]
    return np.stack([a[inside], b[inside], c[inside]], axis=1)


def least_squares(columns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the columns that minimise the squared distance to the counts, by accelerated projected gradients."""
    n = len(counts)

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(columns[:, k], x, n) for k in range(3))
        out[0] = 0
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        r = np.concatenate([[0.0], r[1:]])
        return r[columns].sum(axis=1)

    v = np.ones(len(columns))
    for _ in range(30):
        v = backward(forward(v))
        top = float(np.linalg.norm(v))
        v /= top or 1
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y + backward(counts - forward(y)) / (1.02 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Combinations of lengths and their repeats that use up ``counts[length]`` of every length below the window."""
    left, out = counts.astype(np.int64).copy(), []
    left[0] = 0
    columns = combinations(np.flatnonzero(left[:window]), window)
    if len(columns):
        wanted = np.rint(least_squares(columns, left[: window + 1].astype(float))).astype(np.int64)
        for k in np.argsort(-wanted, kind="stable")[: int((wanted > 0).sum())]:
            sizes, uses = np.unique(columns[k][columns[k] > 0], return_counts=True)
            if (n := min(int(wanted[k]), int((left[sizes] // uses).min()))) > 0:
                left[sizes] -= n * uses
                out.append((columns[k][columns[k] > 0].tolist(), n))
    while left.any():
        combination, room, free = [], window, left.copy()
        while (fits := np.flatnonzero(free[1 : room + 1])).size:
            size = int(fits[-1]) + 1
            n = min(int(free[size]), room // size)
            combination += [size] * n
            free[size] -= n
            room -= n * size
        sizes, uses = np.unique(combination, return_counts=True)
        n = int((left[sizes] // uses).min())
        left[sizes] -= n * uses
        out.append((combination, n))
    return out


def _slots(combos: list[tuple[list[int], int]], full: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and the first sequence and the offset of each run of ranks."""
    keys, first, offset, used, sequence = [window << 48], [0], [0], {}, full
    for combination, n in combos:
        at = 0
        for size in combination:
            keys.append((size << 48) + used.get(size, 0)), first.append(sequence), offset.append(at)
            used[size] = used.get(size, 0) + n
            at += size
        sequence += n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(first, np.int64)[order], np.array(offset, np.int64)[order]


def pack(cut: DataFrame, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The pieces (see :func:`pieces`) plus ``sequence_id`` and ``offset`` (long). Pieces of equal columns are rows of their own."""
    part = F.when(F.col("length") == window, F.pmod(F.xxhash64(key, "start"), F.lit(FULL_PARTS))).otherwise(F.pmod(F.xxhash64(key, "start"), F.lit(PARTS)))
    cut = checkpointed(cut.withColumn("_part", part.cast("int")))
    sizes = cut.groupBy("length", "_part").agg(F.count("*").alias("n")).toPandas()  # at most WINDOW * PARTS + FULL_PARTS rows
    before = np.zeros(window * PARTS + FULL_PARTS, np.int64)  # by length and part
    before[sizes["length"].to_numpy(np.int64) * PARTS + sizes["_part"].to_numpy(np.int64)] = sizes["n"].to_numpy(np.int64)
    counts = np.append(before[: window * PARTS].reshape(window, PARTS).sum(axis=1), before[window * PARTS :].sum())
    ends = np.cumsum(before)
    starts = np.append(np.repeat(ends[PARTS - 1 : window * PARTS : PARTS] - counts[:window], PARTS), np.full(FULL_PARTS, ends[window * PARTS - 1]))
    rests = np.append(counts[:window], 0)
    held = cut.sparkSession.sparkContext.broadcast((ends - before - starts, *_slots(plan(rests, window), int(counts[window]), window)))

    def find(length: pd.Series, part: pd.Series, row: pd.Series) -> pd.DataFrame:
        ahead, keys, first, offset = held.value
        size = length.to_numpy(np.int64)
        rank = ahead[size * PARTS + part.to_numpy(np.int64)] + row.to_numpy(np.int64) - 1
        at = np.searchsorted(keys, (size << 48) + rank, side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + (size << 48) + rank - keys[at], "offset": offset[at]})

    row = F.row_number().over(Window.partitionBy("length", "_part").orderBy(key, "start", "ids_crc32"))
    found = F.pandas_udf(find, "sequence_id long, offset long")("length", "_part", "_row")
    return cut.withColumn("_row", row).withColumn("_found", found).select(*[c for c in cut.columns if c != "_part"], "_found.*")


def op7_nnls_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs, path or default_path()))
