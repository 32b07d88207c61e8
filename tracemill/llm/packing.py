"""Packing of tokenised documents into sequences, in their order, by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import give_back, text_pieces

#: Tokens of a sequence; the id that ends a document.
LENGTH, END_ID = 4096, 2
#: Bytes of text that are packed together, and that are encoded at once.
BLOCK, PIECE = 8 << 20, 1 << 20
#: Cost, in tokens of padding, of a window that ends inside a document after a sentence or inside a sentence.
SENTENCE, BROKEN = 24.0, 256.0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def window_cuts(places: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The places (ascending, from 0 to the end, gaps of at most `length`) at which windows end, minimising the sum of
    padding and penalties. f(j) = length - p[j] + penalty[j] + min(f(i) + p[i]) over the i that a window from i to j
    allows; that minimum over a sliding range comes from a monotone queue, so the whole takes linear time."""
    p, cost = places.tolist(), penalty.tolist()
    before, queue, value = [0] * len(p), deque([(0, 0.0)]), 0.0
    for j in range(1, len(p)):
        while p[queue[0][0]] < p[j] - length:
            queue.popleft()
        i, least = queue[0]
        before[j] = i
        value = length + cost[j] + least  # f(j) + p(j)
        while queue and queue[-1][1] >= value:
            queue.pop()
        queue.append((j, value))
    out, j = [], len(p) - 1
    while j > 0:
        out.append(p[j])
        j = before[j]
    return out[::-1]


def windows(ends: np.ndarray, sentences: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Window bounds for documents that end at `ends`, with the places after their sentences; window starts with 0."""
    total = int(ends[-1])
    places = np.unique(np.concatenate(([0], ends, sentences)))
    gaps = np.diff(places)
    far = np.flatnonzero(gaps > length // 2)
    more = [np.arange(places[i] + length // 2, places[i + 1], length // 2) for i in far]  # sentences too long for a window
    places = np.unique(np.concatenate((places, *more))).astype(np.int64)
    penalty = np.full(len(places), BROKEN)
    penalty[np.isin(places, sentences)] = SENTENCE
    penalty[np.isin(places, ends)] = 0.0
    penalty[[0, -1]] = 0.0
    return np.array([0, *window_cuts(places, penalty, length)] if total else [0, 0])


def encoded(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a block's texts, where each text's begin (with the end), and the places after sentences; pieces of the
    block are encoded one after the other, since their units take far more memory than their ids."""
    parts, size = [], 0
    for _, text in text_pieces(batch, PIECE):
        ids, begin, stops = encoder(name, True).encode(text, ends=True)
        parts.append((ids.copy(), begin[bool(parts) :] + size, stops + size))
        size += len(ids)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents follow each other as they are stored. A window is cut at the end of a document, after a sentence, or,
    at a higher cost, within one. Null and empty texts hold the end id alone; repeated rows are packed each; empty
    tables give no rows. Other columns are not read. Blocks of about 8 MB of text are packed on their own, so that a
    task holds one block, and sequences are numbered by partition: no shuffle.
    """

    def packed(batches):
        yield from blocks(batches)
        give_back()

    def blocks(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch, _ in text_pieces(whole, BLOCK):
                ids, begin, stops = encoded(batch, name)
                n = np.diff(begin)
                ends = np.cumsum(n + 1)
                all_ids = np.insert(ids, begin[1:], end_id).astype("<u4")
                owner = np.searchsorted(begin, stops, "right") - 1  # a stop at a document's end goes to the next, whose begin it is
                bounds = windows(ends, stops + np.maximum(owner, 0), length)
                cut = np.unique(np.concatenate((bounds, ends, [0])))
                left, right = cut[:-1], cut[1:]
                doc = np.searchsorted(ends, left, "right")
                window = np.searchsorted(bounds, left, "right") - 1
                first = ends[doc] - n[doc] - 1
                data = memoryview(all_ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(left - first), pa.array(right - left), pa.array(crc, pa.int64()), pa.array(n[doc] + 1), pa.array(number + window), pa.array(left - bounds[window])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                number += len(bounds) - 1

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return source.mapInArrow(packed, SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
