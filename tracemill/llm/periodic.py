"""Runs of periodic words in texts: Lyndon stacks under both orders, extended by rolling-hash comparisons."""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import mixed
from .shared import text_pieces

#: Words of a run at least, and its length in periods at least.
LEAST, EXPONENT = 6, 4
#: Modulus and base of the rolling hash of word numbers.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
#: Words that are compared one by one before hashes are.
DIRECT = 8

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

_powers = [1]


def powers(n: int) -> list[int]:
    """BASE**0 .. BASE**n modulo PRIME."""
    for _ in range(len(_powers), n + 1):
        _powers.append(_powers[-1] * BASE % PRIME)
    return _powers


class Extension:
    """How far two places of a sequence agree, to the right and to the left.

    The first words are compared one by one. Then a binary search over prefix hashes finds where they part, and what it
    says is checked on the words there. exact: stretches are compared themselves in place of their hashes.
    """

    def __init__(self, ids: list[int], exact: bool = False):
        self.ids, self.exact, self.far = ids, exact, {}
        self.sums = list(accumulate(ids, lambda h, x: (h * BASE + x + 1) % PRIME, initial=0))
        self.powers = powers(len(ids))

    def same(self, i: int, j: int, n: int) -> bool:
        if self.exact:
            return self.ids[i : i + n] == self.ids[j : j + n]
        s = self.sums
        return (s[i + n] - s[j + n] - (s[i] - s[j]) * self.powers[n]) % PRIME == 0

    def right(self, i: int, j: int) -> int:
        """The number of equal words from i and from j > i on."""
        ids, most = self.ids, len(self.ids) - j
        n, near = 0, min(most, DIRECT)
        while n < near and ids[i + n] == ids[j + n]:
            n += 1
        if n < near or n == most:
            return n
        far = self.far.get(j - i)  # the last stretch at this distance: it may begin within what is already equal
        if far and far[0] <= i + n <= far[1]:
            n = far[1] - i
        else:
            n = self._search(n, most, lambda at, size: self.same(i + at, j + at, size))
            if ids[i + n - 1] != ids[j + n - 1] or n < most and ids[i + n] == ids[j + n]:
                raise ArithmeticError("hashes of different words are equal")
        self.far[j - i] = (i, i + n)
        return n

    def left(self, i: int, j: int) -> int:
        """The number of equal words before i and before j > i."""
        ids = self.ids
        n, near = 0, min(i, DIRECT)
        while n < near and ids[i - n - 1] == ids[j - n - 1]:
            n += 1
        if n < near or n == i:
            return n
        n = self._search(n, i, lambda at, size: self.same(i - at - size, j - at - size, size))
        if ids[i - n] != ids[j - n] or n < i and ids[i - n - 1] == ids[j - n - 1]:
            raise ArithmeticError("hashes of different words are equal")
        return n

    @staticmethod
    def _search(n: int, most: int, same) -> int:
        size = DIRECT
        while n + size <= most and same(n, size):
            n, size = n + size, 2 * size
        while size > 1:
            size //= 2
            if n + size <= most and same(n, size):
                n += size
        return n


def lyndon(ids: list[int], extension: Extension, falling: bool):
    """(place, length) of the longest Lyndon word at each place, from the right to the left, under the order of the
    numbers or the falling one. The stack holds the starts of the Lyndon words that what is read so far is made of; a new
    word takes in those on top while it is less than they are."""
    end, stack = len(ids), [len(ids)]
    for i in range(end - 1, -1, -1):
        while (j := stack[-1]) < end:
            n = 0
            if ids[i] == ids[j]:
                n = extension.right(i, j)
                if j + n == end:  # a prefix is less than what it begins, under both orders
                    break
            if (ids[i + n] > ids[j + n]) != falling:
                break
            stack.pop()
        yield i, j - i
        stack.append(i)


def runs_of(ids: list[int], least: int, exponent: int, exact: bool = False) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. Each run holds, under one of the orders, the Lyndon word
    of its period as the longest one of some place, so that extending these words to both sides finds all runs. Each run
    is verified on its words; were hashes of different words equal, words would be compared in their place."""
    try:
        extension, found, last = Extension(ids, exact), set(), {}
        for falling in (False, True):
            for i, q in lyndon(ids, extension, falling):
                if i + q >= len(ids):
                    continue
                s, e = last.get(q, (0, 0))
                if s <= i and i + 2 * q <= e:  # another period of a run that is known
                    continue
                right = extension.right(i, i + q)
                left = extension.left(i, i + q)
                if left + right >= q:
                    last[q] = (i - left, i + q + right)
                    if left + q + right >= max(least, exponent * q):
                        found.add((i - left, left + q + right, q))
        for s, n, q in found:
            if ids[s : s + n - q] != ids[s + q : s + n] or s and ids[s - 1] == ids[s + q - 1] or s + n < len(ids) and ids[s + n] == ids[s + n - q]:
                raise ArithmeticError("a run is none")
    except ArithmeticError:
        if exact:
            raise
        return runs_of(ids, least, exponent, True)
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Where runs can lie: stretches of words whose triples all occur often enough in the text. A run of period q holds
    each of its triples at least (its length - 2) // q times, and so does a run that is one word longer, so that runs lie
    within these stretches as they lie in the text."""
    often = min(max(least, exponent) - 2, exponent - 1)
    if often < 2 or len(ids) < 3:
        return [(0, len(ids))]
    top = int(ids.max()) + 1
    if top <= 1 << 21:
        triples = (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    else:  # numbers that are equal by chance make stretches longer, no more
        triples = mixed(mixed(ids[:-2].astype(np.uint64)) * np.uint64(3) + mixed(ids[1:-1].astype(np.uint64) + np.uint64(1 << 40))) + ids[2:].astype(np.uint64)
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    counts = np.diff(np.concatenate((first, [len(ranked)])))
    marked = np.zeros(len(ids), bool)
    marked[order] = np.repeat(counts >= often, counts)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).view(np.int8)))
    return [(a, b + 2) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b + 2 - a >= max(least, exponent)]


def runs_of_words(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    if len(words) < max(least, exponent):
        return []
    ids = pd.factorize(np.array(words, object))[0].astype(np.int64)
    return [(a + s, n, q) for a, b in stretches(ids, least, exponent) for s, n, q in runs_of(ids[a:b].tolist(), least, exponent)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        cover[s + q] += 1
        cover[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, prepared=None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; in words; by start, then period) and the text
    without what its runs repeat (`collapsed`, words joined by spaces).

    A run is a stretch of at least `least` words and `exponent` (2 or more) times its smallest period that no
    neighbouring word extends. prepared(doc_id, words) may give other words to search. Null, empty and white texts have
    no words and no runs; rows that repeat are returned each; a null doc_id stays null; empty tables give no rows; other
    columns are not read. Each text is searched on its own, where it is read: no shuffle. A long text takes some 20 times
    its bytes of memory, more where all of it is periodic.
    """

    def searched(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for batch, text in text_pieces(whole):
                ids, counts, every, rest = batch.column("doc_id"), [], [], []
                for doc_id, one in zip(ids.to_pylist(), text.cast(pa.large_binary()), strict=True):
                    words = one.as_py().split()  # of bytes: white space is just that of the contracts
                    words = words if prepared is None else prepared(doc_id, words)
                    runs = runs_of_words(words, least, exponent)
                    counts.append(len(words))
                    every.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    rest.append(collapsed(words, runs))
                columns = [ids, pa.array(counts, pa.int64()), pa.array(every, kind), pa.array(rest, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return source.mapInArrow(searched, SCHEMA)


def with_periods(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, where a tenth of the documents repeat some from a word on; without doc_id, none do."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), prepared=with_periods)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))).alias("best")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    out = found.select("doc_id", "runs", best, F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
