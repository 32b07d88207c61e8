"""Language identification: each text as a mixture of languages, by expectation maximisation."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, text_pieces

#: Cells of the hashed table of n-grams of each language; orders of n-grams.
CELLS, ORDERS = 1 << 16, (1, 2, 3)
#: Rounds of expectation maximisation, penalty of each language beyond the first.
ROUNDS, PENALTY = 12, 3.0
#: Languages that can be learnt; more values of `lang` end the job, since their tables (0.8 MB each) would not fit.
LANGUAGES = 256
#: Characters of text whose n-grams are held at once; longer texts are read in parts, cut after a character that is no letter.
PART = 1 << 20


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; whatever is no letter becomes a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(_is_letter()[np.minimum(points, 0x10FFFF)], points, 32).astype(np.uint32)


_letter: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter[0]


def parts(text: pa.LargeStringArray, limit: int | None = None):
    """(texts, places): the texts, in parts of about `limit` characters together, and which text each is of. A word that
    alone is longer than a part is cut."""
    limit = limit or PART
    held, owner, size = [], [], 0
    for i, t in enumerate(text.to_pylist()):
        start = 0
        while True:
            stop = len(t)
            if stop - start > limit:
                at = start + limit
                stop = next((k for k in range(at, min(len(t), at + limit)) if not t[k - 1].isalpha()), at)
            held.append(t[start:stop])
            owner.append(i)
            size += stop - start
            if size >= limit:
                yield pa.array(held, pa.large_string()), np.array(owner)
                held, owner, size = [], [], 0
            start = stop
            if start >= len(t):
                break
    if held:
        yield pa.array(held, pa.large_string()), np.array(owner)


def features(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: n-gram cells (len(ORDERS) for each character and the space after the word), the first
    cell of each word (with the end), the number of words before each text (with the end), letters of each word."""
    parts = [letters(t + " ") if t else np.array([32], np.uint32) for t in text.to_pylist()]
    sizes = np.array([len(p) for p in parts])
    points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    at = np.concatenate(([0], np.cumsum(sizes)))
    space = points == 32
    before = np.concatenate(([True], space[:-1])) if len(space) else space
    keep = ~(space & before)  # one space after each word
    points, space = points[keep], space[keep]
    at = np.concatenate(([0], np.cumsum(keep)))[at]
    p = points.astype(np.uint64)
    prior = np.concatenate((np.array([32], np.uint64), p[:-1]))
    prior2 = np.concatenate((np.array([32, 32], np.uint64), p[:-2]))[: len(p)]
    prior2 = np.where(prior == 32, np.uint64(32), prior2)
    grams = []
    for order in ORDERS:
        h = p + (prior << np.uint64(21)) * np.uint64(order > 1) + (prior2 << np.uint64(42)) * np.uint64(order > 2)
        h = (h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append(((h >> np.uint64(40)) % np.uint64(CELLS)).astype(np.int32))
    ends = np.flatnonzero(space) + 1
    starts = np.concatenate(([0], ends)).astype(np.int64)
    first = np.searchsorted(starts[:-1], at) if len(starts) > 1 else np.zeros(len(at), np.int64)
    return np.stack(grams, 1), starts, first, np.diff(starts) - 1


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (cells x languages) of character n-grams, each order's interpolated by the sum
    over its orders. Learns from all texts with a language whose id's crc32 modulo 4 is not 2. Tasks send one row for
    each language and cell, so that what is gathered is bounded by languages x cells."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 4)).select("lang", "text")
    size = CELLS * len(ORDERS)
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different values of lang")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch, text in text_pieces(whole, 2 << 20):
                langs = batch.column("lang").to_pylist()
                for some, owner in parts(text):
                    grams, starts, first, _ = features(some)
                    bounds, of = starts[first], [langs[i] for i in owner]
                    for lang in set(of):
                        mine = total.setdefault(lang, np.zeros(size, np.int64))
                        chosen = np.concatenate([grams[bounds[i] : bounds[i + 1]] for i, x in enumerate(of) if x == lang])
                        for k in range(len(ORDERS)):
                            mine[k * CELLS : (k + 1) * CELLS] += np.bincount(chosen[:, k], minlength=CELLS)
        for lang, counts in total.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells])], ["lang", "cell", "n"])

    got = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((size, len(langs)))
    for j, lang in enumerate(langs):
        mine = got[got["lang"] == lang]
        table[mine["cell"].to_numpy(), j] = mine["n"].to_numpy()
    log = np.zeros_like(table)
    for k in range(len(ORDERS)):
        part = table[k * CELLS : (k + 1) * CELLS]
        log[k * CELLS : (k + 1) * CELLS] = np.log((part + 0.01) / (part.sum(0) + 0.01 * CELLS)) if len(langs) else part
    return langs, log.astype(np.float32)


def mixtures(likely: np.ndarray, weight: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of languages in each text, and the log likelihood. likely: of each word in each language, the
    largest of a row being 1; allowed: languages of each text."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    full = np.flatnonzero(np.diff(first))
    share = (allowed / np.maximum(allowed.sum(1, keepdims=True), 1)).astype(np.float32)
    fit_ = np.zeros(n)
    for _ in range(rounds):
        joint = likely * share[doc]
        total = joint.sum(1) + np.float32(1e-30)
        if len(full):
            sums = np.add.reduceat(joint * (weight / total)[:, None], first[full], axis=0)
            share[full] = sums / np.maximum(sums.sum(1, keepdims=True), np.float32(1e-30))
    if len(full):
        total = (likely * share[doc]).sum(1) + np.float32(1e-30)
        fit_[full] = np.add.reduceat((weight * np.log(total)).astype(np.float64), first[full])
    return share, fit_


def predict(docs: DataFrame, langs: list[str], log: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text, and its share of the two leading languages.

    A text's words are drawn from a mixture of languages. Expectation maximisation finds the proportions for the
    leading 1, 2, .. languages, as long as one more makes the log likelihood less a penalty for each language better;
    the largest proportion of the best set is the prediction and the score. Texts that are null or have no letter are `und`
    with score 0. Repeated rows repeat, empty tables give none, other columns are not read. Long texts are read in parts;
    of a whole text only its words' likelihoods are held, about 6 numbers for each word and language.
    """
    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_langs int"
    sent = docs.sparkSession.sparkContext.broadcast(log)

    def one(batch, text):
        n = batch.num_rows
        names, score, chosen = ["und"] * n, np.zeros(n), np.zeros(n, np.int32)
        words, sizes, seen, log = [], [], np.zeros(n, np.int64), sent.value
        for some, owner in parts(text) if langs else ():
            grams, starts, first, size = features(some)
            if len(size):
                rows = np.zeros((len(grams), len(langs)), np.float32)
                for k in range(len(ORDERS)):
                    rows += log[grams[:, k] + k * CELLS]
                word = np.add.reduceat(rows, starts[:-1], axis=0) / np.float32(len(ORDERS))
                words.append(np.exp(word - word.max(1, keepdims=True)))
                sizes.append(np.maximum(size, 0).astype(np.float32))
                seen += np.bincount(owner, np.diff(first), n).astype(np.int64)
        if words:
            likely, weight, first = np.concatenate(words), np.concatenate(sizes), np.concatenate(([0], np.cumsum(seen)))
            del words, sizes
            base, _ = mixtures(likely, weight, first, np.ones((n, len(langs)), np.float32), ROUNDS // 2)
            order = np.argsort(-base, 1, kind="stable")
            share = np.zeros_like(base)
            share[np.arange(n), order[:, 0]] = 1
            best = np.zeros(n)
            full = np.flatnonzero(seen)
            word_best = np.log(np.take_along_axis(likely, np.repeat(order[:, :1], seen, 0), 1)[:, 0] + np.float32(1e-30))
            best[full] = np.add.reduceat((weight * word_best).astype(np.float64), first[:-1][full])
            chosen[:] = 1
            # The likelihood is concave in the proportions: no mixture is better than this one by more than the largest
            # slope less the weight of all words. Where that can't make up for a penalty, one language it is.
            doc = np.repeat(np.arange(n), seen)
            total = (likely * base[doc]).sum(1) + np.float32(1e-30)
            most, slope, whole = np.full(n, -np.inf), np.zeros((n, len(langs))), np.zeros(n)
            slope[full] = np.add.reduceat((likely * (weight / total)[:, None]).astype(np.float64), first[:-1][full], axis=0)
            whole[full] = np.add.reduceat(weight.astype(np.float64), first[:-1][full])
            most[full] = np.add.reduceat((weight * np.log(total)).astype(np.float64), first[:-1][full]) + slope[full].max(1) - whole[full]
            mixed = np.flatnonzero(most - PENALTY * np.log(seen + 1.0) > best + 1e-9) if len(langs) > 1 else np.zeros(0, int)
            for m in range(2, len(langs) + 1):
                if not len(mixed):
                    break
                rows_of = np.concatenate([np.arange(first[i], first[i + 1]) for i in mixed])
                sub_first = np.concatenate(([0], np.cumsum(seen[mixed])))
                allowed = np.zeros((len(mixed), len(langs)), np.float32)
                np.put_along_axis(allowed, order[mixed, :m], 1.0, 1)
                got, value = mixtures(likely[rows_of], weight[rows_of], sub_first, allowed)
                value = value - PENALTY * (m - 1) * np.log(seen[mixed] + 1.0)
                better = value > best[mixed] + 1e-9
                mixed = mixed[better]
                best[mixed], share[mixed], chosen[mixed] = value[better], got[better], m
            top = share.argmax(1)
            for i in np.flatnonzero(seen):
                names[i], score[i] = langs[top[i]], min(1.0, share[i, top[i]])
            chosen = np.where(seen > 0, chosen, 0).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(chosen)], ["doc_id", "held_out", "lang_pred", "score", "n_langs"])

    def scored(batches):
        for whole in batches:
            for batch, text in text_pieces(whole, 1 << 20):
                yield one(batch, text)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4).alias("held_out"), "text").mapInArrow(scored, schema)


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, *fit(docs))
