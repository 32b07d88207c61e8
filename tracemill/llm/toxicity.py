"""Toxicity: a lexicon learnt from labels, matched with typing errors, and weighed by the window around each match."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jaccard import shingles
from .rolling import mixed
from .shared import held_out, removed, text_pieces, written

#: Labelled rows that the classifier learns from at most (chosen by hash).
SAMPLE = 50_000
#: Least number of toxic texts with an entry, least share of toxic texts among those with it, least z-score.
SUPPORT, PRECISION, Z = 5, 0.6, 5.0
#: Beginnings of words that may be entries; different words that must share one.
STEMS, DIFFERENT = range(4, 8), 6
#: For these, of which there are more to choose from: least share of toxic texts, least z-score.
STEM_PRECISION, STEM_Z = 0.8, 7.0
#: Shortest entry that is matched with one typing error.
FUZZY = 5
#: Characters on either side of a match that are its window.
WINDOW = 48
#: Counts that evidence of each class starts with (toxic, clean): (errors, quoted).
PRIOR = {(0, False): (9.0, 0.5), (1, False): (3.0, 1.0), (0, True): (1.0, 3.0), (1, True): (1.0, 6.0)}
#: Words that report what someone else said, in the languages of the corpus.
REPORTS = frozenset(["said", "says", "wrote", "writes", "called", "quote", "quoted", "word", "term", "phrase", "sagte", "schrieb", "nannte", "wort", "dit", "écrit", "appelé", "mot", "dijo", "escribió", "llamó", "palabra"])
QUOTES = "\"'“”„«»‘’"
#: Hashes by whose minima near copies are found.
MINIMA = 4
#: States of the automaton that a task holds before it begins anew, bytes of texts that are read at once, and of words counted.
STATES, PIECE, WORDS = 20_000, 1 << 20, 8 << 20
WORD = re.compile(r"\w(?:[\w*@$!|+-]*\w)?")
THRESHOLD = 0.3


class Lexicon:
    """A trie of entries, intersected with the automaton of all strings within one edit of a word that is read.

    Edits are a character changed, added, left out, or two neighbours swapped. States of the product are sets of
    (trie node, edits); they are made when a word first needs them, so that a step is one dictionary look-up.
    """

    def __init__(self, entries: list[tuple[str, bool]], fuzzy: int = FUZZY):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.stem = [99], [99]  # edits that an entry which ends here allows; 99: none ends
        for text, stem in entries:
            node = 0
            for c in text:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.word.append(99)
                    self.stem.append(99)
            (self.stem if stem else self.word)[node] = 1 if len(text) >= fuzzy else 0
        self._empty()

    def _empty(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.arcs: list[dict[str, int]] = []
        self.ends: list[int] = []  # fewest edits if the word ends in this state; 99: no match
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        out = set(items)
        for node, e, wait in items:
            if e == 0 and not wait and node >= 0:
                out |= {(n, 1, "") for n in self.next[node].values()}
        return frozenset(out)

    def _state(self, items: frozenset) -> int:
        if items not in self.known:
            self.known[items] = len(self.sets)
            self.sets.append(items)
            self.arcs.append({})
            best = 99
            for node, e, wait in items:
                if node < 0:  # the stem of an entry has been read; what follows doesn't matter
                    best = min(best, e)
                elif not wait and (e <= self.word[node] < 99 or e <= self.stem[node] < 99):
                    best = min(best, e)
            self.ends.append(best)
        return self.known[items]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, wait in self.sets[state]:
            if node < 0:
                out.add((node, e, ""))
                continue
            if wait:
                if wait == c:
                    out.add((node, e, ""))
                continue
            if e <= self.stem[node] < 99:
                out.add((-1, e, ""))
            child = self.next[node].get(c)
            if child is not None:
                out.add((child, e, ""))
            if e == 0:
                out.add((node, 1, ""))
                for d, n in self.next[node].items():
                    if d != c:
                        out.add((n, 1, ""))
                    after = self.next[n].get(c)
                    if after is not None and d != c:
                        out.add((after, 1, d))
        made = self._state(self._closed(out))
        self.arcs[state][c] = made
        return made

    def match(self, word: str) -> int:
        """Fewest edits (0 or 1) from an entry; 99 if no entry is near."""
        if len(self.sets) > STATES:
            self._empty()
        state, arcs = self.start, self.arcs
        for c in word:
            step = arcs[state].get(c)
            state = self._step(state, c) if step is None else step
            if not self.sets[state]:
                return 99
        return self.ends[state]


def quoted(text: str, start: int, end: int, window: int = WINDOW) -> bool:
    """True if the match stands between quotation marks, or after a word that reports another's, within its window."""
    before, after = text[max(0, start - window) : start], text[end : end + window]
    marks = [i for i, c in enumerate(before) if c in QUOTES and not (0 < i < len(before) - 1 and before[i - 1].isalpha() and before[i + 1].isalpha())]
    if len(marks) % 2 and any(c in QUOTES for c in after):
        return True
    return any(w in REPORTS for w in WORD.findall(before)[-4:])


def evidence(text: str, lexicon: Lexicon, innocent: frozenset) -> Counter:
    """How often each class of match, (errors, quoted), stands in a text."""
    out: Counter = Counter()
    lower = text.lower()
    if len(lower) != len(text):  # a few characters change their length
        text = lower
    match = lexicon.match
    for m in WORD.finditer(lower):
        e = match(m[0])
        if e < 99 and not (e and m[0] in innocent):
            out[e, quoted(lower, m.start(), m.end())] += 1
    return out


class Scorer:
    def __init__(self, entries: list[tuple[str, bool]], innocent: list[str], rates: dict, base: float):
        self.entries, self.innocent, self.rates, self.base = entries, frozenset(innocent), rates, base
        self.lexicon: Lexicon | None = None

    def __getstate__(self):
        return self.__dict__ | {"lexicon": None}

    def classes(self, text: str) -> Counter:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.entries)
        return evidence(text, self.lexicon, self.innocent)

    def score(self, text: str) -> float:
        """The probability that at least one match is abuse; without a match the share of toxic texts among such."""
        log = math.log1p(-self.base)
        for c, n in self.classes(text).items():
            log += n * math.log1p(-self.rates[c])
        return min(1.0, max(0.0, -math.expm1(log)))


def _words(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): texts of either label that have a word, or a word that begins with the part before ``*``."""

    def count(batches):
        seen: dict[str, list[int]] = {}
        size = 0
        for whole in batches:
            for batch, texts in text_pieces(whole, PIECE):
                for text, y in zip(texts.to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    own = set(WORD.findall(text.lower()))
                    for k in STEMS:
                        own |= {m[:k] + "*" for m in own if len(m) > k and m[-1] != "*"}
                    for w in own:
                        if w not in seen:
                            seen[w] = [0, 0]
                            size += 64 + len(w)
                        seen[w][0 if y else 1] += 1
                    if size > WORDS:
                        yield pack(seen)
                        seen, size = {}, 0
        yield pack(seen)

    def pack(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["word", "toxic", "clean"])

    return rows.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon_of(counts: DataFrame, toxic: int, clean: int) -> list[tuple[str, bool]]:
    """Words, and beginnings of many words, that toxic texts have far more often than chance would give them."""
    q = max(toxic, 1) / max(toxic + clean, 2)
    n = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - n * q) / F.sqrt(n * q * (1 - q))
    strong = (F.col("toxic") >= SUPPORT) & (F.col("toxic") >= F.when(F.col("stem"), STEM_PRECISION).otherwise(PRECISION) * n) & (z >= F.when(F.col("stem"), STEM_Z).otherwise(Z))
    likely = counts.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * n))
    found = likely.filter((F.length("word") >= 3) & ~F.col("word").endswith("*")).select("word", F.lit(False).alias("stem"), "toxic", "clean").filter(strong)
    stems = likely.filter(F.col("word").endswith("*")).select(F.expr("substring(word, 1, length(word) - 1)").alias("word"), F.lit(True).alias("stem"), "toxic", "clean").filter(strong)
    under = counts.filter(~F.col("word").endswith("*") & (F.length("word") > min(STEMS)) & (F.col("toxic") > 0))
    under = under.select(F.explode(F.transform(F.sequence(F.lit(min(STEMS)), F.least(F.lit(max(STEMS)), F.length("word") - 1)), lambda k: F.substring("word", 1, k))).alias("word"), F.col("toxic").alias("t"))
    varied = under.groupBy("word").agg(F.count("*").alias("k"), F.max("t").alias("most")).filter(F.col("k") >= DIFFERENT)
    found = found.unionByName(stems.join(varied, "word").filter("most <= 0.5 * toxic").select("word", "stem", "toxic", "clean"))
    rows = found.withColumn("z", z).orderBy(F.desc("z"), "word", "stem").collect()  # SUPPORT texts of the sample have each
    held = {(r["word"]): r for r in rows if r["stem"]}
    # a stem that one more character leaves as it is gives way to the longer one
    closed = {s for s, r in held.items() if not any(t.startswith(s) and len(t) == len(s) + 1 and held[t]["toxic"] + held[t]["clean"] >= 0.98 * (r["toxic"] + r["clean"]) for t in held)}
    short = {s for s in closed if not any(s != t and s.startswith(t) for t in closed)}
    words = [r["word"] for r in rows if not r["stem"] and not any(r["word"].startswith(s) for s in short)]
    return [(s, True) for s in sorted(short)] + [(w, False) for w in sorted(words)]


def without_near_copies(texts: DataFrame) -> DataFrame:
    """One text of each label from each group of near copies of the sample (text, toxic). Texts with an equal minimum of
    their hashed shingles, by one of `MINIMA` hashes after the other, fall into one group."""
    names = [f"m{k}" for k in range(MINIMA)]

    def minima(batches):
        for whole in batches:
            for batch, text in text_pieces(whole, PIECE):
                h, first = shingles(text)
                full = np.flatnonzero(np.diff(first))
                cols = []
                for k in range(MINIMA):
                    own = np.arange(len(text), dtype=np.uint64)  # texts without words stay apart, or nearly so
                    if len(full):
                        own[full] = np.minimum.reduceat(mixed(h ^ mixed(np.array([k + 1], np.uint64))), first[:-1][full])
                    cols.append(pa.array(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), *cols], ["id", "toxic", *names])

    rows = written(texts.withColumn("id", F.monotonically_increasing_id()), "toxicity-texts")
    groups = rows.mapInArrow(minima, "id long, toxic long, " + ", ".join(f"{n} long" for n in names)).withColumn("c", F.col("id"))
    for n in names:
        groups = groups.withColumn("c", F.min("c").over(Window.partitionBy(n)))
    first = groups.groupBy("c", "toxic").agg(F.min("id").alias("id")).select("id")
    return rows.join(first, "id", "left_semi").drop("id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learns from the labelled documents of the training fold (crc32 of the id as text, modulo 4, is not 2).

    Of more than `sample` labelled rows those with the smallest hashes count. Texts that repeat count once, and so do
    near copies, whose words would all seem to be what makes them toxic. A document
    with several labels is toxic if one of them is 1. Without toxic labels the lexicon is empty and scores are the base.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is bounded, so that it may be broadcast
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(marked), "doc_id")
    texts = written(without_near_copies(mine.groupBy("text").agg(F.max("toxic").alias("toxic"))), "toxicity-sample")
    by = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = by.get(1, 0), sum(n for y, n in by.items() if y != 1)
    counts = _words(texts).persist()
    entries = lexicon_of(counts, toxic, clean) if toxic else []
    near = Lexicon(entries)

    def neighbours(batches):
        for batch in batches:
            keep = [near.match(w) == 1 for w in batch.column("word").to_pylist()]
            yield batch.filter(pa.array(keep))

    # words near an entry that clean texts have as often: words of their own, not typing errors
    own = counts.filter("clean > toxic and word not like '%*'").mapInArrow(neighbours, "word string, toxic long, clean long")
    innocent = sorted(r["word"] for r in own.select("word").collect()) if entries else []  # words of the sample, one edit from an entry
    counts.unpersist()
    first = Scorer(entries, innocent, {c: 0.5 for c in PRIOR}, 0.0)

    def seen(batches):
        for whole in batches:
            got: Counter = Counter()
            for batch, text_ in text_pieces(whole, PIECE):
                for text, y in zip(text_.to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    kinds = first.classes(text)
                    strongest = next((c for c in PRIOR if c in kinds), None)
                    got["none" if strongest is None else f"{strongest[0]}{int(strongest[1])}", int(y)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([y for _, y in got], pa.int64()), pa.array(list(got.values()), pa.int64())], ["kind", "toxic", "n"])

    table = {(r["kind"], r["toxic"]): r["n"] for r in texts.mapInArrow(seen, "kind string, toxic long, n long").groupBy("kind", "toxic").agg(F.sum("n").alias("n")).collect()}
    rates = {}
    for c, (a, b) in PRIOR.items():
        key = f"{c[0]}{int(c[1])}"
        rates[c] = (table.get((key, 1), 0) + a) / (table.get((key, 1), 0) + table.get((key, 0), 0) + a + b)
    none = table.get(("none", 1), 0), table.get(("none", 0), 0)
    removed(texts)
    return Scorer(entries, innocent, rates, (none[0] + 0.5) / (sum(none) + 10))


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; null and empty texts get the score without matches.
    Repeated rows repeat, empty tables give none, other columns are not read."""

    def scored(batches):
        for batch, text in (piece for whole in batches for piece in text_pieces(whole, PIECE)):
            got = [scorer.score(t) if t else scorer.base for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array([int(x >= threshold) for x in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays under the threshold, in their own columns. Null and empty texts stay, repeated rows
    fare alike, empty tables give no rows."""
    scorer, schema = fit(docs, labels), docs.schema

    def kept(batches):
        for batch, text in (piece for whole in batches for piece in text_pieces(whole, PIECE)):
            yield batch.filter(pa.array([not t or scorer.score(t) < threshold for t in text.to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
