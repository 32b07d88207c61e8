"""Language-model scores: backoff over n-grams as sums of one value for each n-gram, looked up in tasks or joined in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import LOWER, mixed, word_hashes, words
from .shared import give_back, held_out, removed, text_bytes, text_pieces, written

#: The token that ends each text.
END = np.uint64(1)
#: Where n-grams are looked up, never what is counted: in the tasks the most frequent ones of each order, so many at most,
#: the others by joins; those that are so large a share of all tokens are broadcast to the n-grams that contain them.
MOST, STATE = 200_000, 1e-4
#: Least count of an n-gram of two or more words, at every size of the corpus; 1 keeps them all.
LEAST = 2
#: Bits of the filter of each order's n-grams, and of the part of it that a code's first byte chooses.
FILTER, PART = 1 << 27, 1 << 19
#: Entries of the tables in a bucket, about (24 bytes each); codes, entries or n-grams that a task holds before it sends
#: them to their buckets; n-grams to be counted that are sent to a bucket, at most on average; documents in a list, about;
#: parts that lists are dealt to.
BUCKET, HELD, COUNTED, LISTED, DEALT = 1_000_000, 1_000_000, 1_000_000, 1 << 15, 4096
#: What absolute discounting takes from each count; the longest n-gram.
DISCOUNT, ORDER = 0.75, 3


def tokens(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text's followed by END; where each text's begin (with the end)."""
    raw, offsets = text_bytes(text)
    raw = LOWER[raw]
    start, end, before = words(raw, offsets)
    n = np.diff(before)
    first = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(first[-1], END, np.uint64)
    if len(start):
        keep = np.ones(len(out), bool)
        keep[first[1:] - 1] = False
        out[keep] = word_hashes(raw, start, end)
    return out, first


class Tally:
    """Counts of numbers, kept sorted and merged now and then."""

    def __init__(self, most: int = 1_000_000):
        self.parts, self.size, self.most = [], 0, most

    def add(self, values: np.ndarray) -> None:
        self.parts.append(np.unique(values, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.most and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
            self.most = max(self.most, 2 * self.size)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, inverse = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in self.parts])).astype(np.int64)

    def rows(self, step: int = 200_000):
        keys, n = self.merged()
        for i in range(0, len(keys), step):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + step].view(np.int64)), pa.array(n[i : i + step])], ["w", "n"])


def tallied(docs: DataFrame, codes) -> DataFrame:
    """(w, n): how often codes(hashes, first) gives each number; tasks count before the shuffle."""

    def count(batches):
        tally = Tally()
        for whole in batches:
            for _, text in text_pieces(whole, 2 << 20):
                tally.add(codes(*tokens(text)))
                if tally.size > 4_000_000:
                    yield from tally.rows()
                    tally = Tally()
        yield from tally.rows()

    return docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def position(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in a sorted table; -1 where a value is missing."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


class Places:
    """Places in a sorted table of codes, for values in any order: the first bits of a code say where it lies in an array
    with gaps, or after which codes that came before it."""

    def __init__(self, table: np.ndarray):
        self.shift = np.uint64(63 - max(1, len(table)).bit_length())  # two to four slots for each code
        i = np.arange(len(table))
        slot = np.maximum.accumulate((table >> self.shift).astype(np.int64) - i) + i
        size = max(1 << (64 - int(self.shift)), int(slot[-1]) + 1 if len(slot) else 0) + 1  # the last one stays free
        self.codes, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.codes[slot], self.at[slot] = table, i

    def of(self, values: np.ndarray) -> np.ndarray:
        """-1 where a value is missing."""
        slot = (values >> self.shift).astype(np.int64)
        at, code = self.at[slot], self.codes[slot]
        out = np.where(code == values, at, -1)
        here = np.flatnonzero((at >= 0) & (code < values))
        while len(here):
            slot[here] += 1
            at, code, value = self.at[slot[here]], self.codes[slot[here]], values[here]
            out[here] = np.where(code == value, at, -1)
            here = here[(at >= 0) & (code < value)]
        return out


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that begin with the shorter n-gram a and end with b."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b ^ np.uint64(0x5851F42D4C957F2D)))


def grams(w: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the codes of the n-grams that end at each token, and whether they lie in one text."""
    inside = np.ones(len(w), bool)
    inside[first[:-1]] = False
    out = [(w, np.ones(len(w), bool))]
    for _ in range(1, order):
        code, ok = out[-1]
        out.append((joint(np.concatenate((code[:1], code[:-1])), code), inside & ok & np.concatenate((ok[:1], ok[:-1]))))
    return out


def passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """True for all codes in the filter, and for few others as long as it is not full."""
    out = np.ones(len(codes), bool)
    for place in places(codes):
        here = np.flatnonzero(out)
        at = place[here]
        out[here] = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def places(codes: np.ndarray) -> list[np.ndarray]:
    part = (codes >> np.uint64(56)).astype(np.int64) * PART
    return [part + ((codes >> np.uint64(shift)) % np.uint64(PART)).astype(np.int64) for shift in (0, 20)]


def filter_of(table: DataFrame) -> np.ndarray:
    """A filter of the codes w; each task makes the parts that it owns, of a size that does not grow with the table."""

    def parts(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = batch.column("w").to_numpy().view(np.uint64)
            owner = (codes >> np.uint64(56)).astype(np.int64)
            for k in np.unique(owner):
                bits = own.setdefault(int(k), np.zeros(PART, bool))
                for place in places(codes[owner == k]):
                    bits[place - k * PART] = True
        for k, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["part", "bits"])

    out = np.zeros(FILTER >> 3, np.uint8)
    spread = table.select("w", F.shiftrightunsigned("w", 56).alias("part")).repartition("part").select("w")
    for row in spread.mapInArrow(parts, "part long, bits binary").toLocalIterator():
        out[row["part"] * PART >> 3 : (row["part"] + 1) * PART >> 3] = np.frombuffer(row["bits"], np.uint8)
    return out


def bucket_bits(n: int, most: int) -> int:
    """Bits of a code that say its bucket, so that n codes come to `most` in a bucket or fewer."""
    return max(0, int(np.ceil(np.log2(max(1, n) / most))))


def cuts(codes: np.ndarray, bits: int):
    """(bucket, start, end) of sorted codes, by their first bits."""
    bucket = (codes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(codes), np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(codes) else []
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield int(bucket[i]), int(i), int(j)


def counted(docs: DataFrame, order: int, known, total: int, least: int = LEAST) -> DataFrame:
    """(w, a, b, n): the n-grams of this order that occur `least` times, their codes and those of their beginnings and ends.
    An n-gram that occurs so often has a beginning and an end that do; known, a broadcast filter, passes those. total: how
    many n-grams there can be. Tasks send what they counted to buckets of codes, many n-grams in a row."""
    bits = bucket_bits(total, COUNTED)

    def merged(parts):
        a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        w = joint(a, b)
        by = np.argsort(w)
        w = w[by]
        at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else by
        return w[at], a[by[at]], b[by[at]], np.add.reduceat(n[by], at) if len(w) else n

    def sent(w, a, b, n):
        made = [(k, a[i:j].tobytes() + b[i:j].tobytes() + n[i:j].tobytes()) for k, i, j in cuts(w, bits)]
        for i in range(0, len(made), 64):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made[i : i + 64]], pa.int32()), pa.array([d for _, d in made[i : i + 64]], pa.binary())], ["bucket", "data"])

    def count(batches):
        parts, size = [], 0
        for whole in batches:
            for _, text in text_pieces(whole, 2 << 20):
                below, within = grams(*tokens(text), order - 1)[-1]
                start = within.copy()
                if order == 2:
                    start[:] = below != END
                use = np.flatnonzero(start[:-1] & within[1:])
                ok = np.zeros(len(below), bool)
                ok[within] = passes(known.value, below[within])
                use = use[ok[use] & ok[use + 1]]
                parts.append((below[use], below[use + 1], np.ones(len(use), np.int64)))
                size += len(use)
                if size > HELD:
                    some = merged(parts)
                    parts, size = [some[1:]], len(some[0])
                    if 2 * size > HELD:
                        yield from sent(*some)
                        parts, size = [], 0
        if parts:
            yield from sent(*merged(parts))
        del parts
        give_back()

    def summed(batches):
        now, parts = None, []

        def often():
            w, a, b, n = merged(parts)
            keep = n >= least
            columns = [x[keep].view(np.int64) for x in (w, a, b, n)]
            for i in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in columns], ["w", "a", "b", "n"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                if bucket != now:
                    if parts:
                        yield from often()
                    now, parts = bucket, []
                a, b, n = np.frombuffer(data.as_buffer(), np.int64).reshape(3, -1).copy()
                parts.append((a.view(np.uint64), b.view(np.uint64), n))
        if parts:
            yield from often()
        del parts
        give_back()

    rows = docs.select("text").mapInArrow(count, "bucket int, data binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(summed, "w long, a long, b long, n long")


def looked_up(rows: DataFrame, column: str, table: DataFrame, often: DataFrame) -> DataFrame:
    """rows with what the table holds for the code in this column; codes that many rows have are broadcast."""
    often = F.broadcast(often.withColumnRenamed("w", column))
    table = table.withColumnRenamed("w", column)
    hot = rows.join(F.broadcast(table.join(often, column, "left_semi")), column)
    return hot.unionByName(rows.join(often, column, "left_anti").join(table, column))


def frequent(table: DataFrame):
    """True for those n-grams that are so frequent that there are no more than MOST of them."""
    bin_ = F.floor(F.log2("n") * 16)
    least, sum_ = 1 << 10, 0
    for row in sorted(table.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect(), key=lambda row: -row["bin"]):  # 16 rows for each power of two
        sum_ += row["n"]
        if sum_ > MOST:
            break
        least = row["bin"]
    return bin_ >= least


class Model:
    """total, kinds: training tokens, and different ones. tables: for each order (w, n, value). The log probability of a
    text is the sum of the values of all its n-grams: that of a word is log p(word), that of a longer n-gram is
    log p(word | history) less the weight of failure and log p(word | shorter history), which its shorter n-grams bring;
    each brings the weight of failure that it has as a history too. Of n-grams that do not occur often enough the value
    is 0. frequent: of each order codes, counts and values; filters: of each order."""

    def __init__(self, total: int, kinds: int, tables: list[DataFrame], filters: list):
        self.total, self.kinds, self.tables, self.filters = total, kinds, tables, filters
        self.frequent = []
        for table in tables:
            rows = table.filter(frequent(table)).select("w", "n", "value").toArrow()  # at most MOST rows
            codes, n, value = (column.to_numpy() for column in rows.columns)
            order = np.argsort(codes.view(np.uint64))
            self.frequent.append((codes.view(np.uint64)[order], n[order], value[order]))
            del rows, codes, n, value
        give_back()  # the driver's memory holds what was collected no longer


def fit(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> tuple[DataFrame, Model]:
    """All counts and values of words (w, n, value), written to the shared folder as those of longer n-grams are, and the
    model. docs: the training texts; least: how often longer n-grams have to occur to count."""
    spark = docs.sparkSession
    counts = written(tallied(docs, lambda w, first: w), "lm-words")
    row = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
    total, kinds = row["total"] or 0, row["kinds"]
    log = F.log10((F.col("n") - DISCOUNT) / F.lit(float(max(total, 1))))
    lower = written(counts.select("w", "n", log.alias("log"), log.alias("value")), "lm-lower")
    removed(counts)
    tables, filters = [], []
    known = spark.sparkContext.broadcast(filter_of(lower.filter(F.col("n") >= least).select("w")))  # words that pairs which count can hold
    for k in range(2, order + 1):
        often = lower.filter(F.col("n") >= STATE * total).select("w")  # at most 1 / STATE rows
        grams_ = written(counted(docs, k, known, total, least), "lm-grams")
        below = written(looked_up(grams_, "b", lower.select("w", F.col("log").alias("below")), often).select("w", "a", "n", "below"), "lm-below")
        sums = below.groupBy("a").agg((F.sum("n") - DISCOUNT * F.count("*")).alias("mass"), F.sum(F.pow(F.lit(10.0), "below")).alias("rest")).withColumnRenamed("a", "w")
        left = lambda x: F.greatest(1 - x, F.lit(1e-12))
        weights = written(sums.join(lower.select("w", F.col("n").alias("seen")), "w").select("w", "seen", F.log10(left(F.col("mass") / F.col("seen")) / left(F.col("rest"))).alias("weight")), "lm-weights")
        tables.append(written(lower.join(weights, "w", "left").select("w", "n", (F.col("value") + F.coalesce("weight", F.lit(0.0))).alias("value")), "lm-values"))
        log = F.log10((F.col("n") - DISCOUNT) / F.col("seen"))
        next_ = written(looked_up(below, "a", weights, often).select("w", "n", log.alias("log"), (log - F.col("below") - F.col("weight")).alias("value")), "lm-lower")
        for table in (grams_, below, weights, lower):
            removed(table)
        lower = next_
        filters.append(filter_of(lower.select("w") if filters else lower.select("w").unionByName(tables[0].select("w"))))  # the first holds the words too
        known.destroy()
        known = spark.sparkContext.broadcast(filters[-1]) if k < order else None
    tables.append(lower.select("w", "n", "value"))
    return tables[0], Model(total, kinds, tables, [filters[0] if filters else filter_of(lower.select("w")), *filters])


def in_buckets(codes: np.ndarray, bits: int):
    """(bucket, places) of the codes, by their first bits; places are in the order of the codes."""
    order = np.argsort(codes)
    for bucket, i, j in cuts(codes[order], bits):
        yield bucket, order[i:j]


#: Rows of a bucket: entries of the tables (kind 0), codes that a list of documents asks for (1), and that list with what
#: is known of its documents already (2). Rows of a list: what one bucket has for its documents (1), and the list (2).
NAMES, ROWS = ["bucket", "kind", "list", "data"], "bucket int, kind int, list long, data binary"
#: A document of a list; `given` is false where doc_id is null.
DOCUMENT = np.dtype([("doc_id", "i8"), ("n_tokens", "i8"), ("known", "i8"), ("base", "f8"), ("log", "f8"), ("given", "?"), ("held_out", "?")])
SUMS = "doc_id long, held_out boolean, n_tokens long, known long, base double, log double"


def owners(n: int):
    """The type of places among n documents."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _rows(made: list[tuple[int, bytes]], kind: int, list_: int | None = None):
    """Record batches of entries, codes or lists."""
    for k in range(0, len(made), 64):
        some = made[k : k + 64]
        columns = [pa.array([b for b, _ in some], pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array([list_] * len(some), pa.int64()), pa.array([d for _, d in some], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, NAMES)


def entries(tables: list[DataFrame], bits: int) -> DataFrame:
    """Codes, counts (-1 but for words) and values of all orders, many in a row."""
    every = tables[0].select("w", "n", "value")
    for table in tables[1:]:
        every = every.unionByName(table.select("w", F.lit(-1).cast("long").alias("n"), "value"))

    def rows(batches):
        held, size = [], 0

        def sent():
            codes, n, value = (np.concatenate(x) for x in zip(*held, strict=True))
            made = [(b, codes[at].tobytes() + n[at].tobytes() + value[at].tobytes()) for b, at in in_buckets(codes, bits)]
            yield from _rows(made, 0)

        for batch in batches:
            held.append((batch.column("w").to_numpy().view(np.uint64), batch.column("n").to_numpy(), batch.column("value").to_numpy()))
            size += batch.num_rows
            if size > HELD:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    return every.mapInArrow(rows, ROWS)


def answer(table: list[np.ndarray], raw: np.ndarray, whole: float) -> bytes:
    """What the entries have for the documents of a list, from the codes that these ask for: sums for those that asked for
    one of the entries, and numbers and sums of words for those that asked for one. Never more of them than codes."""
    m, k = raw[:16].view(np.int64).tolist()
    codes, owner = raw[16 : 16 + 8 * m].view(np.uint64), raw[16 + 8 * m :].view(owners(k))
    at = position(table[0], codes)
    hit = at >= 0
    owner, n, value = owner[hit], table[1][at[hit]], table[2][at[hit]]
    some = np.flatnonzero(np.bincount(owner, minlength=k))
    word = n >= 0
    seen = np.bincount(owner[word], minlength=k)
    knew = np.flatnonzero(seen)
    base = np.bincount(owner[word], np.log10((n[word] + 1) / whole), k)
    parts = (np.array([len(some), len(knew)], np.int64), np.bincount(owner, value, k)[some], seen[knew].astype(np.int64), base[knew].astype(np.float64), some.astype(owners(k)), knew.astype(owners(k)))
    return b"".join(x.tobytes() for x in parts)


def add_answer(docs: np.ndarray, raw: np.ndarray) -> None:
    """Adds one bucket's answer to the documents of its list."""
    n, m = raw[:16].view(np.int64).tolist()
    ends = np.cumsum([16, 8 * n, 8 * m, 8 * m]).tolist()
    log, seen, base = (raw[i:j].view(t) for i, j, t in zip(ends[:-1], ends[1:], (np.float64, np.int64, np.float64), strict=True))
    places = raw[ends[-1] :].view(owners(len(docs)))
    docs["log"][places[:n]] += log
    docs["known"][places[n:]] += seen
    docs["base"][places[n:]] += base


def found(rows_: DataFrame, whole: float) -> DataFrame:
    """The sums of each document over what was known of it and what it gets from the entries whose codes it asks for. All
    rows of a bucket meet in one task: first the entries, about BUCKET of them, then what one list after the other asks
    for. The answers for a list, one from each bucket, meet the list again."""

    def answered(batches):
        now, parts, table = None, [], None
        def made():
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["list", "kind", "data"])

        for batch in batches:
            out, size = [], 0
            for bucket, kind, list_, data in zip(*(batch.column(c).to_pylist() for c in NAMES[:3]), batch.column("data"), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                if bucket != now:
                    now, parts, table = bucket, [], None
                if kind == 0:
                    parts.append(raw.reshape(3, -1).copy())
                    continue
                if table is None and kind == 1:
                    three = [np.concatenate([p[i].view(t) for p in parts] or [np.zeros(0, t)]) for i, t in enumerate((np.uint64, np.int64, np.float64))]
                    order = np.argsort(three[0])
                    table, parts = [x[order] for x in three], []
                out.append((list_, kind, answer(table, raw, whole) if kind == 1 else raw.tobytes()))
                size += len(out[-1][2])
                if size > 1 << 20:
                    yield from made()
                    out, size = [], 0
            if out:
                yield from made()
        parts = table = None
        give_back()

    def summed(batches):
        docs = None

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array(docs["doc_id"], mask=~docs["given"]), *(pa.array(docs[c]) for c in ("held_out", "n_tokens", "known", "base", "log"))], [c.split()[0] for c in SUMS.split(", ")])

        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                if kind == 2:
                    if docs is not None:
                        yield from rows()
                    docs = raw.view(DOCUMENT).copy()
                else:
                    add_answer(docs, raw)
        if docs is not None:
            yield from rows()

    answers = rows_.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answered, "list long, kind int, data binary")
    return answers.repartition("list").sortWithinPartitions("list", F.desc("kind")).mapInArrow(summed, SUMS)


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    Values of n-grams that are too rare for the tasks' tables are asked for in buckets of codes afterwards, so that no
    table grows with the corpus on the driver or in a task; only those that a filter passes are.
    Unknown words are one class, which gets what discounting took from the known ones. Null and empty texts are their
    end alone. Repeated rows repeat, empty tables give none; other columns are not read. Without training texts all
    probabilities are 1.
    """
    total, kinds, orders = model.total, model.kinds, len(model.tables)
    tables = [counts, *model.tables[1:]]
    bits = bucket_bits(sum(t.count() for t in tables), BUCKET)
    sent = docs.sparkSession.sparkContext.broadcast((model.frequent, model.filters))

    def scored(batches):
        frequent, filters = sent.value
        often = [Places(codes) for codes, _, _ in frequent]
        base = np.log10((frequent[0][1] + 1) / (total + kinds + 1))
        held, docs_, size, n, key = [], [], 0, 0, 0

        def asked():
            codes, place = (np.concatenate(x) for x in zip(*held, strict=True))
            place = place.astype(owners(n))
            yield from _rows([(-1 - key % DEALT, np.concatenate(docs_).tobytes())], 2, key)  # not among the entries: lists spread however few these are
            yield from _rows([(b, np.array([len(at), n], np.int64).tobytes() + codes[at].tobytes() + place[at].tobytes()) for b, at in in_buckets(codes, bits)], 1, key)

        for whole in batches:
            for batch, text in text_pieces(whole, 2 << 20):
                w, first = tokens(text)
                add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
                own = np.zeros(batch.num_rows, DOCUMENT)
                log, place = np.zeros(len(w)), np.repeat(np.arange(n, n + len(own), dtype=np.uint32), np.diff(first))
                for k, (codes, ok) in enumerate(grams(w, first, orders)):
                    here = np.flatnonzero(ok)
                    at = often[k].of(codes[here])
                    hit = at >= 0
                    rest = here[~hit]
                    log[here[hit]] += frequent[k][2][at[hit]]
                    rest = rest[passes(filters[k], codes[rest])]
                    held.append((codes[rest], place[rest]))
                    size += len(held[-1][0])
                    if not k:
                        own["base"] = add(np.where(hit, base[np.maximum(at, 0)] if len(base) else 0.0, 0.0))
                        own["known"] = add(hit.astype(np.int64))
                doc_id = batch.column("doc_id")
                own["doc_id"], own["given"] = doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False)
                own["held_out"], own["n_tokens"], own["log"] = batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(first), add(log)
                if not n:
                    key = batch.column("key")[0].as_py()  # of its first document: the list's own
                docs_.append(own)
                n += len(own)
                if size > HELD or n > LISTED:
                    yield from asked()
                    held, docs_, size, n = [], [], 0, 0
        if n:
            yield from asked()
        del held, docs_
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 7).alias("held_out"), "text")
    out = found(entries(tables, bits).unionByName(rows.mapInArrow(scored, ROWS)), float(total + kinds + 1))
    unknown = F.col("n_tokens") - F.col("known")  # words that training never had
    chance, unseen = float(np.log10(1 / (total + kinds + 1))), float(np.log10(DISCOUNT * kinds / total)) if total else 0.0
    return out.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + unknown * F.lit(chance)).alias("base_score"), (F.col("log") + unknown * F.lit(unseen)).alias("score"),
    )


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, *fit(docs.filter(~held_out(F.col("doc_id"), 7))))
