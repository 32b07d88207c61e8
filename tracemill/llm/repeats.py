"""Removal of long repeated byte strings by prefix-free parsing: suffix arrays of the dictionary, weighed by the parse."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import Rolling
from .shared import keyed, own_columns, removed, text_bytes, text_pieces, written

#: Bytes of a string that must repeat, and of the window whose least hash is a trigger. A trigger's gram and a window
#: of triggers together are one string, so that strings which are equal have the same trigger.
LENGTH, SPREAD = 200, 101
#: Documents that are told apart by a broadcast of their keys (8 bytes each); beyond it the join is shuffled.
BROADCAST_KEYS = 500_000
#: Low bits that tell places of equal grams apart; only differences of up to SPREAD count.
PLACE = np.uint64((1 << 24) - 1)
#: Bytes of texts that are parsed at once; a longer text is parsed in parts.
PIECE = 1 << 19
#: Bytes of phrases of which one suffix array is made, and phrases with one gram that it takes (300 bytes each at most).
#: Phrases of grams with more of them go the way of `scattered`.
ARRAY, CROWD = 1 << 20, 2_048
#: Bits of a rank; a suffix array has fewer places.
RANK = 21
_BYTES = "gram long, phrase long, c long, data binary"


def parts(whole: pa.RecordBatch, length: int, limit: int = PIECE):
    """(batch, owner, base, raw, offsets): pieces of texts of about `limit` bytes. Part i, raw[offsets[i]:offsets[i + 1]],
    stands in the text of row owner[i], base[i] bytes from its beginning. Texts longer than that come in parts which
    overlap by length - 1 bytes, so that each string of `length` bytes lies in one."""
    for batch, text in text_pieces(whole, limit):
        raw, offsets = text_bytes(text)
        if len(text) > 1 or len(raw) <= 2 * limit:
            yield batch, np.arange(len(text)), np.zeros(len(text), np.int64), raw, offsets
            continue
        for a in range(0, len(raw) - length + 1, limit):
            some = raw[a : a + limit + length - 1]
            yield batch, np.zeros(1, np.int64), np.array([a]), some, np.array([0, len(some)])


class Parse:
    """The phrases of all parts of a piece: phrase i covers raw[begin[i]:end[i]] and holds the strings of LENGTH bytes
    that start in begin[i] .. end[i] - LENGTH. Each such string of a part lies in exactly one phrase, and neighbours
    overlap by LENGTH - 1 bytes. Where a phrase is cut depends on the rolling hashes of its bytes alone."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, spread: int = SPREAD):
        self.raw = raw
        grams = Rolling(raw).grams(length - spread + 1)
        n = len(raw) - length + 1
        starts, stops = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
        if n <= 0 or not (stops > starts).any():
            self.begin = self.end = self.text = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        low = (grams & ~PLACE) | (PLACE - (np.arange(len(grams), dtype=np.uint64) & PLACE))
        reach = 1
        while 2 * reach <= spread:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < spread:
            rest = spread - reach
            low = np.minimum(low[:-rest], low[rest:])
        low = low[:n]
        valid = np.zeros(n + 1, np.int8)
        some = stops > starts
        np.add.at(valid, starts[some], 1)
        np.add.at(valid, stops[some], -1)
        valid = np.cumsum(valid[:n], dtype=np.int8) > 0
        change = np.ones(n, bool)
        change[1:] = low[1:] != low[:-1]
        change[starts[some]] = True
        begin = np.flatnonzero(change & valid)
        following = np.append(begin[1:], n)
        text = np.searchsorted(offsets, begin, "right") - 1
        self.begin, self.text = begin, text
        self.end = np.minimum(following, stops[text]) - 1 + length
        place = PLACE - (low[begin] & PLACE)
        trigger = begin + ((place - begin.astype(np.uint64)) & PLACE).astype(np.int64)
        self.gram = grams[trigger]

    def names(self) -> np.ndarray:
        data, name = memoryview(np.ascontiguousarray(self.raw)), xxhash.xxh3_64_intdigest
        return np.fromiter((name(data[a:b]) for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)), np.uint64, len(self.begin))


def parsed(texts: DataFrame, length: int, spread: int) -> DataFrame:
    """(gram, phrase, key, begin, size): the phrases of each text, where they stand in it."""

    def rows(batches):
        for whole in batches:
            for batch, owner, base, raw, offsets in parts(whole, length):
                p = Parse(raw, offsets, length, spread)
                begin = p.begin - offsets[p.text] + base[p.text]
                yield pa.RecordBatch.from_arrays([pa.array(p.gram.view(np.int64)), pa.array(p.names().view(np.int64)), batch.column("key").take(pa.array(owner[p.text])), pa.array(begin.astype(np.int32)), pa.array((p.end - p.begin).astype(np.int16))], ["gram", "phrase", "key", "begin", "size"])

    return texts.mapInArrow(rows, "gram long, phrase long, key long, begin int, size short")


def triggers(texts: DataFrame, length: int, spread: int) -> DataFrame:
    """(gram, n): how often triggers occur; tasks count before the shuffle."""

    def rows(batches):
        for whole in batches:
            for _, _, _, raw, offsets in parts(whole, length):
                gram, n = np.unique(Parse(raw, offsets, length, spread).gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    return texts.mapInArrow(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _few(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast if there are few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _with(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts joined to the list that their key has; only texts with one are shuffled."""
    return texts.join(_few(lists.select("key")), "key", "left_semi").join(lists, "key")


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def suffix_array(raw: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings raw[p:p + length] of these places by their bytes, and for each place of that order
    whether its string differs from the one before. Ranks of the first 8 bytes of all suffixes give those of three times
    as many, until three of them cover the strings."""
    n, block = len(raw), min(8, length)
    if n >= 1 << RANK:
        raise ValueError("too many bytes for one suffix array")
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    first = np.zeros((n, 8), np.uint8)
    first[:, :block] = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n, :block]
    rank, depth = _ranks(first.view(">u8")[:, 0].astype(np.uint64)), block

    def three(at: np.ndarray, a: int, b: int) -> np.ndarray:
        later = [np.where(at + x < n, rank[np.minimum(at + x, n - 1)], np.uint64(0)) for x in (a, b)]
        return (rank[at] << np.uint64(2 * RANK)) | (later[0] << np.uint64(RANK)) | later[1]

    while 3 * depth < length:
        rank, depth = _ranks(three(np.arange(n), depth, 2 * depth)), 3 * depth
    keys = three(places, min(depth, length - depth), length - depth)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))


def groups_of_grams(batches, size: int = ARRAY):
    """Tables of whole groups of rows with one gram, of about `size` bytes of data; the rows come sorted by gram."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).combine_chunks()
        held = table if held is None or not held.num_rows else pa.concat_tables([held, table]).combine_chunks()
        if not held.num_rows:
            continue
        gram = held.column("gram").to_numpy()
        cuts = np.flatnonzero(gram[1:] != gram[:-1]) + 1
        ends = np.cumsum(pc.binary_length(held.column("data")).to_numpy())
        start = 0
        for cut in cuts.tolist():
            if ends[cut - 1] - (ends[start - 1] if start else 0) >= size:
                yield held.slice(start, cut - start)
                start = cut
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield held


def repeated_strings(dictionary: DataFrame, length: int) -> DataFrame:
    """(gram, phrase, offs): in phrases that stand once in the parse (c = 1), where strings start that stand elsewhere
    too. dictionary: gram, phrase, c, data. All phrases with one gram meet in one task, and with them all that can hold
    equal strings. The suffix array of their bytes puts equal strings next to each other; the parse says how often each
    of them stands in the corpus, which is as often as its phrase does."""

    def rows(batches):
        for table in groups_of_grams(batches):
            data = table.column("data").combine_chunks().cast(pa.large_binary())
            raw, bounds = text_bytes(data)
            c = table.column("c").to_numpy()
            sizes = np.diff(bounds) - length + 1
            phrase = np.repeat(np.arange(len(sizes)), sizes)
            off = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order, new = suffix_array(raw, bounds[:-1][phrase] + off, length)
            if not len(order):
                continue
            heads = np.flatnonzero(new)
            often = np.add.reduceat(c[phrase[order]], heads) > 1
            hit = order[np.repeat(often, np.diff(np.append(heads, len(order))))]
            hit = np.sort(hit[c[phrase[hit]] == 1])
            which, first = np.unique(phrase[hit], return_index=True)
            offs = pa.ListArray.from_arrays(pa.array(np.append(first, len(hit)).astype(np.int32)), pa.array(off[hit].astype(np.int16)))
            yield pa.RecordBatch.from_arrays([table.column(x).combine_chunks().take(pa.array(which)) for x in ("gram", "phrase")] + [offs], ["gram", "phrase", "offs"])

    return dictionary.repartition("gram").sortWithinPartitions("gram").mapInArrow(rows, "gram long, phrase long, offs array<short>")


def scattered(dictionary: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The same for grams that too many phrases share for one task (a passage in ever other surroundings): one row for
    each string, counted by 128-bit names before the shuffle, so that neither a gram nor a string is one task's work.
    Also the table that was written for it."""

    def strings(batches):
        name = xxhash.xxh3_128_digest
        for batch in batches:
            raw, bounds = text_bytes(batch.column("data").cast(pa.large_binary()))
            data, c = memoryview(np.ascontiguousarray(raw)), batch.column("c").to_numpy()
            step = max(1, PIECE // (SPREAD * 64))
            for k in range(0, len(c), step):
                sizes = np.diff(bounds[k : k + step + 1]) - length + 1
                which = np.repeat(np.arange(k, k + len(sizes)), sizes)
                off = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                two = np.frombuffer(b"".join([name(data[a : a + length]) for a in (bounds[:-1][which] + off).tolist()]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), *(batch.column(x).take(pa.array(which)) for x in ("gram", "phrase")), pa.array(off.astype(np.int16)), pa.array(np.minimum(c[which], 2))],
                    ["a", "b", "gram", "phrase", "off", "c"],
                )

    all_ = written(dictionary.mapInArrow(strings, "a long, b long, gram long, phrase long, off short, c long"), "repeats-strings")
    twice = all_.groupBy("a", "b").agg(F.sum("c").alias("s")).filter("s > 1").select("a", "b")
    return all_.filter("c = 1").join(twice, ["a", "b"], "left_semi").groupBy("gram", "phrase").agg(F.collect_list("off").alias("offs")), all_


def repeated(texts: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """(key, hits): for each text with repeated strings its phrases (begin, size) and, in each, the offsets at which such
    strings start (null: at all). texts: key, text, as written.

    The dictionary is the distinct phrases; the parse says where they stand. A phrase that stands twice repeats with
    all its strings. Of the others only those can hold a repeated string that share their trigger's gram with another
    phrase. Since neighbours overlap by length - 1 bytes, each place of a string in the corpus is one place in a phrase
    of the dictionary, once for each time that the phrase stands in the parse: the suffix array of the dictionary, with
    these counts, is the order of the corpus to the depth of a string, and what follows the phrase is not needed.
    """
    texts = texts.select("key", "text")
    often = written(triggers(texts, length, spread).filter("n > 1").select("gram"), "repeats-often")  # a table, so that a gram that many places have can be split in the join
    parse = written(parsed(texts, length, spread).join(often, "gram", "left_semi"), "repeats-parse")
    entries = written(parse.groupBy("gram", "phrase").agg(F.count("*").alias("c"), F.min(F.struct("key", "begin", "size")).alias("at")), "repeats-dictionary")
    forks = written(entries.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1"), "repeats-forks")

    def bytes_(batches):
        for whole in batches:
            for batch, text in text_pieces(whole, PIECE):
                raw, offsets = text_bytes(text)
                items = batch.column("phrases")
                owner = np.repeat(np.arange(len(items)), np.asarray(items.value_lengths()))
                flat = items.flatten()
                begin, size = (flat.field(x).to_numpy().astype(np.int64) for x in ("begin", "size"))
                begin, data = offsets[owner] + begin, memoryview(np.ascontiguousarray(raw))
                for k in range(0, len(begin), 4096):
                    some = slice(k, k + 4096)
                    made = [data[a : a + n].tobytes() for a, n in zip(begin[some].tolist(), size[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([flat.field(x).slice(k, 4096) for x in ("gram", "phrase", "c")] + [pa.array(made, pa.binary())], ["gram", "phrase", "c", "data"])

    def dictionary(grams):
        """The bytes of the phrases with these grams, from one place where each stands."""
        open_ = entries.join(grams.select("gram"), "gram", "left_semi").select("at.key", F.struct("at.begin", "at.size", "gram", "phrase", "c").alias("p"))
        lists = written(open_.groupBy("key").agg(F.collect_list("p").alias("phrases")), "repeats-open")
        made.append(lists)
        return _with(texts, lists).select("text", "phrases").mapInArrow(bytes_, _BYTES)

    made = [often, parse, entries, forks]
    found = repeated_strings(dictionary(forks.filter(F.col("k") <= CROWD)), length)
    crowds = forks.filter(F.col("k") > CROWD)
    if not crowds.isEmpty():
        more, strings = scattered(dictionary(crowds), length)
        found = found.unionByName(more)
        made.append(strings)
    whole = entries.filter("c > 1").select("gram", "phrase", F.lit(None).cast("array<smallint>").alias("offs"))
    hits = parse.join(whole.unionByName(found), ["gram", "phrase"]).select("key", "begin", "size", "offs")
    hits = written(hits.groupBy("key").agg(F.collect_list(F.struct("begin", "size", "offs")).alias("hits")), "repeats-hits")
    removed(*made)
    return hits


def covered(raw: np.ndarray, offsets: np.ndarray, items: pa.ListArray, length: int) -> np.ndarray:
    """True for each byte that a repeated string covers."""
    owner = np.repeat(np.arange(len(items)), np.asarray(items.value_lengths()))
    flat = items.flatten()
    begin = offsets[owner] + flat.field("begin").to_numpy()
    offs = flat.field("offs")
    change = np.zeros(len(raw) + 1, np.int32)
    all_ = offs.is_null().to_numpy(zero_copy_only=False)
    np.add.at(change, begin[all_], 1)
    np.add.at(change, begin[all_] + flat.field("size").to_numpy()[all_], -1)
    starts = np.repeat(begin, np.asarray(offs.value_lengths().fill_null(0))) + offs.flatten().to_numpy()
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def remove(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text without the bytes that strings of `length`
    bytes cover which also start elsewhere. Null and empty texts have no bytes; rows that repeat are copies of each
    other; texts shorter than `length` keep all; empty tables give no rows; other columns are not read."""
    source = keyed(docs)
    hits = repeated(source, length, spread)

    def cut(batches):
        for whole in batches:
            for batch, text in text_pieces(whole, PIECE):
                raw, offsets = text_bytes(text)
                gone = covered(raw, offsets, batch.column("hits"), length)
                total = np.concatenate(([0], np.cumsum(gone)))
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < len(raw)]
                first[inner] |= gone[inner]
                runs = np.concatenate(([0], np.cumsum(first)))
                sha = [hashlib.sha256(raw[a:b][~gone[a:b]]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    touched = _with(source, hits).select("doc_id", "text", "hits").mapInArrow(cut, schema)
    rest, text, zero = source.join(_few(hits.select("key")), "key", "left_anti"), F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    rest = rest.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return touched.unionByName(rest)


def without_repeats(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """The documents in their own columns, their texts without repeated strings (and without characters of which a
    part is covered), n_chars counted anew. Null texts stay null, repeated rows lose what they share, empty tables give
    no rows."""
    source = keyed(docs, whole=True)
    hits = repeated(source, length, spread)

    def cut(batches):
        for whole in batches:
            for batch, text in text_pieces(whole, PIECE):
                raw, offsets = text_bytes(text)
                gone = covered(raw, offsets, batch.column("hits"), length)
                kept = [raw[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(kept, pa.string())], ["key", "kept"])

    few = _few(hits.select("key"))
    new = _with(source.select("key", "text"), hits).mapInArrow(cut, "key long, kept string")
    out = source.join(few, "key", "left_semi").join(new, "key").select(*own_columns(docs, F.col("kept")))
    out = out.unionByName(source.join(few, "key", "left_anti").select(*own_columns(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
