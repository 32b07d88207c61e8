"""Similarity join of word shingle sets, and the components of its links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import LOWER, mixed, word_hashes, words
from .shared import keyed, own_columns, removed, text_bytes, text_pieces, written

#: Words of a shingle; similarity in per cent.
WORDS, PERCENT = 5, 80
#: Nodes that share a token of the rare class at most; what frequent tokens extend prefixes by: SLACK of the set, and 2.
RARE, SLACK = 16, 0.02
#: Ratio of neighbouring size classes, and spare parts of a set as a share of its class's least size.
RATIO, SPARE = 1.25, 0.16
#: Rounds in which each node of a bucket is compared with one other before all that is still apart is.
ROUNDS = 3
#: Nodes of either side of a cell in which what is still apart is compared, and tokens of either side.
STRAYS, OTHERS, CELL_TOKENS = 256, 1024, 4 << 20
#: Documents that are told apart by a broadcast of their rows (8 bytes each); beyond it the join is shuffled.
BROADCAST_KEYS = 500_000
_C = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(64)]


def shingles(text: pa.LargeStringArray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, ascending, and where each text's begin (with the end)."""
    raw, offsets = text_bytes(text)
    raw = LOWER[raw]
    start, end, before = words(raw, offsets)
    m = np.diff(before)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(before), np.int64)
    w = word_hashes(raw, start, end)
    h = np.zeros(len(w), np.uint64)
    for k in range(min(size, len(w))):
        h[: len(w) - k] += w[k:] * _C[k]
    full = np.zeros(len(w), bool)
    for k in np.flatnonzero((m > 0) & (m < size)):  # fewer words: the whole sequence
        a = before[k]
        h[a] = np.uint64(sum(int(w[a + j]) * int(_C[j]) for j in range(m[k])) % 2**64) + np.uint64(m[k])
        full[a] = True
    at = np.arange(len(w)) - np.repeat(before[:-1], m)
    full |= at <= np.repeat(m - size, m)
    owner = np.repeat(np.arange(len(m)), m)[full]
    h = mixed(h[full])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[once], owner[once]
    return h, np.searchsorted(owner, np.arange(len(m) + 1))


def names(h: np.ndarray, first: np.ndarray, clash: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each set, and a second one, which is also the first of those sets whose first name is in clash."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(salt)), dtype=np.uint64)))
        out.append(sums[first[1:]] - sums[first[:-1]])
    a, b = (x.view(np.int64) for x in out)
    return (np.where(np.isin(a, np.array(clash, np.int64)), b, a) if clash else a), b


def slack(n):
    return (n * SLACK).astype(np.int64) + 2


def _sets(docs: DataFrame, make, schema: str, size: int, clash: list[int]) -> DataFrame:
    """make(batch, h, first, name, second name) for pieces of the table."""

    def rows(batches):
        for whole in batches:
            for batch, text in text_pieces(whole, 1 << 20):
                h, first = shingles(text, size)
                yield from make(batch, h, first, *names(h, first, clash))

    return docs.mapInArrow(rows, schema)


def prefixes(docs: DataFrame, size: int, clash: list[int]) -> DataFrame:
    """(token, node, n, e): the e tokens of each set's extended prefix, in the order of hashes."""

    def make(batch, h, first, node, _):
        n = np.diff(first)
        length = np.where(n > 0, np.minimum(n, n - (PERCENT * n + 99) // 100 + 1 + slack(n)), 0)
        once = np.zeros(len(n), bool)
        once[np.unique(node, return_index=True)[1]] = True  # copies in one piece count once
        take = np.where(once, length, 0)
        keep = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(first[:-1], take)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(np.repeat(node, take)), pa.array(np.repeat(n, take).astype(np.int32)), pa.array(np.repeat(length, take).astype(np.int32))], ["token", "node", "n", "e"])

    return _sets(docs.select("text"), make, "token long, node long, n int, e int", size, clash)


def wholes(docs: DataFrame, size: int, clash: list[int]) -> DataFrame:
    """(token, node, n): all tokens of each set."""

    def make(batch, h, first, node, _):
        n = np.diff(first)
        for k in range(0, len(h), 200_000):
            some = slice(k, k + 200_000)
            owner = np.searchsorted(first, np.arange(k, min(k + 200_000, len(h))), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(node[owner]), pa.array(n[owner].astype(np.int32))], ["token", "node", "n"])

    return _sets(docs.select("text"), make, "token long, node long, n int", size, clash)


def parts_of(h: np.ndarray, n: int, c: int) -> tuple[np.ndarray, int]:
    """Keys of the combinations of tokens into which the set falls for pairs whose smaller set is in class c, and how
    many of the parts that two similar sets must share are spare."""
    low, high = RATIO**c, RATIO ** (c + 1)
    differ = int((2 + (100 - PERCENT) / PERCENT) * high * (100 - PERCENT) / (100 + PERCENT)) + 1
    spare = int(SPARE * low)
    count = differ + 1 + spare
    part = (mixed(h + np.uint64(7)) % np.uint64(count)).astype(np.int64)
    sums = np.zeros(count, np.uint64)
    np.add.at(sums, part, mixed(h + np.uint64(13)))
    keys = mixed(sums ^ mixed(np.arange(count, dtype=np.uint64) + np.uint64(c << 40))).view(np.int64)
    used = np.bincount(part, minlength=count) > 0
    empty = count - int(used.sum())
    # empty parts say little: they are left out where enough others must be shared
    return (keys[used], spare - empty) if empty <= spare else (keys, spare)


def combinations(docs: DataFrame, size: int, clash: list[int]) -> DataFrame:
    """(token, node, n, class, spare): combinations of each set's tokens, for its size class and the one below."""

    def make(batch, h, first, node, _):
        for i in range(len(node)):
            own = h[first[i] : first[i + 1]]
            if not len(own):
                continue
            c = int(np.log(len(own) + 1e-9) / np.log(RATIO) + 1e-12)
            c += (RATIO ** (c + 1) <= len(own)) - (RATIO**c > len(own))
            for k in {c, max(c - 1, 0)}:
                keys, spare = parts_of(own, len(own), k)
                yield pa.RecordBatch.from_arrays([pa.array(keys)] + [pa.array(np.full(len(keys), x), t) for x, t in ((node[i], pa.int64()), (len(own), pa.int32()), (k, pa.int32()), (spare, pa.int32()))], ["token", "node", "n", "class", "spare"])

    return _sets(docs.select("text"), make, "token long, node long, n int, class int, spare int", size, clash)


def _only(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents whose sets the nodes are, one of each."""
    keys = nodes.select(F.col("row").alias("key")).distinct()
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def _pairs(shared: DataFrame, *kept: str) -> DataFrame:
    """(x, y, i): the nodes of every two that share a rare token, with n and the columns `kept`, and how many they share.
    Lists of nodes that many tokens have are taken once."""
    lists = shared.groupBy("token", *(["class"] if "class" in shared.columns else [])).agg(F.sort_array(F.collect_list(F.struct("node", "n", *kept))).alias("nodes"))
    lists = lists.groupBy("nodes", *(["class"] if "class" in shared.columns else [])).agg(F.count("*").alias("w"))
    own = ["class"] if "class" in shared.columns else []
    left = lists.select(*own, "w", "nodes", F.posexplode("nodes").alias("p", "x"))
    both = left.select(*own, "w", "x", F.explode(F.slice("nodes", F.col("p") + 2, F.lit(RARE))).alias("y"))
    return both.groupBy("x", "y", *own).agg(F.sum("w").alias("i"))


def candidates(docs: DataFrame, nodes: DataFrame, size: int, clash: list[int], made: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """(x, y) nodes, and (bucket, node, n, class) of large groups: every two similar sets are a pair or in one bucket.
    made: gets the tables that are written for these.

    Sets of similarity 0.8 share more than `slack` tokens of their extended prefixes. One of these is rare, unless both
    sets are heavy: have about as many frequent tokens there. Tokens of heavy sets are counted anew, over all of the
    set; then one of those shared is rare, unless 0.8 of either set are frequent tokens. Such sets are split into parts,
    of which two similar sets have more than `spare` in common; the combinations of tokens in these are indexed. One of
    them is rare, unless both sets have more than `spare` frequent ones; those of such sets are the buckets. Pairs whose
    rare tokens in common, with all frequent ones and all after the prefix, are too few are left out.
    """
    enough = lambda i: i * (100 + PERCENT) >= (F.col("x.n") + F.col("y.n")) * PERCENT
    least = lambda c: F.least(f"x.{c}", f"y.{c}")
    alike = least("n") * 100 >= F.greatest("x.n", "y.n") * PERCENT
    ends = [F.col("x.node").alias("x"), F.col("y.node").alias("y")]
    tokens = prefixes(docs, size, clash)
    # a table, so that a token that many sets have can be split in the join
    often = written(tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "jaccard-often")
    shared = written(tokens.join(often, "token", "left_semi").distinct(), "jaccard-shared")
    made += [often, shared]
    counts = written(shared.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "jaccard-counts")
    shared = shared.join(counts, "token")
    made.append(counts)
    busy = shared.filter(F.col("df") > RARE).groupBy("node").agg(F.count("*").alias("f"), F.max("n").alias("n"))
    busy = busy.select("node", "f", (F.col("f") >= F.floor(F.col("n") * (SLACK * PERCENT / 100)) + 2).alias("heavy"))
    busy = written(busy.join(nodes, "node"), "jaccard-heavy")
    made.append(busy)
    rare = shared.filter(F.col("df") <= RARE).join(busy.select("node", "f", "heavy"), "node", "left").fillna({"f": 0, "heavy": False})
    after = F.greatest(F.col("x.n") - F.col("x.e"), F.col("y.n") - F.col("y.e"))
    out = _pairs(rare, "e", "f", "heavy").filter(alike & enough(F.col("i") + least("f") + after) & ~(F.col("x.heavy") & F.col("y.heavy"))).select(*ends)
    heavy = busy.filter("heavy").select("node", "row")
    if heavy.isEmpty():
        return out, None
    full = written(wholes(_only(docs, heavy), size, clash).join(heavy.select("node"), "node", "left_semi").distinct(), "jaccard-whole")
    made.append(full)
    full = full.join(full.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "token")
    busy = full.filter(F.col("df") > RARE).groupBy("node").agg(F.count("*").alias("f"), F.max("n").alias("n"))
    busy = written(busy.select("node", "f", (F.col("f") * 100 >= F.col("n") * PERCENT).alias("heavy")).join(nodes, "node"), "jaccard-heavier")
    made.append(busy)
    rare = full.filter(F.col("df") <= RARE).join(busy.select("node", "f", "heavy"), "node", "left").fillna({"f": 0, "heavy": False})
    out = out.unionByName(_pairs(rare, "f", "heavy").filter(alike & enough(F.col("i") + least("f")) & ~(F.col("x.heavy") & F.col("y.heavy"))).select(*ends))
    heavy = busy.filter("heavy").select("node", "row")
    if heavy.isEmpty():
        return out, None
    parts = written(combinations(_only(docs, heavy), size, clash).join(heavy.select("node"), "node", "left_semi").distinct(), "jaccard-parts")
    made.append(parts)
    parts = parts.join(parts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "token")
    hot = parts.filter(F.col("df") > RARE)
    busy = hot.groupBy("node", "class").agg(F.count("*").alias("f"), F.max("spare").alias("spare"))
    rare = parts.filter(F.col("df") <= RARE).join(busy.select("node", "class", "f"), ["node", "class"], "left").fillna({"f": 0})
    out = out.unionByName(_pairs(rare, "f", "spare").filter(alike & (F.col("i") + least("f") > least("spare"))).select(*ends))
    return out, hot.join(busy.filter("f > spare").select("node", "class"), ["node", "class"], "left_semi").select(F.col("token").alias("bucket"), "node", "n", "class")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y) of those pairs whose sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("set").alias("a")), "x").join(sets.select(F.col("node").alias("y"), F.col("set").alias("b")), "y")
    both = both.select("x", "y", F.size("a").alias("m"), F.size("b").alias("n"), F.size(F.array_intersect("a", "b")).alias("i"))
    return both.filter(F.col("i").cast("long") * 100 >= PERCENT * (F.col("m") + F.col("n") - F.col("i")).cast("long")).select("x", "y")


def links_of_cell(left, right):
    """(x, y) of different labels whose sets are similar; intersections are counted as products of 0/1 matrices, a slice
    of the tokens that both sides have at a time."""
    import pandas as pd

    if not len(left) or not len(right):
        return pd.DataFrame({"x": [], "y": []}, dtype="int64")
    sides = []
    for side in (left, right):
        sizes = side["set"].map(len).to_numpy()
        sides.append((np.repeat(np.arange(len(side)), sizes), np.concatenate(side["set"].to_list()), sizes))
    common = np.intersect1d(sides[0][1], sides[1][1])
    shared = np.zeros((len(left), len(right)), np.float32)
    at = [np.searchsorted(common, t) for _, t, _ in sides]
    ok = [(p < len(common)) & (common[np.minimum(p, len(common) - 1)] == t) if len(common) else np.zeros(len(t), bool) for p, (_, t, _) in zip(at, sides, strict=True)]
    for start in range(0, len(common), 4096):
        both = []
        for p, use, (row, _, sizes) in zip(at, ok, sides, strict=True):
            m = np.zeros((len(sizes), 4096), np.float32)
            mine = use & (p >= start) & (p < start + 4096)
            m[row[mine], p[mine] - start] = 1
            both.append(m)
        shared += both[0] @ both[1].T
    i = shared.astype(np.int64)
    hit = i * 100 >= PERCENT * (sides[0][2][:, None] + sides[1][2][None, :] - i)
    hit &= left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :]
    a, b = np.nonzero(hit)
    a, b = left["node"].to_numpy()[a], right["node"].to_numpy()[b]
    return pd.DataFrame({"x": np.minimum(a, b), "y": np.maximum(a, b)})


def strays(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y) of all similar nodes of one size class that are in different components. nodes: (class, node, label).

    Of each class the nodes outside its largest component meet all of its nodes in cells of bounded size, which return
    links only: as many comparisons as there are such nodes times the class, but no row for each pair."""
    largest = nodes.groupBy("class", "label").agg(F.count("*").alias("c")).groupBy("class").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    # as many rows as there are size classes
    side = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(CELL_TOKENS / F.pow(F.lit(RATIO), F.col("class") + 1))))
    sizes = F.broadcast(largest.filter(F.col("all") > F.col("most")).select("class", "main", F.ceil((F.col("all") - F.col("most")) / side(STRAYS)).alias("p"), F.ceil(F.col("all") / side(OTHERS)).alias("q")))
    held = nodes.join(sizes, "class").join(sets, "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    left = held.filter(F.col("label") != F.col("main")).select("class", "node", "label", "set", place("p", 1).alias("i"), spread("q").alias("j"))
    right = held.select("class", "node", "label", "set", place("q", 2).alias("j"), spread("p").alias("i"))
    right = right.toDF("class", "node", "label", "set", "j", "i")  # columns of its own
    return left.groupBy("class", "i", "j").cogroup(right.groupBy("class", "i", "j")).applyInPandas(links_of_cell, "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component. Labels spread along edges and jump to their own labels, so that
    the rounds are about the logarithm of the longest path."""
    both = written(edges.select(F.col("x").alias("node"), F.col("y").alias("to")).unionByName(edges.select(F.col("y").alias("node"), F.col("x").alias("to"))).distinct(), "jaccard-edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        hop = labels.select(F.col("node").alias("next"), F.col("label").alias("hop"))
        new = written(spread.join(hop, "next", "left").select("node", F.least("next", F.coalesce("hop", "next")).alias("label"), "was"), "jaccard-labels")
        removed(labels)
        labels = new.select("node", "label")
        if new.filter("label <> was").isEmpty():
            removed(both)
            return labels


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after these links between nodes."""
    ends = edges.join(labels.select(F.col("node").alias("x"), F.col("label").alias("a")), "x").join(labels.select(F.col("node").alias("y"), F.col("label").alias("b")), "y")
    merged = components(ends.filter("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct())
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
    out = written(labels.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "jaccard-nodes")
    removed(labels, merged)
    return out


def _labelled(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """docs: key, doc_id, text, as written. (row, doc_id, n, node) of all documents, and (node, best, doc_id, row, label)
    of all that have shingles: best says which row of the node comes first. row is the document's key."""

    def summary(batch, h, first, a, b):
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(np.diff(first)), pa.array(a), pa.array(b)], ["row", "doc_id", "n", "node", "check"])

    rows = written(_sets(docs.select("key", "doc_id", "text"), summary, "row long, doc_id long, n long, node long, check long", size, []), "jaccard-rows")
    # different sets with one 64-bit name, of which n sets give n * n / 2**65 on average: under 300 of 10**11; their second names serve
    clash = [r["node"] for r in rows.filter("n > 0").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("node").collect()]
    if clash:
        rows = rows.withColumn("node", F.when(F.col("node").isin(clash), F.col("check")).otherwise(F.col("node")))
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best"))
    nodes = written(nodes.select("node", F.col("best.doc_id").alias("doc_id"), "best", F.col("best.row").alias("row")), "jaccard-nodes")
    made: list[DataFrame] = []
    pairs, members = candidates(docs, nodes, size, clash, made)
    first = pairs = written(pairs.distinct(), "jaccard-pairs")
    every = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node")))
    if members is not None:
        members = written(members, "jaccard-members")
        every = every.unionByName(members.select("node"))
    labels = written(every.distinct().withColumn("label", F.col("node")), "jaccard-nodes")
    removed(*made)

    def tokens(batch, h, first, a, b):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.LargeListArray.from_arrays(pa.array(first), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))], ["node", "set"])

    mine = _only(docs, nodes.join(labels, "node", "left_semi"))
    sets = written(_sets(mine, tokens, "node long, set array<long>", size, clash).join(labels.select("node"), "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT
    for k in range(-1, ROUNDS + 1 if members is not None else 0):
        if 0 <= k < ROUNDS:
            at = members.join(labels, "node")
            split = at.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", F.lit(k))).alias("c")).filter("lo <> hi")
            pairs = at.join(split.select("bucket", "c"), "bucket").filter((F.col("label") != F.col("c.label")) & near(F.col("n"), F.col("c.n")))
            pairs = pairs.select(F.least("node", "c.node").alias("x"), F.greatest("node", "c.node").alias("y"))
        links = linked(pairs.distinct(), sets) if k < ROUNDS else strays(members.select("class", "node").distinct().join(labels, "node"), sets)
        found = written(links, "jaccard-links")
        if not found.isEmpty():
            labels = _relabelled(labels, found)
        removed(found)
    removed(first, sets, *([members] if members is not None else []))
    return rows, nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def groups(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to, itself included.

    Documents with equal sets are one node. Candidate pairs are verified on whole sets. Nodes of a large group's bucket
    are, in `ROUNDS` rounds, compared with one other of it each, so that the group falls together; then all that are
    still in different components are compared, so that no link is lost. Null, empty and white texts have no shingles
    and stay alone; rows with a null doc_id get the least id of the others, if any; rows repeat as they do in the input;
    empty tables give no rows; other columns are not read.
    """
    rows, joined = _labelled(keyed(docs), size)
    least = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(joined.join(least, "label").select("node", "component_id"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """One row of each group, in its own columns: the one with the least id, on ties (rows that repeat an id, groups
    without one) the first. Rows without shingles stay."""
    whole = keyed(docs, whole=True)
    rows, joined = _labelled(whole, size)
    kept = joined.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    gone = written(rows.filter("n > 0").select("row").join(kept, "row", "left_anti").withColumnRenamed("row", "key"), "jaccard-gone")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else gone
    return whole.join(gone, "key", "left_anti").select(*own_columns(docs))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
