"""Exact deduplication through an extendible-hash index in the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WHITE_SPACE, keyed, own_columns, removed, written

#: Distinct keys that a bucket holds before it splits.
BUCKET_KEYS = 50_000
#: Keys of groups with copies that are broadcast at most (16 bytes each); beyond it the join is shuffled.
BROADCAST_KEYS = 500_000


def normalised(text):
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def first_bits(bits: int, column: str = "key"):
    """The first bits of a key, as a number: its entry in a directory of that depth."""
    return F.shiftrightunsigned(column, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[int, DataFrame]:
    """The global depth, and (slot, bucket): which bucket an entry of the directory points to.

    It begins with one bucket. While a bucket holds more than `bucket_keys` keys, the directory doubles and the bucket
    splits in two by one more bit; entries of buckets that did not split go on pointing to the same one. Keys are
    distinct hashes, so that copies never overfill a bucket. How many keys each entry of the deepest directory would
    have is counted once; the splits work on these counts, a row for each few hundred keys.
    """
    deepest = min(62, 8 + max(0, math.ceil(math.log2(max(1, keys.count()) / bucket_keys))))
    open_ = written(keys.groupBy(first_bits(deepest).alias("slot")).agg(F.count("*").alias("n")), "dedup-slots")
    parts, depth = [], 0
    while True:
        part = F.shiftrightunsigned("slot", deepest - depth)
        full = open_.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).filter(F.col("n") > bucket_keys).select("part")
        last = depth == deepest
        here = open_.withColumn("part", part)
        # a bucket's name: its depth and its bits
        parts.append((here if last else here.join(full, "part", "left_anti")).select("slot", F.concat_ws(":", F.lit(depth), "part").alias("bucket")))
        if last or full.isEmpty():
            break
        open_ = written(here.join(full, "part", "left_semi").select("slot", "n"), "dedup-slots")
        depth += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return deepest, written(out, "dedup-directory")


def _few(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def links(entries: DataFrame) -> DataFrame:
    """(key, digest, n_bytes, n, best): what each task has read of a text, how often and which row comes first. A text that
    is everywhere is a link for each task, so that its bucket's owner gets few rows of it and still merges them itself."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("id"), (-F.col("row")).alias("row"))).alias("best")
    return entries.withColumn("task", F.spark_partition_id()).groupBy("task", "key", "digest", "n_bytes").agg(F.count("*").alias("n"), best).drop("task")


def placed(rows: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """Rows with a key, with their bucket, where its owner is: all rows of a bucket in one task."""
    return rows.withColumn("slot", first_bits(depth)).join(_few(slots), "slot").drop("slot").repartition("bucket")


def chained(linked: DataFrame) -> DataFrame:
    """(bucket, key, chain) by the owner of each bucket: the entries of a key, one for each different text, with how many
    rows it has (n), from how many links, and which comes first. Links of a key that collide without being equal stay
    apart in the chain. No shuffle: a bucket's links are in one task."""
    merged = linked.groupBy("bucket", "key", "digest", "n_bytes").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.count("*").alias("links"))
    return merged.groupBy("bucket", "key").agg(F.array_sort(F.collect_list(F.struct("digest", "n_bytes", "n", "best", "links"))).alias("chain"))


def _index(source: DataFrame, bucket_keys: int) -> tuple[DataFrame, DataFrame]:
    """Entries (key, digest, n_bytes, doc_id, n_chars, row) of all documents, and the groups with more than one entry:
    key, digest, n_bytes, group_size, keep_id, keep_row. source: row, doc_id, text (normalised), n_chars.

    Each task makes links of what it reads, the directory names the bucket of each link's key, and the bucket's owner
    chains the links that reach it and merges those that are equal: only there does a group come together. The texts of
    chains with several entries come to the same owner, each different one once, and are compared byte by byte; a chain
    that holds two different texts ends the job.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    name = [F.xxhash64("text").alias("key"), digest, F.octet_length("text").alias("n_bytes")]
    entries = written(source.select("row", "doc_id", "n_chars", *name), "dedup-entries")
    linked = written(links(entries), "dedup-links")
    depth, slots = directory(linked.select("key").distinct(), bucket_keys)
    index = written(chained(placed(linked, depth, slots)).sortWithinPartitions("bucket", "key"), "dedup-index")
    chains = index.select("key", F.explode("chain").alias("link")).select("key", "link.*").filter("n > 1")
    again = source.select("text", F.xxhash64("text").alias("key")).join(_few(chains.select("key").distinct()), "key", "left_semi")
    # each different text of a key once, at the owner of its bucket
    texts = placed(again.groupBy("key", "text").agg(F.count("*").alias("n")), depth, slots).select("bucket", "key", digest, F.octet_length("text").alias("n_bytes"), "text")
    compared = texts.groupBy("bucket", "key", "digest", "n_bytes").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    equal = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.raise_error(F.lit("different texts share key, digest and length")).cast("long"))
    heads = chains.join(compared.drop("bucket"), ["key", "digest", "n_bytes"], "left")
    # texts that can't be found again compare as null, which is no equality either
    heads = heads.select("key", "digest", "n_bytes", equal.alias("group_size"), (-F.col("best.id")).alias("keep_id"), (-F.col("best.row")).alias("keep_row"))
    heads = written(heads, "dedup-heads")
    removed(linked, slots, index)
    return entries, heads


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal without white space. The row with the most code points stays, on ties
    the smallest id. Null and empty texts are equal to each other. Repeated rows count as copies: of rows with one id
    each is returned, and `kept` is true for all that carry the id that stays. Empty tables give no rows. Groups come
    from an extendible-hash index, see `_index`.
    """
    text = normalised(F.col(text_col))
    source = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))
    entries, heads = _index(source, bucket_keys)
    out = entries.join(_few(heads), ["key", "digest", "n_bytes"], "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256")
    )
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row of each group, in its own columns: the one with the most code points, on ties the smallest id, on ties
    (rows that repeat an id, rows without one) the first."""
    whole = keyed(docs, whole=True)
    source = whole.select(F.col("key").alias("row"), "doc_id", normalised(F.col("text")).alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    entries, heads = _index(source, bucket_keys)
    gone = entries.join(_few(heads), ["key", "digest", "n_bytes"]).filter(F.col("row") != F.col("keep_row")).select(F.col("row").alias("key"))
    gone = written(gone, "dedup-gone")
    removed(entries, heads)
    return whole.join(_few(gone), "key", "left_anti").select(*own_columns(docs))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS n
  FROM documents
), g AS (
  SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""
