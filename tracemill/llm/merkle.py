"""A manifest of a dataset: Merkle trees built level by level, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import removed, written

#: Children of a node.
FANOUT = 2
#: Levels on the way down between two written tables.
CUT = 5
#: Trees or range partitions whose shifts are broadcast at most (about 40 bytes each).
BROADCAST_ROWS = 200_000


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """SHA-256 (as 32 bytes) of strings, one after the other."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hex_of(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with `tree`) with i, the row number in its tree from 0, and n, the tree's rows.

    A window over a tree would put it into one task. Rows are sorted by ranges of (tree, order), so that each range is a
    stretch of the whole order; the row number in the range and the rows of the tree's earlier ranges add up to i. The
    window that adds them up has a row for each range."""
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "merkle-order").withColumn("part", F.shiftright("place", 33))
    ranges = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    earlier = F.sum("rows").over(tree.orderBy("part")) - F.col("rows")
    shifts = written(ranges.select("tree", "part", (earlier - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")), "merkle-shifts")
    few = F.broadcast(shifts) if shifts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shifts
    out = written(placed.join(few, ["tree", "part"]).withColumn("i", F.col("place") + F.col("shift")).drop("part", "place", "shift"), "merkle-leaves")
    removed(placed, shifts)
    return out


def levels(leaves: DataFrame, payload: list[str], fanout: int) -> list[DataFrame]:
    """The nodes of each level, from the leaves (tree, i, n, hash, payload) up: tree, i, n (nodes of the tree at this
    level), hash, children (i, hash, payload, in order; at most `fanout`). A tree with one node left has no more levels."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out, own = [leaves], payload
    while most > 1:
        child = F.struct("i", "hash", *own).alias("child")
        runs = out[-1].filter("n > 1").groupBy("tree", F.expr(f"i div {fanout}").alias("i")).agg(F.sort_array(F.collect_list(child)).alias("children"), F.max("n").alias("n"))
        up = runs.select("tree", "i", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest(F.array_join(F.transform("children", lambda c: hex_of(c.hash)), "")).alias("hash"), "children")
        out.append(written(up, "merkle-level"))
        most, own = -(-most // fanout), []
    return out


def tops(nodes: list[DataFrame]) -> DataFrame:
    """tree, level, hash: what remains of each tree."""
    out = None
    for level, table in enumerate(nodes):
        top = table.filter("n = 1").select("tree", F.lit(level).alias("level"), "hash")
        out = top if out is None else out.unionByName(top)
    return out


def descended(nodes: list[DataFrame], starts: DataFrame, payload: list[str], carried: list[str]) -> DataFrame:
    """payload, hash, path and the columns `carried` of each leaf, from starts (tree, level, path, carried; a row for
    each tree). path: for each level, from the leaf up, the hashes of the siblings on the left and on the right.

    Level by level down, nodes join the paths of their parents and put their own siblings before them: as many rows are
    joined as there are nodes, not leaves times levels."""
    left = lambda p: F.aggregate(F.slice("children", 1, p), F.lit(b""), lambda a, c: F.concat(a, c.hash))
    right = lambda p: F.aggregate(F.slice("children", p + 2, F.size("children")), F.lit(b""), lambda a, c: F.concat(a, c.hash))
    paths, kept = None, None
    for level in range(len(nodes) - 1, 0, -1):
        here = starts.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("i"), "path", *carried)
        here = here if paths is None else here.unionByName(paths)
        below = nodes[level].select("tree", "i", "children").join(here, ["tree", "i"]).select("tree", "path", "children", *carried, F.posexplode("children").alias("p", "child"))
        path = F.concat(F.array(F.struct(left(F.col("p")).alias("left"), right(F.col("p")).alias("right"))), "path").alias("path")
        paths = below.select("tree", F.col("child.i").alias("i"), path, *carried, *([] if level > 1 else ["child.hash", *[f"child.{c}" for c in payload]]))
        if level > 1 and (len(nodes) - level) % CUT == 0:
            paths, before = written(paths, "merkle-paths"), kept
            if before is not None:
                removed(before)
            kept = paths
    alone = nodes[0].filter("n = 1").join(starts.filter("level = 0").drop("level"), "tree").select(*payload, "hash", "path", *carried)
    return alone if paths is None else paths.select(*payload, "hash", "path", *carried).unionByName(alone)


def manifest(rows: DataFrame, payload: list[str], order: list[str], fanout: int = FANOUT) -> DataFrame:
    """payload, hash, path, subroot and root of each row, from rows (tree, hash and the columns of payload and order).

    Leaves of a tree are in the given order, subroots in the order of the trees. hash, subroot and root are 32 bytes; a
    path is what `folded` takes. Empty tables give no rows."""
    low = levels(numbered(rows, order).select("tree", "i", "n", "hash", *payload), payload, fanout)
    subroots = written(tops(low).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "level", "hash"), "merkle-subroots")
    high = levels(numbered(subroots, ["name"]), ["name", "level"], fanout)
    empty = F.array().cast("array<struct<left: binary, right: binary>>")
    starts = descended(high, tops(high).select("tree", "level", empty.alias("path"), F.col("hash").alias("root")), ["name", "level"], ["root"])
    starts = written(starts.select(F.col("name").alias("tree"), "level", "path", F.col("hash").alias("subroot"), "root"), "merkle-starts")
    removed(subroots, *high)
    return descended(low, starts, payload, ["subroot", "root"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda a, s: digest(hex_of(F.concat(s.left, a, s.right))))


def proofs(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A document's leaf hashes doc_id, source, lang, n_chars and text; leaves of a lang are in the order of doc_id (nulls
    first; on ties of the leaf, which is then the same or, for rows that repeat an id, decides). Null is a lang of its
    own, before all others. Rows whose crc32(doc_id) 7 divides are checked with n_chars + 1 in place of n_chars; those
    without doc_id never are. Null and empty texts are different leaves; identical rows are leaves each; empty tables
    give no rows; other columns are not read.
    """
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("decimal(20,0)")
    leaf = lambda n: digest(*map(field, (doc_id, F.col("source"), F.col("lang"), n, F.col("text"))))
    tampered = F.when((F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull(), leaf(n_chars + 1))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    rows = docs.select(tree.alias("tree"), doc_id.alias("doc_id"), leaf(n_chars).alias("hash"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("key"))
    rows = written(rows, "merkle-rows")
    out = manifest(rows, ["doc_id", "tampered"], ["doc_id", "hash", "key"], fanout)
    back = folded(F.coalesce("tampered", "hash"), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda s: hex_of(F.concat(s.left, s.right))), "")
    out = out.select("doc_id", "hash", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), back.alias("back"))
    return out.select("doc_id", hex_of(F.col("hash")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"), "proof_sha256", hex_of(F.col("back")).alias("folded_root"), (F.col("back") == F.col("root")).alias("verified"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars, text, source,
    xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::UBIGINT),
      lambda c, b: list_reduce(range(0, 8)::UBIGINT[], lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(c, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) AS crc
  FROM documents
), f AS (
  SELECT doc_id, lang, crc, n_chars, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
    || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS a, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS z,
    coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS n0, coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') AS n1
  FROM d
), leaves AS (
  SELECT doc_id, lang, sha256(a || n0 || z) AS h, CASE WHEN crc % 7 = 0 THEN sha256(a || n1 || z) ELSE sha256(a || n0 || z) END AS t FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), low AS (
  SELECT 0 AS level, lang, i, n, h FROM placed
  UNION ALL
  SELECT * FROM (SELECT level + 1, lang, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, lang, i // 2)
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT * FROM (SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2)
), climb AS (
  SELECT doc_id, h AS leaf, lang, t AS at, '' AS proof, i, n, 0 AS level FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, CASE WHEN s.h IS NULL THEN sha256(c.at) WHEN c.i % 2 = 0 THEN sha256(c.at || s.h) ELSE sha256(s.h || c.at) END,
    c.proof || coalesce(s.h, ''), c.i // 2, (c.n + 1) // 2, c.level + 1
  FROM climb c LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1
), upper AS (
  SELECT c.doc_id, c.leaf, s.h AS subroot, c.at, c.proof, s.i, s.n, 0 AS level FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, CASE WHEN s.h IS NULL THEN sha256(c.at) WHEN c.i % 2 = 0 THEN sha256(c.at || s.h) ELSE sha256(s.h || c.at) END,
    c.proof || coalesce(s.h, ''), c.i // 2, (c.n + 1) // 2, c.level + 1
  FROM upper c LEFT JOIN high s ON s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1
)
SELECT u.doc_id, u.leaf, u.subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.at AS folded_root, u.at = r.h AS verified
FROM upper u CROSS JOIN (SELECT h FROM high WHERE n = 1) r WHERE u.n = 1
"""
