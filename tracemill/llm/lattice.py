"""Near duplicates among embeddings: cells of the E8 lattice in several tables, neighbouring cells, cosines."""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import components
from .rolling import mixed
from .shared import removed, written

#: Vectors with this cosine or more are linked.
COSINE = 0.9
#: Tables; cells of a table that a vector is put into; length of projections of unit vectors in one dimension. With these
#: values two vectors whose cosine is just 0.9 share a cell with probability 0.96, two with 0.95 with 0.9999.
TABLES, CELLS, SCALE = 6, 6, 1.0
#: Rows of one side that are compared at once; larger cells are cut into blocks.
ROWS = 2048
#: Directions around which vectors count as one class at most, and rows of a cell that make its mean one of them.
PIVOTS, CROWD = 1000, 256
SEED = 12
#: Rows of small tables that are broadcast at most.
BROADCAST_ROWS = 500_000


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice: two coordinates of +-1, or eight of +-1/2 with an even number of minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum."""
    out = np.rint(x)
    off = x - out
    odd = np.flatnonzero(out.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return out


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: whole coordinates of an even sum, or these moved by 1/2 in each."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=4)
def projections(dims: int, tables: int) -> np.ndarray:
    """dims x (8 for each table); the first rows are the same for all dims."""
    parts = [np.random.Generator(np.random.PCG64([SEED, k])).standard_normal((64, 8 * tables)) for k in range(-(-dims // 64))]
    return np.concatenate(parts)[:dims]


def slots(units: np.ndarray, tables: int, cells: int, scale: float) -> np.ndarray:
    """Hashes of the cells that each unit vector is put into: in each table its own and the nearest neighbouring ones."""
    at = units @ projections(units.shape[1], tables) * scale
    out = []
    for t in range(tables):
        x = at[:, 8 * t : 8 * t + 8]
        home = nearest(x)
        points = home[:, None, :]
        if cells > 1:
            near = np.argpartition(-((x - home) @ roots().T), cells - 2, axis=1)[:, : cells - 1]
            points = np.concatenate((points, home[:, None, :] + roots()[near]), 1)
        h = np.full(points.shape[:2], t + 1, np.uint64)
        for k in range(8):
            h = mixed(h ^ np.rint(2 * points[:, :, k]).astype(np.int64).view(np.uint64))
        out.append(h.view(np.int64))
    return np.concatenate(out, 1) if len(units) else np.zeros((0, tables * cells), np.int64)


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column, filled with zeros at the end, and which of them are neither null nor zero nor hold
    null or non-finite components. Each is scaled by a power of two, which no cosine depends on."""
    n = len(column)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), float("nan")), np.float64)
    out = np.zeros((n, max(int(size.max(initial=0)), 1)))
    out[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    most = np.abs(out).max(1)
    ok = np.isfinite(out).all(1) & (most > 0)
    out[~ok] = 0
    return np.ldexp(out, -np.frexp(np.where(ok, most, 1))[1][:, None]), ok


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]


def _column(values: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def named(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, vec_id, v, name: a digest of the direction's components, null for vectors that link with nothing."""

    def names(batches):
        for batch in batches:
            m, ok = matrix(batch.column("v"))
            m = m + 0.0  # no negative zeros
            keys = [hashlib.blake2b(np.trim_zeros(v, "b").tobytes(), digest_size=16).digest() if good else None for v, good in zip(m, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(keys, pa.binary())], ["row", "vec_id", "v", "name"])

    kind = dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"]
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return written(rows.mapInArrow(names, f"row long, vec_id long, v {kind}, name binary"), "lattice-rows")


def placed(nodes: DataFrame, tables: int, cells: int, scale: float) -> DataFrame:
    """nodes with the cells that they are put into."""

    def put(batches):
        for batch in batches:
            found = slots(unit(matrix(batch.column("v"))[0]), tables, cells, scale)
            yield pa.RecordBatch.from_arrays([*batch.columns, _column(found)], [*batch.schema.names, "slots"])

    kind = dict(nodes.dtypes)["v"]
    return written(nodes.mapInArrow(put, f"node long, m long, least long, v {kind}, slots array<long>"), "lattice-nodes")


def pivots(nodes: DataFrame, most: int = PIVOTS, crowd: int = CROWD) -> np.ndarray | None:
    """Mean directions of the fullest cells of the first table, fullest first; None where no cell is full."""
    home = F.element_at("slots", 1)
    full = [r["slot"] for r in nodes.groupBy(home.alias("slot")).count().filter(F.col("count") > crowd).orderBy(F.desc("count"), "slot").limit(most).collect()]
    if not full:
        return None
    held = np.sort(np.array(full, np.int64))

    def sums(batches):
        total = None
        for batch in batches:
            at = np.asarray(pc.list_element(batch.column("slots"), 0), np.int64)
            place = np.minimum(np.searchsorted(held, at), len(held) - 1)
            mine = np.flatnonzero(held[place] == at)
            u = unit(matrix(batch.column("v"))[0])
            if total is None or u.shape[1] > total.shape[1]:
                wider = np.zeros((len(held), u.shape[1]))
                wider[:, : 0 if total is None else total.shape[1]] = 0 if total is None else total
                total = wider
            np.add.at(total, (place[mine][:, None], np.arange(u.shape[1])), u[mine])
        if total is not None:
            there = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(held[there]), _column(total[there])], ["slot", "sum"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(max(map(len, rows["sum"])))
        for s in rows["sum"]:
            out[: len(s)] += s
        return pd.DataFrame({"slot": [rows["slot"].iloc[0]], "sum": [out]})

    parts = nodes.select("slots", "v").mapInArrow(sums, "slot long, sum array<double>")
    got = {r["slot"]: r["sum"] for r in parts.groupBy("slot").applyInPandas(added, "slot long, sum array<double>").collect()}  # `most` rows at most
    out = np.zeros((len(full), max(map(len, got.values()))))
    for i, slot in enumerate(full):
        out[i, : len(got[slot])] = got[slot]
    return unit(out)


def classed(nodes: DataFrame, around: np.ndarray, cosine: float) -> DataFrame:
    """nodes with `class`: the first direction that lies within half the angle of `cosine`, -1 if none does. By the
    triangle inequality of angles all vectors of a class are linked, which no comparison has to show."""
    least = float(np.cos(np.arccos(cosine) / 2)) + 1e-9

    def sorted_out(batches):
        for batch in batches:
            u = unit(matrix(batch.column("v"))[0])
            d = min(u.shape[1], around.shape[1])
            near = u[:, :d] @ around[:, :d].T >= least
            where = np.where(near.any(1), near.argmax(1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int64())], [*batch.schema.names, "class"])

    kind = dict(nodes.dtypes)["v"]
    return written(nodes.mapInArrow(sorted_out, f"node long, m long, least long, v {kind}, slots array<long>, class long"), "lattice-classes")


def gathered(nodes: DataFrame, rows: int) -> DataFrame:
    """The rows that are compared together: slot, a, b (blocks of the slot), side, node, m, class, v.

    A cell of up to `rows` rows is one block. A larger one is cut into blocks, each of one class, and each two blocks
    meet, but for those of one class."""
    each = nodes.select(F.explode("slots").alias("slot"), "node", "m", "class", "v")
    crowded = written(nodes.select(F.explode("slots").alias("slot"), "class").groupBy("slot", "class").agg(F.count("*").alias("n")), "lattice-counts")
    full = written(crowded.groupBy("slot").agg(F.sum("n").alias("all")).filter(F.col("all") > rows).select("slot"), "lattice-full")
    small = each if full.isEmpty() else each.join(_few(full), "slot", "left_anti")
    zero = F.lit("").alias
    small = small.select("slot", zero("a"), zero("b"), F.lit(0).alias("side"), "node", "m", "class", "v")
    if full.isEmpty():
        return small
    cut = crowded.join(_few(full), "slot", "left_semi").withColumn("parts", F.ceil(F.col("n") / rows))
    name = lambda part: F.concat_ws(":", F.col("class").cast("string"), part.cast("string"))
    blocks = cut.select("slot", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("slot", "class", name(F.col("part")).alias("block"))
    left, right = blocks.toDF("slot", "class", "a"), blocks.toDF("slot", "other", "b")
    pairs = written(left.join(right, "slot").filter((F.col("a") <= F.col("b")) & ~((F.col("class") == F.col("other")) & (F.col("class") >= 0))).select("slot", "a", "b"), "lattice-blocks")
    mine = each.join(_few(cut.select("slot", "class", "parts")), ["slot", "class"]).withColumn("block", name(F.pmod(F.xxhash64("node"), F.col("parts"))))
    out = [small]
    for side, column in enumerate(("a", "b")):
        meet = pairs if side == 0 else pairs.filter("a <> b")
        met = mine.join(_few(meet.withColumn("block", F.col(column))), ["slot", "block"])
        out.append(met.select("slot", "a", "b", F.lit(side).alias("side"), "node", "m", "class", "v"))
    return out[0].unionByName(out[1]).unionByName(out[2])


class Comparison:
    """Links within a cell, counted where the pair meets for the first time: in the least cell that both are put into."""

    def __init__(self, cosine: float, tables: int, cells: int, scale: float):
        self.cosine, self.slots = cosine, lambda u: slots(u, tables, cells, scale)

    def __call__(self, slot: int, v: np.ndarray, norm: np.ndarray, m: np.ndarray, kind: np.ndarray, cut: int):
        """Rows before `cut` meet those after it, or all meet all where cut is their number. (places, links, least place
        that the place is linked with, over others) of the rows that have links."""
        one = cut == len(v)
        a, b = np.arange(cut), np.arange(0 if one else cut, len(v))
        hit = (v[a] @ v[b].T) / (norm[a][:, None] * norm[b]) >= self.cosine
        hit &= (kind[a][:, None] != kind[b]) | (kind[a] < 0)[:, None]
        if one:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return None
        keep_a, keep_b = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        a, b, hit = a[keep_a], b[keep_b], hit[np.ix_(keep_a, keep_b)]
        label = np.arange(len(v))
        while True:  # labels spread until each has the least place of its component
            new = label.copy()
            np.minimum.at(new, a, np.where(hit, label[b], len(v)).min(1))
            np.minimum.at(new, b, np.where(hit, new[a][:, None], len(v)).min(0))
            if (new == label).all():
                break
            label = new
        first = hit & ~self._met(slot, v[a], v[b])
        links = np.zeros(len(v), np.int64)
        links[a] += first @ m[b]
        if not one:
            links[b] += m[a] @ first
        who = np.unique(np.concatenate((a, b)))
        return who, links[who], label[who]

    def _met(self, slot: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs share a cell before this one."""
        x, y = self.slots(unit(left)), self.slots(unit(right))
        both = np.intersect1d(x[x < slot], y[y < slot])
        if not len(both):
            return np.zeros((len(left), len(right)), bool)
        sides = []
        for side in (x, y):
            at = np.minimum(np.searchsorted(both, side), len(both) - 1)
            there = both[at] == side
            mark = np.zeros((len(side), len(both)), np.float32)
            mark[np.nonzero(there)[0], at[there]] = 1
            sides.append(mark)
        return sides[0] @ sides[1].T > 0


def linked(groups: DataFrame, compare: Comparison) -> DataFrame:
    """node, links (of its row, counted once for each pair), to: another node of its component in the cell."""

    def walked(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest is not None or batch is not None else None
            if table is None or not table.num_rows:
                continue
            now = table.to_batches()[0]
            slot = np.asarray(now.column("slot"), np.int64)
            a, b = (pc.dictionary_encode(now.column(c)).indices.to_numpy() for c in ("a", "b"))
            new = np.flatnonzero((slot[1:] != slot[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            begin = np.concatenate(([0], new, [len(slot)]))
            if batch is not None:  # the last group may go on
                rest = now.slice(int(begin[-2]))
                begin = begin[:-1]
            side, node, m, kind = (np.asarray(now.column(c), np.int64) for c in ("side", "node", "m", "class"))
            v, _ = matrix(now.column("v"))
            norm, found = np.linalg.norm(v, axis=1), []
            for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if j - i > 1:
                    got = compare(int(slot[i]), v[i:j], norm[i:j], m[i:j], kind[i:j], j - i if a[i] == b[i] and not side[i:j].any() else int((side[i:j] == 0).sum()))
                    if got is not None:
                        found.append((node[i + got[0]], got[1], node[i + got[2]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["node", "links", "to"])

    keys = ["slot", "a", "b"]
    return written(groups.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(walked, "node long, links long, to long"), "lattice-links")


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tables: int = TABLES, cells: int = CELLS, scale: float = SCALE, rows: int = ROWS, crowd: int = CROWD) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with this cosine or more), component_id (the smallest vec_id
    reachable by links, itself included), kept (vec_id = component_id).

    Equal directions are one node. Nodes are put into cells of the E8 lattice, in several tables each, and compared by
    cosine within the cells; no pair under the bound is linked, pairs just over it are found with the probability that
    `TABLES` states, and closer ones almost surely. Vectors near the mean of a full cell form a class whose links are
    counted, not compared. Null and zero vectors and those with null or non-finite components link with nothing; shorter
    vectors count as filled with zeros; rows that repeat an id are vectors each; rows without an id link but lend none;
    empty tables give no rows; other columns are not read.
    """
    source = named(vectors, id_col, vector_col)
    nodes = source.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min("row").alias("node"), F.count("*").alias("m"), F.min("vec_id").alias("least"), F.any_value("v").alias("v"))
    nodes = written(nodes, "lattice-directions")
    held = placed(nodes.select("node", "m", "least", "v"), tables, cells, scale)
    around = pivots(held, crowd=crowd)
    kinds = held.withColumn("class", F.lit(-1).cast("long")) if around is None else classed(held, around, cosine)
    found = linked(gathered(kinds.drop("least"), rows), Comparison(cosine, tables, cells, scale))
    of = kinds.filter("class >= 0").groupBy("class").agg(F.sum("m").alias("all"), F.min("node").alias("head"))  # `PIVOTS` rows at most
    heads = kinds.select("node", "class").join(F.broadcast(of), "class").select(F.col("node").alias("x"), F.col("head").alias("y"))
    edges = found.select(F.col("node").alias("x"), F.col("to").alias("y")).unionByName(heads).filter("x <> y").distinct()
    label = components(edges)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = kinds.select("node", "m", "class", "least").join(F.broadcast(of), "class", "left").join(counted, "node", "left").join(label, "node", "left")
    per_node = per_node.select("node", "least", (F.coalesce("all", "m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label"))
    per_node = written(per_node, "lattice-result")
    least = per_node.groupBy("label").agg(F.min("least").alias("component_id"))
    each = nodes.select("name", "node").join(per_node, "node").join(least, "label").select("name", "n_links", "component_id")
    out = source.select("vec_id", "name").join(each, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    removed(held, found, label)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_near_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
