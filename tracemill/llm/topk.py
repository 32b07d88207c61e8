"""Exact top-k search by inner product: columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one cell of the grid queries x candidates; both sides of a task are bounded by them.
CELL_QUERIES, CELL_ROWS = 4096, 16384
#: Candidates scored at once, and dimensions added before candidates are compacted.
TILE, DIMENSIONS = 4096, 16

SCHEMA = "query long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); without vectors that are null or hold null, NaN or infinity."""
    component = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), component.alias("v"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Vertical layout: one row per dimension. Shorter vectors are filled with zeros."""
    out = np.zeros((dims, len(column)), np.int64)
    for i, v in enumerate(column):
        out[: len(v), i] = v
    return out


def _tails(m: np.ndarray, steps: list[int]) -> np.ndarray:
    """Norms of what is left of each column after each step, rounded up."""
    squares = m.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[s:].sum(0)) * (1 + 1e-9) + 1e-6 for s in steps])


def best_in_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query the k best rows of this cell and whatever ties with the last of them.

    Scores grow by blocks of dimensions. After each block, the scores so far plus the product of the norms of what
    remains bound each candidate; those that can't reach the k-th best score known so far are compacted away.
    """
    empty = pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
    if not len(queries) or not len(rows):
        return empty
    dims = max(queries["v"].map(len).max(), rows["v"].map(len).max(), 1)
    q, c, ids = _matrix(queries["v"], dims), _matrix(rows["v"], dims), rows["vec_id"].to_numpy(np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims >= 2**52:
        q, c = q.astype(object), c.astype(object)  # exact beyond the range of doubles
    else:
        q, c = q.astype(np.float64), c.astype(np.float64)
    steps = [*range(DIMENSIONS, dims, DIMENSIONS), dims]
    q_tail, c_tail = _tails(q, steps), _tails(c, steps)
    out = []
    for i, (key, query) in enumerate(zip(queries["query"], queries["vec_id"], strict=True)):
        top_score, top_id, least = np.zeros(0, q.dtype), np.zeros(0, np.int64), -np.inf
        same = np.flatnonzero(ids == query)  # the query's own row: one that has its id and its vector
        own = next((int(j) for j in same if np.array_equal(c[:, j], q[:, i])), -1)
        for t in range(0, len(ids), TILE):
            alive = np.arange(t, min(t + TILE, len(ids)))
            alive = alive[alive != own]
            score, begin = np.zeros(len(alive), q.dtype), 0
            for s, end in enumerate(steps):
                score = score + q[begin:end, i] @ c[begin:end, alive]
                begin, slack = end, q_tail[s, i] * c_tail[s, alive]
                sure = score - slack
                if len(sure) >= k:
                    least = max(least, float(np.partition(sure.astype(np.float64), len(sure) - k)[len(sure) - k]) - 1e-3)
                keep = score + slack >= least
                alive, score = alive[keep], score[keep]
            top_score, top_id = np.concatenate((top_score, score)), np.concatenate((top_id, ids[alive]))
            if len(top_score) > k:
                order = np.lexsort((top_id, -top_score.astype(np.float64)))[:k] if top_score.dtype != object else np.array(sorted(range(len(top_score)), key=lambda j: (-top_score[j], top_id[j]))[:k])
                top_score, top_id = top_score[order], top_id[order]
                least = max(least, float(top_score[-1]) - 1e-3)
        out.append(pd.DataFrame({"query": np.full(len(top_id), key), "query_id": np.full(len(top_id), query), "vec_id": top_id, "score": top_score.astype(np.int64)}))
    return pd.concat(out) if out else empty


def top_k(vectors: DataFrame, queries, k: int = 10, **columns) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product for each query row.

    `queries` is a condition on vec_id. A row is no candidate for itself; ties go to the smaller vec_id. Vectors that
    are null or hold null or non-finite components take no part; empty vectors score 0, shorter ones count as filled
    with zeros. Rows that share a vec_id are candidates and queries each. Empty tables give no rows.

    Queries and rows meet in a grid of cells of bounded size, so that neither side has to fit into one task.
    """
    rows = scaled(vectors, **columns)
    total = rows.agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).first()
    p, q = max(1, -(-total["n"] // CELL_ROWS)), max(1, -(-total["q"] // CELL_QUERIES))
    p = max(p, min(24, -(-total["n"] // 1024)))
    asked = rows.filter(queries).withColumn("query", F.monotonically_increasing_id()).withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    held = rows.withColumn("p", F.pmod(F.xxhash64("vec_id"), F.lit(p)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    local = asked.groupBy("p", "q").cogroup(held.groupBy("p", "q")).applyInPandas(lambda a, b: best_in_cell(a, b, k), SCHEMA)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.k <> c.k
), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
