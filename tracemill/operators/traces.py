"""Ordered work within traces, ledgers and groups, and the joins between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each logical key. max_by combines before the shuffle, so that a hot key is no large group."""
    rest = [c for c in ledger.columns if c not in keys]
    return ledger.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def rank_of(events: DataFrame, trace: str, order: str, where: Column, name: str) -> DataFrame:
    """The rows that `where` holds for, numbered from 1 within their trace."""
    return events.filter(where).withColumn(name, F.row_number().over(Window.partitionBy(trace).orderBy(order)))


def gap_to_previous(events: DataFrame, trace: str, order: str, support: Column, target: Column) -> DataFrame:
    """For each target the last support before it and the number of events between them."""
    before = Window.partitionBy(trace).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("support", F.last(F.when(support, F.col(order)), ignorenulls=True).over(before))
    return marked.filter(target & F.col("support").isNotNull()).withColumn("gap", F.col(order) - F.col("support") - 1)


def carried(events: DataFrame, keys: list[str], order: list[str], column: str, bad: Column, name: str) -> DataFrame:
    """The value of the last row before for which `bad` held."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(bad, F.col(column)), ignorenulls=True).over(before))


def within_budget(calls: DataFrame, keys: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """Running totals, and whether a call began within the budget."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("elapsed", F.sum(cost).over(w)).withColumn("allowed", F.col("elapsed") - F.col(cost) < budget)


def next_after_first(events: DataFrame, keys: list[str], order: str, failed: Column, action: str) -> DataFrame:
    """The action that follows the first failed step of each trace."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = events.withColumn("next_action", F.lead(action).over(w)).filter(failed)
    return steps.groupBy(*keys).agg(F.min(order).alias("failed_at"), F.min_by("next_action", order).alias("next_action"))


def first_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def linked_results(calls: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """Each call with its first result, if any."""
    first = results.groupBy(key).agg(F.min(order).alias("result_at"))
    return calls.join(first, key, "left")


def positional_diff(base: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows by position whose value differs (a null is a value), or that one side lacks."""
    side = lambda df, name: df.select(*keys, F.struct(F.col(value).alias("value")).alias(name))
    both = side(base, "x").join(side(other, "y"), keys, "full_outer")
    kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x.value").eqNullSafe(F.col("y.value")), "changed")
    return both.select(*keys, F.col("x.value").alias("a"), F.col("y.value").alias("b"), kind.alias("kind")).filter("kind is not null")


def candidate_pairs(safe: DataFrame, unsafe: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k unsafe partners of each safe row within its group that are closest in size, ties by id. safe: keys, safe_id,
    size; unsafe: keys, unsafe_id, size.

    Both sides are put into the order of sizes; a row meets the k unsafe ones on either side of its place, never a whole
    group."""
    rank = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    below = unsafe.select(*keys, "unsafe_id", F.col("size").alias("other"), rank("size", F.desc("unsafe_id")).alias("place"))
    above = unsafe.select(*keys, "unsafe_id", F.col("size").alias("other"), rank("size", "unsafe_id").alias("place"))
    both = safe.select(*keys, "safe_id", "size", F.lit(1).alias("side")).unionByName(unsafe.select(*keys, F.lit(None).cast("long").alias("safe_id"), "size", F.lit(0).alias("side")))
    up_to = Window.partitionBy(*keys).orderBy("size", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("n", F.count_if(F.col("side") == 0).over(up_to).cast("int")).filter("side = 1")  # unsafe rows that are not larger
    lower = placed.filter("n > 0").withColumn("place", F.explode(F.sequence(F.greatest(F.col("n") - k + 1, F.lit(1)), "n"))).join(below, [*keys, "place"])
    upper = placed.withColumn("place", F.explode(F.sequence(F.col("n") + 1, F.col("n") + k))).join(above, [*keys, "place"])
    pairs = lower.unionByName(upper).select(*keys, "safe_id", "unsafe_id", F.abs(F.col("size") - F.col("other")).alias("gap"))
    return first_k(pairs, ["safe_id"], ["gap", "unsafe_id"], k)


def distinct_first(df: DataFrame, task: str, order: list, limit: int) -> DataFrame:
    """The first rows, a row of each task before any second one; a global top-k, which Spark takes from each partition."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(task).orderBy(*order)))
    return turn.filter(F.col("turn") <= limit).orderBy("turn", *order).limit(limit)


def quota(df: DataFrame, cell: list[str], order: list, limits: DataFrame, default: int) -> DataFrame:
    """Up to each cell's own quota of rows."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return ranked.join(F.broadcast(limits), cell, "left").filter(F.col("rank") <= F.coalesce("quota", F.lit(default))).drop("quota")  # limits: a row for each cell
