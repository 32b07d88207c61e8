"""Aggregates over attempts, runs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at the half-even rounded rank share * (n - 1) of each group. Values are counted before they are
    ordered, so that a group costs as many rows as it has different values."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys)
    counts = counts.withColumn("__upto", F.sum("__n").over(over.orderBy(value))).withColumn("__all", F.sum("__n").over(over))
    rank = F.bround(F.lit(share) * (F.col("__all") - 1))
    return counts.filter(F.col("__upto") > rank).groupBy(*keys).agg(F.min(value).alias(name))


def policy_metrics(results: DataFrame) -> DataFrame:
    """Totals, rates, mean and p95 latency, retries per success and mean cost of successes (null without any) by policy."""
    won = F.col("success") == 1
    main = results.groupBy("policy").agg(
        F.count("*").alias("tasks_total"), F.sum("success").alias("tasks_succeeded"), ratio(F.sum("success"), F.count("*")).alias("success_rate"),
        ratio(F.sum("n_invalid"), F.sum("n_attempts")).alias("invalid_rate"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
        ratio(F.sum(F.col("n_attempts") - 1), F.sum("success")).alias("retries_per_success"), F.round(F.avg(F.when(won, F.col("cost_usd"))), 9).alias("cost_per_success"),
    )
    return main.join(nearest_rank(results, ["policy"], "latency_ms", 0.95, "p95_latency_ms"), "policy")


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 for one value), half width and bounds of the normal 95 % interval; nulls are skipped."""
    out = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    half = F.lit(1.96) * F.col("std") / F.sqrt("n")
    return out.select(*keys, "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(half, 6).alias("ci95_half_width"), F.round(F.col("mean") - half, 6).alias("ci95_low"), F.round(F.col("mean") + half, 6).alias("ci95_high"))


def unpivoted(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "value")


def delta(base: DataFrame, other: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Both sides and other - base; null where a side is missing."""
    return base.select(*keys, F.col(value).alias("base")).join(other.select(*keys, F.col(value).alias("comparison")), keys, "full_outer").withColumn("delta", F.round(F.col("comparison") - F.col("base"), 6))


def advantage(deltas: DataFrame, null_deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas less those that a null comparison shows."""
    return deltas.select(*keys, "delta").join(null_deltas.select(*keys, F.col("delta").alias("null_delta")), keys).withColumn("advantage", F.round(F.col("delta") - F.col("null_delta"), 6))


def weighted_mean(df: DataFrame, keys: list[str], weight: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[ratio(F.sum(F.col(v) * F.col(weight)), F.sum(weight)).alias(v) for v in values])


def kappa(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Agreement and Cohen's kappa of two raters' labels; 1 if chance alone would agree, 0 without items."""
    both = a.select(key, F.col("label").alias("x")).join(b.select(key, F.col("label").alias("y")), key)
    cells = both.groupBy("x", "y").agg(F.count("*").alias("n"))  # as many rows as pairs of labels
    total = F.sum("n")
    left = cells.groupBy(F.col("x").alias("l")).agg(F.sum("n").alias("p"))
    right = cells.groupBy(F.col("y").alias("l")).agg(F.sum("n").alias("q"))
    chance = left.join(right, "l").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0)).alias("pq"))
    seen = cells.agg(F.coalesce(total, F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    n = F.col("n").cast("double")
    observed, expected = F.col("same") / F.nullif(n, F.lit(0.0)), F.col("pq") / F.nullif(n * n, F.lit(0.0))
    value = F.when(F.col("n") == 0, 0.0).when(expected == 1, 1.0).otherwise((observed - expected) / F.nullif(1 - expected, F.lit(0.0)))
    return seen.crossJoin(chance).select("n", F.round(F.coalesce(observed, F.lit(0.0)), 6).alias("agreement"), F.round(value, 6).alias("kappa"))  # one row each


def main_effects(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Mean of each level of each factor, pooled over the others, from one pass of grouping sets."""
    out = df.groupingSets([[f] for f in factors], *factors).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"), *[F.grouping(f).alias(f"__{f}") for f in factors])
    name = F.coalesce(*[F.when(F.col(f"__{f}") == 0, F.lit(f)) for f in factors])
    level = F.coalesce(*[F.when(F.col(f"__{f}") == 0, F.col(f)) for f in factors])
    return out.select(name.alias("factor"), level.alias("level"), "mean", "n")


def bootstrap(clusters: DataFrame, draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of sum(part) / sum(whole) over samples of clusters. clusters: position, part, whole, one row
    for each cluster; draws: sample, position. Only sums of clusters meet the draws, never rows."""
    each = draws.join(clusters, "position").groupBy("sample").agg((F.sum("part") / F.nullif(F.sum("whole"), F.lit(0))).alias("value"))
    every = Window.orderBy("value", "sample")  # a row for each sample
    ranked = each.withColumns({"r": F.row_number().over(every) - 1, "n": F.count("*").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    at = lambda share: F.least(F.col("n") - 1, F.floor(share * F.col("n")))
    return ranked.agg(F.count("*").alias("samples"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max(F.when(F.col("r") == at(low), F.col("value"))), 6).alias("low"), F.round(F.max(F.when(F.col("r") == at(high), F.col("value"))), 6).alias("high"))


def taxonomy(df: DataFrame, column: str) -> DataFrame:
    """Counts of each value, the most frequent first, ties by name."""
    return df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "name")))  # a row for each name
