"""Whole episodes: success, diagnostic labels, and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_subsequence


def diagnosed(events: DataFrame, category: Column, sequence: list[str], claim: str, question: str) -> DataFrame:
    """Success of each episode by its category (0: must ask, 1: must not call, 2: must call in an order and make its
    claim), calls, errors, and labels of what went wrong."""
    lower = F.lower(F.coalesce("content", F.lit("")))
    answer = (F.col("kind") == "message") & (F.col("role") == "assistant")
    each = events.groupBy("trajectory").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("ordinal", "tool")))), lambda x: x["tool"]).alias("tools"),  # the calls of one episode
        F.bool_or(F.coalesce(F.col("content") == question, F.lit(False))).alias("asked"), F.bool_or(F.contains(lower, F.lit(claim.lower()))).alias("claims"), F.count_if("error").alias("error_steps"), F.count_if(answer).alias("answers"),
    )
    none = F.size("tools") == 0
    success = F.when(category == 0, none & F.col("asked")).when(category == 1, none & F.col("claims")).otherwise(F.col("claims") & ~none & is_subsequence(F.array(*map(F.lit, sequence)), F.col("tools")))
    labels = F.array_compact(F.array(F.when(none & (F.col("answers") == 0), "tool_skip"), F.when(F.size("tools") > 5, "unnecessary_tool_use"), F.when(none & (F.col("answers") > 0), "fabrication")))
    return each.select("trajectory", success.alias("success"), F.size("tools").alias("calls_made"), "error_steps", labels.alias("labels"))


def patched(events: DataFrame, contents: DataFrame, order: DataFrame) -> DataFrame:
    """Events with new contents, and blocks of neighbours in a new order (place: 1, 2, .. within the block). A block with
    a gap ends the job. contents: trajectory, event_id, new_content; order: trajectory, event_id, place."""
    w = Window.partitionBy("trajectory")
    block = events.select("trajectory", "event_id", "ordinal").join(order, ["trajectory", "event_id"])
    gap = F.max("ordinal").over(w) - F.min("ordinal").over(w) + 1 != F.count("*").over(w)
    moved = block.withColumn("start", F.min("ordinal").over(w)).withColumn("gap", gap)
    moved = moved.select("trajectory", "event_id", F.when(F.col("gap"), F.raise_error(F.lit("a block must be contiguous")).cast("int")).otherwise(F.col("start") + F.col("place") - 1).cast("int").alias("moved_to"))
    rows = events.join(contents, ["trajectory", "event_id"], "left").join(moved, ["trajectory", "event_id"], "left")
    return rows.withColumns({"content": F.coalesce("new_content", "content"), "ordinal": F.coalesce("moved_to", "ordinal")}).drop("new_content", "moved_to")
