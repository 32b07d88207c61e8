"""Which tool a policy calls next: candidates of a task, ranked by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses after which a schema-first policy looks for another tool.
SCHEMA_STATUSES = ("malformed_schema", "schema_drift", "invalid_schema")
#: Faults that may be retried unless a configuration names others; fields of it that a policy may override.
RETRYABLE = ("timeout", "rate_limit", "network_failure")
OVERRIDABLE = ("seed", "max_attempts", "default_timeout_ms", "time_budget_ms", "base_backoff_ms", "backoff_jitter_ms", "fault_probabilities", "policies", "retryable_faults", "policy_overrides")


def workload(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tools and tasks of JSON documents {tools: [..], tasks: [..]} in the column `value`, with the defaults that absent
    fields have: no jitter, no fallback tools, null for a blank description."""
    tool = "struct<name:string,base_latency_ms:int,jitter_ms:int,schema_fields:array<string>,description:string,timeout_ms:int,fault_multipliers:map<string,double>>"
    task = "struct<task_id:string,primary_tool:string,fallback_tools:array<string>,required_schema:array<string>,user_query:string>"
    doc = lines.select(F.from_json("value", f"tools array<{tool}>, tasks array<{task}>").alias("d"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    tools = doc.select(F.inline("d.tools")).withColumns({"jitter_ms": F.coalesce("jitter_ms", F.lit(0)), "description": blank("description"), "fault_multipliers": F.coalesce("fault_multipliers", F.expr("cast(map() as map<string,double>)"))})
    tasks = doc.select(F.inline("d.tasks")).withColumns({"fallback_tools": F.coalesce("fallback_tools", F.expr("cast(array() as array<string>)")), "user_query": blank("user_query")})
    return tools, tasks


def overridden(config: Column, override: Column) -> Column:
    """A map of settings with those of another that a policy may change."""
    allowed = F.map_filter(override, lambda k, _: k.isin(*OVERRIDABLE))
    return F.map_concat(F.map_filter(config, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def options(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """A row for each candidate of a task that the catalog has: pos (its place, the primary first), tool, supports (the
    tool has all required fields), tried, and the columns of the task. tools: name, fields, base_latency_ms."""
    each = tasks.select("*", F.posexplode(F.concat(F.array("primary_tool"), "fallback_tools")).alias("pos", "tool"))
    held = each.join(tools.withColumnRenamed("name", "tool"), "tool")
    return held.withColumns({"supports": F.size(F.array_except("required_schema", "fields")) == 0, "tried": F.array_contains("attempted", F.col("tool"))})


def heuristic_score(prefer_schema: bool = True, avoid_reuse: bool = True) -> Column:
    schema = F.when(F.col("supports"), 1.0).otherwise(0.0) * (2.0 if prefer_schema else 0.5)
    return schema + F.lit(1.0) / F.greatest(F.lit(1.0), F.col("base_latency_ms").cast("double")) + F.when(F.col("tried") & F.lit(avoid_reuse), -0.6).otherwise(0.0)


def chosen(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """For each task its candidates in order, and what each kind of planner calls; '' where the catalog has none of them.
    One aggregation over the candidates; ties of the heuristic score go to the greater name."""
    first = lambda where: F.min_by("tool", F.when(where, F.col("pos")))
    own = options(tasks, tools).withColumn("score", heuristic_score()).groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "tool"))), lambda x: x["tool"]).alias("candidates"),  # the few tools of a task
        F.min_by("tool", "pos").alias("first"), first(F.col("supports") & ~F.col("tried")).alias("next_compatible"), first(F.col("supports")).alias("first_compatible"), first(~F.col("tried")).alias("first_untried"), F.max_by("tool", F.struct("score", "tool")).alias("best"),
    )
    rows = tasks.join(own, "task_id", "left")
    schema_first = F.col("policy") == "schema_first"
    native = F.coalesce(F.when(schema_first & F.col("last_status").isin(*SCHEMA_STATUSES), F.col("next_compatible")), F.when(schema_first, F.col("first_compatible")), F.col("first"), F.lit(""))
    return rows.select(
        "task_id", "policy", F.coalesce("candidates", F.expr("cast(array() as array<string>)")).alias("candidates"), "next_compatible", native.alias("native"), F.coalesce("best", F.lit("")).alias("heuristic"),
        F.coalesce("first_untried", "first", F.lit("")).alias("minimal"), F.coalesce(F.try_element_at("sequence", F.col("attempt_number")), native).alias("replayed"),
    )
