"""Tool choice over a catalog (one tool for each nation) and tasks (one for each customer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choices as C
from ..sources.tables import table
from .registry import query


def tools(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.filter(F.array(*[F.when(F.shiftright(key, i) % 2 == 1, F.lit(f"f{i}")) for i in range(5)]), lambda x: x.isNotNull()).alias("fields"), (20 + key * 7 % 40).alias("base_latency_ms"))


def tasks(spark, sf_dir):
    key, own = F.col("c_custkey"), F.col("c_nationkey")
    name = lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    statuses = F.array(F.lit("timeout"), F.lit("schema_drift"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select(
        key.alias("task_id"), F.when(key % 3 == 0, "schema_first").otherwise("retry").alias("policy"), name(own + key % 2 * 5).alias("primary_tool"), F.array(name(own * 3 % 31), name((own + 7) % 25)).alias("fallback_tools"),
        F.array_distinct(F.array(F.concat(F.lit("f"), (key % 5).cast("string")), F.concat(F.lit("f"), (F.floor(key / 5) % 5).cast("string")))).alias("required_schema"), F.when(key % 4 < 2, F.array(name(own))).otherwise(F.expr("cast(array() as array<string>)")).alias("attempted"),
        F.get(statuses, (key % 3).cast("int")).alias("last_status"), F.when(key % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.expr("cast(array() as array<string>)")).alias("sequence"), (key % 4 + 1).cast("int").alias("attempt_number"),
    )


OPTIONS = """WITH tools AS (SELECT n_name AS tool, list_filter([CASE WHEN (n_nationkey >> i) % 2 = 1 THEN 'f' || i END for i in range(5)], lambda x: x IS NOT NULL) AS fields, 20 + n_nationkey * 7 % 40 AS latency FROM nation),
tasks AS (SELECT c_custkey AS task_id, CASE WHEN c_custkey % 3 = 0 THEN 'schema_first' ELSE 'retry' END AS policy, ['NATION_' || (c_nationkey + c_custkey % 2 * 5), 'NATION_' || (c_nationkey * 3 % 31), 'NATION_' || ((c_nationkey + 7) % 25)] AS tools,
  list_distinct(['f' || (c_custkey % 5), 'f' || (c_custkey // 5 % 5)]) AS required, CASE WHEN c_custkey % 4 < 2 THEN ['NATION_' || c_nationkey] ELSE [] END AS attempted, ['timeout', 'schema_drift', NULL][c_custkey % 3 + 1] AS last_status,
  CASE WHEN c_custkey % 5 = 0 THEN ['a', 'b'] ELSE [] END AS sequence, c_custkey % 4 + 1 AS attempt FROM customer),
o AS (SELECT t.task_id, u.p AS pos, tools.tool, list_has_all(fields, required) AS supports, list_contains(attempted, tools.tool) AS tried,
    CASE WHEN list_has_all(fields, required) THEN 2.0::DOUBLE ELSE 0 END + 1.0::DOUBLE / latency - CASE WHEN list_contains(attempted, tools.tool) THEN 0.6::DOUBLE ELSE 0 END AS score
  FROM (SELECT *, unnest([{'p': i, 't': tools[i]} for i in [1, 2, 3]]) AS u FROM tasks) t JOIN tools ON u.t = tools.tool),
c AS (SELECT task_id, list(tool ORDER BY pos) AS candidates, arg_min(tool, pos) AS fst, arg_min(tool, pos) FILTER (supports AND NOT tried) AS nxt, arg_min(tool, pos) FILTER (supports) AS compatible, arg_min(tool, pos) FILTER (NOT tried) AS untried,
    first(tool ORDER BY score DESC, tool DESC) AS best FROM o GROUP BY task_id),
n AS (SELECT *, coalesce(CASE WHEN policy = 'schema_first' AND last_status IN ('malformed_schema', 'schema_drift', 'invalid_schema') THEN nxt END, CASE WHEN policy = 'schema_first' THEN compatible END, fst, '') AS native FROM tasks LEFT JOIN c USING (task_id))"""


@query(f"{OPTIONS} SELECT task_id, policy, coalesce(candidates, []) AS candidates, nxt AS next_compatible, native FROM n")
def p01_candidates(spark, sf_dir):
    """Candidates, schema containment, next compatible tool, a policy's own choice."""
    return C.chosen(tasks(spark, sf_dir), tools(spark, sf_dir)).select("task_id", "policy", "candidates", "next_compatible", "native")


@query(f"{OPTIONS} SELECT task_id, coalesce(best, '') AS heuristic, coalesce(untried, fst, '') AS minimal, coalesce(sequence[attempt], native) AS replayed FROM n")
def p04_planners(spark, sf_dir):
    """Heuristic, minimal and replaying planners."""
    return C.chosen(tasks(spark, sf_dir), tools(spark, sf_dir)).select("task_id", "heuristic", "minimal", "replayed")


@query(f"{OPTIONS} SELECT policy, count(*) AS tasks, round(avg((coalesce(best, '') = native)::INT), 6) AS choice_accuracy, count(*) FILTER (coalesce(best, '') <> native) AS choice_changes FROM n GROUP BY policy")
def a47_choice_accuracy(spark, sf_dir):
    """How often one planner chooses as another does, and how often not."""
    rows = C.chosen(tasks(spark, sf_dir), tools(spark, sf_dir))
    same = F.col("heuristic") == F.col("native")
    return rows.groupBy("policy").agg(F.count("*").alias("tasks"), F.round(F.avg(same.cast("int")), 6).alias("choice_accuracy"), F.count_if(~same).alias("choice_changes"))


@query("""SELECT c_custkey AS task_id, list_sort(['seed=' || CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 7 END, 'max_attempts=3', 'cost=1']) AS settings,
  coalesce(['timeout', 'rate_limit', 'network_failure', 'schema_drift', NULL][c_custkey % 5 + 1] IN ('timeout', 'rate_limit', 'network_failure'), false) AS retryable FROM customer""")
def p08_override(spark, sf_dir):
    """Settings that a policy overrides (cost is none of them), and whether a status may be retried."""
    key = F.col("c_custkey")
    entry = lambda k, v: (F.lit(k), v.cast("string"))
    base = F.create_map(*entry("seed", F.lit(7)), *entry("max_attempts", F.lit(3)), *entry("cost", F.lit(1)))
    override = F.when(key % 2 == 0, F.create_map(*entry("seed", key), *entry("cost", F.lit(9)))).otherwise(F.create_map(*entry("cost", F.lit(8))))
    statuses = F.array(*[F.lit(x) for x in ("timeout", "rate_limit", "network_failure", "schema_drift")], F.lit(None).cast("string"))
    settings = F.array_sort(F.transform(F.map_entries(C.overridden(base, override)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "customer").select(key.alias("task_id"), settings.alias("settings"), F.coalesce(F.get(statuses, (key % 5).cast("int")).isin(*C.RETRYABLE), F.lit(False)).alias("retryable"))


@query("""SELECT 't' || n_nationkey AS name, 10 + n_nationkey AS base_latency_ms, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 0 END AS jitter_ms, ['id', n_name] AS schema_fields, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS description, 2 AS tasks FROM nation""")
def s02_workload(spark, sf_dir):
    """Tools and tasks of JSON documents, with defaults."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    tool = F.struct(F.concat(F.lit("t"), key.cast("string")).alias("name"), (10 + key).cast("string").alias("base_latency_ms"), F.when(key % 2 == 0, key).alias("jitter_ms"), F.array(F.lit("id"), name).alias("schema_fields"), F.when(key % 3 == 0, F.concat(F.lit(" "), name, F.lit(" "))).otherwise(" ").alias("description"))
    task = [F.struct(F.concat(key.cast("string"), F.lit(f"-{i}")).alias("task_id"), F.concat(F.lit("t"), key.cast("string")).alias("primary_tool"), F.array(F.lit("id")).alias("required_schema")) for i in range(2)]
    lines = table(spark, sf_dir, "nation").select(F.regexp_replace(F.to_json(F.struct(F.array(tool).alias("tools"), F.array(*task).alias("tasks"))), r'"base_latency_ms":"(\d+)"', '"base_latency_ms":$1').alias("value"))
    tools_, tasks_ = C.workload(lines)
    return tools_.join(tasks_.groupBy(F.col("primary_tool").alias("name")).agg(F.count("*").cast("int").alias("tasks")), "name").select("name", "base_latency_ms", "jitter_ms", "schema_fields", "description", "tasks")
