"""Ledgers, traces, state relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces as T
from ..sources.tables import ATTEMPTS, attempts, table, trace_events
from .registry import query


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w01_latest_ledger_row(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"))
    return T.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT conv_id AS trajectory, turn AS ordinal, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS write_rank FROM conversations WHERE role = 'assistant'")
def w03_write_rank(spark, sf_dir):
    return T.rank_of(trace_events(spark, sf_dir), "trajectory", "ordinal", F.col("role") == "assistant", "write_rank").select("trajectory", "ordinal", "write_rank")


@query("""WITH m AS (SELECT conv_id, turn, role, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS support FROM conversations)
SELECT conv_id AS trajectory, turn AS ordinal, support, turn - support - 1 AS gap FROM m WHERE role = 'assistant' AND support IS NOT NULL""")
def w04_gap_to_support(spark, sf_dir):
    return T.gap_to_previous(trace_events(spark, sf_dir), "trajectory", "ordinal", F.col("role") == "user", F.col("role") == "assistant").select("trajectory", "ordinal", "support", "gap")


@query(f"""WITH {ATTEMPTS} SELECT policy, task_id, attempt_number::INT AS attempt_number, last_value(CASE WHEN status <> 'success' THEN status END IGNORE NULLS) OVER (PARTITION BY policy, task_id ORDER BY attempt_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_error FROM attempts""")
def w06_previous_error(spark, sf_dir):
    a = T.carried(attempts(spark, sf_dir), ["policy", "task_id"], ["attempt_number"], "status", F.col("status") != "success", "previous_error")
    return a.select("policy", "task_id", "attempt_number", "previous_error")


@query(f"""WITH {ATTEMPTS}, r AS (SELECT policy, task_id, attempt_number::INT AS attempt_number, latency_ms, sum(latency_ms) OVER (PARTITION BY policy, task_id ORDER BY attempt_number)::BIGINT AS elapsed FROM attempts)
SELECT policy, task_id, attempt_number, elapsed, elapsed - latency_ms < 60 AS allowed FROM r""")
def w07_running_budget(spark, sf_dir):
    return T.within_budget(attempts(spark, sf_dir), ["policy", "task_id"], "attempt_number", "latency_ms", 60).select("policy", "task_id", "attempt_number", "elapsed", "allowed")


@query(f"""WITH {ATTEMPTS}, s AS (SELECT policy, task_id, attempt_number::INT AS n, status, lead(event_type) OVER (PARTITION BY policy, task_id ORDER BY attempt_number) AS nx FROM attempts)
SELECT policy, task_id, min(n) AS failed_at, arg_min_null(nx, n) AS next_action FROM s WHERE status <> 'success' GROUP BY ALL""")
def w09_action_after_failure(spark, sf_dir):
    return T.next_after_first(attempts(spark, sf_dir), ["policy", "task_id"], "attempt_number", F.col("status") != "success", "event_type")


@query("""WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, min(event_id) AS result_at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c.user_id, event_id, result_at FROM c LEFT JOIN r USING (user_id)""")
def j15_first_result(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.linked_results(e.filter("event_type = 'click'").select("user_id", "event_id"), e.filter("event_type = 'purchase'"), "user_id", "event_id")


@query("""WITH a AS (SELECT conv_id AS trajectory, turn AS ordinal, text FROM conversations WHERE conv_id % 2 = 0), b AS (SELECT conv_id - 1 AS trajectory, turn AS ordinal, text FROM conversations WHERE conv_id % 2 = 1)
SELECT trajectory, ordinal, length(a.text) AS a, length(b.text) AS b, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (trajectory, ordinal) WHERE a.text IS DISTINCT FROM b.text""")
def j18_positional_diff(spark, sf_dir):
    e = trace_events(spark, sf_dir)
    odd = e.filter("trajectory % 2 = 1").withColumn("trajectory", F.col("trajectory") - 1)
    d = T.positional_diff(e.filter("trajectory % 2 = 0"), odd, ["trajectory", "ordinal"], "content")
    return d.withColumns({c: F.length(c).cast("long") for c in ("a", "b")})


@query("""WITH n AS (SELECT user_id, event_type, max(value) AS value FROM events WHERE value >= 10 GROUP BY ALL), o AS (SELECT user_id, event_type, min(value) AS value FROM events GROUP BY ALL)
SELECT user_id, event_type, round(coalesce(n.value, o.value), 6) AS value FROM n FULL JOIN o USING (user_id, event_type)""")
def u08_upsert(spark, sf_dir):
    e, keys = table(spark, sf_dir, "events"), ["user_id", "event_type"]
    new = e.filter("value >= 10").groupBy(*keys).agg(F.round(F.max("value"), 6).alias("value"))
    return T.upsert(e.groupBy(*keys).agg(F.round(F.min("value"), 6).alias("value")), new, keys)
