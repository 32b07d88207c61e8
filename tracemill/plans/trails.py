"""Links, replays and checks of tool-using traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import trails as T
from ..sources.tables import TOOL_EVENTS, table, tool_events
from .registry import query

LINKED = f"""WITH {TOOL_EVENTS}, calls AS (SELECT trajectory, call_id, arg_max(event_id, ordinal) AS call_event_id FROM tool_events WHERE tool IS NOT NULL GROUP BY ALL),
linked AS (SELECT t.*, c.call_event_id FROM tool_events t LEFT JOIN calls c USING (trajectory, call_id) WHERE role = 'tool')"""
SAYS = "error::VARCHAR || ' amount ' || k % 5 || ' ref ' || k % 4"


@query(f"{LINKED} SELECT trajectory, event_id, call_event_id FROM linked")
def j14_linked_results(spark, sf_dir):
    return T.linked_calls(tool_events(spark, sf_dir)).select("trajectory", "event_id", "call_event_id")


@query(f"""{LINKED}, r AS (SELECT trajectory, call_event_id, arg_min(event_id, ordinal) AS result_event_id, arg_min(content, ordinal) AS result, arg_min(error, ordinal) AS error FROM linked WHERE call_event_id IS NOT NULL GROUP BY ALL)
SELECT w.trajectory, w.event_id AS call_event_id, w.tool, w.arguments, result_event_id, result, r.error FROM tool_events w LEFT JOIN r ON w.trajectory = r.trajectory AND w.event_id = r.call_event_id WHERE kind = 'write'""")
def j15_receipts(spark, sf_dir):
    return T.receipts(tool_events(spark, sf_dir))


@query(f"""WITH {TOOL_EVENTS}, w AS (SELECT * FROM tool_events WHERE kind = 'write')
SELECT a.trajectory, a.event_id AS earlier, b.event_id AS later, list_sort(list_intersect(a.anchors, b.anchors)) AS shared, coalesce(g.ids, []) AS gap_event_ids, len(coalesce(g.ids, []))::INT AS gap_count
FROM w a JOIN w b ON a.trajectory = b.trajectory AND a.ordinal < b.ordinal AND list_has_any(a.anchors, b.anchors)
LEFT JOIN LATERAL (SELECT list(e.event_id ORDER BY e.ordinal) AS ids FROM tool_events e WHERE e.trajectory = a.trajectory AND e.ordinal > a.ordinal AND e.ordinal < b.ordinal AND (e.kind <> 'message' OR e.content IS NOT NULL)) g ON true""")
def j16_same_entity_pairs(spark, sf_dir):
    return T.same_entity_writes(tool_events(spark, sf_dir))


@query(f"""{LINKED}, s AS (SELECT *, {SAYS} AS says FROM linked WHERE content IS NOT NULL)
SELECT trajectory, arg_min(event_id, ordinal) FILTER (call_event_id IS NULL) AS raw_event_id, min(event_id) FILTER (call_event_id IS NOT NULL) AS linked_event_id
FROM s GROUP BY trajectory, turn, says HAVING count(call_event_id) = 1 AND count(*) > 1""")
def j17_redundant_results(spark, sf_dir):
    """Results that stand twice, compared by what they say."""
    return T.redundant_results(tool_events(spark, sf_dir))


def _mutated(events):
    """Every 17th result another amount, every 19th the same in another order."""
    i = F.col("event_id")
    amount = F.format_string('{"amount": %s, "ref": "R-10%s"}', (F.col("k") % 5 + 7).cast("string"), (F.col("k") % 4 + F.when(i % 2 == 0, 4).otherwise(0)).cast("string"))
    same = F.format_string('{"ref": "R-10%s",  "amount": %s}', (F.col("k") % 4).cast("string"), (F.col("k") % 5).cast("string"))
    return events.withColumn("content", F.when((F.col("kind") == "result") & (i % 7 == 0), amount).when((F.col("kind") == "result") & (i % 5 == 0), same).otherwise(F.col("content")))


CHANGES = f"""WITH {TOOL_EVENTS}, changes AS (SELECT *, CASE WHEN ordinal < 5 THEN 'pre_target' ELSE 'causal' END AS change FROM tool_events WHERE kind = 'result' AND event_id % 7 = 0)"""


def _targets(events):
    return events.filter("ordinal = 5").select("trajectory", F.col("ordinal").alias("target"))


@query(f"{CHANGES} SELECT trajectory, ordinal, event_id, change FROM changes WHERE trajectory IN (SELECT trajectory FROM tool_events WHERE ordinal = 5)")
def j18_replay_changes(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    return T.replay_changes(e, _mutated(e), _targets(e)).select("trajectory", "ordinal", F.col("after_id").alias("event_id"), "change")


@query(f"WITH {TOOL_EVENTS} SELECT trajectory, event_id FROM tool_events WHERE kind = 'result' AND (event_id % 7 = 0 OR event_id % 31 = 0)")
def j19_unfaithful_results(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    return T.unfaithful_results(e, _mutated(e).filter("event_id % 31 <> 0"))


@query(f"""{CHANGES}, c AS (SELECT * FROM changes WHERE change = 'causal'), gone AS (SELECT trajectory, list_filter(list_distinct(list((k % 5)::DOUBLE)), lambda x: NOT list_contains(list((k % 5 + 7)::DOUBLE), x)) AS numbers,
  list_filter(list_distinct(list('R-10' || k % 4)), lambda x: NOT list_contains(list('R-10' || (k % 4 + CASE WHEN event_id % 2 = 0 THEN 4 ELSE 0 END)), x)) AS strings FROM c GROUP BY trajectory),
s AS (SELECT e.trajectory, event_id, tool, CASE WHEN tool = 'calculate' THEN list_sort(list_transform(list_intersect([(k % 5)::DOUBLE, 1.5], numbers), lambda x: x::VARCHAR)) ELSE list_intersect(['R-10' || k % 4], strings) END AS stale
  FROM tool_events e JOIN gone USING (trajectory) WHERE tool IS NOT NULL AND ordinal > 5)
SELECT * FROM s WHERE len(stale) > 0""")
def j20_stale_references(spark, sf_dir):
    """Calls after the change that use replaced values."""
    e = tool_events(spark, sf_dir)
    return T.stale_references(e, T.replay_changes(e, _mutated(e), _targets(e)), _targets(e))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderdate AS approved_at, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE '#' || o_orderkey END AS approved, CASE WHEN o_orderkey % 7 = 0 THEN '#' || (o_orderkey + 1) ELSE '#' || o_orderkey END AS proposed FROM orders),
c AS (SELECT r.id, count(*) AS n, min('#' || (l_orderkey + l_partkey % 2)) AS changed FROM r JOIN lineitem ON id = l_orderkey WHERE l_shipdate > approved_at AND l_linenumber % 3 = 0 GROUP BY 1)
SELECT r.id, approved, proposed, coalesce(n, 0) AS n, changed, CASE WHEN approved IS NULL OR approved <> proposed OR coalesce(n, 0) <> 1 THEN 'ESCALATE' WHEN changed = approved THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM r LEFT JOIN c USING (id)""")
def j21_target_check(spark, sf_dir):
    """Approved, proposed and changed targets."""
    key = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("#"), c.cast("string"))
    approval = F.when(key % 11 == 0, F.lit('{"order_id": ""}')).when(key % 13 == 0, F.format_string('{"order_id": "%s", "record_id": "x"}', name(key))).otherwise(F.format_string('{"order_id": "%s", "entity_id": "%s"}', name(key), name(key)))
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderdate").alias("approved_at"), approval.alias("approval"), F.format_string('{"record_id": "%s"}', name(key + F.when(key % 7 == 0, 1).otherwise(0))).alias("proposal"))
    changes = table(spark, sf_dir, "lineitem").filter("l_linenumber % 3 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("changed_at"), name(F.col("l_orderkey") + F.col("l_partkey") % 2).alias("entity"))
    return T.target_checks(rows, changes)


@query(f"WITH {TOOL_EVENTS} SELECT trajectory, list(event_id ORDER BY ordinal) AS event_ids FROM (SELECT *, row_number() OVER (PARTITION BY trajectory ORDER BY ordinal DESC) AS r FROM tool_events) WHERE r <= 12 GROUP BY 1")
def p13_tail_view(spark, sf_dir):
    last = F.array_sort(F.collect_list(F.struct("ordinal", "event_id")))  # twelve at most
    return T.tail(tool_events(spark, sf_dir)).groupBy("trajectory").agg(F.transform(last, lambda x: x["event_id"]).alias("event_ids"))


@query(f"WITH {TOOL_EVENTS} SELECT trajectory, event_id, tool FROM tool_events JOIN (VALUES (0, 'update'), (1, 'update'), (1, 'lookup')) w(domain, tool) USING (tool) WHERE domain = trajectory % 3")
def p21_write_events(spark, sf_dir):
    """Calls of tools that write in the trace's domain."""
    allowed = spark.createDataFrame([(0, "update"), (1, "update"), (1, "lookup")], "domain long, tool string")
    e = tool_events(spark, sf_dir).withColumn("domain", F.col("trajectory") % 3)
    return e.join(F.broadcast(allowed), ["domain", "tool"], "left_semi").select("trajectory", "event_id", "tool")  # a few tools for each domain


@query(f"""WITH {TOOL_EVENTS} SELECT trajectory, count(*) FILTER (tool = 'update' AND k % 20 = 3) AS matches, CASE WHEN count(*) FILTER (tool = 'update' AND k % 20 = 3) = 1 THEN min(event_id) FILTER (tool = 'update' AND k % 20 = 3) END AS event_id FROM tool_events GROUP BY 1""")
def p22_selected_target(spark, sf_dir):
    return T.selected(tool_events(spark, sf_dir), F.coalesce((F.col("tool") == "update") & (F.col("k") % 20 == 3), F.lit(False)))


@query(f"""WITH {TOOL_EVENTS}, t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN event_id END IGNORE NULLS) OVER (PARTITION BY trajectory ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM tool_events),
f AS (SELECT trajectory, arg_min(content, ordinal) AS first_text FROM tool_events WHERE role = 'user' AND content IS NOT NULL GROUP BY 1)
SELECT trajectory, event_id, last_user, coalesce(first_text, 'Complete the user''s requested support action.') AS first_text FROM t LEFT JOIN f USING (trajectory) WHERE kind = 'write'""")
def p23_user_before_write(spark, sf_dir):
    return T.before_writes(tool_events(spark, sf_dir))


@query(f"""{LINKED}, e AS (SELECT trajectory, count(*) FILTER (tool IS NOT NULL) - count(DISTINCT call_id) FILTER (tool IS NOT NULL) AS duplicate_call_ids, count(*) FILTER (role = 'tool' AND call_id IS NULL) AS results_without_id FROM tool_events GROUP BY 1),
o AS (SELECT trajectory, count(*) AS n FROM linked WHERE call_id IS NOT NULL AND call_event_id IS NULL GROUP BY 1)
SELECT trajectory, duplicate_call_ids, results_without_id, coalesce(n, 0) AS orphan_results, duplicate_call_ids = 0 AND results_without_id = 0 AND coalesce(n, 0) = 0 AS passed FROM e LEFT JOIN o USING (trajectory)""")
def q03_trace_errors(spark, sf_dir):
    return T.trace_errors(tool_events(spark, sf_dir))


@query(f"""WITH {TOOL_EVENTS}, s AS (SELECT *, max(CASE WHEN role = 'user' THEN ordinal END) OVER (PARTITION BY trajectory ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS support FROM tool_events)
SELECT trajectory, event_id, support, coalesce(g.ids, []) AS gap_event_ids, list_filter(coalesce(g.ids, []), lambda x: x % 2 = 1) AS missing FROM s
LEFT JOIN LATERAL (SELECT list(e.event_id ORDER BY e.ordinal) AS ids FROM tool_events e WHERE e.trajectory = s.trajectory AND e.ordinal > s.support AND e.ordinal < s.ordinal AND (e.kind <> 'message' OR e.content IS NOT NULL)) g ON true
WHERE kind = 'write' AND support IS NOT NULL""")
def w05_intervening(spark, sf_dir):
    """Events between the last support and the target, and those of them that a plan (even ids) leaves out."""
    rows = T.intervening(tool_events(spark, sf_dir), F.col("kind") == "write", F.col("role") == "user")
    return rows.withColumn("missing", F.filter("gap_event_ids", lambda x: x % 2 != 0))


@query(f"""WITH {TOOL_EVENTS}, a AS (SELECT *, CASE WHEN tool IS NOT NULL THEN 'call' WHEN kind = 'message' AND role = 'assistant' THEN 'answer' END AS action FROM tool_events),
n AS (SELECT *, first_value(action IGNORE NULLS) OVER (PARTITION BY trajectory ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM a)
SELECT trajectory, coalesce(bool_or(error AND nx = 'answer'), false) AS result_ignored FROM n GROUP BY 1""")
def w08_ignored_results(spark, sf_dir):
    return T.ignored_results(tool_events(spark, sf_dir))


@query("SELECT c_mktsegment AS domain, c_custkey::VARCHAR AS task_id, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey))::INT AS seed_rank FROM customer")
def w11_seed_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("domain"), F.col("c_custkey").cast("string").alias("task_id"))
    return c.withColumn("seed_rank", F.row_number().over(Window.partitionBy("domain").orderBy(F.expr("try_cast(task_id as long)"), "task_id")))


@query(f"""WITH {TOOL_EVENTS}, f AS (SELECT trajectory, min(ordinal) AS f FROM tool_events WHERE event_id % 9 = 0 GROUP BY 1)
SELECT trajectory, event_id, CASE WHEN f IS NULL THEN 'nothing_changed' WHEN role <> 'assistant' OR tool IS NOT NULL THEN 'no_prose' WHEN ordinal <= f THEN 'not_after_change' WHEN event_id % 6 = 3 THEN 'empty' ELSE 'applied' END AS state
FROM tool_events LEFT JOIN f USING (trajectory) WHERE event_id % 3 = 0""")
def w12_patch_states(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    patches = e.filter("event_id % 3 = 0").select("trajectory", "event_id", F.when(F.col("event_id") % 6 == 3, " ").otherwise("new").alias("new_content"))
    return T.patch_states(e, patches, e.filter("event_id % 9 = 0").select("trajectory", "event_id"))
