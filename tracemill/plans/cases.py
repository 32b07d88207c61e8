"""Cases, seeds and audits of what was made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import training as T
from ..sources.tables import ATTEMPTS, attempts, table
from .registry import query
from .training import HAZARDS

text = lambda c: c.cast("string")


@query(f"""WITH {ATTEMPTS}, r AS (SELECT policy, task_id, list(event_type ORDER BY attempt_number) AS tools FROM attempts GROUP BY ALL),
c AS (SELECT DISTINCT task_id, CASE WHEN task_id % 5 = 0 THEN '' ELSE 'view' END AS f, CASE WHEN task_id % 3 = 0 THEN ['view', 'click'] WHEN task_id % 3 = 1 THEN ['view'] ELSE [] END AS s FROM attempts WHERE task_id % 4 <> 0)
SELECT policy, task_id, f AS expected_first, tools[1] AS called_first, s AS expected_sequence, tools[1:greatest(len(s), 1)] AS called_prefix FROM r JOIN c USING (task_id) WHERE NOT (f <> '' AND tools[1] = f AND len(s) > 0 AND tools[1:len(s)] = s)""")
def j01_case_mismatches(spark, sf_dir):
    """Runs held against the cases of their tasks, of which the last line counts."""
    a = attempts(spark, sf_dir)
    runs = a.groupBy("policy", "task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt_number", "event_type"))), lambda x: x["event_type"]).alias("tools"))  # the attempts of one task
    t, seq = F.col("task_id"), lambda *names: F.array(*map(F.lit, names))
    expected = F.when(t % 3 == 0, seq("view", "", "click")).when(t % 3 == 1, seq("view"))
    cases = a.select("task_id").distinct().filter(t % 4 != 0).select("task_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("line")).withColumn("expected_first", F.when(F.col("line") == 1, "old").when(t % 5 != 0, "view")).withColumn("expected_sequence", F.when(F.col("line") == 2, expected))
    return C.case_mismatches(runs, cases)


@query("""WITH n AS (SELECT o_orderstatus AS policy, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"note":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || '}', ',' ORDER BY o_orderkey) || ']' AS d FROM orders GROUP BY 1) SELECT policy, sha256(d) AS document FROM n""")
def z03_nested_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("policy"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("note"))
    return C.nested_results(o, ["policy"], ["o_orderkey"]).withColumn("document", F.sha2("document", 256))


@query("""SELECT p_partkey AS id, 0 AS place, 'tool_call' AS type, p_brand AS name, '{"k":' || p_partkey || ',"n":' || p_size || '}' AS arguments, NULL AS text FROM part UNION ALL SELECT p_partkey, 1, 'clarify', NULL, NULL, p_name FROM part
UNION ALL SELECT p_partkey, 2, 'final_answer', NULL, NULL, '' FROM part UNION ALL SELECT p_partkey, 3, 'abort', NULL, NULL, p_type FROM part""")
def z11_oracle_actions(spark, sf_dir):
    """Actions of a list of texts, objects and lists."""
    p = table(spark, sf_dir, "part")
    raw = F.format_string('[{"type": "call", "n": %s, "name": "%s", "k": %s}, ["%s", ["FINAL", {"type": "other"}, 5]], {"type": "abort", "reason": "%s"}]', text(F.col("p_size")), F.col("p_brand"), text(F.col("p_partkey")), F.col("p_name"), F.col("p_type"))
    return p.select(F.col("p_partkey").alias("id"), F.posexplode(C.actions(raw)).alias("place", "a")).select("id", "place", "a.*")


@query("""SELECT c_custkey AS id, c_custkey AS seed, 3 AS max_attempts, c_acctbal::DOUBLE AS price, CASE WHEN c_custkey % 2 = 0 THEN ['timeout', 'rate_limit', 'network_failure'] ELSE [c_mktsegment] END AS retryable, CASE WHEN c_custkey % 3 = 0 THEN '{"a":{"b":1}}' ELSE '{}' END AS overrides FROM customer""")
def s03_run_config(spark, sf_dir):
    key = F.col("c_custkey")
    more = F.concat(F.when(key % 2 == 0, "").otherwise(F.format_string(', "retryable_faults": ["%s"]', F.col("c_mktsegment"))), F.when(key % 3 == 0, ', "policy_overrides": {"a": {"b": 1}}').otherwise(""))
    raw = F.format_string('{"seed": %s, "max_attempts": "3", "default_timeout_ms": 1, "time_budget_ms": 2, "base_backoff_ms": 3, "backoff_jitter_ms": 4, "policies": ["x"], "cost": {"base_per_call_usd": %s, "per_ms_usd": 0.5}%s}', text(key), text(F.col("c_acctbal")), more)
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), C.run_config(raw).alias("c"))
    return rows.select("id", F.col("c.seed"), F.col("c.max_attempts"), F.col("c.base_per_call_usd").alias("price"), F.col("c.retryable_faults").alias("retryable"), F.col("c.policy_overrides").alias("overrides"))


@query("""SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS label FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def z32_reviewed_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return C.reviewed_labels(o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("final_label")))


@query("""SELECT o_orderkey::VARCHAR AS case_id, c_mktsegment AS domain, o_orderstatus AS family, 'reserve' AS case_role, c_custkey AS trajectory, CASE WHEN o_orderstatus = 'F' THEN c_mktsegment || '-rule' END AS rule, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END AS least FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0""")
def z45_enriched_seeds(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0"), table(spark, sf_dir, "customer")
    traces = c.select(F.col("c_custkey").alias("trajectory"), F.col("c_mktsegment").alias("domain"), F.array(F.lit("e")).alias("events"))
    cases = o.select(text(F.col("o_orderkey")).alias("case_id"), F.col("o_custkey").alias("trajectory"), F.col("o_orderstatus").alias("family")).join(traces.select("trajectory"), "trajectory", "left_semi")
    rules = F.map_from_entries(F.collect_set(F.struct("c_mktsegment", F.concat("c_mktsegment", F.lit("-rule")))))
    families = c.agg(rules.alias("rules")).select(F.explode(F.array(*map(F.lit, "FOP"))).alias("family"), F.when(F.col("family") == "F", F.col("rules")).alias("allowed_target_rules"), F.when(F.col("family") == "F", 3).alias("min_source_writes"), F.lit(None).cast("int").alias("min_target_write_rank"))
    return C.enriched_seeds(cases, traces, families, "reserve").select("case_id", "domain", "family", "case_role", "trajectory", F.col("allowed_target_rules").alias("rule"), F.col("min_source_writes").alias("least"))


@query("""WITH r AS (SELECT o_custkey AS t, arg_max({'k': o_orderkey, 's': o_orderstatus}, o_orderkey) AS x FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 GROUP BY 1), e AS (SELECT t, x.k AS k, x.s AS s FROM r)
SELECT t::VARCHAR AS subject, unnest(list_concat(list_filter([CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'stale pipeline code hash' END, CASE WHEN k % 11 = 0 THEN 'stale pipeline resource hash' END, CASE WHEN s <> 'F' THEN 'status=' || s END, CASE WHEN k % 13 = 0 THEN 'baseline source fidelity did not pass' END], lambda x: x IS NOT NULL), CASE WHEN k % 4 = 0 THEN ['e' || k] ELSE [] END)) AS error FROM e
UNION ALL SELECT c_custkey::VARCHAR, 'no row of this version' FROM customer WHERE c_custkey NOT IN (SELECT t FROM r)""")
def q17_pilot_audit(spark, sf_dir):
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").alias("trajectory"), k.alias("line"), F.when(k % 3 == 0, "v1").otherwise("v2").alias("version"), F.when(k % 7 == 0, "old").otherwise("c").alias("config_hash"), F.when(k % 2 == 0, "other").otherwise("p").alias("code_hash"), F.when(k % 11 != 0, "r").alias("resource_hash"),
        F.when(F.col("o_orderstatus") == "F", "ready_for_human_review").otherwise(F.col("o_orderstatus")).alias("status"), (k % 5 == 0).alias("reusable"), (k % 4 != 0).alias("valid"), F.array(F.concat(F.lit("e"), text(k))).alias("errors"), (k % 13 != 0).alias("faithful"), F.lit(True).alias("dependencies_ok"), F.lit(True).alias("semantic_ok"),
    )
    return C.pilot_audit(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trajectory")), "v2", {"config": "c", "code": "p", "resource": "r"})


@query("""SELECT o_orderstatus AS domain, o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'gone' WHEN o_orderkey % 10 = 0 THEN 'new' ELSE 'changed' END AS difference FROM orders WHERE (o_orderkey % 9 = 0) <> (o_orderkey % 10 = 0) OR (o_orderkey % 9 <> 0 AND o_orderkey % 4 = 1)""")
def q02_embedded_tasks(spark, sf_dir):
    """Q2, Q4: tasks that result files carry against the current ones, without what doesn't count."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    task = lambda n, more: F.format_string('{"goal": {"n": %s, "extra": null}, "id": %s%s}', text(n), text(k), more)
    rows = lambda df, t: df.select(F.col("o_orderstatus").alias("domain"), k.alias("id"), t.alias("task"))
    embedded = rows(o.filter(k % 9 != 0), task(F.col("o_custkey"), F.lit(', "ticket": "x"')))
    current = rows(o.filter(k % 10 != 0), task(F.col("o_custkey") + F.when(k % 4 == 1, 1).otherwise(0), F.lit("")))
    return C.embedded_differences(embedded, current, ("ticket", "annotations"))


@query(f"""WITH t AS (SELECT c_custkey AS task_id, [CASE WHEN c_custkey % 3 = 0 THEN 'answer' ELSE 'tool_call' END, 'tool_call', 'answer'] AS a, c_nationkey AS n FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT *, list_filter([0, 1, 2], lambda i: a[i + 1] = 'tool_call') AS calls FROM t),
s AS (SELECT task_id, n, f.range::INT AS fault, {HAZARDS}[f.range % 5 + 1] AS hazard, calls[f.range % len(calls) + 1]::INT AS step FROM c, range(3) f)
SELECT task_id, fault, hazard, step AS fault_step, 't' || (n + step) AS failed_tool, '{{"tool_call":{{"arguments":{{"a":' || step || ',"b":' || n || '}},"name":"t' || (n + step) || '"}}}}' AS chosen, '{{"final_answer":"{C.GIVEN_UP}"}}' AS rejected FROM s""")
def f42_recovery_rows(spark, sf_dir):
    """rows that teach a recovery, from the oracle's steps and the schedule of faults."""
    key, n = F.col("c_custkey"), F.col("c_nationkey")
    step = lambda a, i: F.struct(F.lit(i).alias("index"), a.alias("action"), F.concat(F.lit("t"), text(n + i)).alias("tool"), F.format_string('{"b": %s, "a": %s}', text(n), F.lit(str(i))).alias("arguments"))
    steps = F.array(step(F.when(key % 3 == 0, "answer").otherwise("tool_call"), 0), step(F.lit("tool_call"), 1), step(F.lit("answer"), 2))
    t = table(spark, sf_dir, "customer").select(key.alias("task_id"), F.when(key % 2 == 0, "tool_required").otherwise("no_tool").alias("category"), steps.alias("steps"))
    return C.recovery_rows(T.fault_schedule(t, HAZARDS, 3), t.select("task_id", F.inline("steps")))


@query("""WITH r AS (SELECT o_orderkey % 9000 AS id, o_orderstatus AS domain, o_custkey % 50 AS task_id FROM orders WHERE o_orderkey % 11 = 0), f AS (SELECT o_orderkey AS id, o_orderstatus AS domain, o_custkey % 700 AS task_id FROM orders WHERE o_orderkey % 77 = 0),
e(domain, expected) AS (VALUES ('F', 10), ('X', 1))
SELECT 'row count' AS error, domain AS subject FROM (SELECT domain, count(*) AS n FROM r GROUP BY 1) FULL JOIN e USING (domain) WHERE coalesce(n, 0) <> coalesce(expected, 0) UNION ALL SELECT 'duplicate id', id::VARCHAR FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'frozen id', id::VARCHAR FROM r WHERE id IN (SELECT id FROM f) UNION ALL SELECT DISTINCT 'frozen task', domain || ':' || task_id FROM r WHERE (domain, task_id) IN (SELECT (domain, task_id) FROM f)""")
def q18_frozen_errors(spark, sf_dir):
    """A set that is to be frozen, held against its quotas and against what is frozen."""
    o = table(spark, sf_dir, "orders")
    of = lambda rows, key, task: rows.select(key.alias("id"), F.col("o_orderstatus").alias("domain"), task.alias("task_id"))
    rows = of(o.filter("o_orderkey % 11 = 0"), F.col("o_orderkey") % 9000, F.col("o_custkey") % 50)
    return C.frozen_errors(rows, of(o.filter("o_orderkey % 77 = 0"), F.col("o_orderkey"), F.col("o_custkey") % 700), {"F": 10, "X": 1})


@query("""WITH r AS (SELECT o_custkey AS case_id FROM orders WHERE o_orderkey % 9 = 0), e AS (SELECT c_custkey AS case_id FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT case_id, count(*) AS n FROM r GROUP BY 1)
SELECT case_id, CASE WHEN n IS NULL THEN 'missing' WHEN case_id % 2 <> 0 OR case_id NOT IN (SELECT case_id FROM e) THEN 'unexpected' ELSE 'twice' END AS error FROM n FULL JOIN e USING (case_id) WHERE n IS NULL OR n > 1 OR case_id NOT IN (SELECT case_id FROM e)""")
def q21_registration_errors(spark, sf_dir):
    registered = table(spark, sf_dir, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("case_id"))
    return C.registration_errors(registered, table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("case_id")), "case_id")


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderstatus AS domain, 'f' || o_custkey % 3 AS family, o_custkey % 25 AS task_id, o_orderkey % 17 AS score FROM orders), l AS (SELECT l_orderkey AS id, l_linenumber AS line, max(l_quantity) AS q FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL), v AS (SELECT id, arg_max(q > 20, line) AS accepted FROM l GROUP BY 1),
b AS (SELECT domain, family, task_id, score, id, row_number() OVER (PARTITION BY domain, family, task_id ORDER BY score DESC, id) AS r FROM p JOIN v USING (id) WHERE accepted)
SELECT domain, family, task_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain, family ORDER BY score DESC, id) AS rank FROM b WHERE r = 1) WHERE rank <= 4""")
def q23_reviewed_selection(spark, sf_dir):
    """Q20, Q23: packets, the last review of each, and what is selected of those that it accepts."""
    o, line = table(spark, sf_dir, "orders"), F.col("l_linenumber")
    packets = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("domain"), F.concat(F.lit("f"), text(F.col("o_custkey") % 3)).alias("family"), (F.col("o_custkey") % 25).alias("task_id"), (F.col("o_orderkey") % 17).alias("score"))
    reviews = table(spark, sf_dir, "lineitem").filter(line % 2 == 1).groupBy(F.col("l_orderkey").alias("id"), line.alias("line")).agg(F.max("l_quantity").alias("q")).select("id", "line", (F.col("q") > 20).alias("accepted"))
    return C.reviewed_selection(packets, reviews.join(packets.select("id"), "id", "left_semi"), 4)
