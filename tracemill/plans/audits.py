"""Audits of runs, outputs, pairs and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from ..sources.tables import TOOL_EVENTS, table, tool_events
from .registry import query


@query("""WITH r AS (SELECT event_id - event_id % 500 // 499 AS id, user_id * 3 + event_id % 3 AS task_id FROM events WHERE event_id % 400 <> 7), t AS (SELECT DISTINCT user_id * 3 + j AS task_id FROM events, (SELECT unnest(range(3)) AS j) WHERE user_id <> 5), n AS (SELECT task_id, count(*) AS n FROM r GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM r) AS runs, (SELECT count(DISTINCT id) FROM r) AS ids, (SELECT count(*) FROM t) AS tasks, (SELECT count(*) FROM t WHERE task_id NOT IN (SELECT task_id FROM n)) AS not_run, (SELECT count(*) FROM t JOIN n USING (task_id) WHERE n <> 20) AS other_count, (SELECT count(*) FROM r WHERE task_id NOT IN (SELECT task_id FROM t)) AS unknown)
SELECT *, list_filter([CASE WHEN runs <> tasks * 20 THEN 'run count' END, CASE WHEN ids < runs THEN 'duplicate ids' END, CASE WHEN not_run > 0 THEN 'incomplete coverage' END, CASE WHEN unknown > 0 THEN 'unknown tasks' END], lambda x: x IS NOT NULL) AS errors FROM a""")
def q02_result_audit(spark, sf_dir):
    """Q2, Q4: runs against the tasks that were to be run."""
    e = table(spark, sf_dir, "events")
    runs = e.filter("event_id % 400 <> 7").select((F.col("event_id") - F.floor(F.col("event_id") % 500 / 499)).alias("id"), (F.col("user_id") * 3 + F.col("event_id") % 3).alias("task_id"))
    tasks = e.filter("user_id <> 5").select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, range(3)))).alias("j")).select((F.col("user_id") * 3 + F.col("j")).alias("task_id"))
    return A.result_audit(runs, tasks, 20)


@query("""WITH r AS (SELECT p_partkey - p_partkey % 50 // 49 AS id, p_partkey % 9 = 0 AS leak, p_type AS g FROM part), q AS (SELECT * FROM (VALUES ('ECONOMY', 10), ('NOTHING', 1)) v(g, quota))
SELECT 'duplicate id' AS error, id::VARCHAR AS subject FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'private key', id::VARCHAR FROM r WHERE leak UNION ALL SELECT 'quota', g FROM q LEFT JOIN (SELECT g, count(*) AS n FROM r GROUP BY 1) USING (g) WHERE n IS DISTINCT FROM quota""")
def q05_output_audit(spark, sf_dir):
    """Q5, Q18: ids, leaks and quotas."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select((key - F.floor(key % 50 / 49)).alias("id"), F.when(key % 9 == 0, F.array(F.lit("a"), F.lit("gold"))).otherwise(F.array(F.lit("a"))).alias("keys"), F.col("p_type").alias("group"))
    return A.output_audit(rows, ["gold", "reward"], {"ECONOMY": 10, "NOTHING": 1})


@query("""WITH r AS (SELECT o_orderkey // 2 AS pair_id, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 14 = 1 THEN 'safe' ELSE 'policy_breaking' END AS label, CASE WHEN o_orderkey % 10 <> 3 THEN 'r' END AS rule FROM orders WHERE o_orderkey % 34 <> 0),
e AS (SELECT pair_id, list_filter([CASE WHEN count(*) <> 2 THEN 'not two traces' END, CASE WHEN count(DISTINCT label) <> 2 THEN 'labels' END, CASE WHEN bool_or(label = 'policy_breaking' AND rule IS NULL) THEN 'missing rule' END], lambda x: x IS NOT NULL) AS errors FROM r GROUP BY 1) SELECT * FROM e WHERE len(errors) > 0""")
def q14_pair_errors(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 34 <> 0").select(F.floor(key / 2).alias("pair_id"), F.when((key % 2 == 0) | (key % 14 == 1), "safe").otherwise("policy_breaking").alias("label"), F.when(key % 10 != 3, "r").alias("rule"))
    return A.pair_errors(rows)


@query("""SELECT f.v AS family, l.v AS level, count(c_custkey) AS n FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NONE')) f(v) CROSS JOIN (VALUES ('0'), ('1')) l(v) LEFT JOIN customer ON c_mktsegment = f.v AND c_nationkey % 3 = l.v::INT GROUP BY ALL HAVING count(c_custkey) <> 10""")
def q15_cell_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("family"), (F.col("c_nationkey") % 3).cast("string").alias("level"))
    return A.cell_counts(rows, ["family", "level"], {"family": ["BUILDING", "MACHINERY", "NONE"], "level": ["0", "1"]}, 10)


@query("""WITH x AS (SELECT p_partkey // 4 AS trace, 'd' || p_partkey % 4 AS delta, p_partkey AS k FROM part), c AS (SELECT trace, CASE WHEN k % 11 = 0 THEN 'dx' ELSE delta END AS delta, ['consistent', 'not_mentioned', 'contradiction', 'consistent', 'consistent'][k % 5 + 1] AS verdict, [['c1'], [], ['c1'], [], ['c9']][k % 5 + 1] AS evidence FROM x WHERE k % 7 <> 0),
j AS (SELECT coalesce(x.trace, c.trace) AS trace, coalesce(x.delta, c.delta) AS delta, x.trace IS NOT NULL AS wanted, c.trace IS NOT NULL AS there, verdict, evidence FROM x FULL JOIN c ON x.trace = c.trace AND x.delta = c.delta)
SELECT trace, delta, list_filter([CASE WHEN NOT there THEN 'missing' END, CASE WHEN NOT wanted THEN 'invented' END, CASE WHEN verdict = 'contradiction' THEN 'no consent' END, CASE WHEN verdict = 'consistent' AND evidence = [] THEN 'no evidence' END, CASE WHEN evidence = ['c9'] THEN 'no later claim' END], lambda z: z IS NOT NULL) AS errors FROM j""")
def q13_verdict_grounding(spark, sf_dir):
    """Q12, Q13: checks against the changes they are for, and their evidence against later claims."""
    k = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select(F.floor(k / 4).alias("trace"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("delta"), k.alias("k"))
    verdicts, one = F.array(*map(F.lit, ["consistent", "not_mentioned", "contradiction", "consistent", "consistent"])), lambda v: F.array(F.lit(v))
    none, pick = F.expr("cast(array() as array<string>)"), (F.col("k") % 5).cast("int")
    checks = x.filter("k % 7 <> 0").select("trace", F.when(F.col("k") % 11 == 0, "dx").otherwise(F.col("delta")).alias("delta"), F.get(verdicts, pick).alias("verdict"), F.get(F.array(one("c1"), none, one("c1"), none, one("c9")), pick).alias("evidence"))
    claims = x.select("trace", F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("claim"))
    return A.verdict_grounding(x.select("trace", "delta"), checks, claims)


@query("""SELECT p_partkey AS id, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND (p_partkey % 7 <> 0 OR p_partkey % 4 = 0) AS reusable FROM part""")
def q16_reusable(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 2 == 0, "v2").otherwise("v1").alias("version"), F.lit("h").alias("resource_hash"), F.when(k % 3 != 0, "ready_for_human_review").otherwise("failed").alias("status"), (k % 5 != 0).alias("valid"), (k % 7 == 0).alias("needs_replay"),
        F.lit(True).alias("persisted"), F.when(k % 4 == 0, True).alias("replay_passed"), F.lit(True).alias("reconciled"), F.lit(True).alias("verified"),
    )
    return rows.select("id", A.reusable("v2", "h").alias("reusable"))


@query("""SELECT c_custkey AS id, list_filter([CASE WHEN c_mktsegment <> 'BUILDING' THEN 'other domain' END, CASE WHEN c_nationkey IN (1, 2) THEN 'excluded task' END, CASE WHEN c_custkey % 13 = 0 THEN 'reviewed already' END, CASE WHEN c_acctbal < 0 THEN 'too short' END], lambda x: x IS NOT NULL) AS errors FROM customer""")
def q22_seed_errors(spark, sf_dir):
    """Q20-Q23: all reasons why a seed is not eligible."""
    c = table(spark, sf_dir, "customer")
    packets = c.filter("c_custkey % 13 = 0").select("c_custkey", F.lit(True).alias("seen"))
    rules = {"other domain": F.col("c_mktsegment") != "BUILDING", "excluded task": F.col("c_nationkey").isin(1, 2), "reviewed already": F.col("seen").isNotNull(), "too short": F.col("c_acctbal") < 0}
    return c.join(packets, "c_custkey", "left").select(F.col("c_custkey").alias("id"), A.listed(rules).alias("errors"))


@query("""WITH s AS (SELECT user_id % 3 AS d, user_id AS trace, CASE WHEN event_type = 'error' THEN 'BAD' WHEN event_id % 4 = 0 THEN 'OK' ELSE 'GOOD' END AS e, event_id % 2 = 0 AS s FROM events), t AS (SELECT d, trace, count(*) FILTER (e = 'GOOD') / count(*) AS q, count(*) FILTER (e = 'BAD') AS b, count(*) FILTER (e = 'BAD' AND s) AS a FROM s GROUP BY ALL)
SELECT 'd' || d AS domain, count(*) AS traces, round(avg(q), 6) AS avg_quality, sum(b)::BIGINT AS bad_steps, sum(a)::BIGINT AS actionable FROM t GROUP BY d""")
def a38_step_quality(spark, sf_dir):
    i = F.col("event_id")
    steps = table(spark, sf_dir, "events").select(F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("domain"), F.col("user_id").alias("trace"), F.when(F.col("event_type") == "error", "BAD").when(i % 4 == 0, "OK").otherwise("GOOD").alias("evaluation"), F.when(i % 2 == 0, "try again").alias("suggestion"))
    return A.step_quality(steps)


@query(f"""WITH {TOOL_EVENTS} SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN count(tool) > 5 THEN 'unnecessary_tool_use' END, CASE WHEN count(*) FILTER (error) > 0 THEN 'errors' END], lambda x: x IS NOT NULL)) AS label FROM tool_events GROUP BY trajectory) GROUP BY 1""")
def a26_label_histogram(spark, sf_dir):
    labels = A.listed({"unnecessary_tool_use": F.col("calls") > 5, "errors": F.col("errors") > 0})
    each = tool_events(spark, sf_dir).groupBy("trajectory").agg(F.count("tool").alias("calls"), F.count_if("error").alias("errors"))
    return each.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS family, min(o_orderkey) FILTER (o_totalprice > 200000) AS id, arg_min(o_orderpriority, o_orderkey) FILTER (o_totalprice > 200000) AS priority FROM orders GROUP BY 1""")
def t12_first_blocked(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    blocked = F.when(F.col("o_totalprice") > 200000, F.col("o_orderkey"))
    return o.groupBy(F.col("o_orderstatus").alias("family")).agg(F.min(blocked).alias("id"), F.min_by("o_orderpriority", blocked).alias("priority"))


@query("""SELECT task_id, row_number() OVER (ORDER BY n NULLS LAST, task_id) AS position FROM (SELECT *, TRY_CAST(task_id AS INT) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS task_id FROM customer)) ORDER BY n NULLS LAST, task_id LIMIT 50""")
def t02_numeric_aware_order(spark, sf_dir):
    """The first tasks in an order that knows numbers; a global top-k."""
    from pyspark.sql import Window

    key = F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("task_id")).withColumn("n", F.expr("try_cast(task_id as int)"))
    order = [F.col("n").asc_nulls_last(), F.col("task_id")]
    return rows.orderBy(*order).limit(50).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).select("task_id", "position")  # fifty rows


@query("""WITH p AS (SELECT user_id % 3 AS g, user_id AS case_id, bool_or(event_id % 2 = 0 AND event_type = 'error') AS b, bool_or(event_id % 9 = 0 AND event_type = 'click') AS a FROM events GROUP BY ALL) SELECT g, arg_min(case_id, (CASE WHEN b AND NOT a THEN 0 ELSE 1 END, case_id)) AS case_id, bool_or(b AND NOT a) AS cured FROM p GROUP BY 1""")
def z18_changed_case(spark, sf_dir):
    kind, i = F.col("event_type"), F.col("event_id")
    p = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("g"), F.col("user_id").alias("case_id")).agg(F.bool_or((i % 2 == 0) & (kind == "error")).alias("before"), F.bool_or((i % 9 == 0) & (kind == "click")).alias("after"))
    return A.changed_case(p, ["g"])


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'generic' ELSE 'specific' END AS specificity, CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['order record'] ELSE ['max_refund', 'refund'] END AS handles, CASE WHEN event_id % 3 = 2 THEN ['k' || (props->>'$.k')] ELSE [] END AS quoted FROM events""")
def z64_reason_specificity(spark, sf_dir):
    """What a reason names of the evidence."""
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    texts = F.array(F.lit("The records are a summary, maxrefunds are not there"), F.lit("The Order Record is missing"), F.concat(F.lit("max_refund of the refund says "), k, F.lit(".")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get(texts, (F.col("event_id") % 3).cast("int")).alias("reason"), k.alias("k"))
    names = F.array_union(A.identifier_parts(F.lit("Order_record")), F.array(F.lit("max_refund"), F.lit("refund")))
    handles = F.filter(names, lambda n: ~n.isin("order", "record"))
    return A.specificity(rows, handles, F.array("k"))


@query(f"""WITH {TOOL_EVENTS}, s AS (SELECT trajectory AS trace, ordinal AS step, k % 3 AS v FROM tool_events) SELECT trace, step, coalesce(v <> lag(v) OVER (PARTITION BY trace ORDER BY step), false) AS changed FROM s""")
def z56_state_changes(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    state = F.when(F.col("event_id") % 2 == 0, F.format_string('{"a": %s, "b": 1}', (F.col("k") % 3).cast("string"))).otherwise(F.format_string('{"b":1,"a":%s}', (F.col("k") % 3).cast("string")))
    return A.state_changes(e.select(F.col("trajectory").alias("trace"), F.col("ordinal").alias("step"), state.alias("state"))).drop("hash")


@query("""SELECT event_id AS id, protocol, CASE WHEN asked = event_id % 4 THEN CASE asked WHEN 0 THEN event_type WHEN 3 THEN NULL ELSE event_type || ' of ' || user_id END END AS text
FROM (SELECT *, (event_id // 4) % 4 AS asked, ['openai_chat', 'anthropic_messages', 'gemini_generate_content', 'other'][(event_id // 4) % 4 + 1] AS protocol FROM events)""")
def z62_response_text(spark, sf_dir):
    """The text of responses in the form of the protocol that was spoken; those of other forms have none."""
    i, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    parts = F.format_string('[{"text": "%s"}, {"text": 7}, {"kind": "image"}, {"text": " of %s"}]', kind, user)
    forms = [F.format_string('{"choices": [{"message": {"content": "%s"}}]}', kind), F.format_string('{"content": %s}', parts), F.format_string('{"candidates": [{"content": {"parts": %s}}]}', parts), F.format_string('{"text": "%s"}', kind)]
    protocols = F.array(*map(F.lit, [*A.RESPONSES, "other"]))
    e = table(spark, sf_dir, "events").select(i.alias("id"), F.get(protocols, (F.floor(i / 4) % 4).cast("int")).alias("protocol"), F.get(F.array(*forms), (i % 4).cast("int")).alias("r"))
    return e.select("id", "protocol", A.response_text(F.col("r"), F.col("protocol"), strict=False).alias("text"))


@query(f"""WITH {TOOL_EVENTS} SELECT event_id AS id, CASE WHEN tool = 'update' THEN 'unknown tool' WHEN tool = 'calculate' THEN NULL ELSE 'missing id' END AS error FROM tool_events WHERE tool IS NOT NULL""")
def z10_action_errors(spark, sf_dir):
    tools = spark.createDataFrame([("lookup", ["n", "id"]), ("calculate", ["expression"])], "tool string, required array<string>")
    return A.action_errors(tool_events(spark, sf_dir).filter("tool is not null").select(F.col("event_id").alias("id"), "tool", "arguments"), tools)


@query(f"""WITH {TOOL_EVENTS} SELECT trajectory, arg_min(event_id, ordinal) AS event_id FROM tool_events WHERE kind = 'write' AND contains(arguments, 'R-102') GROUP BY 1""")
def z63_first_write_of_entity(spark, sf_dir):
    w = tool_events(spark, sf_dir).filter("kind = 'write'").filter(F.contains("arguments", F.lit("R-102")))
    return w.groupBy("trajectory").agg(F.min_by("event_id", "ordinal").alias("event_id"))


@query(f"""WITH {TOOL_EVENTS}, t AS (SELECT trajectory, min(ordinal) AS t FROM tool_events WHERE kind = 'write' GROUP BY 1) SELECT trajectory, event_id || '#L1' AS claim_id, content AS text FROM tool_events JOIN t USING (trajectory) WHERE kind = 'message' AND role = 'assistant' AND ordinal > t AND content IS NOT NULL""")
def z38_later_claims(spark, sf_dir):
    """Prose of the assistant after the target, as claims by line."""
    e = tool_events(spark, sf_dir)
    first = e.filter("kind = 'write'").groupBy("trajectory").agg(F.min("ordinal").alias("target"))
    prose = e.filter("kind = 'message' and role = 'assistant'").join(first, "trajectory").filter("ordinal > target")
    lines = prose.select("trajectory", "event_id", F.posexplode(F.split("content", r"\r?\n")).alias("i", "line")).filter(F.trim("line") != "")
    return lines.select("trajectory", F.concat(F.col("event_id").cast("string"), F.lit("#L"), (F.col("i") + 1).cast("string")).alias("claim_id"), F.trim("line").alias("text"))


@query("""SELECT policy, metric, round(value, 6) AS value FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS policy, 'mean' AS metric, avg(value) AS value FROM events GROUP BY 1 UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'c' END, 'single', max(value) FROM events GROUP BY 1)""")
def z01_policy_metrics(spark, sf_dir):
    """Metrics of two kinds of runs as one table, nulls left out."""
    e = table(spark, sf_dir, "events")
    many = e.groupBy(F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("policy")).agg(F.avg("value").alias("mean"))
    one = e.groupBy(F.when(F.col("event_id") % 3 == 0, "a").otherwise("c").alias("policy")).agg(F.max("value").alias("single"))
    both = many.unionByName(one, allowMissingColumns=True).unpivot(["policy"], ["mean", "single"], "metric", "value")
    return both.filter("value is not null").withColumn("value", F.round("value", 6))
