"""Seeds, packets, identities and metrics by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import named_metrics as M
from ..operators import packets as P
from ..sources.tables import ATTEMPTS, TOOL_EVENTS, attempts, table, tool_events
from .registry import query

text = lambda c: c.cast("string")


@query(f"""WITH {ATTEMPTS}, s AS (SELECT policy || ':' || task_id AS trace, attempt_number AS index, event_id % 5 <> 0 AS called, event_type AS tool, status, event_id FROM attempts)
SELECT trace, min(index)::INT AS index, arg_min(tool, index) AS tool, arg_min('{{"n":' || event_id || '}}', index) AS arguments, arg_min(status, index) AS status FROM s WHERE called AND status <> 'success' AND event_id % 7 <> 0 GROUP BY 1""")
def z66_failed_steps(spark, sf_dir):
    """The first tool step of a trace that was observed to fail; steps without an observation are none."""
    a, i = attempts(spark, sf_dir), F.col("event_id")
    steps = a.select(F.concat_ws(":", "policy", text(F.col("task_id"))).alias("trace"), F.col("attempt_number").alias("index"), F.when(i % 5 != 0, "tool_call").otherwise("final_answer").alias("action_type"), F.col("event_type").alias("tool"), F.format_string('{"n":%s}', text(i)).alias("arguments"), F.when(i % 7 != 0, F.col("status")).alias("status"))
    return P.first_failed_steps(steps)


@query("""SELECT conv_id AS id, bool_and(length(text) > 20) AND (contains(lower(arg_max(text, turn)), 'the') OR contains(lower(arg_max(text, turn)), 'de')) AND contains(lower(arg_max(text, turn)), lower(arg_min(role, turn)[1])) AS success,
  '[{"role":"system","content":"fix it"},{"role":"user","content":"q' || conv_id || '"}]' AS first_two, 'Tool result: {"status": "timeout", "result": {"n":' || count(*) || '}}' AS last FROM conversations GROUP BY 1""")
def z67_recovery_messages(spark, sf_dir):
    """Success as claims in the last response, and the messages before a recovery."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_and(F.length("text") > 20).alias("ok"), F.max_by("text", "turn").alias("response"), F.substring(F.min_by("role", "turn"), 1, 1).alias("letter"), F.count("*").alias("n"))
    either = F.when(F.contains(F.lower("response"), F.lit("the")), "THE").otherwise("De")
    m = P.recovery_messages("fix it", F.concat(F.lit("q"), text(F.col("conv_id"))), F.lit("{}"), F.lit("timeout"), F.format_string('{"n": %s}', text(F.col("n"))))
    rows = c.select(F.col("conv_id").alias("id"), P.evaluated_success(F.col("ok"), F.array(either, F.upper("letter")), F.col("response")).alias("success"), m.alias("m"))
    return rows.select("id", "success", F.to_json(F.slice("m", 1, 2)).alias("first_two"), F.element_at("m", -1)["content"].alias("last"))


@query("""SELECT o_orderstatus AS domain, count(DISTINCT p) + max((p IS NULL)::INT) AS texts FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'one' WHEN o_orderstatus = 'O' AND o_orderkey % 97 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders) GROUP BY 1 HAVING count(DISTINCT p) + max((p IS NULL)::INT) <> 1""")
def z31_policy_drift(spark, sf_dir):
    status = F.col("o_orderstatus")
    policy = F.when(status == "F", "one").when((status == "O") & (F.col("o_orderkey") % 97 == 0), F.lit(None)).otherwise(F.col("o_orderpriority"))
    return P.policy_drift(table(spark, sf_dir, "orders").select(status.alias("domain"), policy.alias("policy")))


@query("""SELECT id, e[1:12] AS context FROM (SELECT user_id AS id, list_concat(coalesce(list(event_type ORDER BY event_id) FILTER (value > 50), []), list('e' || event_id ORDER BY event_id)) AS e FROM events GROUP BY 1)""")
def z39_rejection_context(spark, sf_dir):
    i = F.col("event_id")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(ordered(F.when(F.col("value") > 50, F.struct(i, F.col("event_type").alias("v")))).alias("a"), ordered(F.struct(i, F.concat(F.lit("e"), text(i)).alias("v"))).alias("b"))  # the events of a user
    return u.select(F.col("user_id").alias("id"), P.rejection_context([F.col("a"), F.lit(None).cast("array<string>"), F.col("b")]).alias("context"))


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY sha256('p' || o_orderkey), o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 NOT IN (3, 7)""")
def z40_review_packet(spark, sf_dir):
    """Ready rows that no packet has, in an order that tells nothing of them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    packet = P.review_packet(o.filter("o_orderstatus = 'F'"), o.filter((F.col("id") % 10).isin(3, 7)), "id", F.sha2(F.concat(F.lit("p"), text(F.col("id"))), 256))
    return packet.select("id", "place")


@query("""WITH p AS (SELECT c_mktsegment AS domain, c_nationkey AS pair_id, count(*) AS n, count(DISTINCT c_custkey % 2) AS labels FROM customer WHERE c_custkey % 30 < 2 GROUP BY ALL) SELECT domain, count(*) FILTER (n = 2 AND labels = 2) AS pairs FROM p GROUP BY 1 HAVING count(*) FILTER (n = 2 AND labels = 2) <> 2""")
def z42_development_pairs(spark, sf_dir):
    key = F.col("c_custkey")
    return P.pair_faults(table(spark, sf_dir, "customer").filter(key % 30 < 2).select(F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").alias("pair_id"), F.when(key % 2 == 0, "safe").otherwise("policy_breaking").alias("label")), 2)


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'BUILDING' ELSE coalesce(c_mktsegment, 'none') END AS domain, o_custkey + CASE WHEN o_orderkey % 40 = 0 THEN 10000000 ELSE 0 END AS trajectory, o_orderkey % 500 AS task_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0),
j AS (SELECT s.domain, task_id, c_mktsegment AS own, c_acctbal > 0 AS safe FROM s LEFT JOIN customer ON trajectory = c_custkey)
SELECT domain, list_filter([CASE WHEN count(*) <> 15 THEN 'row count' END, CASE WHEN count(DISTINCT task_id) < count(*) THEN 'duplicate tasks' END, CASE WHEN count(*) FILTER (own IS NULL) > 0 THEN 'unknown trajectory' END, CASE WHEN count(*) FILTER (own <> domain) > 0 THEN 'other domain' END, CASE WHEN count(*) FILTER (NOT safe) > 0 THEN 'not safe' END], lambda x: x IS NOT NULL) AS errors FROM j GROUP BY 1""")
def z50_seed_errors(spark, sf_dir):
    """Checks of seed sets by domain."""
    o, c = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    own = c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    seeds = o.join(own, "o_custkey", "left").select(F.when(key % 50 == 0, "BUILDING").otherwise(F.coalesce("c_mktsegment", F.lit("none"))).alias("domain"), (F.col("o_custkey") + F.when(key % 40 == 0, 10000000).otherwise(0)).alias("trajectory"), (key % 500).alias("task_id"))
    return P.seed_errors(seeds, c.select(F.col("c_custkey").alias("trajectory"), F.col("c_mktsegment").alias("domain"), (F.col("c_acctbal") > 0).alias("safe")), 15)


@query("""WITH h AS (SELECT DISTINCT sha256((o_custkey)::VARCHAR) AS h FROM orders), p AS (SELECT substr(h, 1, 3) AS part, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS s FROM h GROUP BY 1)
SELECT sum(n)::BIGINT AS keys, sha256(string_agg(part || ':' || s::VARCHAR, ',' ORDER BY part)) AS hash FROM p""")
def z34_seed_set_hash(spark, sf_dir):
    return P.set_hash(table(spark, sf_dir, "orders"), "o_custkey")


@query("""SELECT event_id AS id, 'request_' || substr(sha256('{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user_id":' || user_id || '}'), 1, 24) AS request_id FROM events""")
def z61_request_ids(spark, sf_dir):
    """Identities over all that a request says."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), P.request_id("user_id", "event_type", "props").alias("request_id"))


@query(f"""WITH {TOOL_EVENTS} SELECT event_id AS id, CASE WHEN tool = 'calculate' THEN list_sort(list_distinct([(k % 5) || ' + 1.5 * x2', '#w' || k])) ELSE list_sort(list_distinct(['r-10' || k % 4, '#w' || k])) END AS entities FROM tool_events WHERE tool IS NOT NULL AND k > 9""")
def f33_entity_values(spark, sf_dir):
    """Values of arguments and results that name an entity."""
    e = tool_events(spark, sf_dir).filter("tool is not null and k > 9")
    return e.select(F.col("event_id").alias("id"), P.entity_values(F.format_string('{"arguments": %s, "more": [" #W%s ", "word", {"n": 12345}]}', F.col("arguments"), text(F.col("k")))).alias("entities"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN [p_type] WHEN p_partkey % 3 = 1 THEN [p_brand, p_type] ELSE [] END AS names FROM part""")
def z72_tool_names(spark, sf_dir):
    by = F.col("p_partkey") % 3
    both = F.format_string('[{"type": "function", "function": {"name": "%s"}}, 5, {"name": "%s"}, {"function": {}}, {"name": ""}]', F.col("p_brand"), F.col("p_type"))
    forms = F.when(by == 0, F.format_string('[{"name": "%s", "parameters": {}}]', F.col("p_type"))).when(by == 1, both).otherwise(F.lit('{"name": "no list"}'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), P.tool_names(forms).alias("names"))


@query("""WITH m AS (SELECT p_brand || p_size AS model, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_type END AS provider, p_retailprice - 905 AS price, p_size - 1 AS tokens FROM part),
e AS (SELECT model, count(*) > 1 AS a, bool_or(provider = '') AS b, min(price) < 0 AS c, min(tokens) <= 0 AS d FROM m GROUP BY 1)
SELECT model, list_filter([CASE WHEN a THEN 'duplicate' END, CASE WHEN b THEN 'incomplete' END, CASE WHEN c THEN 'negative price' END, CASE WHEN d THEN 'no tokens' END], lambda x: x IS NOT NULL) AS errors FROM e WHERE a OR b OR c OR d""")
def q24_registry_errors(spark, sf_dir):
    """Q24: entries of a model registry that are wrong."""
    p = table(spark, sf_dir, "part")
    return P.registry_errors(p.select(F.concat("p_brand", text(F.col("p_size"))).alias("model"), F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.col("p_type")).alias("provider"), F.lit("chat").alias("protocol"), (F.col("p_retailprice") - 905).alias("price_in"), F.lit(1.0).alias("price_out"), (F.col("p_size") - 1).alias("max_tokens")))


@query("""WITH f AS (SELECT conv_id AS trace, string_agg(role, ',' ORDER BY turn) AS e FROM conversations GROUP BY 1), s AS (SELECT trace, 's' || length(e) AS e FROM f WHERE trace % 3 <> 0), r AS (SELECT trace, '+r' || trace AS e FROM f WHERE trace % 2 = 0)
SELECT trace, 'full' AS view_type, e AS evidence FROM f UNION ALL SELECT trace, 'summary', e FROM s UNION ALL SELECT trace, 'summary_receipt', s.e || coalesce(r.e, '') FROM s LEFT JOIN r USING (trace)""")
def z51_monitor_views(spark, sf_dir):
    turn = F.struct("turn", "role")
    f = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("trace")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["role"]), ",").alias("evidence"))  # the turns of one conversation
    s = f.filter("trace % 3 <> 0").withColumn("evidence", F.concat(F.lit("s"), text(F.length("evidence"))))
    return P.monitor_views(f, s, f.filter("trace % 2 = 0").withColumn("evidence", F.concat(F.lit("+r"), text(F.col("trace")))))


@query(f"""WITH {TOOL_EVENTS}, t AS (SELECT trajectory, min(ordinal) AS target FROM tool_events WHERE kind = 'write' GROUP BY 1)
SELECT trajectory, 'd' || trajectory % 3 AS domain, list(event_id ORDER BY ordinal) AS event_ids, CASE trajectory % 3 WHEN 0 THEN ['r0', 'r3'] WHEN 1 THEN ['r1'] ELSE [] END AS rules, coalesce(list(event_id ORDER BY ordinal) FILTER (tool = 'calculate' AND ordinal > target), []) AS later_calculator_ids FROM tool_events JOIN t USING (trajectory) GROUP BY trajectory""")
def z35_seed_packets(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    targets = e.filter("kind = 'write'").groupBy("trajectory").agg(F.min("ordinal").alias("target")).withColumn("domain", F.concat(F.lit("d"), text(F.col("trajectory") % 3)))
    rules = spark.createDataFrame([("d0", "r3"), ("d0", "r0"), ("d1", "r1")], "domain string, rule string")
    return P.seed_packets(e, targets, rules, ["calculate"])


@query("""WITH d AS (SELECT l_returnflag AS decision, l_linestatus AS cohort, l_orderkey AS trace, l_shipdate::VARCHAR AS text FROM lineitem) SELECT decision, cohort, count(*) AS rows, count(DISTINCT trace) AS traces, count(DISTINCT sha256(text)) AS texts FROM d GROUP BY ALL""")
def z60_outcome_counts(spark, sf_dir):
    """Counts of a prepared data set, or of a baseline's decisions."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("decision"), F.col("l_linestatus").alias("cohort"), F.col("l_orderkey").alias("trace"), text(F.col("l_shipdate")).alias("text"))
    return P.outcome_counts(rows, ["decision", "cohort"])


@query("""SELECT 'split ' || CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS name, NULL AS domain, count(*)::INT AS n FROM customer GROUP BY 1 UNION ALL SELECT 'task ' || c_custkey, c_mktsegment, c_nationkey % 4 FROM customer""")
def s15_task_manifest(spark, sf_dir):
    key = F.col("c_custkey")
    claims = F.when(F.col("c_nationkey") % 4 == 0, F.lit(None).cast("array<string>")).otherwise(F.array_repeat(F.lit("c"), (F.col("c_nationkey") % 4).cast("int")))
    tasks = table(spark, sf_dir, "customer").select(key.alias("task_id"), F.col("c_mktsegment").alias("domain"), F.lit("x").alias("category"), F.when(key % 5 == 0, "test").otherwise("train").alias("split"), F.array(F.lit("t")).alias("tools"), claims.alias("claims"))
    splits, each = P.split_manifest(tasks)
    return splits.select(F.concat(F.lit("split "), "split").alias("name"), F.lit(None).cast("string").alias("domain"), F.col("tasks").cast("int").alias("n")).unionByName(each.select(F.concat(F.lit("task "), text(F.col("task_id"))).alias("name"), "domain", F.col("num_claims").alias("n")))


@query(f"""WITH {ATTEMPTS}, o AS (SELECT *, row_number() OVER (PARTITION BY policy, user_id ORDER BY event_id) AS ordinal, row_number() OVER (PARTITION BY policy, user_id, status = 'success' ORDER BY event_id) AS same FROM attempts),
s AS (SELECT policy, user_id, max(n) AS longest FROM (SELECT policy, user_id, ordinal - same AS run, count(*) AS n FROM o WHERE status <> 'success' GROUP BY ALL) GROUP BY ALL)
SELECT policy, user_id, count(*) AS runs, coalesce(any_value(longest), 0) AS longest_failure_streak, round(avg((status = 'success')::INT), 6) AS success_rate, list_sort(list_distinct(list(status))) AS statuses FROM o LEFT JOIN s USING (policy, user_id) GROUP BY ALL""")
def x07_metrics_by_name(spark, sf_dir):
    """Metrics that a configuration names, aggregates and functions of whole groups."""
    rows = attempts(spark, sf_dir).withColumn("ordinal", F.col("event_id"))
    return M.metrics(rows, ["policy", "user_id"], ["runs", "longest_failure_streak", "success_rate", "statuses"])
