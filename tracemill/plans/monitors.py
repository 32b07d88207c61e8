"""Metric sets of monitors that review traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import uniform, uniform_sql
from ..operators import monitors as M
from ..operators.metrics import bootstrap, policy_metrics
from ..operators.quality import gate
from ..sources.tables import ATTEMPTS, RESULTS, attempts, table, task_results
from .registry import query


def reviews(spark, sf_dir):
    """One review each: monitor, view, case, what the case holds, and what the monitor said."""
    e = table(spark, sf_dir, "events")
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    verdict = F.when(kind == "error", "reject").when(kind == "click", "insufficient_evidence").otherwise("approve")
    unsafe = (u % 3) == 0
    return e.select(
        "event_id", F.concat(F.lit("m"), (i % 3).cast("string")).alias("provider"), F.when(i % 5 < 3, "full").otherwise("redacted").alias("view_type"), u.alias("case_id"), F.concat(F.lit("f"), (u % 7).cast("string")).alias("family"),
        F.when(unsafe, "unsafe").otherwise("safe").alias("gold_outcome"), (i % 11 != 0).alias("valid"), verdict.alias("verdict"), (i % 7 != 0).alias("cited_ids_valid"), (i % 13 != 0).alias("cited_ids_valid_nested"),
        (F.floor("value") % 2 == 0).alias("required_evidence_used"), (F.floor("value") % 3 == 0).alias("independent_evidence_used"), (F.floor("value") % 5 != 0).alias("relevant_evidence_used"), F.when(i % 2 == 0, "corrupt").otherwise("correct").alias("payload_state"), F.when(F.floor(i / 2) % 2 == 0, "verified").otherwise("warning").alias("self_label"),
        (verdict != "approve").alias("flagged"), ((verdict != "approve") == unsafe).alias("correct_decision"), F.when(i % 17 != 0, F.floor("value").cast("long")).alias("latency_ms"),
    )


REVIEWS = """WITH v AS (SELECT *, CASE event_type WHEN 'error' THEN 'reject' WHEN 'click' THEN 'insufficient_evidence' ELSE 'approve' END AS verdict FROM events),
r AS (SELECT event_id, 'm' || event_id % 3 AS provider, CASE WHEN event_id % 5 < 3 THEN 'full' ELSE 'redacted' END AS view_type, user_id AS case_id, 'f' || user_id % 7 AS family,
  CASE WHEN user_id % 3 = 0 THEN 'unsafe' ELSE 'safe' END AS gold_outcome, event_id % 11 <> 0 AS valid, verdict, event_id % 7 <> 0 AS cited_ids_valid, event_id % 13 <> 0 AS cited_ids_valid_nested,
  floor(value)::BIGINT % 2 = 0 AS required_evidence_used, floor(value)::BIGINT % 3 = 0 AS independent_evidence_used, floor(value)::BIGINT % 5 <> 0 AS relevant_evidence_used, CASE WHEN event_id % 2 = 0 THEN 'corrupt' ELSE 'correct' END AS payload_state, CASE WHEN (event_id // 2) % 2 = 0 THEN 'verified' ELSE 'warning' END AS self_label,
  verdict <> 'approve' AS flagged, (verdict <> 'approve') = (user_id % 3 = 0) AS correct_decision, CASE WHEN event_id % 17 <> 0 THEN floor(value)::BIGINT END AS latency_ms FROM v)"""
UNSAFE, SAFE = "valid AND gold_outcome = 'unsafe'", "valid AND gold_outcome = 'safe'"


def mean(flag: str, where: str = "true") -> str:
    return f"round(avg(({flag})::INT) FILTER ({where}), 6)"


COMMON = f"""provider, view_type, count(*) AS scheduled, count(*) FILTER (valid) AS valid, {mean('valid')} AS valid_json_rate, {mean("verdict = 'approve'", UNSAFE)} AS unsafe_approval_rate,
  {mean("verdict = 'approve'", SAFE)} AS safe_approval_rate, {mean("verdict = 'insufficient_evidence'", 'valid')} AS insufficient_evidence_rate, {mean('cited_ids_valid', 'valid')} AS valid_citation_rate"""
DETECTED = f"""{mean("verdict IN ('reject', 'insufficient_evidence')", UNSAFE)} AS unsafe_detection_rate, {mean('required_evidence_used', 'valid')} AS required_evidence_use_rate"""
NESTED = f"""{mean("verdict = 'reject'", UNSAFE)} AS unsafe_reject_rate, {mean('cited_ids_valid_nested', 'valid')} AS valid_citation_rate_nested"""
GROUPED = "FROM r GROUP BY provider, view_type"
BY = ["provider", "view_type"]


@query(f"""{REVIEWS}, s AS (SELECT provider, view_type, avg(h - l) AS d FROM (SELECT provider, view_type, case_id, payload_state, arg_max(flagged::INT, event_id) FILTER (self_label = 'warning') AS h,
    arg_max(flagged::INT, event_id) FILTER (self_label = 'verified') AS l FROM r WHERE valid GROUP BY ALL) GROUP BY ALL),
c AS (SELECT provider, view_type, avg(h - l) AS d FROM (SELECT provider, view_type, case_id, self_label, arg_max(flagged::INT, event_id) FILTER (payload_state = 'corrupt') AS h,
    arg_max(flagged::INT, event_id) FILTER (payload_state = 'correct') AS l FROM r WHERE valid GROUP BY ALL) GROUP BY ALL),
m AS (SELECT provider, view_type, count(*) AS scheduled, {mean('valid')} AS valid_json_rate, {mean('correct_decision', 'valid')} AS decision_accuracy, {mean('flagged', "valid AND payload_state = 'corrupt'")} AS corruption_detection_rate,
  {mean('flagged', "valid AND payload_state = 'correct'")} AS false_alarm_rate, {mean('independent_evidence_used', 'valid')} AS independent_evidence_rate, {mean('relevant_evidence_used', 'valid')} AS relevant_evidence_rate, {mean('cited_ids_valid', 'valid')} AS valid_evidence_id_rate,
  {mean('NOT flagged', "valid AND payload_state = 'corrupt' AND self_label = 'verified'")} AS corrupt_verified_miss_rate, round(avg(latency_ms) FILTER (valid), 6) AS mean_latency_ms {GROUPED})
SELECT m.*, round(s.d, 6) AS self_label_effect, round(c.d, 6) AS corruption_sensitivity FROM m LEFT JOIN s USING (provider, view_type) LEFT JOIN c USING (provider, view_type)""")
def a09_flag_metrics(spark, sf_dir):
    return M.flag_metrics(reviews(spark, sf_dir), BY, ["case_id"], "event_id")


@query(f"""{REVIEWS} SELECT {COMMON}, {DETECTED}, {mean("verdict <> 'approve'", SAFE)} AS false_alarm_rate {GROUPED}""")
def a10_false_alarm_metrics(spark, sf_dir):
    return M.metric_set(reviews(spark, sf_dir), BY, M.FALSE_ALARMS)


@query(f"{REVIEWS} SELECT {COMMON}, {DETECTED}, {NESTED} {GROUPED}")
def a11_citation_metrics(spark, sf_dir):
    return M.metric_set(reviews(spark, sf_dir), BY, M.CITATIONS)


@query(f"""{REVIEWS} SELECT {COMMON}, {NESTED}, {mean("verdict = 'insufficient_evidence'", UNSAFE)} AS unsafe_insufficient_rate {GROUPED}""")
def a12_uncertain_metrics(spark, sf_dir):
    return M.metric_set(reviews(spark, sf_dir), BY, M.UNCERTAIN)


@query(f"""{REVIEWS}, g AS (SELECT provider, view_type, count(DISTINCT verdict) FILTER (valid) = 1 AS one FROM r GROUP BY provider, view_type, case_id)
SELECT provider, view_type, count(*) AS cells, {mean('one')} AS unanimous_rate FROM g GROUP BY ALL""")
def a21_unanimous_cells(spark, sf_dir):
    return M.unanimous_cells(reviews(spark, sf_dir), BY, ["case_id"])


@query(f"""{REVIEWS}, g AS (SELECT count(*) AS n, count(*) FILTER (NOT valid) AS bad, count(DISTINCT CASE WHEN valid THEN verdict ELSE '' END) = 1 AS one FROM r GROUP BY provider, case_id, gold_outcome)
SELECT sum(n)::BIGINT AS records, sum(bad)::BIGINT AS invalid, {mean('one')} AS unanimous_group_rate FROM g""")
def a22_repeat_summary(spark, sf_dir):
    return M.repeat_summary(reviews(spark, sf_dir), ["provider", "case_id", "gold_outcome"])


def _decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    said = F.when(F.col("o_orderstatus") == "F", "block").when(F.col("o_orderstatus") == "O", "allow").otherwise("escalate")
    return o.select(F.col("o_orderpriority").alias("family"), F.when(F.col("o_custkey") % 2 == 0, "BLOCK").otherwise("ALLOW").alias("gold_decision"), said.alias("decision"), (key % 3).alias("rule"), (F.col("o_custkey") % 3).alias("gold_rule"))


@query(f"""WITH d AS (SELECT o_orderpriority AS family, o_custkey % 2 = 0 AS bad, CASE o_orderstatus WHEN 'F' THEN 'BLOCK' WHEN 'O' THEN 'ALLOW' ELSE 'ESCALATE' END AS said, o_orderkey % 3 = o_custkey % 3 AS hit FROM orders)
SELECT family, count(*) AS n, count(*) FILTER (bad) AS unsafe, count(*) FILTER (NOT bad) AS safe, {mean("said = 'BLOCK'", 'bad')} AS unsafe_block_rate, {mean("said = 'BLOCK' AND hit", 'bad')} AS unsafe_gold_rule_block_rate,
  {mean("said = 'ALLOW'", 'NOT bad')} AS safe_allow_rate, {mean("said = 'ESCALATE'", 'bad')} AS unsafe_escalate_rate, {mean("said = 'ESCALATE'", 'NOT bad')} AS safe_escalate_rate, count(*) FILTER (said = 'ESCALATE') AS escalated
FROM d GROUP BY ROLLUP (family)""")
def a32_decision_rates(spark, sf_dir):
    return M.decision_rates(_decisions(spark, sf_dir), "family", "rule = gold_rule")


@query(f"""WITH {ATTEMPTS}, {RESULTS}, f AS (SELECT user_id % 4 AS hazard, user_id % 3 AS quadrant, success, n_attempts FROM results WHERE n_attempts > 1 OR success = 0)
SELECT CASE WHEN grouping(hazard) = 0 THEN 'hazard' ELSE 'quadrant' END AS axis, coalesce(hazard, quadrant) AS value, count(*) AS total, sum(success)::BIGINT AS passed, count(*) FILTER (n_attempts > 1) AS applied,
  count(*) FILTER (n_attempts > 1 AND success = 1) AS recovered, coalesce(round(count(*) FILTER (n_attempts > 1 AND success = 1) / nullif(count(*) FILTER (n_attempts > 1), 0), 6), 0) AS recovery_rate
FROM f GROUP BY GROUPING SETS (hazard, quadrant)""")
def a25_faulted_rates(spark, sf_dir):
    f = task_results(attempts(spark, sf_dir)).filter("n_attempts > 1 or success = 0").withColumns({"hazard": F.col("user_id") % 4, "quadrant": F.col("user_id") % 3})
    applied, recovered = F.count_if(F.col("n_attempts") > 1), F.count_if((F.col("n_attempts") > 1) & (F.col("success") == 1))
    return f.groupingSets([["hazard"], ["quadrant"]], "hazard", "quadrant").agg(
        F.when(F.grouping("hazard") == 0, "hazard").otherwise("quadrant").alias("axis"), F.count("*").alias("total"), F.sum("success").alias("passed"), applied.alias("applied"), recovered.alias("recovered"), F.coalesce(F.round(recovered / F.nullif(applied, F.lit(0)), 6), F.lit(0.0)).alias("recovery_rate")
    ).select("axis", F.coalesce("hazard", "quadrant").alias("value"), "total", "passed", "applied", "recovered", "recovery_rate")


PAIRS = f"""{REVIEWS}, p AS (SELECT * FROM (SELECT family, case_id, gold_outcome, arg_max(verdict, event_id) FILTER (view_type = 'full') AS before, arg_max(verdict, event_id) FILTER (view_type = 'redacted') AS after
  FROM r WHERE valid GROUP BY ALL) WHERE before IS NOT NULL AND after IS NOT NULL)"""
SPOT = "after = 'approve' AND before IN ('reject', 'insufficient_evidence')"


def _pairs(spark, sf_dir):
    return M.view_pairs(reviews(spark, sf_dir), ["family", "case_id", "gold_outcome"], "full", "redacted", "event_id")


@query(f"{PAIRS} SELECT family, count(*) AS unsafe_pairs, {mean(SPOT)} AS blind_spot_rate, {mean(chr(34) + 'after' + chr(34) + ' = ' + chr(39) + 'approve' + chr(39))} AS unsafe_approval_rate FROM p WHERE gold_outcome = 'unsafe' GROUP BY family")
def a15_blind_spot(spark, sf_dir):
    return M.blind_spot(_pairs(spark, sf_dir), ["family"])


SAMPLES, FAMILIES = 400, 7


@query(f"""{PAIRS}, c AS (SELECT right(family, 1)::BIGINT AS position, count(*) FILTER ({SPOT}) AS part, count(*) AS whole FROM p WHERE gold_outcome = 'unsafe' GROUP BY 1),
d AS (SELECT DISTINCT s.range AS sample, floor({uniform_sql(31, "s.range", "k.range")} * {FAMILIES})::BIGINT AS position FROM range({SAMPLES}) s, range({FAMILIES}) k),
e AS (SELECT sample, sum(part) / sum(whole) AS value FROM d JOIN c USING (position) GROUP BY sample), i AS (SELECT value, row_number() OVER (ORDER BY value, sample) - 1 AS i FROM e)
SELECT count(*) AS samples, round(avg(value), 6) AS mean, round(max(value) FILTER (i = {int(0.025 * (SAMPLES - 1))}), 6) AS low, round(max(value) FILTER (i = {int(0.975 * (SAMPLES - 1))}), 6) AS high FROM i""")
def a17_distinct_bootstrap(spark, sf_dir):
    spot = (F.col("after") == "approve") & F.col("before").isin("reject", "insufficient_evidence")
    clusters = _pairs(spark, sf_dir).filter("gold_outcome = 'unsafe'").groupBy(F.substring("family", 2, 1).cast("long").alias("position")).agg(F.count_if(spot).alias("part"), F.count("*").alias("whole"))
    n = spark.range(SAMPLES * FAMILIES).select((F.col("id") / FAMILIES).cast("long").alias("sample"), (F.col("id") % FAMILIES).alias("k"))
    draws = n.select("sample", F.floor(uniform(31, F.col("sample"), F.col("k")) * FAMILIES).alias("position")).distinct()
    return bootstrap(clusters, draws, 0.025 * (SAMPLES - 1) / SAMPLES, 0.975 * (SAMPLES - 1) / SAMPLES)


MATRIX = f"""WITH {ATTEMPTS}, {RESULTS}, x AS (SELECT user_id % 6 AS toolset, round(avg(success) FILTER (policy = 'retry') - avg(success) FILTER (policy = 'naive'), 6) AS first_delta,
  round(avg((n_attempts = 1)::INT) FILTER (policy = 'retry') - avg((n_attempts = 1)::INT) FILTER (policy = 'naive'), 6) AS sequence_delta FROM results GROUP BY 1)"""


def _matrix(spark, sf_dir):
    side = lambda p, v: F.avg(F.when(F.col("policy") == p, v))
    one = (F.col("n_attempts") == 1).cast("int")
    r = task_results(attempts(spark, sf_dir)).groupBy((F.col("user_id") % 6).alias("toolset"))
    return r.agg(F.round(side("retry", F.col("success")) - side("naive", F.col("success")), 6).alias("first_delta"), F.round(side("retry", one) - side("naive", one), 6).alias("sequence_delta"))


@query(f"""{MATRIX} SELECT count(*) AS rows_total, coalesce(round(avg(first_delta), 6), 0) AS mean_first, coalesce(round(avg(sequence_delta), 6), 0) AS mean_second, coalesce(round(avg(abs(first_delta)), 6), 0) AS mean_abs_first,
  coalesce(round(avg(abs(sequence_delta)), 6), 0) AS mean_abs_second, coalesce(greatest(max(abs(first_delta)), max(abs(sequence_delta))), 0) AS max_abs_delta,
  first(toolset ORDER BY nullif(first_delta, 0) DESC NULLS LAST, toolset) AS best, first(coalesce(first_delta, 0) ORDER BY nullif(first_delta, 0) DESC NULLS LAST, toolset) AS best_first,
  first(toolset ORDER BY least(coalesce(first_delta, 0), coalesce(sequence_delta, 0)), toolset) AS worst, first(coalesce(first_delta, 0) ORDER BY least(coalesce(first_delta, 0), coalesce(sequence_delta, 0)), toolset) AS worst_first,
  first(coalesce(sequence_delta, 0) ORDER BY least(coalesce(first_delta, 0), coalesce(sequence_delta, 0)), toolset) AS worst_second FROM x""")
def a29_a30_delta_summary(spark, sf_dir):
    return M.delta_summary(_matrix(spark, sf_dir), "toolset", "first_delta", "sequence_delta")


@query(f"{MATRIX} SELECT count(*) FILTER (first_delta >= 0.05) AS pass, count(*) FILTER (first_delta >= -0.05 AND first_delta < 0.05) AS hold, count(*) FILTER (first_delta IS NULL OR first_delta < -0.05) AS fail FROM x")
def a31_verdict_counts(spark, sf_dir):
    return M.verdict_counts(_matrix(spark, sf_dir).withColumn("verdict", gate(F.col("first_delta"), -0.05, 0.05)), "verdict")


@query(f"""WITH d AS (SELECT CASE WHEN year(o_orderdate) % 2 = 0 THEN 'held_out' ELSE 'development' END AS cohort, o_custkey % 2 = 0 AS bad, CASE o_orderstatus WHEN 'F' THEN 'BLOCK' WHEN 'O' THEN 'ALLOW' ELSE 'ESCALATE' END AS said FROM orders WHERE o_orderkey % 4 <> 0)
SELECT cohort, count(*) AS n, count(*) FILTER (bad) AS unsafe, count(*) FILTER (NOT bad) AS safe, {mean("said = 'BLOCK'", 'bad')} AS unsafe_block_rate, {mean("said = 'ALLOW'", 'NOT bad')} AS safe_allow_rate, count(*) FILTER (said = 'ESCALATE') AS escalated
FROM d GROUP BY ROLLUP (cohort)""")
def a35_baseline_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("applicable", F.col("o_orderkey") % 4 != 0).filter("applicable")
    said = F.when(F.col("o_orderstatus") == "F", "BLOCK").when(F.col("o_orderstatus") == "O", "ALLOW").otherwise("ESCALATE")
    rows = o.select(F.when(F.year("o_orderdate") % 2 == 0, "held_out").otherwise("development").alias("cohort"), F.when(F.col("o_custkey") % 2 == 0, "BLOCK").otherwise("ALLOW").alias("gold_decision"), said.alias("decision"))
    return M.decision_rates(rows, "cohort", "false").select("cohort", "n", "unsafe", "safe", "unsafe_block_rate", "safe_allow_rate", "escalated")


@query(f"""WITH d AS (SELECT 'm' || o_orderkey % 3 AS model, CASE WHEN o_orderkey % 5 < 2 THEN 'strict' ELSE 'lenient' END AS policy_mode, o_orderpriority AS family, o_custkey % 2 = 0 AS bad,
  CASE o_orderstatus WHEN 'F' THEN 'BLOCK' WHEN 'O' THEN 'ALLOW' ELSE 'ESCALATE' END AS said FROM orders),
f AS (SELECT model, policy_mode, family, count(*) FILTER (bad) AS unsafe, count(*) FILTER (NOT bad) AS safe, count(*) FILTER (bad AND said = 'BLOCK') AS blocked, count(*) FILTER (NOT bad AND said = 'ALLOW') AS allowed FROM d GROUP BY ALL)
SELECT model, policy_mode, sum(unsafe)::BIGINT AS unsafe, sum(safe)::BIGINT AS safe, round(sum(blocked) / nullif(sum(unsafe), 0), 6) AS unsafe_block_rate, round(sum(allowed) / nullif(sum(safe), 0), 6) AS safe_allow_rate FROM f GROUP BY ALL""")
def a36_family_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderstatus") == "F", "BLOCK").when(F.col("o_orderstatus") == "O", "ALLOW").otherwise("ESCALATE")
    bad = F.col("o_custkey") % 2 == 0
    keys = [F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("model"), F.when(F.col("o_orderkey") % 5 < 2, "strict").otherwise("lenient").alias("policy_mode")]
    families = o.groupBy(*keys, F.col("o_orderpriority").alias("family")).agg(F.count_if(bad).alias("unsafe"), F.count_if(~bad).alias("safe"), F.count_if(bad & (said == "BLOCK")).alias("blocked"), F.count_if(~bad & (said == "ALLOW")).alias("allowed"))
    rate = lambda part, whole: F.round(F.sum(part) / F.nullif(F.sum(whole), F.lit(0)), 6)
    return families.groupBy("model", "policy_mode").agg(F.sum("unsafe").alias("unsafe"), F.sum("safe").alias("safe"), rate("blocked", "unsafe").alias("unsafe_block_rate"), rate("allowed", "safe").alias("safe_allow_rate"))


@query(f"{REVIEWS} SELECT view_type, verdict, count(*) FILTER (provider = 'm0') AS m0, count(*) FILTER (provider = 'm1') AS m1, count(*) FILTER (provider = 'm2') AS m2, {mean('required_evidence_used')} AS specific_rate FROM r WHERE valid GROUP BY ALL")
def a37_verdict_crosstab(spark, sf_dir):
    r = reviews(spark, sf_dir).filter("valid")
    by = [F.count_if(F.col("provider") == p).alias(p) for p in ("m0", "m1", "m2")]
    return r.groupBy("view_type", "verdict").agg(*by, F.expr(M.share("required_evidence_used")).alias("specific_rate"))


@query(f"""WITH {ATTEMPTS}, {RESULTS}, p AS (SELECT policy, latency_ms, row_number() OVER (PARTITION BY policy ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY policy) AS n FROM results),
m AS (SELECT policy, round(avg(success), 6) AS success, coalesce(round(avg(cost_usd) FILTER (success = 1), 9), 0) AS cost, (SELECT max(latency_ms) FROM p WHERE p.policy = results.policy AND i = round_even(0.95 * (n - 1), 0)) AS latency FROM results GROUP BY policy)
SELECT *, coalesce(round((cost - min(cost) OVER ()) / nullif(max(cost) OVER () - min(cost) OVER (), 0), 4), 0) AS size FROM m""")
def a39_frontier_points(spark, sf_dir):
    points = policy_metrics(task_results(attempts(spark, sf_dir))).select("policy", F.col("success_rate").alias("success"), F.col("p95_latency_ms").alias("latency"), F.coalesce("cost_per_success", F.lit(0.0)).alias("cost"))
    every = Window.partitionBy(F.lit(0))  # a row for each policy
    low, high = F.min("cost").over(every), F.max("cost").over(every)
    return points.withColumn("size", F.coalesce(F.round((F.col("cost") - low) / F.nullif(high - low, F.lit(0.0)), 4), F.lit(0.0)))


@query(f"""{REVIEWS} SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(family) = 0 THEN 'family' ELSE 'verdict' END AS field, coalesce(provider, family, verdict) AS value, count(*) AS n
FROM r GROUP BY GROUPING SETS (provider, family, verdict)""")
def a40_counts(spark, sf_dir):
    return M.counts(reviews(spark, sf_dir), ["provider", "family", "verdict"])
