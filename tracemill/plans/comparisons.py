"""Metrics by policy, comparisons of runs, gates, agreement and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import ratio, uniform, uniform_sql
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import simulate as G
from ..sources.tables import ATTEMPTS, RESULTS, attempts, table, task_results
from .registry import query


BASE = f"WITH {ATTEMPTS}, {RESULTS}"


@query(f"""{BASE}, p AS (
  SELECT policy, latency_ms, row_number() OVER (PARTITION BY policy ORDER BY latency_ms) - 1 AS r, count(*) OVER (PARTITION BY policy) AS n FROM results)
SELECT policy, count(*) AS tasks_total, sum(success)::BIGINT AS tasks_succeeded, round(sum(success) / count(*), 6) AS success_rate,
  round(sum(n_invalid) / sum(n_attempts), 6) AS invalid_rate, round(avg(latency_ms), 6) AS mean_latency_ms,
  CASE WHEN sum(success) = 0 THEN 0 ELSE round(sum(n_attempts - 1) / sum(success), 6) END AS retries_per_success,
  round(avg(cost_usd) FILTER (success = 1), 9) AS cost_per_success,
  (SELECT max(latency_ms) FROM p WHERE p.policy = results.policy AND r = round_even(0.95 * (n - 1), 0)) AS p95_latency_ms
FROM results GROUP BY policy""")
def a01_policy_metrics(spark, sf_dir):
    return M.policy_metrics(task_results(attempts(spark, sf_dir)))


SEEDS = f"""{BASE}, seeds AS (
  SELECT policy, task_id % 5 AS seed, user_id % 2 AS side, avg(success) AS success_rate, avg(latency_ms) AS mean_latency_ms FROM results GROUP BY ALL)"""


def _seeds(spark, sf_dir):
    r = task_results(attempts(spark, sf_dir))
    return r.groupBy("policy", (F.col("task_id") % 5).alias("seed"), (F.col("user_id") % 2).alias("side")).agg(F.avg("success").alias("success_rate"), F.avg("latency_ms").alias("mean_latency_ms"))


STATS = """count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std,
  round(1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS ci95_half_width,
  round(avg(value) - 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS ci95_low,
  round(avg(value) + 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS ci95_high"""


@query(f"""{SEEDS}, u AS (SELECT policy, seed, 'success_rate' AS metric, success_rate AS value FROM seeds WHERE side = 0
  UNION ALL SELECT policy, seed, 'mean_latency_ms', mean_latency_ms FROM seeds WHERE side = 0)
SELECT policy, metric, {STATS} FROM u GROUP BY policy, metric""")
def a04_multi_seed(spark, sf_dir):
    s = _seeds(spark, sf_dir).filter("side = 0")
    return M.spread(M.unpivoted(s, ["policy", "seed"], ["success_rate", "mean_latency_ms"]), ["policy", "metric"], "value")


@query(f"{SEEDS} SELECT 'side' || side AS scenario, policy, {STATS.replace('value', 'success_rate')} FROM seeds GROUP BY ALL")
def a05_scenario_sweep(spark, sf_dir):
    s = _seeds(spark, sf_dir).withColumn("scenario", F.concat(F.lit("side"), F.col("side").cast("string")))
    return M.spread(s, ["scenario", "policy"], "success_rate")


CASES = f"""{BASE}, cases AS (SELECT task_id, arg_min(event_type, (ts, event_id)) AS expected, count(*) AS weight FROM attempts WHERE policy <> 'naive' GROUP BY task_id),
firsts AS (SELECT policy, task_id, arg_min(event_type, attempt_number) AS first_type FROM attempts GROUP BY policy, task_id),
scores AS (SELECT policy, task_id % 7 AS toolset, count(*) AS cases_evaluated, round(avg((first_type = expected)::INT), 6) AS first_tool_accuracy FROM firsts JOIN cases USING (task_id) GROUP BY ALL)"""


def _scores(spark, sf_dir):
    calls = attempts(spark, sf_dir)
    cases = calls.filter("policy <> 'naive'").groupBy("task_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("expected"))
    first = calls.groupBy("policy", "task_id").agg(F.min_by("event_type", "attempt_number").alias("first_type"))
    return first.join(cases, "task_id").groupBy("policy", (F.col("task_id") % 7).alias("toolset")).agg(F.count("*").alias("cases_evaluated"), ratio(F.count_if(F.col("first_type") == F.col("expected")), F.count("*")).alias("first_tool_accuracy"))


@query(f"{CASES} SELECT * FROM scores")
def a06_eval_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"{CASES} SELECT toolset, round(sum(first_tool_accuracy * cases_evaluated) / sum(cases_evaluated), 6) AS first_tool_accuracy FROM scores GROUP BY toolset")
def a07_case_weighted_accuracy(spark, sf_dir):
    return M.weighted_mean(_scores(spark, sf_dir), ["toolset"], "cases_evaluated", ["first_tool_accuracy"])


DELTAS = f"""{SEEDS}, d AS (SELECT policy, seed, b.success_rate AS base, c.success_rate AS comparison, round(c.success_rate - b.success_rate, 6) AS delta
  FROM (SELECT * FROM seeds WHERE side = 0 AND seed <> 1) b FULL JOIN (SELECT * FROM seeds WHERE side = 1 AND seed <> 3) c USING (policy, seed))"""


def _deltas(spark, sf_dir):
    s = _seeds(spark, sf_dir)
    return M.delta(s.filter("side = 0 and seed <> 1"), s.filter("side = 1 and seed <> 3"), ["policy", "seed"], "success_rate")


@query(f"{DELTAS} SELECT policy, seed, round(base, 6) AS base, round(comparison, 6) AS comparison, delta FROM d")
def j02_full_outer_delta(spark, sf_dir):
    return _deltas(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("base", "comparison")})


@query(f"""{DELTAS}, n AS (SELECT policy, task_id % 5 AS seed, round(avg(success) FILTER (task_id % 2 = 1) - avg(success) FILTER (task_id % 2 = 0), 6) AS null_delta FROM results WHERE user_id % 2 = 0 GROUP BY ALL)
SELECT policy, seed, delta, null_delta, round(delta - null_delta, 6) AS advantage FROM d JOIN n USING (policy, seed)""")
def j03_advantage_vs_null(spark, sf_dir):
    # the null run compares two halves of the base run's tasks
    halves = task_results(attempts(spark, sf_dir)).filter("user_id % 2 = 0").groupBy("policy", (F.col("task_id") % 5).alias("seed"), (F.col("task_id") % 2).alias("half")).agg(F.avg("success").alias("rate"))
    null = M.delta(halves.filter("half = 0"), halves.filter("half = 1"), ["policy", "seed"], "rate")
    return M.advantage(_deltas(spark, sf_dir), null, ["policy", "seed"])


@query(f"{DELTAS} SELECT count(delta) AS n, round(avg(delta), 6) AS mean, round(avg(abs(delta)), 6) AS mean_abs, round(max(abs(delta)), 6) AS max_abs FROM d")
def a08_delta_signal(spark, sf_dir):
    d = F.col("delta")
    return _deltas(spark, sf_dir).agg(F.count(d).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.avg(F.abs(d)), 6).alias("mean_abs"), F.round(F.max(F.abs(d)), 6).alias("max_abs"))


@query("""SELECT factor, level, round(avg(toxic), 6) AS mean, count(*) AS n FROM (
  SELECT 'source' AS factor, source AS level, toxic FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'lang', lang, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def a13_main_effects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return M.main_effects(docs.join(table(spark, sf_dir, "labels"), "doc_id"), ["source", "lang"], "toxic")


@query(f"""{BASE}, w AS (SELECT task_id, max(success) FILTER (policy = 'naive') AS base, max(success) FILTER (policy = 'retry') AS changed FROM results GROUP BY task_id)
SELECT count(*) AS n_pairs, round(avg(changed - base), 6) AS mean_delta, round(count(*) FILTER (base = 1 AND changed = 0) / count(*), 6) AS blind_spot_rate FROM w WHERE base IS NOT NULL AND changed IS NOT NULL""")
def a14_paired_blind_spot(spark, sf_dir):
    side = lambda p: F.max(F.when(F.col("policy") == p, F.col("success")))
    w = task_results(attempts(spark, sf_dir)).groupBy("task_id").agg(side("naive").alias("base"), side("retry").alias("changed")).filter("base is not null and changed is not null")
    return w.agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.col("changed") - F.col("base")), 6).alias("mean_delta"), ratio(F.count_if((F.col("base") == 1) & (F.col("changed") == 0)), F.count("*")).alias("blind_spot_rate"))


SAMPLES, CLUSTERS = 400, 20


@query(f"""{BASE}, c AS (SELECT task_id % {CLUSTERS} AS position, sum(success) AS part, count(*) AS whole FROM results GROUP BY 1),
d AS (SELECT s.range AS sample, floor({uniform_sql(17, "s.range", "k.range")} * {CLUSTERS})::BIGINT AS position FROM range({SAMPLES}) s, range({CLUSTERS}) k),
e AS (SELECT sample, sum(part) / sum(whole) AS value FROM d JOIN c USING (position) GROUP BY sample),
r AS (SELECT value, row_number() OVER (ORDER BY value, sample) - 1 AS r FROM e)
SELECT count(*) AS samples, round(avg(value), 6) AS mean, round(max(value) FILTER (r = {int(0.025 * SAMPLES)}), 6) AS low, round(max(value) FILTER (r = {int(0.975 * SAMPLES)}), 6) AS high FROM r""")
def a16_cluster_bootstrap(spark, sf_dir):
    clusters = task_results(attempts(spark, sf_dir)).groupBy((F.col("task_id") % CLUSTERS).alias("position")).agg(F.sum("success").alias("part"), F.count("*").alias("whole"))
    n = spark.range(SAMPLES * CLUSTERS).select((F.col("id") / CLUSTERS).cast("long").alias("sample"), (F.col("id") % CLUSTERS).alias("k"))
    draws = n.select("sample", F.floor(uniform(17, F.col("sample"), F.col("k")) * CLUSTERS).alias("position"))
    return M.bootstrap(clusters, draws)


@query("""WITH r AS (SELECT doc_id, quality AS x, 1 - toxic AS y FROM labels), o AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (x = y) / count(*)::DOUBLE AS p FROM r),
e AS (SELECT sum(a.c * b.c) / (SELECT n * n FROM o) AS q FROM (SELECT x AS l, count(*) AS c FROM r GROUP BY 1) a JOIN (SELECT y AS l, count(*) AS c FROM r GROUP BY 1) b USING (l))
SELECT n::BIGINT AS n, round(p, 6) AS agreement, CASE WHEN n = 0 THEN 0 WHEN q = 1 THEN 1 ELSE round((p - q) / (1 - q), 6) END AS kappa FROM o, e""")
def a23_kappa(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return M.kappa(labels.select("doc_id", F.col("quality").alias("label")), labels.select("doc_id", (1 - F.col("toxic")).alias("label")), "doc_id")


@query(f"""{BASE} SELECT policy, (task_id % 3)::BIGINT AS split, round(avg(success), 4) AS pass_rate, count(*) AS n FROM results GROUP BY GROUPING SETS ((policy), (task_id % 3), (policy, task_id % 3), ())""")
def a24_pass_rates(spark, sf_dir):
    r = task_results(attempts(spark, sf_dir)).withColumn("split", F.col("task_id") % 3)
    return r.cube("policy", "split").agg(F.round(F.avg("success"), 4).alias("pass_rate"), F.count("*").alias("n"))


@query(f"""WITH {ATTEMPTS} SELECT *, row_number() OVER (ORDER BY n DESC, name) AS position FROM (SELECT status AS name, count(*) AS n FROM attempts GROUP BY 1)""")
def a27_failure_taxonomy(spark, sf_dir):
    return M.taxonomy(attempts(spark, sf_dir), "status")


@query(f"""{BASE}, m AS (SELECT policy, avg(success) AS s, avg(latency_ms) AS l FROM results GROUP BY 1) SELECT arg_min(policy, (-s, policy)) AS best_success, arg_min(policy, (l, policy)) AS lowest_latency FROM m""")
def a28_best_policy(spark, sf_dir):
    m = task_results(attempts(spark, sf_dir)).groupBy("policy").agg(F.avg("success").alias("s"), F.avg("latency_ms").alias("l"))
    return m.agg(F.min_by("policy", F.struct((-F.col("s")).alias("s"), "policy")).alias("best_success"), F.min_by("policy", F.struct("l", "policy")).alias("lowest_latency"))


@query(f"""{BASE} SELECT policy, CASE WHEN avg(success) >= 0.5 THEN 'PASS' WHEN avg(success) >= 0.46 THEN 'HOLD' ELSE 'FAIL' END AS verdict FROM results GROUP BY policy""")
def f37_gate_verdict(spark, sf_dir):
    return task_results(attempts(spark, sf_dir)).groupBy("policy").agg(Q.gate(F.avg("success"), 0.46, 0.5).alias("verdict"))


@query(f"""{BASE}, c AS (SELECT * FROM (SELECT 'policies' AS "check", count(DISTINCT policy) = 4 AS passed, count(DISTINCT policy)::VARCHAR AS detail FROM results
  UNION ALL SELECT 'costs', bool_and(cost_usd > 0), count(*) FILTER (cost_usd <= 0)::VARCHAR FROM results UNION ALL SELECT 'statuses', count(*) FILTER (last_status = 'timeout') = 0, count(*) FILTER (last_status = 'timeout')::VARCHAR FROM results))
SELECT * FROM c""")
def q01_checks(spark, sf_dir):
    r = task_results(attempts(spark, sf_dir))
    late = F.count_if(F.col("last_status") == "timeout")
    return Q.checks(r, {"policies": (F.count_distinct("policy") == 4, F.count_distinct("policy")), "costs": (F.bool_and(F.col("cost_usd") > 0), F.count_if(F.col("cost_usd") <= 0)), "statuses": (late == 0, late)})


_PICK = uniform_sql(42, "event_id")
_EDGES = [(k, sum(list(G.FAULTS.values())[: i + 1])) for i, k in enumerate(G.FAULTS)]


@query(f"""WITH e AS (SELECT event_id, floor(value)::BIGINT AS base, CASE {" ".join(f"WHEN {_PICK} <= {v}::DOUBLE THEN '{k}'" for k, v in _EDGES)} END AS fault FROM events)
SELECT event_id, fault, CASE fault WHEN 'rate_limit' THEN greatest(5, base // 3) WHEN 'network_error' THEN greatest(8, base // 2) ELSE greatest(1, base) END AS latency_ms,
  CASE WHEN event_id % 4 <= 1 THEN 0 ELSE 100 * 2 ** (event_id % 4 - 2) + event_id % 7 END::BIGINT AS delay_ms FROM e""")
def g01_simulated_calls(spark, sf_dir):
    kind = G.fault(uniform(42, F.col("event_id")))
    e = table(spark, sf_dir, "events").select("event_id", F.floor("value").cast("long").alias("base"), kind.alias("fault"))
    return e.select("event_id", "fault", G.latency(F.col("base"), F.col("fault")).alias("latency_ms"), G.backoff(F.col("event_id") % 4, 100, F.col("event_id") % 7).cast("long").alias("delay_ms"))
