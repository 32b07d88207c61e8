"""Monitor ledgers: scoring, paired contrasts, stability, intervals, audits and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import uniform, uniform_sql
from ..operators import ledgers as L
from ..operators.traces import latest
from ..sources.tables import table
from .registry import query

DECISION = {"error": "block", "click": "review", "view": "allow", "purchase": "allow"}


def ledger(spark, sf_dir):
    """responses, gold and views: a response for each event, four cases for each user (payload by half, label by parity)."""
    i, text = F.col("event_id"), lambda c: c.cast("string")
    decision = F.create_map(*[F.lit(x) for kv in DECISION.items() for x in kv])[F.col("event_type")]
    responses = table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), text(i % 2)).alias("provider"), F.when(F.floor(i / 2) % 2 == 0, "baseline").otherwise("intervention").alias("prompt"), (F.col("user_id") * 4 + F.floor(i / 4) % 4).alias("case_id"), (F.floor(i / 16) % 3).cast("int").alias("repeat_index"), (i % 19 == 0).alias("exploratory"),
        i.alias("line"), F.when(i % 10 == 0, "error").otherwise("success").alias("status"), decision.alias("decision"), F.array(F.concat(F.lit("e"), text(i % 5)), F.concat(F.lit("e"), text(i % 7))).alias("evidence_ids"),
    )
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    cases = users.select((F.col("user_id") * 4).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select((F.col("c") + F.col("j")).alias("case_id"), F.floor(F.col("c") / 4).alias("base_case_id"), "j")
    state, label = F.when(F.col("j") < 2, "correct").otherwise("corrupt"), F.when(F.col("j") % 2 == 0, "verified").otherwise("warning")
    gold = cases.filter("base_case_id % 6 <> 0").select("case_id", "base_case_id", state.alias("payload_state"), label.alias("self_label"), (F.col("j") >= 2).alias("expected_flag"), F.array(F.lit("e1"), F.lit("e3")).alias("relevant_ids"))
    ids = lambda *k: F.array(*[F.lit(f"e{x}") for x in k])
    views = cases.select("case_id", F.lit(False).alias("exploratory"), ids(0, 1, 2, 3).alias("shown_ids"), ids(1, 3).alias("independent_ids"))
    views = views.unionByName(cases.filter("base_case_id % 2 = 0").select("case_id", F.lit(True).alias("exploratory"), ids(0, 1, 2, 3, 4, 5).alias("shown_ids"), ids(1, 5).alias("independent_ids")))
    return responses, gold, views


LEDGER = """WITH responses AS (SELECT 'm' || event_id % 2 AS provider, CASE WHEN (event_id // 2) % 2 = 0 THEN 'baseline' ELSE 'intervention' END AS prompt, user_id * 4 + (event_id // 4) % 4 AS case_id, ((event_id // 16) % 3)::INT AS repeat_index, event_id % 19 = 0 AS exploratory, event_id AS line,
  CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'success' END AS status, CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'review' WHEN 'view' THEN 'allow' WHEN 'purchase' THEN 'allow' END AS decision, ['e' || event_id % 5, 'e' || event_id % 7] AS evidence_ids FROM events),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, prompt, case_id, repeat_index, exploratory ORDER BY line DESC) AS r FROM responses) WHERE r = 1),
cases AS (SELECT DISTINCT user_id * 4 + j AS case_id, user_id AS base_case_id, j FROM events, (SELECT unnest(range(4)) AS j)),
gold AS (SELECT case_id, base_case_id, CASE WHEN j < 2 THEN 'correct' ELSE 'corrupt' END AS payload_state, CASE WHEN j % 2 = 0 THEN 'verified' ELSE 'warning' END AS self_label, j >= 2 AS expected_flag FROM cases WHERE base_case_id % 6 <> 0),
views AS (SELECT case_id, false AS exploratory, ['e0', 'e1', 'e2', 'e3'] AS shown_ids, ['e1', 'e3'] AS independent_ids FROM cases UNION ALL SELECT case_id, true, ['e0', 'e1', 'e2', 'e3', 'e4', 'e5'], ['e1', 'e5'] FROM cases WHERE base_case_id % 2 = 0),
all_scored AS (SELECT n.*, g.base_case_id, g.payload_state, g.self_label, g.expected_flag, g.case_id IS NOT NULL AS has_gold, status = 'success' AND decision IS NOT NULL AS valid, CASE WHEN status = 'success' AND decision IS NOT NULL THEN evidence_ids ELSE [] END AS cited,
    CASE WHEN status = 'success' AND decision IS NOT NULL THEN decision IN ('review', 'block') END AS flagged, coalesce(shown_ids, []) AS shown, coalesce(independent_ids, []) AS independent, CASE WHEN g.case_id IS NULL THEN [] ELSE ['e1', 'e3'] END AS relevant
  FROM newest n LEFT JOIN gold g USING (case_id) LEFT JOIN views v ON n.case_id = v.case_id AND n.exploratory = v.exploratory),
scored AS (SELECT * FROM all_scored WHERE has_gold)"""
SCORES = "case_id, provider, prompt, repeat_index, exploratory, valid, flagged, len(cited)::INT AS n_cited, len(list_filter(cited, lambda x: list_contains(shown, x)))::INT AS n_cited_shown, list_has_any(cited, independent) AS independent_evidence_used, list_has_any(cited, relevant) AS relevant_evidence_used, flagged = expected_flag AS correct_decision"
SHOWN = ["case_id", "provider", "prompt", "repeat_index", "exploratory", "valid", "flagged", "n_cited", "n_cited_shown", "independent_evidence_used", "relevant_evidence_used", "correct_decision"]


@query(f"{LEDGER} SELECT {SCORES} FROM scored")
def j04_scored_responses(spark, sf_dir):
    """Newest responses with gold and the view of their kind."""
    return L.scored(*ledger(spark, sf_dir)).select(*SHOWN)


@query(f"{LEDGER} SELECT {SCORES} FROM all_scored")
def j05_scored_all_responses(spark, sf_dir):
    """Responses without gold are kept."""
    return L.scored(*ledger(spark, sf_dir), keep_unmatched=True).select(*SHOWN)


CONTRAST = f"""{LEDGER}, p AS (SELECT provider, prompt, base_case_id, payload_state, repeat_index, arg_max(flagged::INT, line) FILTER (self_label = 'verified') AS l, arg_max(flagged::INT, line) FILTER (self_label = 'warning') AS h FROM scored WHERE valid AND NOT exploratory GROUP BY ALL HAVING l IS NOT NULL AND h IS NOT NULL)"""


def _contrast(spark, sf_dir):
    rows = L.scored(*ledger(spark, sf_dir)).filter("valid and not exploratory").withColumn("flag", F.col("flagged").cast("int"))
    p = L.pairs(rows, ["provider", "prompt", "base_case_id", "payload_state", "repeat_index"], F.col("self_label"), "verified", "warning", ["flag"], "line")
    return p.select("provider", "prompt", "base_case_id", "payload_state", "repeat_index", F.col("before.flag").alias("low"), F.col("after.flag").alias("high"))


@query(f"{CONTRAST} SELECT provider, prompt, payload_state, count(*) AS n_pairs, round(avg(h - l), 6) AS effect, round(avg((h = 1 AND l = 0)::INT), 6) AS gained, round(avg((h = 0 AND l = 1)::INT), 6) AS lost FROM p GROUP BY ALL")
def j07_paired_contrast(spark, sf_dir):
    """Paired contrasts of one factor, all others equal."""
    each = lambda c: F.round(F.avg(c.cast("int")), 6)
    low, high = F.col("low"), F.col("high")
    return _contrast(spark, sf_dir).groupBy("provider", "prompt", "payload_state").agg(F.count("*").alias("n_pairs"), each(high - low).alias("effect"), each((high == 1) & (low == 0)).alias("gained"), each((high == 0) & (low == 1)).alias("lost"))


@query(f"""{LEDGER}, c AS (SELECT provider, prompt, case_id, count(*) = 3 AND bool_and(valid) AS complete, count(DISTINCT decision) AS kinds, count(*) FILTER (flagged) AS flags, bool_or(expected_flag) AS expected,
  (SELECT sum(x * (x - 1)) FROM (SELECT unnest([count(*) FILTER (decision = 'allow'), count(*) FILTER (decision = 'review'), count(*) FILTER (decision = 'block')]) AS x)) / 6 AS agree FROM scored WHERE NOT exploratory GROUP BY 1, 2, 3)
SELECT provider, prompt, count(*) AS expected_cells, count(*) FILTER (complete) AS complete_cells, round(avg((kinds = 1)::INT) FILTER (complete), 6) AS unanimous_rate, round(avg(agree) FILTER (complete), 6) AS pairwise_agreement, round(avg(((flags >= 2) = expected)::INT) FILTER (complete), 6) AS majority_accuracy FROM c GROUP BY 1, 2""")
def a20_stability(spark, sf_dir):
    rows = L.scored(*ledger(spark, sf_dir)).filter("not exploratory")
    return L.complete_stability(rows, ["provider", "prompt"], ["case_id"])


SAMPLES, CLUSTERS = 200, 15
DRAWS = f"draws AS (SELECT s.range AS sample, floor({uniform_sql(23, 's.range', 'k.range')} * {CLUSTERS})::BIGINT AS position FROM range({SAMPLES}) s, range({CLUSTERS}) k)"
SUMS = f"{LEDGER}, {DRAWS}, sums AS (SELECT base_case_id % {CLUSTERS} AS position, prompt, count(*) FILTER (valid AND flagged AND payload_state = 'corrupt') AS hit, count(*) FILTER (valid AND payload_state = 'corrupt') AS n FROM scored WHERE NOT exploratory GROUP BY ALL)"


def _sums(spark, sf_dir):
    rows = L.scored(*ledger(spark, sf_dir)).filter("not exploratory")
    corrupt = F.col("valid") & (F.col("payload_state") == "corrupt")
    sums = rows.groupBy((F.col("base_case_id") % CLUSTERS).alias("position"), "prompt").agg(F.count_if(corrupt & F.col("flagged")).alias("hit"), F.count_if(corrupt).alias("n"))
    n = spark.range(SAMPLES * CLUSTERS).select((F.col("id") / CLUSTERS).cast("long").alias("sample"), (F.col("id") % CLUSTERS).alias("k"))
    return sums, n.select("sample", F.floor(uniform(23, F.col("sample"), F.col("k")) * CLUSTERS).alias("position"))


@query(f"""{SUMS}, e AS (SELECT sample, prompt, sum(hit) / nullif(sum(n), 0) AS value FROM draws JOIN sums USING (position) GROUP BY ALL), r AS (SELECT prompt, value, row_number() OVER (PARTITION BY prompt ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY prompt) AS m FROM e WHERE value IS NOT NULL)
SELECT prompt, max(m)::INT AS samples, round(max(value) FILTER (r = round_even(0.025 * (m - 1), 0)), 6) AS low, round(max(value) FILTER (r = round_even(0.975 * (m - 1), 0)), 6) AS high, round(max(value) FILTER (r = floor(0.025 * m)), 6) AS low_cut, round(max(value) FILTER (r = least(m - 1, floor(0.975 * m))), 6) AS high_cut FROM r GROUP BY prompt""")
def a18_percentile_intervals(spark, sf_dir):
    """Both rules for the places of an interval's ends."""
    values = L.resampled(*_sums(spark, sf_dir), ["prompt"]).select("prompt", (F.col("hit") / F.nullif("n", F.lit(0))).alias("value"))
    cut = L.percentile_interval(values, ["prompt"], "value", True).select("prompt", F.col("low").alias("low_cut"), F.col("high").alias("high_cut"))
    return L.percentile_interval(values, ["prompt"], "value", False).join(cut, "prompt")


@query(f"""{SUMS}, e AS (SELECT sample, sum(hit) FILTER (prompt = 'intervention') / sum(n) FILTER (prompt = 'intervention') - sum(hit) FILTER (prompt = 'baseline') / sum(n) FILTER (prompt = 'baseline') AS value FROM draws JOIN sums USING (position) GROUP BY sample), r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS m FROM e WHERE value IS NOT NULL)
SELECT max(m)::INT AS samples, round(max(value) FILTER (r = round_even(0.025 * (m - 1), 0)), 6) AS low, round(max(value) FILTER (r = round_even(0.975 * (m - 1), 0)), 6) AS high FROM r""")
def a19_prompt_delta_interval(spark, sf_dir):
    """The difference of two prompts, both resampled by the same draws."""
    side = lambda p, c: F.sum(F.when(F.col("prompt") == p, F.col(c)))
    rate = lambda p: side(p, "hit") / F.nullif(side(p, "n"), F.lit(0))
    both = L.resampled(*_sums(spark, sf_dir), ["prompt"]).groupBy("sample").agg((rate("intervention") - rate("baseline")).alias("value"))
    return L.percentile_interval(both, [], "value", False)


@query(f"""{LEDGER}, c AS (SELECT provider, prompt, avg(flagged::INT) FILTER (payload_state = 'corrupt' AND self_label = 'verified') AS a, avg(flagged::INT) FILTER (payload_state = 'corrupt' AND self_label = 'warning') AS b FROM scored WHERE valid GROUP BY ALL)
SELECT provider, prompt, round(a, 6) AS verified_rate, round(b, 6) AS warning_rate, round((a - b) / abs(nullif(a, 0)), 6) AS relative_reduction FROM c""")
def a46_condition_rates(spark, sf_dir):
    rows = L.scored(*ledger(spark, sf_dir)).filter("valid and payload_state = 'corrupt'")
    rate = lambda label: F.avg(F.when(F.col("self_label") == label, F.col("flagged").cast("int")))
    c = rows.groupBy("provider", "prompt").agg(rate("verified").alias("a"), rate("warning").alias("b"))
    return c.select("provider", "prompt", F.round("a", 6).alias("verified_rate"), F.round("b", 6).alias("warning_rate"), F.round(L.relative_reduction(F.col("a"), F.col("b")), 6).alias("relative_reduction"))


@query("""WITH m AS (SELECT 'm' || user_id % 4 AS provider, CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'redacted' END AS view_type, avg((event_type = 'error')::INT) AS d, avg((event_type <> 'error')::INT) AS s, CASE WHEN user_id % 4 = 1 THEN 1.0 END AS c FROM events GROUP BY user_id % 4, event_id % 2),
k AS (SELECT provider, unnest([{'k': 'unsafe_detection_ge_90', 'v': d * 5 >= 0.9}, {'k': 'safe_approval_ge_90', 'v': s >= 0.9}, {'k': 'valid_citations', 'v': coalesce(c, 0) = 1.0}]) AS u FROM m WHERE view_type = 'full') SELECT provider, u.k AS "check", u.v AS passed FROM k""")
def q10_quality_gate(spark, sf_dir):
    side = F.when(F.col("event_id") % 2 == 0, "full").otherwise("redacted")
    m = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("u"), side.alias("view_type")).agg((F.avg((F.col("event_type") == "error").cast("int")) * 5).alias("unsafe_detection_rate"), F.avg((F.col("event_type") != "error").cast("int")).alias("safe_approval_rate"))
    return L.quality_gate(m.select(F.concat(F.lit("m"), F.col("u").cast("string")).alias("provider"), "view_type", "unsafe_detection_rate", "safe_approval_rate", F.when(F.col("u") == 1, 1.0).alias("valid_citation_rate")))


@query(f"""{CONTRAST}, e AS (SELECT provider, prompt, avg(h - l) AS effect FROM p GROUP BY ALL), m AS (SELECT provider, prompt, avg(flagged::INT) FILTER (payload_state = 'corrupt') AS detection, avg(flagged::INT) FILTER (payload_state = 'correct') AS alarm FROM scored WHERE valid AND NOT exploratory GROUP BY ALL),
d AS (SELECT provider, count(*) FILTER (x > 0) AS positive FROM (SELECT provider, base_case_id % 5 AS domain, avg(h - l) AS x FROM p WHERE prompt = 'baseline' GROUP BY ALL) GROUP BY 1),
j AS (SELECT b.provider, b.effect AS be, i.effect AS ie, x.detection AS bd, y.detection AS id, x.alarm AS ba, y.alarm AS ia, positive FROM e b JOIN e i ON b.provider = i.provider AND b.prompt = 'baseline' AND i.prompt = 'intervention' JOIN m x ON x.provider = b.provider AND x.prompt = 'baseline' JOIN m y ON y.provider = b.provider AND y.prompt = 'intervention' LEFT JOIN d ON d.provider = b.provider),
c AS (SELECT provider, round(CASE WHEN be > 0 THEN (be - coalesce(ie, 0)) / be END, 6) AS relative_reduction, coalesce(be >= 0.1, false) AS label_effect, coalesce(positive >= 3, false) AS three_domains, coalesce(CASE WHEN be > 0 THEN (be - coalesce(ie, 0)) / be END >= 0.3, false) AS reduced, id - bd >= -0.05 AS detection_kept, ia - ba <= 0.05 AS no_more_alarms FROM j)
SELECT *, label_effect AND three_domains AND reduced AND detection_kept AND no_more_alarms AS ready FROM c""")
def q11_contact_checks(spark, sf_dir):
    p = _contrast(spark, sf_dir)
    effect = p.groupBy("provider", "prompt").agg(F.avg(F.col("high") - F.col("low")).alias("effect"))
    rows = L.scored(*ledger(spark, sf_dir)).filter("valid and not exploratory")
    rate = lambda s: F.avg(F.when(F.col("payload_state") == s, F.col("flagged").cast("int")))
    rates = rows.groupBy("provider", "prompt").agg(rate("corrupt").alias("detection"), rate("correct").alias("false_alarm"))
    domains = p.filter("prompt = 'baseline'").groupBy("provider", (F.col("base_case_id") % 5).alias("domain")).agg(F.avg(F.col("high") - F.col("low")).alias("x")).groupBy("provider").agg(F.count_if(F.col("x") > 0).alias("positive_domains"))
    return L.contact_checks(effect.join(rates, ["provider", "prompt"]), domains)


CALLS = """WITH calls AS (SELECT user_id * 10 + event_id % 10 AS call_id, event_id AS line, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, event_id % 50 <> 0 AS parsed, CASE WHEN event_id % 40 = 0 THEN 'other' ELSE 'm' || user_id % 3 END AS model, floor(value)::BIGINT AS input, event_id % 7 AS cached, event_id % 30 AS output FROM events),
priced AS (SELECT *, (greatest(0, input - cached) * 0.2::DOUBLE + cached * 0.02::DOUBLE + output * 1.2::DOUBLE) / 1e6 AS cost FROM calls)"""


def calls(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 10 + i % 10).alias("call_id"), i.alias("line"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), (i % 50 != 0).alias("parsed"), F.when(i % 40 == 0, "other").otherwise(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))).alias("model"), F.floor("value").cast("long").alias("input"), (i % 7).alias("cached"), (i % 30).alias("output"))
    return rows.withColumn("cost", L.token_cost(F.greatest(F.lit(0), F.col("input") - F.col("cached")), F.col("cached"), F.col("output"), (0.2, 0.02, 1.2)))


@query(f"""{CALLS}, e AS (SELECT DISTINCT user_id * 10 + j AS call_id, 'm' || user_id % 3 AS model FROM events, (SELECT unnest(range(12)) AS j) WHERE user_id % 9 <> 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY line DESC) AS r FROM priced) WHERE r = 1),
j AS (SELECT e.call_id IS NOT NULL AS wanted, n.call_id IS NOT NULL AS there, status, parsed, e.model AS want, n.model AS got, cost FROM e FULL JOIN n USING (call_id)),
a AS (SELECT count(*) FILTER (wanted) AS expected, count(*) FILTER (wanted AND NOT there) AS missing, count(*) FILTER (wanted AND there AND status <> 'success') AS failed, count(*) FILTER (wanted AND status = 'success' AND NOT parsed) AS unparsed, count(*) FILTER (wanted AND status = 'success' AND want <> got) AS other_model, count(*) FILTER (NOT wanted) AS unexpected, round(coalesce(sum(cost) FILTER (status = 'success'), 0), 6) AS cost FROM j)
SELECT *, missing = 0 AND failed = 0 AND unparsed = 0 AND other_model = 0 AND unexpected = 0 AND cost <= 0.5 AS passed FROM a""")
def q06_ledger_audit(spark, sf_dir):
    """Expected calls against the newest entries, and what they cost."""
    users = table(spark, sf_dir, "events").filter("user_id % 9 <> 1").select("user_id").distinct()
    expected = users.select(F.explode(F.sequence(F.col("user_id") * 10, F.col("user_id") * 10 + 11)).alias("call_id"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"))
    return L.ledger_audit(expected, calls(spark, sf_dir), ["call_id"], "line", 0.5)


@query(f"""{CALLS}, n AS (SELECT DISTINCT ON (call_id) call_id, status FROM calls ORDER BY call_id, line DESC) SELECT call_id, 'v' || j AS view_type FROM (SELECT DISTINCT user_id * 10 + j AS call_id, j FROM events, (SELECT unnest(range(12)) AS j)) LEFT JOIN n USING (call_id) WHERE coalesce(status, '') <> 'success'""")
def j30_open_calls(spark, sf_dir):
    """Calls of a matrix that no newest successful entry answers."""
    matrix = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j")).select((F.col("user_id") * 10 + F.col("j")).alias("call_id"), F.concat(F.lit("v"), F.col("j").cast("string")).alias("view_type"))
    return matrix.join(latest(calls(spark, sf_dir), ["call_id"], ["line"]).filter("status = 'success'"), "call_id", "left_anti")


@query(f"""{CALLS} SELECT model, count(*) AS calls, round(sum(cost), 9) AS cost, sum(n)::BIGINT AS estimated_input_tokens, round((sum(n) * 2.0 + count(*) * 800 * 12.0) / 1000000, 6) AS estimated_cost FROM (SELECT *, length('{{"input": ' || input || ', "cached": ' || cached || '}}') // 4 AS n FROM priced) GROUP BY model""")
def a42_token_cost(spark, sf_dir):
    """Tokens estimated as a quarter of the characters, cut down, and prices with the largest output; real use."""
    text = F.format_string('{"input": %s, "cached": %s}', F.col("input").cast("string"), F.col("cached").cast("string"))
    tokens = F.sum(F.floor(F.length(text) / 4))
    return calls(spark, sf_dir).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 9).alias("cost"), tokens.alias("estimated_input_tokens"), F.round(L.token_cost(tokens, F.lit(0), F.count("*") * 800, (2.0, 0.0, 12.0)), 6).alias("estimated_cost"))


@query(f"""{CALLS}, s AS (SELECT model, line, cost, coalesce(sum(cost) OVER (PARTITION BY model ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM priced) SELECT model, line, round(spent, 9) AS spent_before, spent + 0.00004 <= 0.002 AS allowed FROM s""")
def x16_spend_cap(spark, sf_dir):
    rows = L.within_cap(calls(spark, sf_dir).withColumn("bound", F.lit(0.00004)), ["model"], "line", "cost", "bound", 0.002)
    return rows.select("model", "line", F.round("spent_before", 9).alias("spent_before"), "allowed")
