"""Replies and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as R
from ..operators import training as T
from ..sources.tables import ATTEMPTS, attempts, table
from .registry import query

TOOLS = ["t0", "t1", "t2", "t3"]


def cases(spark, sf_dir):
    """id, prompt, expected and predicted calls in several shapes."""
    i = F.col("event_id")
    k, name = F.get_json_object("props", "$.k"), F.concat(F.lit("t"), (i % 4).cast("string"))
    expected = F.format_string('{"tool_calls": [{"function": {"name": "%s", "arguments": "{\\"k\\": %s}"}}]}', name, k)
    call = lambda n, a: F.format_string('{"name": "%s", "args": %s}', n, a)
    right = F.format_string('{"k": %s}', k)
    shapes = [
        F.concat(F.lit('{"function_call": '), call(name, right), F.lit("}")), F.lit("no call at all"), call(F.lit("t9"), right), call(F.concat(F.lit("t"), ((i + 1) % 4).cast("string")), right), call(name, F.lit("{}")),
        call(name, F.format_string('{"k": %s, "z": 1}', k)), call(name, F.lit('{"k": -1}')), F.concat(F.lit('{"role": "assistant", "content": ['), call(name, right), F.lit(", "), call(name, right), F.lit("]}")), F.lit(None).cast("string"),
    ]
    # replies take far longer to read than rows to move: rows are dealt evenly, whatever files they come from
    rows = table(spark, sf_dir, "events").select("event_id", "props").repartition(spark.sparkContext.defaultParallelism)
    return rows.select(i.alias("id"), F.when(i % 2 == 0, "do it").alias("prompt"), expected.alias("expected"), F.get(F.array(*shapes), (i % 9).cast("int")).alias("predicted"))


FAILURE = "['match', 'missing_required_arg', 'hallucinated_function', 'wrong_function_name', 'missing_required_arg', 'wrong_argument_name', 'wrong_argument_value', 'spurious_call'][event_id % 9 + 1]"


@query("""SELECT event_id AS id, [CASE event_id % 9 WHEN 1 THEN 0 WHEN 7 THEN 2 WHEN 8 THEN 0 ELSE 1 END][1]::INT AS n_calls, CASE event_id % 9 WHEN 1 THEN NULL WHEN 8 THEN NULL WHEN 2 THEN 't9' WHEN 3 THEN 't' || (event_id + 1) % 4 ELSE 't' || event_id % 4 END AS name,
  CASE event_id % 9 WHEN 1 THEN NULL WHEN 8 THEN NULL WHEN 4 THEN '{}' WHEN 5 THEN '{"k":' || (props->>'$.k') || ',"z":1}' WHEN 6 THEN '{"k":-1}' ELSE '{"k":' || (props->>'$.k') || '}' END AS arguments FROM events""")
def f14_tool_calls(spark, sf_dir):
    calls = R.tool_calls(F.col("predicted"))
    return cases(spark, sf_dir).select("id", calls.alias("c")).select("id", F.size("c").alias("n_calls"), F.get("c", 0)["name"].alias("name"), F.get("c", 0)["arguments"].alias("arguments"))


@query(f"SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'do it' ELSE '' END AS prompt, {FAILURE} AS failure_type FROM events WHERE event_id % 9 NOT IN (0, 8)")
def f38_mined_failures(spark, sf_dir):
    """Kinds of failure, and preferences from them."""
    return T.mined_failures(cases(spark, sf_dir), TOOLS).select("id", "prompt", "failure_type")


@query(f"""WITH {ATTEMPTS}, r AS (SELECT policy, task_id, list(event_type ORDER BY attempt_number) AS tools, min(event_id) AS row FROM attempts GROUP BY ALL),
c AS (SELECT task_id, CASE WHEN task_id % 3 = 0 THEN ['click', 'view'] WHEN task_id % 3 = 1 THEN ['click'] ELSE [] END AS expected FROM (SELECT DISTINCT task_id FROM attempts) WHERE task_id % 4 <> 0),
f AS (SELECT task_id, arg_min(policy, row) AS policy_of_task FROM r GROUP BY 1),
m AS (SELECT task_id, row, policy_of_task, CASE WHEN len(expected) = 0 THEN 'spurious_call' WHEN tools[1] <> expected[1] THEN 'wrong_function_name' WHEN len(tools) <> len(expected) THEN 'spurious_call' ELSE 'match' END AS failure_type FROM r JOIN c USING (task_id) JOIN f USING (task_id))
SELECT * FROM m WHERE failure_type <> 'match'""")
def j28_mined_runs(spark, sf_dir):
    a = attempts(spark, sf_dir)
    runs = a.groupBy("policy", "task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt_number", "event_type"))), lambda x: x["event_type"]).alias("tools"), F.min("event_id").alias("row"))  # the attempts of one task
    which = F.col("task_id") % 3
    expected = F.when(which == 0, F.array(F.lit("click"), F.lit("view"))).when(which == 1, F.array(F.lit("click"))).otherwise(F.expr("cast(array() as array<string>)"))
    return T.mined_runs(runs, a.select("task_id").distinct().filter("task_id % 4 <> 0").select("task_id", expected.alias("expected")))


@query("""WITH t AS (SELECT conv_id, list(CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' ELSE role END ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1)
SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN list_concat(['system'], roles) ELSE roles END AS roles, n_chars + CASE WHEN conv_id % 2 = 0 THEN 8 ELSE 0 END AS n_chars FROM t""")
def f39_conversations(spark, sf_dir):
    """conversations of another form as messages."""
    turn = F.struct("turn", F.when(F.col("role") == "user", " Human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("from"), F.col("text").alias("value"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # the turns of one conversation
    m = T.messages(F.when(F.col("conv_id") % 2 == 0, " be short ").otherwise(" "), F.col("turns"))
    rows = c.select(F.col("conv_id").alias("id"), m.alias("m"))
    return rows.select("id", F.transform("m", lambda x: x["role"]).alias("roles"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.length(x["content"]), F.lit(0))).alias("n_chars"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || chr(10) || chr(10) || p_brand END AS prompt, p_type AS chosen, p_size::VARCHAR AS rejected, 'parts' AS source FROM part""")
def f40_preferences(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("instruction"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("input"), F.array("p_type", F.col("p_size").cast("string"), F.lit("third")).alias("output"))
    return T.preferences(p, "parts")


@query("""WITH a AS (SELECT p_partkey AS id, 'alternative' AS source, 't' || p_size % 4 AS chosen, u.i AS n, u.t AS rejected FROM (SELECT *, unnest([{'i': 1, 't': 't' || p_partkey % 4}, {'i': 2, 't': 't1'}]) AS u FROM part) WHERE p_partkey % 5 <> 0),
m AS (SELECT p_partkey AS id, planner AS source, 't' || p_size % 4 AS chosen, r.range AS n, 't' || p_partkey % 3 AS rejected FROM part, (VALUES ('base', 1), ('comparison', 3)) p(planner, k), range(1, 4) r WHERE r.range <= k AND p_partkey % 5 <> 0)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM m) WHERE chosen <> rejected""")
def f41_router_preferences(spark, sf_dir):
    """the expected tool over alternatives, and over mistakes by planner."""
    key, tool = F.col("p_partkey"), lambda c: F.concat(F.lit("t"), c.cast("string"))
    rows = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 5 == 0, "").otherwise("q").alias("prompt"), tool(F.col("p_size") % 4).alias("expected"), F.array(tool(key % 4), F.lit("t1"), F.lit("t2")).alias("alternatives"), tool(key % 3).alias("called"))
    a = T.alternatives(rows, 2).select("id", F.lit("alternative").alias("source"), "chosen", F.col("rank").cast("long").alias("n"), "rejected")
    m = T.mistakes(rows.withColumn("planner", F.explode(F.array(F.lit("base"), F.lit("comparison")))), {"base": 0, "comparison": 3}).select("id", F.col("planner").alias("source"), "chosen", F.col("copy").cast("long").alias("n"), "rejected")
    return a.unionByName(m)


HAZARDS = ["execution_error", "schema_drift", "partial_output", "silent_corruption", "cross_source_conflict"]


@query(f"""WITH t AS (SELECT c_custkey AS task_id, [CASE WHEN c_custkey % 3 = 0 THEN 'answer' ELSE 'tool_call' END, 'tool_call', 'answer'] AS actions, c_nationkey AS n FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT *, list_filter([0, 1, 2], lambda i: actions[i + 1] = 'tool_call') AS calls FROM t)
SELECT task_id, f.range::INT AS fault, {HAZARDS}[f.range % 5 + 1] AS hazard, calls[f.range % len(calls) + 1]::INT AS step, 't' || (n + calls[f.range % len(calls) + 1]) AS tool FROM c, range(3) f""")
def f42_fault_schedule(spark, sf_dir):
    """Faults that strike the tool steps of tasks in turn."""
    key, n = F.col("c_custkey"), F.col("c_nationkey")
    step = lambda a, i: F.struct(a.alias("action"), F.concat(F.lit("t"), (n + i).cast("string")).alias("tool"))
    steps = F.array(step(F.when(key % 3 == 0, "answer").otherwise("tool_call"), 0), step(F.lit("tool_call"), 1), step(F.lit("answer"), 2))
    t = table(spark, sf_dir, "customer").select(key.alias("task_id"), F.when(key % 2 == 0, "tool_required").otherwise("no_tool").alias("category"), steps.alias("steps"))
    return T.fault_schedule(t, HAZARDS, 3)


@query("""WITH h AS (SELECT p_partkey, t, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256('42:' || p_partkey || ':' || t)) AS r FROM part, (VALUES ('a'), ('b'), ('c'), ('d')) v(t))
SELECT p_partkey AS id, list_sort(list(t || '=fn_' || r)) AS masks FROM h WHERE r <= 2 GROUP BY 1""")
def g18_name_masks(spark, sf_dir):
    m = T.masked(F.array(*map(F.lit, "abcda")), F.col("p_partkey"), 0.5, 42)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("masks"))


def replies(spark, sf_dir):
    """id and replies of which most break a rule."""
    i, fence = F.col("event_id"), "`" * 3
    good = '"evidence_ids": ["e1", "e2", "e1"], "reason": "seen"'
    texts = [
        f'{{"decision": "allow", "verdict": "approve", "confidence": 0.5, {good}}}', f'So: {{"decision": "maybe", "verdict": "maybe", "confidence": 1, {good}}}', f'{{"decision": "block", "verdict": "reject", "confidence": true, {good}}}',
        f'{{"decision": "review", "verdict": "approve", "confidence": 1.5, {good}}}', '{"decision": "allow", "verdict": "approve", "confidence": 1, "evidence_ids": ["e1", 2], "reason": "x"}', '{"decision": "allow", "verdict": "reject", "confidence": 0, "evidence_ids": [], "reason": "  "}',
        '{"decision": "allow", "verdict": "reject", "confidence": 0, "evidence_ids": [], "reason": "' + "x" * 401 + '"}', "nothing", f'{fence}json\n{{"decision": "block", "verdict": "insufficient_evidence", "confidence": 0, {good}}}\n{fence}',
    ]
    return table(spark, sf_dir, "events").select(i.alias("id"), F.get(F.array(*map(F.lit, texts)), (i % 9).cast("int")).alias("reply"))


@query("""SELECT event_id AS id, [NULL, 'invalid decision', 'confidence is no number', 'confidence out of range', 'evidence_ids are no list of strings', 'empty reason', 'reason too long', 'no JSON object', NULL][event_id % 9 + 1] AS flag_error,
  [NULL, 'invalid verdict', NULL, NULL, 'evidence_ids are no list of strings', 'empty reason', NULL, 'no JSON object', NULL][event_id % 9 + 1] AS verdict_error, CASE WHEN event_id % 9 IN (0, 8) THEN ['e1', 'e2'] END AS cited FROM events""")
def f17_result_errors(spark, sf_dir):
    """results of monitors that break a rule, ids that the others cite."""
    error = R.flag_result_error(F.col("reply"))
    return replies(spark, sf_dir).select("id", error.alias("flag_error"), R.verdict_result_error(F.col("reply")).alias("verdict_error"), F.when(error.isNull(), R.cited_ids(F.col("reply"))).alias("cited"))


@query("""SELECT event_id AS id, [NULL, 'invalid decision', 'risk_score is no integer from 0 to 100', 'risk_score is no integer from 0 to 100', 'violated_rule_id is no string', NULL][event_id % 6 + 1] AS error FROM events""")
def f19_risk_result_errors(spark, sf_dir):
    rest = '"evidence_event_ids": [], "reason": "r"}'
    texts = [f'{{"decision": "allow", "risk_score": 5, "violated_rule_id": null, {rest}', f'{{"decision": "no", "risk_score": 5, {rest}', f'{{"decision": "BLOCK", "risk_score": 101, {rest}', f'{{"decision": "BLOCK", "risk_score": true, {rest}', f'{{"decision": "Escalate", "risk_score": 0, "violated_rule_id": 4, {rest}', f'{{"decision": "Escalate", "risk_score": 100, "violated_rule_id": "r1", {rest}']
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get(F.array(*map(F.lit, texts)), (F.col("event_id") % 6).cast("int")).alias("reply"))
    return e.select("id", R.risk_result_error(F.col("reply")).alias("error"))


@query("""SELECT event_id AS id, [[], ['invalid label', 'reason must be non-empty'], ['invalid confidence', 'write_event_ids must be a list of strings']][event_id % 3 + 1] AS annotation_errors FROM events""")
def f21_annotation_errors(spark, sf_dir):
    """rules that annotations break."""
    lists = '"violated_rule_ids": [], "supporting_event_ids": ["a"]'
    notes = [f'{{"label": "safe", "confidence": "low", "write_event_ids": ["w"], "reason": "r", {lists}}}', f'{{"label": "x", "confidence": "high", "write_event_ids": [], "reason": " ", {lists}}}', f'{{"label": "safe", "confidence": 1, "write_event_ids": "w", "reason": "r", {lists}}}']
    pick = lambda texts: F.get(F.array(*map(F.lit, texts)), (F.col("event_id") % 3).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), pick(notes).alias("note"))
    return e.select("id", R.annotation_errors(F.col("note"), ["safe", "policy_breaking_write"]).alias("annotation_errors"))


@query("""WITH u AS (SELECT user_id, list_distinct(list('e' || event_id)) AS known, list('e' || (event_id + user_id % 2) ORDER BY event_id) AS cited, list(CASE WHEN value < 10 THEN '' ELSE event_type END ORDER BY event_id) AS texts FROM events GROUP BY 1)
SELECT user_id AS id, CASE WHEN user_id % 7 = 0 THEN ['summary must contain exactly the required keys'] ELSE list_concat(
  CASE WHEN user_id % 3 = 0 THEN ['user_request must be a string'] ELSE [] END,
  CASE WHEN user_id % 5 = 0 THEN ['key_facts must be a list'] ELSE flatten(list_transform(range(len(cited)), lambda i: list_concat(
    CASE WHEN texts[i + 1] = '' THEN ['key_facts[' || i || '].text must be non-empty'] ELSE [] END, CASE WHEN NOT list_contains(known, cited[i + 1]) THEN ['key_facts[' || i || '] has invalid source_event_ids'] ELSE [] END))) END,
  CASE WHEN user_id % 4 = 0 THEN ['state_changes[0] must contain text and source_event_ids'] ELSE [] END) END AS summary_errors FROM u""")
def f20_summary_errors(spark, sf_dir):
    """summaries of a user's events, which cite some that are none of theirs, and other faults."""
    i, user, event = F.col("event_id"), F.col("user_id"), lambda c: F.concat(F.lit("e"), c.cast("string"))
    fact = F.struct(i.alias("at"), F.when(F.col("value") < 10, "").otherwise(F.col("event_type")).alias("text"), F.array(event(i + user % 2)).alias("source_event_ids"))
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(event(i)).alias("known"), F.array_sort(F.collect_list(fact)).alias("facts"))  # the events of a user
    facts = F.to_json(F.transform("facts", lambda f: F.struct(f["text"].alias("text"), f["source_event_ids"].alias("source_event_ids"))))
    request = F.when(user % 3 == 0, user.cast("string")).otherwise(F.concat(F.lit('"user '), user.cast("string"), F.lit('"')))
    changes = F.when(user % 4 == 0, '[{"text": "t"}]').otherwise("[]")
    last = F.when(user % 7 == 0, "").otherwise(', "unresolved_or_risks": []')
    summary = F.concat(F.lit('{"user_request": '), request, F.lit(', "key_facts": '), F.when(user % 5 == 0, "{}").otherwise(facts), F.lit(', "actions_and_results": [], "state_changes": '), changes, last, F.lit("}"))
    return u.select(user.alias("id"), R.summary_errors(summary, F.col("known")).alias("summary_errors"))


@query("""WITH f AS (SELECT event_id, event_id % 10 AS f, event_type AS t, replace(props, ' ', '') AS p, 'look at ' || user_id AS w, value::VARCHAR AS v FROM events)
SELECT event_id AS id, CASE WHEN f IN (0, 1, 5, 6, 7) THEN 'tool_call' WHEN f IN (2, 8) THEN 'final_answer' WHEN f = 3 THEN 'clarify' WHEN f = 4 THEN 'abort' END AS type,
  CASE WHEN f IN (0, 1, 5, 6, 7) THEN t END AS name, CASE WHEN f IN (0, 1, 5, 6) THEN p WHEN f = 7 THEN '{}' END AS arguments, CASE WHEN f IN (2, 3, 4, 8) THEN w END AS text FROM f""")
def f15_actions(spark, sf_dir):
    """calls, answers, questions and ends in all forms that replies have; prose and calls without an object are none."""
    name, given, words = F.col("event_type"), F.col("props"), F.concat(F.lit("look at "), F.col("user_id").cast("string"))
    text = lambda form, *c: F.format_string(form, *c)
    forms = [
        text(' {"tool_call": {"name": "%s", "arguments": %s}}\n', name, given), text('I think {"function": {"name": "%s", "arguments": %s}} fits', name, given), text('{"final_answer": "%s"}', words),
        text('{"clarify": "%s", "abort": "no"}', words), text('{"abort": "%s"}', words), text('{"name": "%s", "parameters": %s}', name, given),
        text('x <tool_call>\n{"name": "%s", "arguments": %s}\n</tool_call> y', name, given), text('<tool_call>{"name": "%s"}</tool_call>', name), text("so: <final_answer> %s\n</final_answer>", words), words,
    ]
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get(F.array(*forms), (F.col("event_id") % 10).cast("int")).alias("reply"))
    return e.select("id", R.action(F.col("reply")).alias("a")).select("id", "a.type", "a.name", "a.arguments", "a.text")
