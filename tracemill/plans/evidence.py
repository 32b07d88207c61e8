"""What reasons name of the evidence, traces rewritten from other results, views held against one another, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import needles as D
from ..operators import registries as G
from ..operators import rewriting as W
from ..operators import supplements as S
from ..sources.tables import TOOL_EVENTS, table, tool_events
from .registry import query
from .reviewing import evidence
from .trails import LINKED, _mutated

text = lambda c: c.cast("string")

REASON_EVENTS = """e AS (SELECT *, (props->>'$.k')::BIGINT AS k FROM events),
v AS (SELECT user_id AS g, CASE WHEN event_id % 5 = 0 THEN 'subject_output' ELSE event_type || '_record' END AS event_id, event_type AS source, event_id % 3 = 0 AS required, k FROM e),
reasons AS (SELECT event_id AS id, user_id AS g, CASE event_id % 4 WHEN 0 THEN 'The ' || upper(event_type) || ' record lacks max_refund, see N' || k || 'x' WHEN 1 THEN 'whole was ' || k || '.0; list is ["b' || k || '", {"a": null, "z": 1}].' WHEN 2 THEN 'N' || (k + 1) || ' and unNote, notes' ELSE NULL END AS text FROM e),
names AS (SELECT g, lower(unnest([event_id, source, 'k', 'max_refund', 'whole', 'ok', 'note', 'list'])) AS n FROM v WHERE required),
handles AS (SELECT DISTINCT g, u AS needle FROM (SELECT g, unnest(list_concat([n, replace(n, '_', ' ')], list_filter(string_split_regex(n, '[_\\s]+'), lambda p: length(p) >= 4))) AS u FROM names) WHERE length(u) >= 4),
tokens AS (SELECT DISTINCT g, event_id, required, unnest(['k', 'max_refund', 'whole', 'ok', 'note', 'list', k::VARCHAR, (k % 4) || '.5', k || '.0', k::VARCHAR, 'n' || k, '["b' || k || '", {"a": null, "z": 1}]']) AS needle FROM v),
quotes AS (SELECT DISTINCT g, needle FROM tokens t WHERE required AND event_id <> 'subject_output' AND length(needle) >= 3 AND NOT EXISTS (SELECT 1 FROM tokens s WHERE s.g = t.g AND s.needle = t.needle AND s.event_id = 'subject_output')),
hit AS (SELECT id, kind, needle FROM reasons r JOIN (SELECT *, 'h' AS kind FROM handles UNION ALL SELECT *, 'q' FROM quotes) n USING (g) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(needle) || '([^a-z0-9]|$)'))"""


@query(f"""WITH {REASON_EVENTS}, h AS (SELECT id, list_sort(list(needle) FILTER (kind = 'h')) AS handles, list_sort(list(needle) FILTER (kind = 'q')) AS quoted FROM hit GROUP BY 1)
SELECT r.id, CASE WHEN len(handles) > 0 THEN 'specific' ELSE 'generic' END AS specificity, coalesce(handles, []) AS handles, coalesce(quoted, []) AS quoted FROM reasons r LEFT JOIN h USING (id)""")
def z65_reasons_and_evidence(spark, sf_dir):
    """What reasons name and quote of the evidence of their trace, by one automaton."""
    k, i, kind = F.get_json_object("props", "$.k"), F.col("event_id"), F.col("event_type")
    payload = F.format_string('{"k": %s, "max_refund": %s.5, "whole": %s.0, "ok": true, "note": "N%s", "list": ["b%s", {"z": 1, "a": null}]}', k, text(k.cast("long") % 4), k, k, k)
    rows = table(spark, sf_dir, "events")
    events = rows.select(F.col("user_id").alias("group"), F.when(i % 5 == 0, "subject_output").otherwise(F.concat(kind, F.lit("_record"))).alias("event_id"), kind.alias("source"), payload.alias("payload"), (i % 3 == 0).alias("required"))
    says = F.when(i % 4 == 0, F.format_string("The %s record lacks max_refund, see N%sx", F.upper(kind), k)).when(i % 4 == 1, F.format_string('whole was %s.0; list is ["b%s", {"a": null, "z": 1}].', k, k)).when(i % 4 == 2, F.format_string("N%s and unNote, notes", text(k.cast("long") + 1)))
    return D.reason_specificity(rows.select(i.alias("id"), F.col("user_id").alias("group"), says.alias("text")), events)


MUTATED = f"""{LINKED}, amounts AS (SELECT *, kind = 'result' AND event_id % 7 = 0 AS moved FROM linked),
mutated AS (SELECT *, CASE WHEN moved THEN '{{"amount": ' || (k % 5 + 7) || ', "ref": "R-10' || (k % 4 + CASE WHEN event_id % 2 = 0 THEN 4 ELSE 0 END) || '"}}' WHEN event_id % 5 = 0 THEN '{{"ref": "R-10' || k % 4 || '",  "amount": ' || k % 5 || '}}' ELSE content END AS now,
  error::VARCHAR || ' ' || CASE WHEN moved THEN (k % 5 + 7) || ' ' || (k % 4 + CASE WHEN event_id % 2 = 0 THEN 4 ELSE 0 END) ELSE k % 5 || ' ' || k % 4 END AS says FROM amounts),
pairs AS (SELECT trajectory, arg_min(event_id, ordinal) FILTER (call_event_id IS NULL) AS raw, min(event_id) FILTER (call_event_id IS NOT NULL) AS linked FROM amounts WHERE content IS NOT NULL GROUP BY trajectory, turn, error, k % 5, k % 4 HAVING count(call_event_id) = 1 AND count(*) > 1),
copies AS (SELECT p.trajectory, p.raw, p.linked, a.now AS raw_now, b.now AS linked_now, a.says AS raw_says, b.says AS linked_says FROM pairs p JOIN mutated a ON a.trajectory = p.trajectory AND a.event_id = p.raw JOIN mutated b ON b.trajectory = p.trajectory AND b.event_id = p.linked)"""


@query(f"{MUTATED} SELECT trajectory, raw AS event_id, linked_now AS content FROM copies WHERE raw_now <> linked_now")
def z36_synchronized_copies(spark, sf_dir):
    """Copies of results brought in line with what the linked ones say after a replay."""
    e = tool_events(spark, sf_dir)
    return W.synchronized(e, _mutated(e)).filter("synchronized").select("trajectory", "event_id", "content")


@query(f"{MUTATED} SELECT trajectory, raw AS raw_event_id, linked AS linked_event_id FROM copies WHERE raw_says <> linked_says OR raw % 31 = 0 OR linked % 31 = 0")
def z37_copy_conflicts(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    return W.copy_conflicts(e, _mutated(e).filter("event_id % 31 <> 0"))


@query(f"""{MUTATED}, w AS (SELECT trajectory, count(*)::INT AS n_events, list_sort(coalesce(list(event_id) FILTER (kind = 'write'), [])) AS write_event_ids FROM tool_events GROUP BY 1), s AS (SELECT trajectory, list_sort(list(raw)) AS ids FROM copies WHERE raw_now <> linked_now GROUP BY 1)
SELECT trajectory, CASE WHEN trajectory % 2 = 0 THEN 'synthetic_mutation' ELSE 'natural_safe_source' END AS provenance, n_events, write_event_ids, CASE WHEN trajectory % 2 = 0 THEN coalesce(ids, []) ELSE [] END AS synchronized_event_ids FROM w LEFT JOIN s USING (trajectory)""")
def z41_assembled_traces(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    traces = e.select("trajectory").distinct().withColumn("synthetic", F.col("trajectory") % 2 == 0)
    return W.assembled(traces, e, _mutated(e)).select("trajectory", "provenance", F.size("events").alias("n_events"), "write_event_ids", "synchronized_event_ids")


@query(f"""{LINKED}, asked AS (SELECT trajectory, event_id AS call, call_id FROM tool_events WHERE tool IS NOT NULL),
a AS (SELECT c.trajectory, c.call, l.* EXCLUDE (trajectory) FROM asked c JOIN linked l ON l.trajectory = c.trajectory AND (l.call_event_id = c.call OR l.call_id = c.call_id) WHERE l.content IS NOT NULL)
SELECT trajectory, call, arg_min(event_id, ordinal) AS result_event_id, arg_min(content, ordinal) AS content, arg_min(error, ordinal) AS error FROM a GROUP BY ALL""")
def z55_recorded_results(spark, sf_dir):
    e = tool_events(spark, sf_dir)
    return W.recorded_results(e, e.filter("tool is not null").select("trajectory", "event_id", "call_id"))


VIEWS = """WITH e AS (SELECT conv_id AS trace, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS last, length(text)::VARCHAR AS n, 's' || turn % 3 AS status FROM conversations)"""


def _views(spark, sf_dir):
    """Events of two views of each trace: all of them, and a summary of those that are no report, every other without its
    status."""
    e = evidence(spark, sf_dir).select("trace", "ordinal", "event_id", "source", "required", "payload")
    full = e.select("trace", F.lit("full").alias("view_type"), "ordinal", "event_id", "source", F.to_json("payload").alias("payload"))
    kept = F.when(F.col("ordinal") % 2 == 1, F.map_filter("payload", lambda k, v: k != "status")).otherwise(F.col("payload"))
    own = e.filter(F.col("event_id") != W.REPORT).select("trace", "ordinal", F.to_json(F.struct("event_id", kept.alias("payload"))).alias("item"))
    items = own.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("ordinal", "item"))).alias("items"))  # the events of one trace
    summary = items.select("trace", F.lit("summary").alias("view_type"), F.lit(0).alias("ordinal"), F.lit("handoff").alias("event_id"), F.lit(W.SUMMARIZER).alias("source"), F.concat(F.lit('{"summary": ['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}")).alias("payload"))
    report = full.filter(F.col("event_id") == W.REPORT).withColumn("view_type", F.lit("summary"))
    return e, full.unionByName(summary).unionByName(report)


@query(f"""{VIEWS} SELECT trace, v AS view_type, 'e' || turn AS event_id, CASE WHEN v = 'full' OR turn % 2 = 0 THEN [] ELSE ['"' || status || '"'] END AS hidden FROM e, (VALUES ('full'), ('summary')) x(v) WHERE turn % 4 = 1 AND NOT last""")
def z26_missing_values(spark, sf_dir):
    """Values of required records that a view doesn't show for the same event."""
    e, views = _views(spark, sf_dir)
    return W.missing_values(e.filter("required").select("trace", "event_id", F.to_json("payload").alias("payload")), views, ["trace", "view_type"])


@query(f"""{VIEWS}, t AS (SELECT trace, max(turn) AS last FROM e GROUP BY 1) SELECT trace, 'full' AS view_type, CASE WHEN trace % 7 = 0 THEN 'gone' WHEN trace % 11 = 0 THEN 'new' ELSE 'changed' END AS difference FROM t WHERE (trace % 7 = 0) <> (trace % 11 = 0) OR (trace % 5 = 0 AND trace % 7 <> 0 AND last > 0)""")
def z29_changed_views(spark, sf_dir):
    """Views whose evidence, but for the report, is not what it was: by a hash that the order of keys doesn't
    change."""
    e, views = _views(spark, sf_dir)
    full = views.filter("view_type = 'full'")
    event = lambda *names: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}": '), F.col(n) if n == "payload" else F.to_json(F.col(n).cast("variant"))) for n in names]), F.lit("}"))
    keys, report = ["trace", "view_type"], F.col("event_id") == W.REPORT
    t, last = F.col("trace"), full.groupBy("trace").agg(F.max("ordinal").alias("last"))
    old = full.filter(t % 11 != 0).withColumn("event", event("event_id", "source", "payload"))
    changed = full.join(last, "trace").withColumn("source", F.when((t % 5 == 0) & (F.col("ordinal") == 0) & (F.col("last") > 0), "x").otherwise(F.col("source")))
    new = changed.filter(t % 7 != 0).withColumn("event", event("payload", "source", "event_id"))
    some = lambda rows: rows.filter(~report)
    return W.carried_over(some(old), some(new), keys)


@query("""WITH r AS (SELECT 'stage' || o_custkey % 5 AS stage, o_orderkey AS case_id, o_orderstatus AS family FROM orders WHERE o_custkey % 5 IN (1, 2) AND o_orderkey % 3 = 0), c AS (SELECT 'stage' || o_custkey % 5 AS stage, o_orderkey AS case_id, 'F' AS family FROM orders WHERE o_orderkey % 2 = 0)
SELECT *, 'registry' AS origin FROM r UNION ALL SELECT *, 'config' FROM c WHERE c.stage NOT IN (SELECT stage FROM r)""")
def z44_stage_cases(spark, sf_dir):
    """Cases by stage, those of a registry in place of the configured ones."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("stage"), text(F.col("o_custkey") % 5)).alias("stage"), F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("family"), "o_custkey")
    registry = o.filter((F.col("o_custkey") % 5).isin(1, 2) & (F.col("case_id") % 3 == 0)).drop("o_custkey")
    return G.case_rows(o.filter("case_id % 2 = 0").drop("o_custkey").withColumn("family", F.lit("F")), registry)


@query("""WITH t AS (SELECT c_custkey AS trajectory FROM customer), safe AS (SELECT DISTINCT o_custkey AS trajectory FROM orders JOIN t ON o_custkey = trajectory WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0),
a AS (SELECT 'hardseed_' || substr(sha256('{"trajectory":' || trajectory || '}'), 1, 24) AS candidate_id, trajectory, 'merged_annotations' AS origin, 0 AS p, 0 AS line FROM safe UNION ALL
  SELECT 'c' || o_orderkey % 50, o_custkey, 'review_1', 1, o_orderkey FROM orders JOIN t ON o_custkey = trajectory WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'c' || o_orderkey % 80, o_custkey, 'review_2', 2, o_orderkey FROM orders JOIN t ON o_custkey = trajectory WHERE o_orderkey % 11 = 0)
SELECT candidate_id, arg_max(trajectory, (p, line)) AS trajectory, arg_max(origin, (p, line)) AS origin FROM a GROUP BY 1""")
def z47_accepted_candidates(spark, sf_dir):
    """Candidates from the labels, overridden by two later reviews."""
    o, traces = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trajectory"))
    labels = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("trajectory"), F.when(F.col("o_orderstatus") == "F", "safe").otherwise("ambiguous").alias("final_label"))
    review = lambda every, of: o.filter(F.col("o_orderkey") % every == 0).select(F.concat(F.lit("c"), text(F.col("o_orderkey") % of)).alias("candidate_id"), F.col("o_custkey").alias("trajectory"), F.col("o_orderkey").alias("line"))
    return G.accepted(traces, labels, [review(7, 50), review(11, 80)])


@query("""SELECT DISTINCT c_mktsegment AS domain, (c_nationkey % 9)::VARCHAR AS task_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 13 = 0 AND o_orderstatus <> 'O')""")
def z48_used_tasks(spark, sf_dir):
    """Tasks of the traces that a registry has used, reserve cases among them."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 13 = 0")
    case = F.array(F.struct(F.col("o_custkey").alias("trajectory")))
    registry = o.select(F.when(F.col("o_orderstatus") == "F", case).alias("cases"), F.when(F.col("o_orderstatus") == "P", case).alias("reserve_cases"))
    traces = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trajectory"), F.col("c_mktsegment").alias("domain"), (F.col("c_nationkey") % 9).alias("task_id"))
    return G.used_tasks(registry, traces)


FITS = """rows_ AS (SELECT o_orderstatus AS domain, (o_custkey % 40)::VARCHAR AS task_id, 'c' || o_orderkey AS candidate_id, 't' || o_orderkey AS trajectory, o_custkey % 40 % 9 = 0 AS reused_before,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 11 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS b FROM orders WHERE o_orderkey % 4 <> 0),
r AS (SELECT *, greatest(a, b) AS best, CASE WHEN b IS NULL OR a >= b THEN 'a' ELSE 'b' END AS best_family FROM rows_ WHERE a IS NOT NULL OR b IS NOT NULL)"""


def _pass(name: str, score: str, family: str, where: str, earlier: list[str], most: int, one_each: bool) -> str:
    """SQL of one pass over what earlier ones left."""
    had = " UNION ALL ".join(f"SELECT * FROM {e}" for e in earlier) or "SELECT ''::VARCHAR AS domain, ''::VARCHAR AS task_id, ''::VARCHAR AS candidate_id, ''::VARCHAR AS trajectory, ''::VARCHAR AS family, false AS task_reused, false AS reused_before, 0::BIGINT AS position WHERE false"
    first = f"QUALIFY row_number() OVER (PARTITION BY domain, task_id ORDER BY {score} DESC, trajectory, candidate_id) = 1" if one_each else ""
    unused = "AND (domain, task_id) NOT IN (SELECT (domain, task_id) FROM h)" if one_each else ""
    return f"""{name} AS (WITH h AS ({had}), n AS (SELECT domain, count(*) AS had FROM h GROUP BY 1), o AS (SELECT * FROM r WHERE {where} AND candidate_id NOT IN (SELECT candidate_id FROM h) {unused} {first}),
  k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {score} DESC, task_id, trajectory, candidate_id) AS rank FROM o)
  SELECT domain, task_id, candidate_id, trajectory, {family} AS family, (domain, task_id) IN (SELECT (domain, task_id) FROM h) AS task_reused, reused_before, coalesce(had, 0) + rank AS position FROM k LEFT JOIN n USING (domain) WHERE rank <= {most} AND rank <= 50 - coalesce(had, 0))"""


PASSES = [
    _pass("p1", "a", "'a'", "a IS NOT NULL AND NOT reused_before", [], 25, True), _pass("p2", "b", "'b'", "b IS NOT NULL AND NOT reused_before", ["p1"], 25, True),
    _pass("p3", "best", "best_family", "true", ["p1", "p2"], 50, True), _pass("p4", "best", "best_family", "true", ["p1", "p2", "p3"], 50, False),
]


@query(f"""WITH {FITS}, {", ".join(PASSES)} SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4""")
def t07_supplement(spark, sf_dir):
    """Family quotas over distinct tasks, then the best of what is left, with marks for tasks that are taken again."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    entry = lambda name, when, score: F.when(when, F.struct(F.lit(name).alias("key"), score.alias("value")))
    fits = F.map_from_entries(F.array_compact(F.array(entry("a", key % 2 == 0, cust % 11), entry("b", key % 3 == 0, key % 7))))
    o = table(spark, sf_dir, "orders").filter(key % 4 != 0)
    rows = o.select(F.col("o_orderstatus").alias("domain"), (cust % 40).alias("task_id"), F.concat(F.lit("c"), text(key)).alias("candidate_id"), F.concat(F.lit("t"), text(key)).alias("trajectory"), fits.alias("fits"), (cust % 40 % 9 == 0).alias("reused_before"))
    return S.supplement(rows, ["a", "b"], 50)


@query()
def t09_seed_mapping(spark, sf_dir):
    """Cases, the hardest families first, for candidates of the agents that were given least."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    candidates = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("domain"), F.concat(F.lit("c"), text(key)).alias("candidate_id"), (cust % 60).alias("task_id"), F.col("o_orderpriority").alias("agent"), (key % 4).alias("writes"), (cust % 17).alias("events"))
    cases = table(spark, sf_dir, "nation").select(F.get(F.array(*map(F.lit, "FOP")), (F.col("n_nationkey") % 3).cast("int")).alias("domain"), F.concat(F.lit("n"), text(F.col("n_nationkey"))).alias("case_id"), F.when(F.col("n_nationkey") % 4 == 0, "reserve").otherwise("primary").alias("role"), F.when(F.col("n_nationkey") % 2 == 0, "hidden").otherwise("stale").alias("family"))
    return S.seed_mapping(cases, candidates, ["hidden", "stale"], {"hidden": 3})
