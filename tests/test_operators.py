"""Operators on small tables with stated outcomes, and those without SQL against brute force."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.functions import nested as N
from tracemill.functions import replies as R
from tracemill.operators import choices, episodes, ledgers, reviews, trails, training
from tracemill.plans import QUERIES, reviewing

SF = "/root/testdata/sf0.001"


def test_target_checks(spark):
    same = '{"order_id": "A", "entity_id": "A"}'
    rows = [(1, 5, same, '{"record_id": "A"}'), (2, 5, same, '{"order_id": "A"}'), (3, 5, same, '{"order_id": "B"}'), (4, 5, '{"order_id": "A", "record_id": "B"}', '{"order_id": "A"}'), (5, 5, same, same), (6, 5, "{}", same), (7, 5, same, same)]
    changes = [(1, 6, "A"), (2, 6, "C"), (3, 6, "A"), (4, 6, "A"), (5, 6, "A"), (5, 7, "C"), (6, 6, "A"), (7, 4, "A")]
    got = trails.target_checks(spark.createDataFrame(rows, "id int, approved_at int, approval string, proposal string"), spark.createDataFrame(changes, "id int, changed_at int, entity string"))
    assert {r["id"]: r["decision"] for r in got.collect()} == {1: "BLOCK", 2: "ALLOW", 3: "ESCALATE", 4: "ESCALATE", 5: "ESCALATE", 6: "ESCALATE", 7: "ESCALATE"}


EVENTS = "trajectory int, event_id string, ordinal int, turn int, kind string, role string, tool string, call_id string, content string, error boolean, anchors array<string>, arguments string"


def events(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], EVENTS)


def test_same_entity_writes(spark):
    rows = [("w1", 1, 0, "write", "assistant", "update", "a", None, False, ["#W1", "user-1"], "{}")]
    rows += [(f"m{k}", 1 + k, 0, "message", "user", None, None, "hi" if k != 3 else None, False, None, None) for k in range(1, 6)]
    rows += [("w2", 7, 1, "write", "assistant", "update", "b", None, False, ["#W2", "user-1"], "{}"), ("w3", 8, 1, "write", "assistant", "update", "c", None, False, ["#W1"], "{}")]
    got = {(r["earlier"], r["later"]): (r["shared"], r["gap_event_ids"]) for r in trails.same_entity_writes(events(spark, rows)).collect()}
    assert got == {("w1", "w2"): (["user-1"], ["m1", "m2", "m4", "m5"]), ("w1", "w3"): (["#W1"], ["m1", "m2", "m4", "m5", "w2"])}


def test_links_and_redundant_results(spark):
    rows = [
        ("c1", 1, 0, "call", "assistant", "lookup", "x", None, False, None, "{}"), ("c2", 2, 0, "call", "assistant", "lookup", "x", None, False, None, "{}"),
        ("r1", 3, 1, "result", "tool", None, "x", '{"a": 1, "b": 2}', False, None, None), ("r2", 4, 1, "result", "tool", None, None, '{"b":2,"a":1}', False, None, None), ("r3", 5, 1, "result", "tool", None, "gone", '{"b":2,"a":1}', True, None, None),
    ]
    e = events(spark, rows)
    assert {r["event_id"]: r["call_event_id"] for r in trails.linked_calls(e).collect()} == {"r1": "c2", "r2": None, "r3": None}
    assert [tuple(r) for r in trails.redundant_results(e).collect()] == [(1, "r2", "r1")]
    r = trails.trace_errors(e).first()
    assert (r["duplicate_call_ids"], r["results_without_id"], r["orphan_results"], r["passed"]) == (1, 1, 1, False)
    changed = e.withColumn("content", F.when(F.col("event_id") == "r1", '{"a": 9}').otherwise(F.col("content")))
    assert [r["event_id"] for r in trails.unfaithful_results(e, changed.filter("event_id <> 'r3'")).orderBy("event_id").collect()] == ["r1", "r3"]
    target = spark.createDataFrame([(1, 4)], "trajectory int, target int")
    assert [r["change"] for r in trails.replay_changes(e, changed, target).collect()] == ["pre_target"]


def test_patched_block(spark):
    rows = [(f"e{k}", k, 0, "message", "user", None, None, f"t{k}", False, None, None) for k in range(1, 5)]
    e = events(spark, rows)
    new = spark.createDataFrame([(1, "e2", "new")], "trajectory int, event_id string, new_content string")
    order = spark.createDataFrame([(1, "e2", 2), (1, "e3", 1)], "trajectory int, event_id string, place int")
    assert [(r["event_id"], r["content"]) for r in episodes.patched(e, new, order).orderBy("ordinal").collect()] == [("e1", "t1"), ("e3", "t3"), ("e2", "new"), ("e4", "t4")]
    with pytest.raises(Exception, match="contiguous"):
        episodes.patched(e, new, order.withColumn("event_id", F.when(F.col("place") == 1, "e4").otherwise("e2"))).collect()


def test_newest_response_counts(spark):
    """One scored row after a stale one; effect of the label 1, of the payload 0."""
    cell = "provider string, prompt string, case_id int, repeat_index int, exploratory boolean, line int, status string, decision string, evidence_ids array<string>"
    rows = [("m", "p", c, 0, False, c, "success", "block" if c % 2 else "allow", ["e1", "e9"]) for c in range(4)] + [("m", "p", 0, 0, False, -1, "error", None, None), ("m", "p", 99, 0, False, 1, "success", "allow", [])]
    gold = spark.createDataFrame([(c, 7, "corrupt" if c > 1 else "correct", "warning" if c % 2 else "verified", c > 1, ["e1"]) for c in range(4)], "case_id int, base_case_id int, payload_state string, self_label string, expected_flag boolean, relevant_ids array<string>")
    views = spark.createDataFrame([(c, False, ["e1", "e2"], ["e2"]) for c in range(4)], "case_id int, exploratory boolean, shown_ids array<string>, independent_ids array<string>")
    s = ledgers.scored(spark.createDataFrame(rows, cell), gold, views)
    got = {r["case_id"]: r for r in s.collect()}
    assert len(got) == 4 and got[0]["valid"] and (got[0]["n_cited"], got[0]["n_cited_shown"]) == (2, 1)
    assert got[0]["relevant_evidence_used"] and not got[0]["independent_evidence_used"] and got[3]["correct_decision"] and not got[1]["correct_decision"]
    assert ledgers.scored(spark.createDataFrame(rows, cell), gold, views, True).count() == 5
    flag = s.withColumn("flag", F.col("flagged").cast("int"))
    effect = lambda keys, axis, low, high: ledgers.pairs(flag, keys, F.col(axis), low, high, ["flag"], "line").agg(F.avg(F.col("after.flag") - F.col("before.flag"))).first()[0]
    assert effect(["base_case_id", "payload_state"], "self_label", "verified", "warning") == 1.0
    assert effect(["base_case_id", "self_label"], "payload_state", "correct", "corrupt") == 0.0


def test_complete_stability(spark):
    rows = [(c, k, d, v, d in ("review", "block"), True) for c, ds, v in [(1, ["block"] * 3, True), (2, ["block", "allow", "review"], True), (3, ["allow"] * 3, False), (4, ["allow"] * 2, True), (5, ["allow"] * 4, True)] for k, d in enumerate(ds)]
    df = spark.createDataFrame([("m", *r) for r in rows], "provider string, case_id int, line int, decision string, valid boolean, flagged boolean, expected_flag boolean")
    r = ledgers.complete_stability(df, ["provider"], ["case_id"]).first()
    assert (r["expected_cells"], r["complete_cells"], r["unanimous_rate"], r["pairwise_agreement"], r["majority_accuracy"]) == (5, 2, 0.5, 0.5, 1.0)


def test_percentile_intervals(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 12)], "v double")
    nearest, cut = (ledgers.percentile_interval(df, [], "v", t, 0.05, 0.95).first() for t in (False, True))
    assert (nearest["low"], nearest["high"]) == (1.0, 11.0)  # places 0.5 and 9.5, to even
    assert (cut["low"], cut["high"]) == (1.0, 11.0)
    assert ledgers.percentile_interval(df.limit(0), [], "v", True).count() == 0


def test_nested(spark):
    deep = {"a": {"b": [{"c": {"d": {"apiKey": "x", "n": -1.5}}}, None]}, "t": True, "id": "x1", "date": "2024"}
    other = {"a": {"b": [{"c": {"d": {"apiKey": "x", "n": 2}}}, None]}, "t": True, "id": "x1", "more": 1}
    row = spark.createDataFrame([(json.dumps(deep), json.dumps(other)), (None, "{}"), ("no json", "{}")], "j string, o string")
    leaves = N.leaves(F.col("j"))
    got = row.select(N.redacted(F.col("j")).alias("r"), N.pruned(F.col("j"), ("t",)).alias("p"), N.keys(F.col("j")).alias("k"), N.number_set(leaves).alias("n"), N.string_set(leaves).alias("s"), N.exposed(leaves).alias("x"), N.changed_paths(F.col("j"), F.col("o")).alias("c"), N.merged(F.col("j"), F.col("o")).alias("m")).collect()
    assert json.loads(got[0]["r"])["a"]["b"][0]["c"]["d"] == {"apiKey": "[REDACTED]", "n": -1.5}
    assert json.loads(got[0]["p"]) == {k: v for k, v in deep.items() if k != "t"}
    assert got[0]["k"] == ["a", "apiKey", "b", "c", "d", "date", "id", "more"][:7] + ["n", "t"]
    assert (got[0]["n"], got[0]["s"], got[0]["x"], got[0]["c"]) == ([1.5], ["2024"], ['"2024"', '"x"', "-1.5"], ["a.b", "date", "more"])
    assert json.loads(got[0]["m"]) == {**other, "date": "2024"}
    assert all(r["r"] is None and r["k"] is None for r in got[1:])


def test_call_failures(spark):
    one = lambda n, **a: json.dumps({"name": n, "arguments": a})
    rows = [(one("f", x=1), one("f", x=1), "match"), ("none", "none", "match"), ("none", one("f"), "spurious_call"), (one("f"), "none", "missing_required_arg"), (one("f"), one("g"), "wrong_function_name"), (one("f"), one("zz"), "hallucinated_function"),
            (one("f", x=1, y=2), one("f", x=1), "missing_required_arg"), (one("f", x=1), one("f", x=1, y=2), "wrong_argument_name"), (one("f", x=1), one("f", x=2), "wrong_argument_value"), (one("f"), f"[{one('f')}, {one('f')}]", "spurious_call")]
    df = spark.createDataFrame(rows, "e string, p string, want string")
    for r in df.select("want", R.call_failure(R.tool_calls(F.col("e")), R.tool_calls(F.col("p")), ["f", "g"]).alias("got")).collect():
        assert r["got"] == r["want"]


def test_planners(spark):
    tools = spark.createDataFrame([("a", ["x"], 10), ("b", ["x", "y"], 100), ("c", ["x", "y"], 10)], "name string, fields array<string>, base_latency_ms int")
    task = "task_id int, policy string, primary_tool string, fallback_tools array<string>, required_schema array<string>, attempted array<string>, last_status string, sequence array<string>, attempt_number int"
    rows = [(1, "schema_first", "a", ["b", "c", "z"], ["y"], ["b"], "schema_drift", [], 1), (2, "schema_first", "a", ["b", "c"], ["y"], [], None, ["q"], 1), (3, "retry", "a", ["b"], ["y"], ["a"], None, ["q"], 2), (4, "retry", "z", [], [], [], None, [], 1)]
    got = {r["task_id"]: tuple(r[c] for c in ("candidates", "next_compatible", "native", "heuristic", "minimal", "replayed")) for r in choices.chosen(spark.createDataFrame(rows, task), tools).collect()}
    assert got == {1: (["a", "b", "c"], "c", "c", "c", "a", "c"), 2: (["a", "b", "c"], "b", "b", "c", "a", "q"), 3: (["a", "b"], "b", "a", "b", "b", "a"), 4: ([], None, "", "", "", "")}


def test_balanced_picks(spark):
    rows = [r.asDict() for r in reviewing._candidates(spark, SF).collect()]
    want = []
    for domain in {r["domain"] for r in rows}:
        used, counts = set(), Counter()
        for k in range(15):
            left = [r for r in rows if r["domain"] == domain and r["task_id"] not in used]
            best = min(left, key=lambda r: (r["pool"], counts[r["agent"]], r["gap"], r["id"]))
            used.add(best["task_id"])
            counts[best["agent"]] += 1
            want.append((domain, k + 1, best["id"]))
    assert sorted((r["domain"], r["position"], r["id"]) for r in QUERIES["t04_balanced_picks"](spark, SF).collect()) == sorted(want)


def test_quota_wave(spark):
    rows = [(f"d{i % 2}", f"f{i % 3}", (i * 7) % 40, (i * 5) % 11, (i * 3) % 4) for i in range(240)]
    rows = list({(d, f, t): (d, f, t, k, s) for d, f, t, k, s in rows}.values())
    families, quota, want = ["f0", "f1", "f2"], 4, []
    for domain in ("d0", "d1"):
        used = set()
        for family in families:
            own = sorted((r for r in rows if r[:2] == (domain, family)), key=lambda r: (-r[4], r[3], r[2]))
            taken, tasks = [], set()
            for again in (False, True):
                for r in own:
                    if len(taken) < quota and r[2] not in used and (again or r[3] not in tasks):
                        taken.append(r[:3])
                        tasks.add(r[3])
                        used.add(r[2])
            want += taken
    got = reviews.quota_wave(spark.createDataFrame(rows, "domain string, family string, trajectory long, task_id long, score int"), families, quota)
    assert sorted((r["domain"], r["family"], r["trajectory"]) for r in got.collect()) == sorted(want)


def test_different_items_end_the_job(spark):
    a = spark.createDataFrame([(1, "safe")], "item int, label string")
    b = spark.createDataFrame([(2, "safe")], "item int, label string")
    with pytest.raises(Exception, match="different items"):
        reviews.merged_annotations(a, b, spark.createDataFrame([], "item int, final_label string")).collect()


def test_preferences_need_two_outputs(spark):
    df = spark.createDataFrame([(1, "do", None, ["a"])], "id int, instruction string, input string, output array<string>")
    with pytest.raises(Exception, match="two outputs"):
        training.preferences(df, "s").collect()


def test_cost_of_an_audit_is_exact(spark):
    """Costs whose sum lies between two rounded values; as doubles they add up to less in every order."""
    costs = [4.88e-06, 3.544e-05, 2.738e-05, 2.022e-05, 6.58e-06]
    ledger = spark.createDataFrame([(i, i, "success", True, "m", c) for i, c in enumerate(costs)], "call_id int, line int, status string, parsed boolean, model string, cost double")
    got = ledgers.ledger_audit(ledger.select("call_id", "model"), ledger, ["call_id"], "line", 0.5).first()
    assert (got["cost"], got["passed"]) == (0.000095, True)
