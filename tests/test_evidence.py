"""Needles in texts, rewritten traces, views that are carried over, registries and selections, on small tables and
against brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.operators import needles as D
from tracemill.operators import registries as G
from tracemill.operators import rewriting as W
from tracemill.operators import supplements as S


# ---------------------------------------------------------------- needles


@pytest.mark.parametrize("characters", [4_000_000, 40])
def test_needles_equal_patterns(spark, characters):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abAB1_. é") for _ in range(rng.randrange(1, 5)))
    needles = [(g, w) for g in range(4) for w in {word() for _ in range(12)}] + [(0, ""), (1, None), (2, "a"), (2, "A"), (3, "(a+)"), (3, '["b", 1]')]
    texts = [(i, rng.randrange(5), " ".join(word() for _ in range(12))) for i in range(120)] + [(500, 2, None), (501, 3, 'x (A+) ["B", 1]'), (502, 3, ""), (503, 2, "A a 1a a1 -a-")]
    got = {(r["id"], r["needle"]) for r in D.found(spark.createDataFrame(texts, "id int, group int, text string"), spark.createDataFrame(needles, "group int, needle string"), characters).collect()}
    want = {(i, n) for i, g, t in texts for h, n in needles if t is not None and n and g == h and re.search(rf"(?<![a-z0-9]){re.escape(n.lower())}(?![a-z0-9])", t.lower())}
    assert got == want and len(want) > 100
    none = spark.createDataFrame([], "group int, needle string")
    assert D.found(spark.createDataFrame(texts, "id int, group int, text string"), none).count() == 0


def test_payload_tokens(spark):
    payloads = {
        '{"Order_Id": "W12", "n": 7, "x": 12.5, "whole": 3.0, "yes": true, "no": null, "s": "ab", "L": [1, {"B": "x", "A": null}], "O": {}}': {"order_id", "w12", "n", "7", "x", "12.5", "whole", "3", "3.0", "yes", "no", "s", "l", '[1, {"a": null, "b": "x"}]', "o", "{}"},
        '{"big": 1e3, "neg": -2.0, "small": 0.25}': {"big", "1000", "1000.0", "neg", "-2", "-2.0", "small", "0.25"}, "[1]": set(), "no json": set(), "{}": set(),
    }
    df = spark.createDataFrame([(k,) for k in payloads] + [(None,)], "p string")
    assert [set(r[0]) for r in df.select(D.payload_tokens(F.col("p"))).collect()] == [*payloads.values(), set()]


def test_reason_specificity(spark):
    event = lambda e, source, required, payload: (1, e, source, json.dumps(payload), required)
    events = [event("order_record", "orders", True, {"max_refund": 40, "note": "late"}), event("subject_output", "agent", False, {"max_refund": 40}), event("other", "misc", False, {"secret": "zzz"})]
    e = spark.createDataFrame(events, "group int, event_id string, source string, payload string, required boolean")
    reasons = ["The Order Record is gone", "only a summary", "says 40 and late", "max refund?", "maxrefund", None, "secret zzz of misc"]
    got = {r["id"]: (r["specificity"], r["handles"], r["quoted"]) for r in D.reason_specificity(spark.createDataFrame([(i, 1, t) for i, t in enumerate(reasons)], "id int, group int, text string"), e).collect()}
    assert got == {
        0: ("specific", ["order", "order record", "record"], []), 1: ("generic", [], []), 2: ("generic", [], ["late"]), 3: ("specific", ["max refund", "refund"], []),
        4: ("generic", [], []), 5: ("generic", [], []), 6: ("generic", [], []),
    }


# ---------------------------------------------------------------- rewriting

EVENTS = "trajectory int, event_id string, ordinal int, turn int, kind string, role string, tool string, call_id string, content string, error boolean"


def copies():
    """A call whose result stands twice: as raw text and linked to the call; and another call without a copy."""
    return [
        (1, "c1", 1, 0, "call", "assistant", "look", "x", None, False), (1, "raw", 2, 0, "result", "tool", None, None, '{"a": 1, "b": 2}', False), (1, "linked", 3, 0, "result", "tool", None, "x", '{"b":2,"a":1}', False),
        (1, "c2", 4, 1, "write", "assistant", "set", "y", None, False), (1, "alone", 5, 1, "result", "tool", None, "y", "done", False),
    ]


def test_copies_follow_a_replay(spark):
    source = spark.createDataFrame(copies(), EVENTS)
    put = lambda new: spark.createDataFrame([(*e[:8], new.get(e[1], e[8]), e[9]) for e in copies() if new.get(e[1], "") is not None], EVENTS)
    of = lambda df: {r["event_id"]: (r["content"], r["synchronized"]) for r in df.collect()}
    conflicts = lambda df: [tuple(r) for r in W.copy_conflicts(source, df).collect()]
    replayed = put({"linked": '{"a": 9}'})
    assert conflicts(replayed) == [(1, "raw", "linked")]
    fixed = W.synchronized(source, replayed)
    assert of(fixed) == {"c1": (None, False), "raw": ('{"a": 9}', True), "linked": ('{"a": 9}', False), "c2": (None, False), "alone": ("done", False)}
    assert conflicts(fixed) == [] and conflicts(source) == []
    # what says the same in another form is no conflict, yet brought in line; a copy that is gone is a conflict, and left alone
    assert conflicts(put({"linked": '{"b": 2, "a": 1}'})) == [] and of(W.synchronized(source, put({"linked": '{"b": 2, "a": 1}'})))["raw"] == ('{"b": 2, "a": 1}', True)
    gone = put({"linked": None})
    assert conflicts(gone) == [(1, "raw", "linked")] and not any(s for _, s in of(W.synchronized(source, gone)).values())
    assert conflicts(put({"raw": None})) == [(1, "raw", "linked")]


def test_assembled(spark):
    source = spark.createDataFrame(copies() + [(2, *e[1:]) for e in copies()], EVENTS)
    replayed = source.withColumn("content", F.when(F.col("event_id") == "linked", "new").otherwise(F.col("content")))
    traces = spark.createDataFrame([(1, True, "retail"), (2, False, "airline")], "trajectory int, synthetic boolean, domain string")
    got = {r["trajectory"]: r for r in W.assembled(traces, source, replayed).collect()}
    content = lambda r: {e["event_id"]: e["content"] for e in r["events"]}
    assert content(got[1])["raw"] == "new" and content(got[2])["raw"] == '{"a": 1, "b": 2}'
    assert (got[1]["synchronized_event_ids"], got[2]["synchronized_event_ids"]) == (["raw"], [])
    assert (got[1]["provenance"], got[2]["provenance"], got[1]["write_event_ids"], got[1]["domain"]) == ("synthetic_mutation", "natural_safe_source", ["c2"], "retail")
    assert [e["event_id"] for e in got[1]["events"]] == ["c1", "raw", "linked", "c2", "alone"]


def test_recorded_and_replaced_results(spark):
    rows = copies() + [(1, "again", 6, 1, "result", "tool", None, "x", "second", True), (1, "empty", 0, 0, "result", "tool", None, "y", None, False)]
    e = spark.createDataFrame(rows, EVENTS)
    calls = e.filter("tool is not null").select("trajectory", "event_id", "call_id")
    got = {r["call"]: (r["result_event_id"], r["content"], r["error"]) for r in W.recorded_results(e, calls).collect()}
    assert got == {"c1": ("linked", '{"b":2,"a":1}', False), "c2": ("alone", "done", False)}
    new = spark.createDataFrame([(1, "c1", "x", 1, "other", True)], "trajectory int, event_id string, call_id string, ordinal int, new_content string, new_error boolean")
    after = {r["event_id"]: (r["content"], r["error"]) for r in W.with_results(e, new).collect()}
    assert after == {**{r[1]: (r[8], r[9]) for r in rows}, "linked": ("other", True), "again": ("other", True)}


def test_records_and_views(spark):
    summary = json.dumps({"summary": [{"event_id": "e1", "payload": {"n": 1}}, {"event_id": 5, "payload": {}}, "x", {"event_id": "e1", "payload": {"n": 2}}, {"event_id": "e3"}]})
    views = spark.createDataFrame([("t", "v", 0, "e1", "a", '{"n": 7, "ok": true}'), ("t", "v", 1, "s", "handoff_summarizer", summary), ("t", "v", 2, "e2", "a", None), ("t", "w", 0, "e1", "a", '{"n": 7}'), ("t", "w", 1, "s", "handoff_summarizer", "oops")], "trace string, view_type string, ordinal int, event_id string, source string, payload string")
    got = {(r["view_type"], r["event_id"]): r["payload"] for r in W.records(views, ["trace", "view_type"]).collect()}
    assert got == {("v", "e1"): '{"n":2}', ("v", "e2"): "{}", ("v", "e3"): "{}", ("w", "e1"): '{"n": 7}'}
    required = spark.createDataFrame([("t", "e1", '{"n": 7, "status": "late", "order_id": "W1", "ok": true}'), ("t", "e9", '{"n": 1}')], "trace string, event_id string, payload string")
    hidden = {(r["view_type"], r["event_id"]): r["hidden"] for r in W.missing_values(required, views, ["trace", "view_type"]).collect()}
    assert hidden == {("v", "e1"): ['"late"', "7"], ("v", "e9"): ["1"], ("w", "e1"): ['"late"'], ("w", "e9"): ["1"]}


def test_carried_over(spark):
    make = lambda rows: spark.createDataFrame(rows, "trace int, ordinal int, event string")
    old = [(1, 0, '{"a": 1, "b": [1, 2]}'), (1, 1, '{"c": "x"}'), (2, 0, '{"a": 1}'), (3, 0, "no json"), (4, 0, '{"a":1}'), (5, 0, '{"a":1}'), (5, 1, '{"b":1}')]
    new = [(1, 1, '{"c": "x"}'), (1, 0, '{"b": [1, 2], "a": 1}'), (2, 0, '{"a": 2}'), (3, 0, "no jsom"), (6, 0, "{}"), (5, 0, '{"b":1}'), (5, 1, '{"a":1}')]
    assert {(r["trace"], r["difference"]) for r in W.carried_over(make(old), make(new), ["trace"]).collect()} == {(2, "changed"), (3, "changed"), (4, "gone"), (6, "new"), (5, "changed")}
    assert W.carried_over(make(old), make(old[::-1]), ["trace"]).count() == 0
    assert W.carried_over(make([]), make([]), ["trace"]).count() == 0


# ---------------------------------------------------------------- registries


def test_case_rows(spark):
    config = spark.createDataFrame([("core", "c1"), ("core", "c2"), ("smoke", "s1")], "stage string, case_id string")
    registry = spark.createDataFrame([("core", "r1"), ("supplement", "p1")], "stage string, case_id string")
    of = lambda rows: {(r["stage"], r["case_id"], r["origin"]) for r in rows.collect()}
    assert of(G.case_rows(config, registry)) == {("core", "r1", "registry"), ("supplement", "p1", "registry"), ("smoke", "s1", "config")}
    assert of(G.case_rows(config, registry.limit(0))) == {("core", "c1", "config"), ("core", "c2", "config"), ("smoke", "s1", "config")}
    with pytest.raises(Exception, match="registry has no cases: supplement2"):
        G.case_rows(config.unionByName(spark.createDataFrame([("supplement2", "x")], config.schema)), registry).collect()


def test_accepted_and_used(spark):
    traces = spark.createDataFrame([("t1", "retail", 1), ("t2", "retail", 2), ("t3", "air", 1)], "trajectory string, domain string, task_id int")
    labels = spark.createDataFrame([("t1", "safe"), ("t2", "ambiguous"), ("gone", "safe")], "trajectory string, final_label string")
    first = spark.createDataFrame([("h1", "t2", 1), ("h1", "t3", 2), ("h2", "unknown", 3)], "candidate_id string, trajectory string, line long")
    second = spark.createDataFrame([("h1", "t1", 1)], "candidate_id string, trajectory string, line long")
    rows = G.accepted(traces, labels, [first]).collect()
    assert {(r["trajectory"], r["origin"]) for r in rows} == {("t1", "merged_annotations"), ("t3", "review_1")} and len(rows) == 2
    own = next(r["candidate_id"] for r in rows if r["origin"] == "merged_annotations")
    assert {(r["candidate_id"], r["trajectory"], r["origin"]) for r in G.accepted(traces, labels, [first, second]).collect()} == {("h1", "t1", "review_2"), (own, "t1", "merged_annotations")}
    case = "array<struct<trajectory: string>>"
    registry = spark.createDataFrame([([("t1",), (None,)], [("t3",)]), (None, [("unknown",)])], f"cases {case}, reserve_cases {case}")
    assert {r[0] for r in G.used_trajectories([registry, registry]).collect()} == {"t1", "t3", "unknown"}
    assert {tuple(r) for r in G.used_tasks(registry, traces).collect()} == {("retail", "1"), ("air", "1")}


# ---------------------------------------------------------------- selections


def plain_supplement(rows, families, n):
    """One row after the other, as the passes are stated."""
    out = []
    for domain in sorted({r["domain"] for r in rows}):
        own, picked, tasks = [r for r in rows if r["domain"] == domain and r["fits"]], set(), set()
        here = []

        def pick(r, family):
            here.append((domain, r["candidate_id"], family, r["task_id"] in tasks, r["reused_before"]))  # noqa: B023
            picked.add(r["candidate_id"])  # noqa: B023
            tasks.add(r["task_id"])  # noqa: B023

        for f in families:
            added = 0
            for r in sorted((r for r in own if f in r["fits"]), key=lambda r: (-r["fits"][f], r["task_id"], r["trajectory"])):
                if added < max(1, n // len(families)) and len(here) < n and r["candidate_id"] not in picked and r["task_id"] not in tasks and not r["reused_before"]:
                    pick(r, f)
                    added += 1
        best = lambda r: max(families, key=lambda f: (r["fits"].get(f, -1), -families.index(f)))
        for again in (False, True):
            for r in sorted(own, key=lambda r: (-max(r["fits"].values()), r["task_id"], r["trajectory"])):
                if len(here) < n and r["candidate_id"] not in picked and (again or r["task_id"] not in tasks):
                    pick(r, best(r))
        out += [(*x, i) for i, x in enumerate(here, 1)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_supplement(spark, seed):
    rng = random.Random(seed)
    families = ["hidden", "order", "stale"][: 1 + seed % 3]
    rows = [
        {"domain": rng.choice(["air", "retail"]), "task_id": str(rng.randrange(12)), "candidate_id": f"c{i:03d}", "trajectory": f"t{i:03d}", "reused_before": rng.random() < 0.2, "fits": {f: rng.randrange(6) for f in families if rng.random() < 0.5}}
        for i in range(60)
    ]
    df = spark.createDataFrame([(r["domain"], r["task_id"], r["candidate_id"], r["trajectory"], r["fits"], r["reused_before"]) for r in rows] + [(None, "1", "x", "x", {}, False)], "domain string, task_id string, candidate_id string, trajectory string, fits map<string,int>, reused_before boolean")
    for n in (3, 9, 40):
        got = sorted((r["domain"], r["candidate_id"], r["family"], r["task_reused"], r["reused_before"], r["position"]) for r in S.supplement(df, families, n).collect())
        assert got == sorted(plain_supplement(rows, families, n)), n
    assert S.supplement(df.limit(0), families, 3).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_seed_mapping(spark, seed):
    rng = random.Random(seed)
    candidates = [(rng.choice("AB"), f"c{i:03d}", rng.randrange(15), rng.choice(["x", "y", "z", None]), rng.randrange(5), rng.randrange(9)) for i in range(80)]
    cases = [(rng.choice("ABC"), f"n{i:02d}", rng.choice(["primary", "reserve"]), rng.choice(["hidden", "stale", "other"])) for i in range(25)]
    least, priority = {"hidden": 3, "stale": 2}, ["hidden", "stale"]
    used, given, want = set(), {}, {}
    for domain, case, _role, family in sorted(cases, key=lambda c: (c[0], priority.index(c[3]) if c[3] in priority else 9, c[2] != "primary", c[1])):
        able = [c for c in candidates if c[0] == domain and (domain, c[2]) not in used and c[4] >= least.get(family, 1)]
        pick = min(able, key=lambda c: (given.get(c[3] or "", 0), -c[4], -c[5], c[1]), default=None)
        want[case] = pick and pick[1]
        if pick:
            used.add((domain, pick[2]))
            given[pick[3] or ""] = given.get(pick[3] or "", 0) + 1
    c = spark.createDataFrame(candidates, "domain string, candidate_id string, task_id int, agent string, writes int, events int")
    got = {r["case_id"]: r["candidate_id"] for r in S.seed_mapping(spark.createDataFrame(cases, "domain string, case_id string, role string, family string"), c, priority, least).collect()}
    assert got == want and None in want.values() and any(want.values())
