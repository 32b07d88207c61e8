"""Cases, configurations, seeds and audits on small tables, with what ends the job."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import cases as C
from tracemill.operators import reviews as V


def one(spark, column, *values, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_eval_cases(spark):
    t = F.col("t")
    assert one(spark, C.eval_cases(t), '{"cases": [{"b": 1, "a": 2}, {}]}') == [['{"a":2,"b":1}', "{}"]]
    for bad, message in [("[1]", "must be an object"), ("oops", "must be an object"), (None, "must be an object"), ("{}", "must hold a list"), ('{"cases": []}', "must hold a list"), ('{"cases": {}}', "must hold a list")]:
        with pytest.raises(Exception, match=message):
            one(spark, C.eval_cases(t), bad)


def test_case_mismatches(spark):
    runs = spark.createDataFrame([("p", 1, ["a", "b", "c"]), ("p", 2, []), ("q", 2, ["x"]), ("q", 3, ["a"]), ("q", 9, ["a"]), ("r", 1, None)], "policy string, task_id int, tools array<string>")
    cases = spark.createDataFrame([(1, 1, "old", ["z"]), (1, 2, "a", ["a", "", "b"]), (2, 1, "x", None), (3, 1, "", ["a"])], "task_id int, line int, expected_first string, expected_sequence array<string>")
    got = {(r["policy"], r["task_id"]): (r["called_first"], r["called_prefix"]) for r in C.case_mismatches(runs, cases).collect()}
    assert got == {("p", 2): ("", []), ("q", 2): ("x", ["x"]), ("q", 3): ("a", ["a"]), ("r", 1): ("", [])}


def test_actions(spark):
    raw = ["FINAL", "which?", {"type": "call", "name": "f", "b": [1], "a": None}, [{"type": "answer"}, [{"type": "clarify", "text": "c"}, "FINAL"]], {"type": "abort", "reason": "r"}, {"type": "x"}, {"name": "n"}, 5, None]
    got = one(spark, C.actions(F.col("t")), json.dumps(raw), "[]", None, "no json")
    no = None
    assert [tuple(a) for a in got[0]] == [("final_answer", no, no, ""), ("clarify", no, no, "which?"), ("tool_call", "f", '{"a":null,"b":[1]}', no), ("final_answer", no, no, ""), ("clarify", no, no, "c"), ("final_answer", no, no, ""), ("abort", no, no, "r")]
    assert got[1:] == [[], [], []]


def test_run_config(spark):
    whole = {"seed": 4, "max_attempts": "3", "default_timeout_ms": 1, "time_budget_ms": 2, "base_backoff_ms": 3, "backoff_jitter_ms": 4, "policies": ["x"], "cost": {"base_per_call_usd": 1, "per_ms_usd": 0.5}, "fault_probabilities": {"timeout": 0.25}, "policy_overrides": {"p": {"b": 1, "a": 2}}}
    got = one(spark, C.run_config(F.col("t")), json.dumps(whole), json.dumps({**whole, "retryable_faults": [], "policy_overrides": None, "fault_probabilities": {}}))
    assert (got[0]["seed"], got[0]["max_attempts"], got[0]["base_per_call_usd"], got[0]["fault_probabilities"], got[0]["retryable_faults"], got[0]["policy_overrides"]) == (4, 3, 1.0, {"timeout": 0.25}, C.RETRYABLE, '{"p":{"a":2,"b":1}}')
    assert (got[1]["retryable_faults"], got[1]["policy_overrides"], got[1]["fault_probabilities"]) == ([], "{}", {})
    for name in ("seed", "policies", "cost"):
        with pytest.raises(Exception, match="run configuration lacks"):
            one(spark, C.run_config(F.col("t")), json.dumps({k: v for k, v in whole.items() if k != name}))


def test_seeds(spark):
    traces = spark.createDataFrame([("t1", "air", ["e"])], "trajectory string, domain string, events array<string>")
    families = spark.createDataFrame([("stale", {"air": "r1"}, None, 2)], "family string, allowed_target_rules map<string,string>, min_source_writes int, min_target_write_rank int")
    cases = lambda *rows: spark.createDataFrame(rows, "case_id string, trajectory string, family string")
    r = C.enriched_seeds(cases(("c1", "t1", "stale")), traces, families, "smoke").first()
    assert (r["case_role"], r["allowed_target_rules"], r["min_source_writes"], r["min_target_write_rank"], r["events"]) == ("primary", "r1", 1, 2, ["e"])
    for row, message in [(("c2", "gone", "stale"), "c2: unknown trajectory"), (("c3", "t1", "other"), "c3: unknown family")]:
        with pytest.raises(Exception, match=message):
            C.enriched_seeds(cases(row), traces, families, "core").collect()


def test_embedded_differences(spark):
    make = lambda rows: spark.createDataFrame(rows, "domain string, id int, task string")
    a = make([("d", 1, '{"x": 1, "y": null}'), ("d", 2, '{"x": 1}'), ("d", 3, "{}"), ("d", 5, None), ("d", 6, None)])
    b = make([("d", 1, '{"ticket": 5, "x": 1}'), ("d", 2, '{"x": {"y": 1}}'), ("d", 4, "{}"), ("d", 5, None), ("d", 6, "{}")])
    assert {(r["id"], r["difference"]) for r in C.embedded_differences(a, b, ("ticket",)).collect()} == {(2, "changed"), (3, "new"), (4, "gone"), (6, "changed")}


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "gold")], "id int, text string, label string")
    none = spark.createDataFrame([], "subject string, error string")
    with pytest.raises(ValueError, match="the audit did not pass"):
        C.export(rows, spark.createDataFrame([("1", "bad")], none.schema), ["label"], str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    C.export(rows, none, ["label"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["id", "text"]
    with pytest.raises(Exception, match="(?i)exists"):
        C.export(rows, none, ["label"], str(tmp_path / "out"))


def test_picks_of_too_few_tasks(spark):
    rows = spark.createDataFrame([("d", 1, "a", 0, 5, 1), ("d", 1, "b", 0, 4, 2), ("d", 2, "a", 0, 3, 3)], "domain string, task_id long, agent string, pool int, gap long, id long")
    assert [r["id"] for r in V.balanced_picks(rows, 2, strict=True).orderBy("position").collect()] == [3, 2]
    assert V.balanced_picks(rows, 3).count() == 2
    with pytest.raises(Exception, match="only 2 different tasks of 3 in d"):
        V.balanced_picks(rows, 3, strict=True).collect()
    assert [r["id"] for r in V.spare_picks(rows, V.balanced_picks(rows, 2), 2).collect()] == [1]


def test_reviewed_selection(spark):
    packets = spark.createDataFrame([(1, "d", "f", "t1", 5), (2, "d", "f", "t1", 9), (3, "d", "f", "t2", 1), (4, "d", "g", "t3", 1)], "id int, domain string, family string, task_id string, score int")
    reviews = lambda *rows: spark.createDataFrame(rows, "id int, line int, accepted boolean")
    got = C.reviewed_selection(packets, reviews((1, 1, True), (2, 1, True), (2, 2, False), (3, 1, False), (3, 2, True)), 1)
    assert [(r["family"], r["id"]) for r in got.collect()] == [("f", 1)]
    with pytest.raises(Exception, match="in no packet: 9"):
        C.reviewed_selection(packets, reviews((9, 1, True)), 1).collect()


def test_frozen_sets(spark):
    make = lambda *rows: spark.createDataFrame(rows, "id int, domain string, task_id int")
    got = {tuple(r) for r in C.frozen_errors(make((1, "a", 1), (1, "a", 2), (2, "b", 3)), make((2, "z", 9), (7, "a", 1)), {"a": 2, "c": 1}).collect()}
    assert got == {("row count", "b"), ("row count", "c"), ("duplicate id", "1"), ("frozen id", "2"), ("frozen task", "a:1")}
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "case_id string")
    assert {tuple(r) for r in C.registration_errors(keys("a", "b", "b", "x"), keys("a", "b", "c"), "case_id").collect()} == {("b", "twice"), ("x", "unexpected"), ("c", "missing")}
