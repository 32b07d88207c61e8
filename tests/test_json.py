"""Nested JSON, replies and responses, in the forms that they come in and in others."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import nested as N
from tracemill.functions import replies as R
from tracemill.operators import audits as A



def T():
    return F.col("t")


DEEP = '{"a":' * 50 + "1" + "}" * 50
#: Texts that are no JSON here: null, prose, more than a value, a key twice, half a surrogate pair, too deep.
NONE = [None, "", "prose", "1 apple", '{"a":1} {"b":2}', '{"a":1,"a":2}', '"\\ud800"', '["\\udc00x"]', "[" * 100_000 + "]" * 100_000, "NaN", "{"]


def rows(spark, texts, *columns, schema="i int, t string"):
    df = spark.createDataFrame([(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)], schema)
    return [tuple(r) for r in df.select("i", *columns).orderBy("i").drop("i").collect()]


def python_plan(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Python" in plan or "ArrowEval" in plan


def walk(v, path="", key=None, lists=True):
    if isinstance(v, dict):
        return [x for k in sorted(v) for x in walk(v[k], f"{path}.{k}" if path else k, k, lists)]
    if isinstance(v, list) and lists:
        return [x for y in v for x in walk(y, path, key, lists)]
    return [(path, key, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False))]


def made(rng, depth=0):
    n = rng.random()
    if depth < 5 and n < 0.35:
        return {rng.choice(["a", "b", "x_key", "Token", "id", "n"]) + str(rng.randrange(3)): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 5 and n < 0.55:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, -7, 12, "", "é\n\"\\", "a1b2", "plain", "😀"])


@pytest.fixture(scope="module")
def values():
    rng = random.Random(8)
    return [made(rng) for _ in range(300)]


def test_walks_equal_recursion(spark, values):
    got = rows(spark, [json.dumps(v) for v in values], N.leaves(T()), N.leaves(T(), False), N.keys(T()))
    every = lambda v: set(v) | {k for x in v.values() for k in every(x)} if isinstance(v, dict) else {k for x in v for k in every(x)} if isinstance(v, list) else set()
    for v, (all_, lists, keys) in zip(values, got, strict=True):
        assert [(x.path, x.key, x.value) for x in all_] == walk(v)
        assert [(x.path, x.key, x.value) for x in lists] == walk(v, lists=False)
        assert keys == sorted(every(v))


def test_rewriting_equals_recursion(spark, values):
    def clean(v):
        return {k: clean(x) for k, x in v.items() if k not in ("a0", "n1") and x is not None} if isinstance(v, dict) else [clean(x) for x in v] if isinstance(v, list) else v

    def hide(v):
        return {k: "[REDACTED]" if "key" in k.lower() or "token" in k.lower() else hide(x) for k, x in v.items()} if isinstance(v, dict) else [hide(x) for x in v] if isinstance(v, list) else v

    def both(a, b):
        return {k: both(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}} if isinstance(a, dict) and isinstance(b, dict) else b

    def differ(a, b, path=""):
        if isinstance(a, dict) and isinstance(b, dict):
            return [p for k in {**a, **b} for q in [f"{path}.{k}" if path else k] for p in ([q] if (k in a) != (k in b) else differ(a[k], b[k], q))]
        return [path] if json.dumps(a, sort_keys=True) != json.dumps(b, sort_keys=True) else []

    dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    others = values[1:] + values[:1]
    got = rows(spark, [(json.dumps(a), json.dumps(b)) for a, b in zip(values, others, strict=True)], N.pruned(T(), ("a0", "n1")), N.redacted(T()), N.merged(T(), F.col("u")), N.changed_paths(T(), F.col("u")), schema="i int, t string, u string")
    for a, b, r in zip(values, others, got, strict=True):
        assert r == (dump(clean(a)), dump(hide(a)), dump(both(a, b)), sorted(differ(a, b)))


def test_depth_and_what_is_no_json(spark):
    columns = [N.leaves(T()), N.keys(T()), N.redacted(T()), N.pruned(T(), ()), N.merged(T(), F.lit("{}")), N.replaced(T(), "a", F.lit("1")), N.canonical(T()), N.changed_paths(T(), T())]
    assert rows(spark, NONE, *columns) == [(None,) * len(columns)] * len(NONE)
    got = rows(spark, [DEEP, '"\\ud83d\\ude00 \\\\ud800"'], N.leaves(T()), N.canonical(T()))
    assert got[0][0][0].path == ".".join("a" * 50) and got[0][1] == DEEP
    assert got[1][1] == '"😀 \\\\ud800"'


def test_paths(spark):
    texts = ['{"b":{"c":1,"z":null},"a":[1]}', '{"b":5}', '{"b":null}', "{}", "[1]"]
    assert rows(spark, texts, N.replaced(T(), "b.c", F.lit('{"n":[2]}')), N.replaced(T(), "x", F.lit("null")), N.replaced(T(), "b", F.lit("oops"))) == [
        ('{"a":[1],"b":{"c":{"n":[2]},"z":null}}', '{"a":[1],"b":{"c":1,"z":null},"x":null}', None), (None, '{"b":5,"x":null}', None), (None, '{"b":null,"x":null}', None), (None, '{"x":null}', None), (None, None, None),
    ]


def test_no_python_workers(spark):
    from tracemill.plans import QUERIES

    for name in ("f03_redacted", "f04_nested_keys", "f05_leaves", "f06_leaf_sets", "f07_exposed_scalars", "f08_changed_paths", "f09_paths", "f14_tool_calls", "f15_actions", "f38_mined_failures", "p09_deep_merge", "p11_pruned"):
        assert not python_plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_actions(spark):
    call = lambda name, arguments="{}": ("tool_call", name, arguments, None)
    text = lambda kind, t: (kind, None, None, t)
    forms = {
        '{"tool_call": {"name": "find", "arguments": {"b": [1], "a": null}}}': call("find", '{"a":null,"b":[1]}'), '{"tool_call": {}}': call(""), '{"function": {"name": "f"}}': call("f"),
        '{"final_answer": "done", "tool_call": {"name": "first"}}': call("first"), '{"final_answer": "done"}': text("final_answer", "done"), '{"final_answer": {"b": 1, "a": 2}}': text("final_answer", '{"a":2,"b":1}'),
        '{"clarify": "which?"}': text("clarify", "which?"), '{"abort": ""}': text("abort", ""), '{"name": "n", "parameters": {"q": 1}}': call("n", '{"q":1}'), '{"name": "n", "parameters": {"q": 1}, "arguments": {}}': call("n"),
        'well {"name": "n", "arguments": {}} then': call("n"), "<final_answer> ok\n </final_answer>": text("final_answer", "ok"), 'a <tool_call>\n{"name": "look"}\n</tool_call>': call("look"), '"one string"': text("final_answer", "one string"),
        "<tool_call>broken</tool_call> <final_answer>x</final_answer>": text("final_answer", "x"), '{"name": "n"} <final_answer>y</final_answer>': text("final_answer", "y"),
        "plain prose": None, "": None, " \n": None, None: None, "[1]": None, "5": None, "null": None, '{"name": "n"}': None, '{"type": "clarify", "text": "which?"}': None, '{"tool_call": "x"}': None, '{"tool_call": {"name": "a", "arguments": "no"}}': None, '"a" and "b"': None,
    }
    got = rows(spark, list(forms), R.action(T()).alias("a"))
    assert {t: a and tuple(a) for t, (a,) in zip(forms, got, strict=True)} == forms


def test_tool_calls(spark):
    fence = "`" * 3
    forms = {
        '{"tool_calls": [{"function": {"name": " a ", "arguments": "{\\"k\\": 1}"}}, {"name": "b", "args": {"z": 1, "y": 2}}]}': [("a", '{"k":1}'), ("b", '{"y":2,"z":1}')],
        '{"function_call": {"name": "f", "parameters": {}}}': [("f", "{}")], '[[{"name": "x", "arguments": null}], 5, {"name": "no arguments"}]': [("x", "{}")],
        '{"name": "n", "parameters": {"p": 1}, "arguments": {"a": 1}}': [("n", '{"a":1}')], f'{fence}json\n{{"name": "q", "args": {{}}}}\n{fence}': [("q", "{}")], 'x {"name": "q", "args": "{\\"d\\": 4}"} y': [("q", '{"d":4}')],
        '{"role": "assistant", "content": "[{\\"name\\": \\"i\\", \\"args\\": {}}]"}': [("i", "{}")], '{"role": "tool", "content": [{"name": "j", "args": {}}]}': [("j", "{}")], '{"role": "user", "content": [{"name": "j", "args": {}}]}': [],
        '{"name": null, "args": {}}': [("None", "{}")], '{"name": 5, "args": {}}': [("5", "{}")], "prose": [], "": [], None: [], "{}": [], '"text"': [],
    }
    got = rows(spark, list(forms), R.tool_calls(T()))
    assert {t: [tuple(x) for x in c] for t, (c,) in zip(forms, got, strict=True)} == forms


def test_summaries(spark):
    whole = {"user_request": "u", "key_facts": [], "actions_and_results": [], "state_changes": [], "unresolved_or_risks": []}
    item = {"text": "t", "source_event_ids": ["e1", "e2"]}
    exact = ["summary must contain exactly the required keys"]
    cases = [
        (whole, []), ({**whole, "key_facts": [item]}, []), ({**whole, "more": 1}, exact), ({k: v for k, v in whole.items() if k != "state_changes"}, exact), ([], exact), ({**whole, "user_request": 5}, ["user_request must be a string"]),
        ({**whole, "user_request": None, "state_changes": {}}, ["user_request must be a string", "state_changes must be a list"]), ({**whole, "key_facts": [item, {**item, "more": 1}, "x", {"text": "t"}]}, [f"key_facts[{i}] must contain text and source_event_ids" for i in (1, 2, 3)]),
        ({**whole, "unresolved_or_risks": [{**item, "text": " \n"}, {**item, "text": 4, "source_event_ids": []}]}, ["unresolved_or_risks[0].text must be non-empty", "unresolved_or_risks[1].text must be non-empty", "unresolved_or_risks[1] has invalid source_event_ids"]),
        *[({**whole, "state_changes": [{**item, "source_event_ids": ids}]}, ["state_changes[0] has invalid source_event_ids"]) for ids in ("e1", ["e9"], ["e1", 2], None, [["e1"]])],
    ]
    got = rows(spark, [json.dumps(c) for c, _ in cases], R.summary_errors(T(), F.array(F.lit("e1"), F.lit("e2"))))
    assert [e for (e,) in got] == [e for _, e in cases]
    assert rows(spark, [None, "no"], R.summary_errors(T(), F.array(F.lit("e1")))) == [(exact,), (exact,)]


def test_responses(spark):
    texts = [
        ('{"choices": [{"message": {"content": "a"}}]}', "openai_chat", "a"), ('{"content": [{"text": "a"}, {"text": 5}, "x", {"text": "b"}]}', "anthropic_messages", "ab"), ('{"candidates": [{"content": {"parts": [{"text": "x"}]}}, {}]}', "gemini_generate_content", "x"),
        ('{"content": []}', "anthropic_messages", None), ('{"choices": []}', "openai_chat", None), ('{"choices": [{"message": {"content": 5}}]}', "openai_chat", None), ('{"candidates": [{"content": {"parts": [{"text": " "}]}}]}', "gemini_generate_content", None), ('{"content": [{"text": "a"}]}', "openai_chat", None), ("oops", "openai_chat", None), (None, None, None),
    ]
    schema = "i int, t string, p string"
    got = rows(spark, [t[:2] for t in texts], A.response_text(T(), F.col("p"), strict=False), schema=schema)
    assert [t for (t,) in got] == [t[2] for t in texts]
    assert rows(spark, [t[:2] for t in texts[:3]], A.response_text(T(), F.col("p")), schema=schema) == [("a",), ("ab",), ("x",)]
    for text, protocol, message in [('{"content": []}', "anthropic_messages", "anthropic_messages response did not contain text content"), ("{}", "new", "unsupported protocol: new")]:
        with pytest.raises(Exception, match=message):
            rows(spark, [(text, protocol)], A.response_text(T(), F.col("p")), schema=schema)


def test_shallow_texts_are_walked_once(spark, values, monkeypatch):
    """Texts of a few levels never need the list of open items that is made anew for each level."""
    monkeypatch.setattr(N, "opened", lambda *_: F.raise_error(F.lit("opened")))
    text = '{"a":[{"b":1,"api_Key":{"c":[2]}},"s1s1"],"d":{"e":null,"n":0.5}}'
    got = rows(spark, [text], N.leaves(T()), N.leaves(T(), fields=("key", "value")), N.keys(T()), N.redacted(T()), N.pruned(T(), ("n",)), N.changed_paths(T(), F.replace(T(), F.lit("null"), F.lit("7"))), N.merged(T(), F.lit('{"d":{"e":{}}}')))[0]
    assert [(x.path, x.key, x.kind, x.value, x.text) for x in got[0]] == [("a.api_Key.c", "c", "number", "2", None), ("a.b", "b", "number", "1", None), ("a", "a", "string", '"s1s1"', "s1s1"), ("d.e", "e", "null", "null", None), ("d.n", "n", "number", "0.5", None)]
    assert [tuple(x) for x in got[1]] == [("c", "2"), ("b", "1"), ("a", '"s1s1"'), ("e", "null"), ("n", "0.5")]
    assert got[2:] == (["a", "api_Key", "b", "c", "d", "e", "n"], '{"a":[{"api_Key":"[REDACTED]","b":1},"s1s1"],"d":{"e":null,"n":0.5}}', '{"a":[{"api_Key":{"c":[2]},"b":1},"s1s1"],"d":{}}', ["d.e"], '{"a":[{"api_Key":{"c":[2]},"b":1},"s1s1"],"d":{"e":{},"n":0.5}}')


def test_redaction_in_the_text_and_on_a_walk(spark):
    deep = lambda n: "[" * n + '{"token":1}' + "]" * n
    cases = {
        '{"a":"my","token":{"b":[1,"]"],"key":2},"c":"key"}': '{"a":"my","c":"key","token":"[REDACTED]"}', '{"\u212aEY":1,"TOKENS":[],"é":"}"}': '{"TOKENS":"[REDACTED]","é":"}","KEY":"[REDACTED]"}',
        r'{"\token":1,"\\token":2,"q\"key":3}': r'{"\token":1,"\\token":"[REDACTED]","q\"key":"[REDACTED]"}', '["key",":","token"]': '["key",":","token"]', '"key"': '"key"', "7": "7", '{"key":""}': '{"key":"[REDACTED]"}',
        **{deep(n): deep(n).replace("1", '"[REDACTED]"') for n in (3, 7, 8, 30)}, '{"key":' + deep(12) + "}": '{"key":"[REDACTED]"}', '{"k":"' + "x" * 100_000 + '","key":[' + "1," * 50_000 + "1]}": '{"k":"' + "x" * 100_000 + '","key":"[REDACTED]"}',
    }
    assert rows(spark, list(cases), N.redacted(T())) == [(v,) for v in cases.values()]
