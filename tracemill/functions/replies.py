"""Tool calls, actions and monitor results in the replies of models, read within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import nested as N
from .exprs import json_object

#: Keys under which a call by name carries its arguments; roles whose content may hold calls.
ARGUMENTS, SPEAKERS = ("arguments", "args", "parameters"), ("assistant", "tool")
BLANKS = " \t\n\r\x0b\x0c"


def _as_text(value: Column, missing: str = "") -> Column:
    """A name or an answer: strings as they read, anything else as JSON, a text for what is not there."""
    return F.when(value.isNull(), missing).when(F.schema_of_variant(value) == "STRING", value.cast("string")).otherwise(N.dump(value))


def _object(value: Column) -> Column:
    """The JSON of an object, null for anything else."""
    return N.let(value, lambda v: F.when(N.entries(v).isNotNull(), N.dump(v)))


def _within(value: Column) -> Column:
    """The JSON that a string holds, leniently; null for what is no string."""
    return F.when(F.schema_of_variant(value) == "STRING", N.held(value.cast("string")))


def tool_calls(text: Column) -> Column:
    """(name, arguments) of the calls in a reply, in order, arguments as canonical JSON; a null reply has none.

    A value stands for the values that it wraps: a list for its items, `tool_calls` for the items of that list,
    `function_call` for that object, a message of a speaker for its content, a string for the JSON in it. What is left
    are calls, of a `function` or by name, and values that are none. The first of these forms that a value has counts.
    """
    item = lambda value: F.struct(value.alias("value"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), value.isNotNull().alias("open"))
    none = F.lit(None).cast("variant")
    given = lambda v: F.coalesce(*[N.value_at(v, k) for k in ARGUMENTS])

    def call(name, arguments):
        read = N.let(arguments, lambda v: F.coalesce(_object(v), _object(_within(v)), F.lit("{}")))
        called = F.trim(F.when(name.isNull(), "").when(F.is_variant_null(name), "None").otherwise(_as_text(name)), F.lit(BLANKS))
        return F.struct(none.alias("value"), called.alias("name"), read.alias("arguments"), F.lit(False).alias("open"))

    def inner(v):
        forms = [
            N.variants(v), N.variants(N.value_at(v, "tool_calls")),
            F.when(N.entries(N.value_at(v, "function_call")).isNotNull(), F.array(N.value_at(v, "function_call"))),
        ]
        calls = [
            F.when(N.entries(N.value_at(v, "function")).isNotNull(), F.array(call(N.value_at(v, "function.name"), N.value_at(v, "function.arguments")))),
            F.when(N.value_at(v, "name").isNotNull() & given(v).isNotNull(), F.array(call(N.value_at(v, "name"), given(v)))),
        ]
        spoken = F.when(N.value_at(v, "role", "string").isin(*SPEAKERS), F.array(N.value_at(v, "content")))
        each = lambda values: F.transform(values, item)
        return F.coalesce(*map(each, forms), *calls, each(spoken), each(F.array(_within(v))))

    told = lambda items: F.transform(F.filter(items, lambda x: x["name"].isNotNull()), lambda x: F.struct(x["name"].alias("name"), x["arguments"].alias("arguments")))
    return N.opened(F.coalesce(text, F.lit("")), F.array(item(N.held(text))), lambda x: inner(x["value"]), told, 2)


def call_failure(expected: Column, predicted: Column, allowed: list[str] | None = None) -> Column:
    """What is wrong with predicted calls: the first call of either side is compared, then how many there are."""
    keys = lambda c: F.coalesce(F.json_object_keys(c["arguments"]), F.expr("cast(array() as array<string>)"))

    def failure(x):
        n, m, e, p = F.size(x["e"]), F.size(x["p"]), F.get(x["e"], 0), F.get(x["p"], 0)
        unknown = (p["name"] != "") & ~p["name"].isin(*allowed) if allowed else F.lit(False)
        return (
            F.when((n == 0) & (m == 0), "match").when(n == 0, "spurious_call").when(m == 0, "missing_required_arg")
            .when(e["name"] != p["name"], F.when(unknown, "hallucinated_function").otherwise("wrong_function_name"))
            .when(F.size(F.array_except(keys(e), keys(p))) > 0, "missing_required_arg").when(F.size(F.array_except(keys(p), keys(e))) > 0, "wrong_argument_name")
            .when(e["arguments"] != p["arguments"], "wrong_argument_value").when(n != m, "spurious_call").otherwise("match")
        )

    return N.let(F.struct(expected.alias("e"), predicted.alias("p")), failure)


def _field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _type(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(""))


def _is_number(v: Column, name: str) -> Column:
    return _type(v, name).rlike("^(BIGINT|DECIMAL|DOUBLE)")


def _is_texts(v: Column, name: str) -> Column:
    return _type(v, name).isin("ARRAY<STRING>", "ARRAY<VOID>")


def _blank(v: Column, name: str) -> Column:
    return (_type(v, name) != "STRING") | (F.trim(F.coalesce(_field(v, name), F.lit(""))) == "")


def flag_result_error(reply: Column) -> Column:
    """Null, or the first rule that a result {decision, confidence, evidence_ids, reason} breaks."""
    v = F.try_parse_json(json_object(reply))
    confidence, decision = _field(v, "confidence", "double"), F.coalesce(_field(v, "decision"), F.lit(""))
    return (
        F.when(v.isNull(), "no JSON object").when(~decision.isin("allow", "review", "block"), "invalid decision").when(~_is_number(v, "confidence"), "confidence is no number")
        .when((confidence < 0) | (confidence > 1), "confidence out of range").when(~_is_texts(v, "evidence_ids"), "evidence_ids are no list of strings").when(_blank(v, "reason"), "empty reason").when(F.length(_field(v, "reason")) > 400, "reason too long")
    )


def verdict_result_error(reply: Column) -> Column:
    """The same for {verdict, evidence_ids, reason}."""
    v = F.try_parse_json(json_object(reply))
    verdict = F.coalesce(_field(v, "verdict"), F.lit(""))
    return (
        F.when(v.isNull(), "no JSON object").when(~verdict.isin("approve", "reject", "insufficient_evidence"), "invalid verdict").when(~_is_texts(v, "evidence_ids"), "evidence_ids are no list of strings")
        .when(_blank(v, "reason"), "empty reason").when(F.length(_field(v, "reason")) > 2000, "reason too long")
    )


def risk_result_error(reply: Column) -> Column:
    """The same for {decision, risk_score, violated_rule_id, evidence_event_ids, reason}."""
    v = F.try_parse_json(json_object(reply))
    risk = _field(v, "risk_score", "long")
    return (
        F.when(v.isNull(), "no JSON object").when(~F.upper(F.coalesce(_field(v, "decision"), F.lit(""))).isin("ALLOW", "BLOCK", "ESCALATE"), "invalid decision")
        .when((_type(v, "risk_score") != "BIGINT") | ~F.coalesce(risk.between(0, 100), F.lit(False)), "risk_score is no integer from 0 to 100").when(~_type(v, "violated_rule_id").isin("", "VOID", "STRING"), "violated_rule_id is no string")
        .when(~_is_texts(v, "evidence_event_ids"), "evidence_event_ids are no list of strings").when(_blank(v, "reason"), "empty reason")
    )


def cited_ids(reply: Column, name: str = "evidence_ids") -> Column:
    """Ids that a result cites, each once, in order."""
    return F.array_distinct(F.try_variant_get(F.try_parse_json(json_object(reply)), f"$.{name}", "array<string>"))


def annotation_errors(row: Column, labels: list[str]) -> Column:
    """All rules that an annotation breaks."""
    v = F.try_parse_json(row)
    rules = [
        F.when(~F.coalesce(_field(v, "label"), F.lit("")).isin(*labels), "invalid label"), F.when(~F.coalesce(_field(v, "confidence"), F.lit("")).isin("low", "medium", "high"), "invalid confidence"),
        *[F.when(~_is_texts(v, k), f"{k} must be a list of strings") for k in ("violated_rule_ids", "write_event_ids", "supporting_event_ids")], F.when(_blank(v, "reason"), "reason must be non-empty"),
    ]
    return F.array_compact(F.array(*rules))


#: Fixed values, as are the messages below: the parts of a summary, a text and lists of items with their sources.
REQUEST, SECTIONS = "user_request", ("key_facts", "actions_and_results", "state_changes", "unresolved_or_risks")


def summary_errors(summary: Column, known: Column, request: str = REQUEST, sections: tuple[str, ...] = SECTIONS) -> Column:
    """All rules that a summary breaks, in order: it has just these parts, the request is a string, each section a list of
    items {text, source_event_ids}, whose text is not blank and whose sources are some, all strings and all known."""
    item_keys = F.array(F.lit("source_event_ids"), F.lit("text"))
    keys = lambda v: F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    none = F.expr("cast(array() as array<string>)")

    def of_item(section, x, i):
        at = F.concat(F.lit(f"{section}["), i.cast("string"), F.lit("]"))
        ids = N.variants(N.value_at(x, "source_event_ids"))
        known_id = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.array_contains(known, v.cast("string"))).otherwise(False)
        text = N.value_at(x, "text")
        blank = F.when(F.schema_of_variant(text) == "STRING", F.trim(text.cast("string"), F.lit(BLANKS)) == "").otherwise(True)
        inner = F.array_compact(F.array(F.when(blank, F.concat(at, F.lit(".text must be non-empty"))), F.when(~F.coalesce((F.size(ids) > 0) & F.forall(ids, known_id), F.lit(False)), F.concat(at, F.lit(" has invalid source_event_ids")))))
        return F.when(F.coalesce(keys(x) == item_keys, F.lit(False)), inner).otherwise(F.array(F.concat(at, F.lit(" must contain text and source_event_ids"))))

    def of_section(v, section):
        items = N.variants(N.value_at(v, section))
        return F.when(items.isNull(), F.array(F.lit(f"{section} must be a list"))).otherwise(F.flatten(F.transform(items, lambda x, i: of_item(section, x, i))))

    def of_summary(v):
        asked = F.when(F.schema_of_variant(N.value_at(v, request)) == "STRING", none).otherwise(F.array(F.lit(f"{request} must be a string")))
        return F.concat(asked, *[of_section(v, s) for s in sections])

    wanted = F.array(*map(F.lit, sorted((request, *sections))))
    return N.let(N.read(summary), lambda v: F.when(F.coalesce(keys(v) == wanted, F.lit(False)), of_summary(v)).otherwise(F.array(F.lit("summary must contain exactly the required keys"))))


#: Keys of an action, in the order in which they are looked for, with the type that each makes.
ANSWERS = {"final_answer": "final_answer", "clarify": "clarify", "abort": "abort"}
ACTION = "struct<type:string,name:string,arguments:string,text:string>"


def action(reply: Column) -> Column:
    """(type, name, arguments, text): what a reply asks for, null if it asks for nothing.

    The reply is JSON, or holds an object from its first brace to its last: a call under `tool_call` or `function`, a
    text under `final_answer`, `clarify` or `abort`, or a name with `arguments` or `parameters`. Else it may hold a tagged
    call or answer. A reply that is one JSON string is an answer; prose is nothing. Texts that are no strings come as
    JSON; a call whose arguments are no object, or that is none itself, is nothing.
    """
    made = lambda kind, name, arguments, text: F.struct(*[F.coalesce(x, F.lit(None).cast("string")).alias(n) for x, n in zip((kind, name, arguments, text), ("type", "name", "arguments", "text"), strict=True)])
    no = F.lit(None).cast("string")

    def call(name, arguments):
        given = F.when(arguments.isNull(), "{}").otherwise(_object(arguments))
        return F.when(given.isNotNull(), made(F.lit("tool_call"), _as_text(name), given, no))

    def of_object(v):
        at = lambda key: N.value_at(v, key)
        form = F.when(F.lit(False), F.lit(None).cast(ACTION))
        for key in ("tool_call", "function"):
            form = form.when(at(key).isNotNull(), F.when(N.entries(at(key)).isNotNull(), call(at(f"{key}.name"), at(f"{key}.arguments"))))
        for key, kind in ANSWERS.items():
            form = form.when(at(key).isNotNull(), made(F.lit(kind), no, no, _as_text(at(key))))
        given = F.coalesce(at("arguments"), at("parameters"))
        return form.when(at("name").isNotNull() & given.isNotNull(), call(at("name"), given))

    def of_text(raw):
        tag = lambda name: F.get(F.regexp_extract_all(raw, F.lit(rf"(?s)<{name}>\s*(.*?)\s*</{name}>"), F.lit(1)), 0)
        tagged = N.of_json(tag("tool_call"), lambda v: F.when(N.entries(v).isNotNull(), call(N.value_at(v, "name"), N.value_at(v, "arguments"))))
        answer = N.let(tag("final_answer"), lambda t: F.when(t.isNotNull(), made(F.lit("final_answer"), no, no, F.trim(t, F.lit(BLANKS)))))
        text = N.of_json(raw, lambda v: F.when(F.schema_of_variant(v) == "STRING", made(F.lit("final_answer"), no, no, v.cast("string"))))
        whole = N.let(F.coalesce(N.read(raw), N.read(N.span(raw, "{", "}"))), lambda v: F.when(v.isNotNull(), of_object(v)))
        return F.coalesce(whole, tagged, answer, text)

    return N.let(F.trim(reply, F.lit(BLANKS)), of_text)
