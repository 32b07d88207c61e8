"""Cases that runs are scored on, the seeds behind them, and audits of what was made from these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested as N
from .traces import latest

NO_TEXTS = "cast(array() as array<string>)"
ACTIONS = "type string, name string, arguments string, text string"


def eval_cases(payload: Column) -> Column:
    """The cases of a payload as JSON texts; one that is no object with a list of cases that holds some ends the job."""
    def checked(v):
        cases = N.variants(N.value_at(v, "cases"))
        texts = F.transform(cases, N.dump)
        return F.when(N.entries(v).isNull(), F.raise_error(F.lit("eval cases must be an object")).cast("array<string>")).when(F.coalesce(F.size(cases), F.lit(0)) <= 0, F.raise_error(F.lit("eval cases must hold a list of cases")).cast("array<string>")).otherwise(texts)

    return N.let(F.coalesce(N.read(payload), F.try_parse_json(F.lit("null"))), checked)


def case_mismatches(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(policy, task_id, expected_first, called_first, expected_sequence, called_prefix): runs whose first call or whose
    first calls are not those that their case expects, or whose case expects none. Of cases that share a task the last line
    counts; runs without a case are left out. results: policy, task_id, tools; cases: task_id, line, expected_first,
    expected_sequence."""
    own = latest(cases, ["task_id"], ["line"])
    both = results.join(own, "task_id")
    wanted = F.filter(F.coalesce("expected_sequence", F.expr(NO_TEXTS)), lambda t: t != "")
    tools = F.coalesce("tools", F.expr(NO_TEXTS))
    both = both.select("policy", "task_id", F.coalesce("expected_first", F.lit("")).alias("expected_first"), F.coalesce(F.get(tools, 0), F.lit("")).alias("called_first"), wanted.alias("expected_sequence"), F.slice(tools, F.lit(1), F.greatest(F.size(wanted), F.lit(1))).alias("called_prefix"))
    first = (F.col("expected_first") != "") & (F.col("called_first") == F.col("expected_first"))
    sequence = (F.size("expected_sequence") > 0) & (F.col("called_prefix") == F.col("expected_sequence"))
    return both.filter(~(first & sequence))


def nested_results(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One JSON document for each key: the rows of its tasks in order, as they are. A document holds a policy's tasks."""
    rest = [c for c in results.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("row"))))
    return results.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.to_json(F.transform("r", lambda x: x["row"]), {"ignoreNullFields": "false"}).alias("document"))


def actions(raw: Column) -> Column:
    """(type, name, arguments, text) of each action in a JSON list: objects by their type, FINAL as an empty answer, other
    texts as questions, lists for what they hold. Objects of other types and anything else are left out."""
    none, no = F.lit(None).cast("variant"), F.lit(None).cast("string")
    item = lambda value, kind=no, name=no, arguments=no, text=no, is_open=True: F.struct(value.alias("value"), kind.alias("type"), name.alias("name"), arguments.alias("arguments"), text.alias("text"), F.lit(is_open).alias("open"))
    made = lambda kind, **fields: F.array(item(none, F.lit(kind), is_open=False, **fields))
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    said = lambda v, key: F.coalesce(string(N.value_at(v, key)), F.lit(""))

    def inner(x):
        return N.let(x["value"], of)

    def of(v):
        kind = N.value_at(v, "type", "string")
        rest = F.filter(N.entries(v), lambda e: ~e["key"].isin("type", "name"))
        given = F.concat(F.lit("{"), F.array_join(F.transform(rest, lambda e: F.concat(N.quoted(e["key"]), F.lit(":"), N.dump(e["value"]))), ","), F.lit("}"))
        by_type = (
            F.when(kind == "call", made("tool_call", name=said(v, "name"), arguments=given)).when(kind == "answer", made("final_answer", text=said(v, "text")))
            .when(kind == "clarify", made("clarify", text=said(v, "text"))).when(kind == "abort", made("abort", text=said(v, "reason")))
        )
        texts = N.let(string(v), lambda t: F.when(t == "FINAL", made("final_answer", text=F.lit(""))).when(t.isNotNull(), made("clarify", text=t)))
        return F.coalesce(F.transform(N.variants(v), lambda y: item(y)), by_type, texts, F.array(item(none, is_open=False)))

    told = lambda items: F.transform(F.filter(items, lambda x: x["type"].isNotNull()), lambda x: F.struct(*[x[c].alias(c) for c in ("type", "name", "arguments", "text")]))
    start = item(N.read(F.coalesce(raw, F.lit("[]"))))
    return N.opened(F.coalesce(raw, F.lit("")), F.array(start), inner, told)


#: Faults that are tried again unless a configuration says otherwise, and what it has to hold.
RETRYABLE = ["timeout", "rate_limit", "network_failure"]
NUMBERS = ("seed", "max_attempts", "default_timeout_ms", "time_budget_ms", "base_backoff_ms", "backoff_jitter_ms")


def run_config(payload: Column) -> Column:
    """A run's configuration from JSON, with its defaults; one that lacks a number, a price or the policies ends the job."""
    def number(v, name, kind="long"):
        value = F.coalesce(N.value_at(v, name, kind), F.try_variant_get(v, f"$.{name}", "string").try_cast(kind))
        return F.when(value.isNull(), F.raise_error(F.lit(f"run configuration lacks {name}")).cast(kind)).otherwise(value).alias(name.split(".")[-1])

    def config(v):
        policies = N.value_at(v, "policies", "array<string>")
        return F.struct(
            *[number(v, n) for n in NUMBERS], number(v, "cost.base_per_call_usd", "double"), number(v, "cost.per_ms_usd", "double"),
            F.when(policies.isNull(), F.raise_error(F.lit("run configuration lacks policies")).cast("array<string>")).otherwise(policies).alias("policies"),
            F.coalesce(N.value_at(v, "fault_probabilities", "map<string,double>"), F.expr("cast(map() as map<string,double>)")).alias("fault_probabilities"),
            F.coalesce(N.value_at(v, "retryable_faults", "array<string>"), F.array(*map(F.lit, RETRYABLE))).alias("retryable_faults"),
            F.when(N.entries(N.value_at(v, "policy_overrides")).isNotNull(), N.dump(N.value_at(v, "policy_overrides"))).otherwise("{}").alias("policy_overrides"),
        )

    return N.let(F.coalesce(N.read(payload), F.try_parse_json(F.lit("null"))), config)


def public_traces(traces: DataFrame) -> DataFrame:
    """What the model that changes a trace may see of it."""
    return traces.select("trajectory", "domain", "events")


def reviewed_labels(rows: DataFrame) -> DataFrame:
    """(id, label): items whose label is settled; of rows of one item the last."""
    return latest(rows.filter("final_label is not null"), ["id"], ["line"]).select("id", F.col("final_label").alias("label"))


def enriched_seeds(cases: DataFrame, traces: DataFrame, families: DataFrame, stage: str) -> DataFrame:
    """Cases with their trace and what their family asks for. A case whose trace or family is unknown ends the job. cases:
    case_id, trajectory, family; traces: trajectory, domain, events; families (a few): family, allowed_target_rules (by
    domain), min_source_writes, min_target_write_rank."""
    role = stage if stage in ("reserve", "supplement", "supplement2") else "primary"
    known = traces.select("trajectory", F.struct("domain", "events").alias("t"))
    rows = cases.join(known, "trajectory", "left").join(F.broadcast(families.select("family", F.struct("*").alias("f"))), "family", "left")
    fault = F.when(F.col("t").isNull(), "unknown trajectory").when(F.col("f").isNull(), "unknown family")
    rows = rows.withColumn("case_id", F.when(fault.isNull(), F.col("case_id")).otherwise(F.raise_error(F.concat_ws(": ", F.col("case_id").cast("string"), fault)).cast("string")))
    return rows.select("case_id", "t.domain", "family", F.lit(role).alias("case_role"), "trajectory", "t.events", F.col("f.allowed_target_rules")[F.col("t.domain")].alias("allowed_target_rules"), F.coalesce("f.min_source_writes", F.lit(1)).alias("min_source_writes"), F.coalesce("f.min_target_write_rank", F.lit(1)).alias("min_target_write_rank"))


def pilot_audit(rows: DataFrame, seeds: DataFrame, version: str, hashes: dict[str, str]) -> DataFrame:
    """(subject, error): what is wrong with the newest row of each seed of this version and configuration: seeds without a
    row, another hash of the code (unless the row may be used again) or of the resources, a status that is not ready, the
    faults of its validation, and checks of its replay that did not pass. rows: trajectory, line, version, config_hash,
    code_hash, resource_hash, status, reusable, valid, errors, faithful, dependencies_ok, semantic_ok; seeds: trajectory."""
    own = latest(rows.filter((F.col("version") == version) & (F.col("config_hash") == hashes["config"])), ["trajectory"], ["line"])
    not_ = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules = [
        F.when((F.col("code_hash") != hashes["code"]) & not_("reusable"), "stale pipeline code hash"), F.when(~F.col("resource_hash").eqNullSafe(hashes["resource"]), "stale pipeline resource hash"),
        F.when(~F.col("status").eqNullSafe("ready_for_human_review"), F.concat(F.lit("status="), F.coalesce("status", F.lit("None")))), F.when(not_("faithful"), "baseline source fidelity did not pass"),
        F.when(not_("dependencies_ok"), "downstream dependency audit did not pass"), F.when(not_("semantic_ok"), "semantic verification did not pass"),
    ]
    all_ = F.concat(F.array_compact(F.array(*rules)), F.when(not_("valid"), F.coalesce("errors", F.expr(NO_TEXTS))).otherwise(F.expr(NO_TEXTS)))
    found = own.select(F.col("trajectory").cast("string").alias("subject"), F.explode(all_).alias("error"))
    none = seeds.select("trajectory").distinct().join(own.select("trajectory"), "trajectory", "left_anti").select(F.col("trajectory").cast("string").alias("subject"), F.lit("no row of this version").alias("error"))
    return found.unionByName(none)


def embedded_differences(embedded: DataFrame, current: DataFrame, drop: tuple[str, ...]) -> DataFrame:
    """(domain, id, difference): tasks and policies that a result file carries and that are not the current ones: `changed`,
    `gone` or `new`, without nulls and the keys left out. embedded, current: domain, id, task (JSON)."""
    text = lambda df, name: df.select("domain", "id", F.struct(N.pruned(F.col("task"), drop).alias("t")).alias(name))
    both = text(embedded, "a").join(text(current, "b"), ["domain", "id"], "full_outer").filter(~F.col("a.t").eqNullSafe(F.col("b.t")) | F.col("a").isNull() | F.col("b").isNull())
    return both.select("domain", "id", F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").otherwise("changed").alias("difference"))


#: Fixed value: the answer that gives up where a call could be made again.
GIVEN_UP = "I cannot verify the requested information from this result."


def recovery_rows(schedule: DataFrame, steps: DataFrame) -> DataFrame:
    """(task_id, fault, hazard, fault_step, failed_tool, chosen, rejected): for each fault that strikes a call, the same call
    once more over an answer that gives up, as JSON. schedule: task_id, fault, hazard, step; steps: task_id, index, action,
    tool, arguments (JSON)."""
    calls = steps.filter("action = 'tool_call'").select("task_id", F.col("index").alias("step"), "tool", "arguments")
    given = F.coalesce(N.canonical(F.col("arguments")), F.lit("{}"))
    call = F.concat(F.lit('{"tool_call":{"arguments":'), given, F.lit(',"name":'), N.quoted(F.col("tool")), F.lit("}}"))
    rows = schedule.select("task_id", "fault", "hazard", "step").join(calls, ["task_id", "step"])
    return rows.select("task_id", "fault", "hazard", F.col("step").alias("fault_step"), F.col("tool").alias("failed_tool"), call.alias("chosen"), F.lit('{"final_answer":"' + GIVEN_UP + '"}').alias("rejected"))


def export(rows: DataFrame, errors: DataFrame, private: list[str], path: str) -> None:
    """Writes the public columns as JSON lines, if the audit found nothing; otherwise nothing is written."""
    if found := [tuple(r) for r in errors.limit(3).collect()]:
        raise ValueError(f"the audit did not pass: {found}")
    rows.drop(*private).write.mode("errorifexists").json(path)


def frozen_errors(rows: DataFrame, frozen: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(error, subject): what is wrong with a set that is to be frozen beside earlier ones: domains with another number of
    rows than expected, ids that stand twice, ids and tasks that a frozen set has already. rows, frozen: id, domain, task_id."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), "domain string, expected long")
    counts = F.broadcast(wanted).join(rows.groupBy("domain").agg(F.count("*").alias("n")), "domain", "full_outer").filter(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("expected", F.lit(0))))
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    same_id = rows.select("id").distinct().join(frozen.select("id").distinct(), "id", "left_semi")
    same_task = rows.select("domain", "task_id").distinct().join(frozen.select("domain", "task_id").distinct(), ["domain", "task_id"], "left_semi")
    named = lambda df, error, subject: df.select(F.lit(error).alias("error"), subject.cast("string").alias("subject"))
    return (
        named(counts, "row count", F.col("domain")).unionByName(named(twice, "duplicate id", F.col("id"))).unionByName(named(same_id, "frozen id", F.col("id")))
        .unionByName(named(same_task, "frozen task", F.concat_ws(":", F.col("domain"), F.col("task_id").cast("string"))))
    )


def registration_errors(registered: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, error): keys of a registration that are `missing`, `unexpected` or stand `twice`. registered, expected: key."""
    n = registered.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("wanted")).distinct().join(n, key, "full_outer")
    return both.select(key, F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "twice").alias("error")).filter("error is not null")


def reviewed_selection(packets: DataFrame, reviews: DataFrame, per_cell: int) -> DataFrame:
    """The first per_cell rows of each domain and family that their last review accepts, one for each task, the best scores
    first; a review of what no packet holds ends the job. packets: id, domain, family, task_id, score; reviews: id, line,
    accepted."""
    last = latest(reviews, ["id"], ["line"]).select("id", "accepted", F.lit(True).alias("reviewed"))
    both = packets.withColumn("there", F.lit(True)).join(last, "id", "full_outer")
    ok = F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("a review of what is in no packet: "), F.col("id").cast("string"))).cast("boolean")).otherwise(F.coalesce("accepted", F.lit(False)))
    order = F.struct((-F.col("score")).alias("neg"), "id")
    best = both.filter(ok).groupBy("domain", "family", "task_id").agg(F.min(order).alias("o"))
    rank = F.row_number().over(Window.partitionBy("domain", "family").orderBy("o"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= per_cell).select("domain", "family", "task_id", F.col("o.id").alias("id"), "rank")
