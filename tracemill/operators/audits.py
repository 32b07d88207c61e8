"""Checks of data sets, of results and of what may be used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested as N


def listed(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def result_audit(runs: DataFrame, tasks: DataFrame, trials: int) -> DataFrame:
    """One row: runs and what is wrong with them against the tasks that were to be run so many times each. runs: id,
    task_id; tasks: task_id."""
    counts = runs.agg(F.count("*").alias("runs"), F.count_distinct("id").alias("ids"))
    wanted = tasks.select("task_id").distinct()
    tasks_ = wanted.join(runs.groupBy("task_id").agg(F.count("*").alias("n")), "task_id", "left").agg(F.count("*").alias("tasks"), F.count_if(F.col("n").isNull()).alias("not_run"), F.count_if(F.col("n") != trials).alias("other_count"))
    unknown = runs.join(wanted, "task_id", "left_anti").agg(F.count("*").alias("unknown"))
    row = counts.crossJoin(tasks_).crossJoin(unknown)  # one row each
    rules = {"run count": F.col("runs") != F.col("tasks") * trials, "duplicate ids": F.col("ids") < F.col("runs"), "incomplete coverage": F.col("not_run") > 0, "unknown tasks": F.col("unknown") > 0}
    return row.withColumn("errors", listed(rules))


def output_audit(rows: DataFrame, forbidden: list[str], quotas: dict[str, int]) -> DataFrame:
    """Ids that stand twice, rows whose keys are forbidden, groups whose number is not their quota: (error, subject). rows:
    id, keys, group."""
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate id").alias("error"), F.col("id").cast("string").alias("subject"))
    leaks = rows.filter(F.arrays_overlap("keys", F.array(*map(F.lit, forbidden)))).select(F.lit("private key").alias("error"), F.col("id").cast("string").alias("subject"))
    wanted = rows.sparkSession.createDataFrame(list(quotas.items()), "group string, quota long")
    groups = F.broadcast(wanted).join(rows.groupBy("group").agg(F.count("*").alias("n")), "group", "left")  # a row for each quota
    return twice.unionByName(leaks).unionByName(groups.filter("not n <=> quota").select(F.lit("quota").alias("error"), F.col("group").alias("subject")))


def pair_errors(rows: DataFrame) -> DataFrame:
    """Faults of matched pairs: not two rows, not one of either label, an unsafe one without a rule. rows: pair_id, label,
    rule."""
    each = rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("labels"), F.bool_or((F.col("label") == "policy_breaking") & F.col("rule").isNull()).alias("ruleless"))
    rules = {"not two traces": F.col("n") != 2, "labels": F.col("labels") != F.array(F.lit("policy_breaking"), F.lit("safe")), "missing rule": F.col("ruleless")}
    return each.select("pair_id", listed(rules).alias("errors")).filter(F.size("errors") > 0)


def cell_counts(rows: DataFrame, cell: list[str], levels: dict[str, list[str]], wanted: int) -> DataFrame:
    """Cells of a full design with another number of rows than wanted, those without any too."""
    grid = rows.sparkSession.range(1)
    for c in cell:
        grid = grid.withColumn(c, F.explode(F.array(*map(F.lit, levels[c]))))
    counts = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    return grid.drop("id").join(counts, cell, "left").fillna(0, ["n"]).filter(F.col("n") != wanted)


def verdict_grounding(expected: DataFrame, checks: DataFrame, claims: DataFrame) -> DataFrame:
    """Faults of a verifier's checks by change: missing, invented, twice, verdicts that are no consent or lack evidence,
    evidence that is no later claim. expected: trace, delta; checks: trace, delta, verdict, evidence (claim ids);
    claims: trace, claim."""
    known = claims.groupBy("trace").agg(F.collect_set("claim").alias("known"))
    n = checks.groupBy("trace", "delta").agg(F.count("*").alias("n"), F.min_by(F.struct("verdict", "evidence"), "verdict").alias("c"))
    both = expected.withColumn("wanted", F.lit(True)).join(n, ["trace", "delta"], "full_outer").join(known, "trace", "left")
    verdict, evidence = F.col("c.verdict"), F.coalesce("c.evidence", F.expr("cast(array() as array<string>)"))
    rules = {
        "missing": F.col("n").isNull(), "invented": F.col("wanted").isNull(), "twice": F.coalesce(F.col("n") > 1, F.lit(False)), "no consent": verdict.isin("contradiction", "uncertain"), "no evidence": (verdict == "consistent") & (F.size(evidence) == 0),
        "needless evidence": (verdict == "not_mentioned") & (F.size(evidence) > 0), "no later claim": F.size(F.array_except(evidence, F.coalesce("known", F.expr("cast(array() as array<string>)")))) > 0,
    }
    return both.select("trace", "delta", listed(rules).alias("errors"))


def reusable(version: str, resources: str) -> Column:
    """Whether a finished result may be used again: same version and resources, ready, valid, and replayed in full if it
    had to be. Columns: version, resource_hash, status, valid, needs_replay, persisted, replay_passed, reconciled, verified."""
    replayed = F.col("persisted") & F.col("replay_passed") & F.col("reconciled") & F.col("verified")
    ok = (F.col("version") == version) & (F.col("resource_hash") == resources) & (F.col("status") == "ready_for_human_review") & F.col("valid") & (~F.col("needs_replay") | replayed)
    return F.coalesce(ok, F.lit(False))


def step_quality(steps: DataFrame) -> DataFrame:
    """Good and bad steps of each trace, by domain: traces, mean share of good steps, bad ones, those with a suggestion.
    steps: domain, trace, evaluation, suggestion."""
    bad = F.col("evaluation") == "BAD"
    each = steps.groupBy("domain", "trace").agg((F.count_if(F.col("evaluation") == "GOOD") / F.count("*")).alias("quality"), F.count_if(bad).alias("bad"), F.count_if(bad & (F.coalesce("suggestion", F.lit("")) != "")).alias("actionable"))
    return each.groupBy("domain").agg(F.count("*").alias("traces"), F.round(F.avg("quality"), 6).alias("avg_quality"), F.sum("bad").alias("bad_steps"), F.sum("actionable").alias("actionable"))


def changed_case(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The case that shows a change best: the first that was flagged before and is not any more, else the first. pairs:
    keys, case_id, before, after (flags)."""
    cured = F.when(F.col("before") & ~F.col("after"), 0).otherwise(1)
    return pairs.groupBy(*keys).agg(F.min_by("case_id", F.struct(cured.alias("c"), "case_id")).alias("case_id"), F.bool_or(F.col("before") & ~F.col("after")).alias("cured"))


def specificity(reviews: DataFrame, handles: Column, values: Column) -> DataFrame:
    """Whether a reason names a piece of evidence as a whole word (specific) or none (generic), and the values it quotes."""
    quoted = lambda w: F.regexp_replace(w, r"([^A-Za-z0-9_\s])", r"\\$1")
    found = lambda words: F.array_sort(F.filter(F.array_distinct(F.transform(words, F.lower)), lambda w: F.rlike(F.lower("reason"), F.concat(F.lit("(?<![a-z0-9])"), quoted(w), F.lit("(?![a-z0-9])")))))
    hits = found(handles)
    return reviews.select("id", F.when(F.size(hits) > 0, "specific").otherwise("generic").alias("specificity"), hits.alias("handles"), found(values).alias("quoted"))


def identifier_parts(name: Column) -> Column:
    """A name, the name with blanks, and its parts of four letters or more."""
    lower = F.lower(name)
    return F.array_distinct(F.concat(F.array(lower, F.replace(lower, F.lit("_"), F.lit(" "))), F.filter(F.split(lower, r"[_\s]+"), lambda p: F.length(p) >= 4)))


def state_changes(states: DataFrame) -> DataFrame:
    """Whether each step of a trace left another state than the one before. states: trace, step, state (JSON)."""
    before = F.lag("hash").over(Window.partitionBy("trace").orderBy("step"))
    return states.withColumn("hash", F.sha2(F.coalesce(F.to_json(F.try_parse_json("state")), "state"), 256)).withColumn("changed", F.coalesce(F.col("hash") != before, F.lit(False))).drop("state")


#: Where the text of a response stands, by protocol: a string, or a list of parts with texts.
RESPONSES = {"openai_chat": ("$.choices[0].message.content", False), "anthropic_messages": ("$.content", True), "gemini_generate_content": ("$.candidates[0].content.parts", True)}


def response_text(response: Column, protocol: Column, strict: bool = True) -> Column:
    """The text of a provider's response in the form of its protocol, and of no other. Parts whose text is no string are
    left out. A response without text and an unknown protocol end the job, or give null if not strict."""
    v = N.read(response)
    string = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (path, parts) in RESPONSES.items():
        joined = F.array_join(F.array_compact(F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: string(N.value_at(x, "text")))), "")
        out = out.when(protocol == name, joined if parts else string(F.try_variant_get(v, path, "variant")))
    text = F.when(F.trim(out, F.lit(" \t\n\r\x0b\x0c")) != "", out)
    if not strict:
        return text
    known = protocol.isin(*RESPONSES)
    return F.when(text.isNotNull(), text).when(known, F.raise_error(F.concat(protocol, F.lit(" response did not contain text content"))).cast("string")).otherwise(F.raise_error(F.concat(F.lit("unsupported protocol: "), F.coalesce(protocol, F.lit("none")))).cast("string"))


def action_errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Whether a call names a known tool and has all arguments that it needs. calls: id, tool, arguments (JSON); tools:
    tool, required."""
    rows = calls.join(tools, "tool", "left")
    given = F.coalesce(F.json_object_keys("arguments"), F.expr("cast(array() as array<string>)"))
    missing = F.array_sort(F.array_except("required", given))
    return rows.select("id", F.when(F.col("required").isNull(), "unknown tool").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))).alias("error"))
