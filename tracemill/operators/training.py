"""Rows to train routers from: conversations and preferences in one form, preferences mined from failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import call_failure, tool_calls


def role(raw: Column) -> Column:
    name = F.lower(F.trim(raw))
    return F.when(name == "human", "user").when(name == "gpt", "assistant").when(name == "", "user").otherwise(name)


def messages(system: Column, turns: Column) -> Column:
    """One list of messages: the system text, if any, then all turns {from, value} with the roles that others use."""
    text = F.trim(F.coalesce(system, F.lit("")))
    first = F.when(text != "", F.array(F.struct(F.lit("system").alias("role"), text.alias("content")))).otherwise(F.expr("cast(array() as array<struct<role:string,content:string>>)"))
    return F.concat(first, F.transform(turns, lambda t: F.struct(role(t["from"]).alias("role"), t["value"].alias("content"))))


def preferences(rows: DataFrame, source: str) -> DataFrame:
    """prompt, chosen, rejected: the parts of the prompt joined, the first two outputs. A row with fewer ends the job."""
    enough = F.when(F.size("output") < 2, F.raise_error(F.lit("two outputs are needed: chosen and rejected")).cast("string"))
    prompt = F.array_join(F.filter(F.array("instruction", "input"), lambda x: F.coalesce(x != "", F.lit(False))), "\n\n")
    return rows.select("id", prompt.alias("prompt"), F.coalesce(enough, F.get("output", 0)).alias("chosen"), F.get("output", 1).alias("rejected"), F.lit(source).alias("source"))


def mined_failures(cases: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Cases whose prediction is there and wrong, as preferences: what was expected over what was predicted. cases:
    id, prompt, expected, predicted (texts)."""
    rows = cases.filter("expected is not null and predicted is not null")
    failure = call_failure(tool_calls(F.col("expected")), tool_calls(F.col("predicted")), allowed)
    # exploded, so that no filter reads the replies a second time
    wrong = F.explode(F.filter(F.array(failure), lambda f: f != "match")).alias("failure_type")
    return rows.select("id", F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("expected").alias("chosen"), F.col("predicted").alias("rejected"), wrong)


def mined_runs(results: DataFrame, cases: DataFrame, policy: str | None = None) -> DataFrame:
    """Preferences from the calls of runs, compared with the sequence that each case expects (or its first tool): the
    first expected and called tool differ, or how many there are. results: task_id, policy, row, tools; cases: task_id,
    expected. The policy stated is that of the task's first row, as in a look-up by task alone."""
    rows = results if policy is None else results.filter(F.col("policy") == policy)
    first = rows.groupBy("task_id").agg(F.min_by("policy", "row").alias("policy_of_task"))
    both = rows.join(cases, "task_id").join(first, "task_id")
    e, p = F.col("expected"), F.col("tools")
    kind = F.when((F.size(e) == 0) & (F.size(p) == 0), "match").when(F.size(e) == 0, "spurious_call").when(F.size(p) == 0, "missing_required_arg").when(F.get(e, 0) != F.get(p, 0), "wrong_function_name").when(F.size(e) != F.size(p), "spurious_call").otherwise("match")
    return both.withColumn("failure_type", kind).filter("failure_type <> 'match'").select("task_id", "row", "policy_of_task", "failure_type")


def alternatives(cases: DataFrame, most: int) -> DataFrame:
    """The expected tool over each of its first alternatives. cases: id, prompt, expected, alternatives."""
    rows = cases.select("id", "prompt", F.col("expected").alias("chosen"), F.posexplode(F.slice("alternatives", 1, most)).alias("rank", "rejected"))
    return rows.withColumn("rank", F.col("rank") + 1).filter("prompt <> '' and chosen <> '' and rejected <> '' and chosen <> rejected")


def mistakes(rows: DataFrame, repeats: dict[str, int]) -> DataFrame:
    """The expected tool over the called one, as often as the planner's factor says (once at least). rows: id, prompt,
    planner, expected, called."""
    n = F.coalesce(F.create_map(*[F.lit(x) for kv in repeats.items() for x in kv])[F.col("planner")], F.lit(1))
    bad = rows.filter("prompt <> '' and expected <> '' and called <> '' and expected <> called")
    return bad.select("id", "planner", F.col("expected").alias("chosen"), F.col("called").alias("rejected"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n))).alias("copy"))


def fault_schedule(tasks: DataFrame, hazards: list[str], faults: int) -> DataFrame:
    """For each task that needs tools and each fault the hazard and the step that it strikes, both in turn. tasks:
    task_id, category, steps [{action, tool}]."""
    steps = F.filter(F.transform("steps", lambda x, i: F.struct(i.alias("step"), x["action"].alias("action"), x["tool"].alias("tool"))), lambda x: x["action"] == "tool_call")
    rows = tasks.filter("category = 'tool_required'").withColumn("calls", steps).filter(F.size("calls") > 0).withColumn("fault", F.explode(F.sequence(F.lit(0), F.lit(faults - 1))))
    struck = F.get("calls", F.col("fault") % F.size("calls"))
    return rows.select("task_id", "fault", F.get(F.array(*map(F.lit, hazards)), F.col("fault") % len(hazards)).alias("hazard"), struck["step"].alias("step"), struck["tool"].alias("tool"))


def masked(tools: Column, record: Column, ratio: float, seed: int, prefix: str = "fn") -> Column:
    """{name: placeholder} for that share of a record's tools, those that come first by a hash of seed, record and name."""
    order = F.array_sort(F.transform(F.array_distinct(tools), lambda t: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), record.cast("string"), t), 256).alias("h"), t.alias("t"))))
    some = F.slice(order, F.lit(1), F.greatest(F.lit(1), F.round(F.size(order) * F.lit(ratio)).cast("int")))
    return F.map_from_entries(F.transform(some, lambda x, i: F.struct(x["t"], F.concat(F.lit(f"{prefix}_"), (i + 1).cast("string")))))
