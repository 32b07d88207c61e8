"""Joins between the events of a trace, and of a trace with a replay of it. events: trajectory, event_id, ordinal and, as
needed, turn, kind, role, tool, call_id, content, error, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested as N

#: Argument names that say which record an action is about.
TARGET_KEYS = ("order_id", "reservation_id", "record_id", "entity_id")
#: Fixed value: what a trace without a user's text is taken to ask for.
DEFAULT_REQUEST = "Complete the user's requested support action."


def shown() -> Column:
    """True for events that hold a call, a result or some text."""
    return (F.col("kind") != "message") | (F.coalesce("content", F.lit("")) != "")


def linked_calls(events: DataFrame) -> DataFrame:
    """Results with the call that they answer: of calls that share an id the last one; null for none."""
    calls = events.filter("tool is not null and call_id is not null").groupBy("trajectory", "call_id").agg(F.max_by("event_id", "ordinal").alias("call_event_id"))
    return events.filter("role = 'tool'").join(calls, ["trajectory", "call_id"], "left")


def receipts(events: DataFrame) -> DataFrame:
    """Each write with its first result, if any."""
    order = F.col("ordinal")
    results = linked_calls(events).filter("call_event_id is not null").groupBy("trajectory", "call_event_id").agg(F.min_by(F.struct(F.col("event_id").alias("result_event_id"), F.col("content").alias("result"), "error"), order).alias("r"))
    writes = events.filter("kind = 'write'").select("trajectory", F.col("event_id").alias("call_event_id"), "tool", "arguments")
    return writes.join(results, ["trajectory", "call_event_id"], "left").select("trajectory", "call_event_id", "tool", "arguments", "r.*")


def trace_errors(events: DataFrame) -> DataFrame:
    """How often each trace breaks a rule: ids that several calls share, results without an id or without a call."""
    each = events.groupBy("trajectory").agg(
        (F.count_if(F.col("tool").isNotNull()) - F.count_distinct(F.expr("case when tool is not null then call_id end"))).alias("duplicate_call_ids"),
        F.count_if((F.col("role") == "tool") & F.col("call_id").isNull()).alias("results_without_id"),
    )
    orphans = linked_calls(events).filter("call_id is not null and call_event_id is null").groupBy("trajectory").agg(F.count("*").alias("orphan_results"))
    return each.join(orphans, "trajectory", "left").fillna(0, ["orphan_results"]).withColumn("passed", F.expr("duplicate_call_ids = 0 and results_without_id = 0 and orphan_results = 0"))


def signature() -> Column:
    """What a result says, whatever the order of its keys and its blanks; null for other events."""
    return F.when(F.col("role") == "tool", F.concat(F.coalesce("error", F.lit(False)).cast("string"), F.lit(" "), F.coalesce(N.canonical(F.col("content")), "content", F.lit(""))))


def redundant_results(events: DataFrame) -> DataFrame:
    """Pairs of a result that no call is named for and the only linked one of the same turn that says the same; of
    several such the first. One aggregation: two linked ones are no pair, and a linked one is used once."""
    at = lambda linked: F.when(F.col("call_event_id").isNotNull() == linked, F.col("event_id"))
    each = linked_calls(events).filter("content is not null").withColumn("says", signature()).groupBy("trajectory", "turn", "says")
    each = each.agg(F.count(at(True)).alias("n"), F.min(at(True)).alias("linked_event_id"), F.min_by(at(False), F.when(at(False).isNotNull(), F.col("ordinal"))).alias("raw_event_id"))
    return each.filter("n = 1 and raw_event_id is not null").select("trajectory", "raw_event_id", "linked_event_id")


def same_entity_writes(events: DataFrame) -> DataFrame:
    """Every two writes of a trace that share an anchor, the anchors, and the events between them that hold something.
    They meet on anchors; a trace's events are sliced between the two."""
    w = Window.partitionBy("trajectory").orderBy("ordinal")
    all_ = F.array_sort(F.collect_list(F.struct("ordinal", "event_id", shown().alias("shown"))))  # the events of one trace
    traces = events.groupBy("trajectory").agg(all_.alias("events"))
    writes = events.filter("kind = 'write'").withColumn("rank", F.row_number().over(w)).select("trajectory", "event_id", "ordinal", "rank", F.explode("anchors").alias("anchor"))
    left = writes.toDF("trajectory", "earlier", "from", "r1", "anchor")
    pairs = left.join(writes.toDF("trajectory", "later", "to", "r2", "anchor"), ["trajectory", "anchor"]).filter("r1 < r2")
    pairs = pairs.groupBy("trajectory", "earlier", "later").agg(F.array_sort(F.collect_set("anchor")).alias("shared"), F.min("from").alias("from"), F.min("to").alias("to"))
    gap = F.filter(F.col("events"), lambda x: (x["ordinal"] > F.col("from")) & (x["ordinal"] < F.col("to")) & x["shown"])
    return pairs.join(traces, "trajectory").select("trajectory", "earlier", "later", "shared", F.transform(gap, lambda x: x["event_id"]).alias("gap_event_ids")).withColumn("gap_count", F.size("gap_event_ids"))


def replay_changes(baseline: DataFrame, mutated: DataFrame, targets: DataFrame) -> DataFrame:
    """Positions at which two replays differ in their results: before the target (pre_target) or from it on (causal).
    targets: trajectory, target (its ordinal)."""
    sides = [d.select("trajectory", "ordinal", F.col("event_id").alias(f"{n}_id"), signature().alias(n), F.when(F.col("role") == "tool", F.col("content")).alias(f"{n}_content")) for d, n in ((baseline, "before"), (mutated, "after"))]
    both = sides[0].join(sides[1], ["trajectory", "ordinal"]).filter(~F.col("before").eqNullSafe(F.col("after"))).join(targets, "trajectory")
    return both.withColumn("change", F.when(F.col("ordinal") < F.col("target"), "pre_target").otherwise("causal"))


def unfaithful_results(source: DataFrame, baseline: DataFrame) -> DataFrame:
    """Results that an unchanged replay lacks or gives otherwise."""
    there = baseline.select("trajectory", "event_id", signature().alias("replayed"), F.lit(True).alias("found"))
    both = source.filter("role = 'tool'").withColumn("says", signature()).join(there, ["trajectory", "event_id"], "left")
    return both.filter(F.col("found").isNull() | ~F.col("says").eqNullSafe(F.col("replayed"))).select("trajectory", "event_id")


def stale_references(events: DataFrame, changes: DataFrame, targets: DataFrame) -> DataFrame:
    """Later calls that still use values which the change replaced: numbers of an expression, else strings of the
    arguments. changes: causal ones of `replay_changes`."""
    leaves = lambda c: N.leaves(F.col(c))
    told = changes.filter("change = 'causal'").select("trajectory", leaves("before_content").alias("b"), leaves("after_content").alias("a"))
    lists = {f"{side}_{name}": F.array_distinct(F.flatten(F.collect_list(f(F.col(side))))) for side in "ab" for name, f in (("n", N.number_set), ("s", N.string_set))}  # the values of one trace
    gone = told.groupBy("trajectory").agg(*[c.alias(n) for n, c in lists.items()])
    gone = gone.select("trajectory", F.array_except("b_n", "a_n").alias("numbers"), F.array_except("b_s", "a_s").alias("strings"))
    later = events.filter("tool is not null").join(gone, "trajectory").join(targets, "trajectory").filter("ordinal > target")
    written = F.regexp_extract_all(F.get_json_object("arguments", "$.expression"), F.lit(r"((?<![A-Za-z0-9_.])-?\d+(?:\.\d+)?)"), F.lit(1))
    numbers = F.array_intersect(F.transform(written, lambda x: F.bround(F.abs(x.cast("double")), 9)), "numbers")
    strings = F.array_intersect(N.string_set(leaves("arguments")), "strings")
    stale = F.when(F.col("tool") == "calculate", F.transform(numbers, lambda x: x.cast("string"))).otherwise(strings)
    return later.select("trajectory", "event_id", "tool", F.array_sort(stale).alias("stale")).filter(F.size("stale") > 0)


def agreed_target(arguments: Column) -> Column:
    """The record that the arguments name, if all names agree; else null."""
    named = F.array_distinct(F.filter(F.array(*[F.get_json_object(arguments, f"$.{k}") for k in TARGET_KEYS]), lambda x: F.coalesce(x != "", F.lit(False))))
    return F.when(F.size(named) == 1, F.get(named, 0))


def target_checks(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """A decision for each action: ESCALATE unless the approved and the proposed target are named and equal and exactly
    one record changed after the approval; then BLOCK if it is the approved one, else ALLOW. rows: id, approved_at,
    approval and proposal (arguments as JSON); changes: id, changed_at, entity."""
    late = rows.select("id", "approved_at").join(changes, "id").filter("changed_at > approved_at and entity <> ''").groupBy("id").agg(F.count("*").alias("n"), F.min("entity").alias("changed"))
    all_ = rows.select("id", agreed_target(F.col("approval")).alias("approved"), agreed_target(F.col("proposal")).alias("proposed")).join(late, "id", "left").fillna(0, ["n"])
    clear = F.coalesce((F.col("approved") == F.col("proposed")) & (F.col("n") == 1), F.lit(False))
    return all_.withColumn("decision", F.when(~clear, "ESCALATE").when(F.col("changed") == F.col("approved"), "BLOCK").otherwise("ALLOW"))


def intervening(events: DataFrame, target: Column, support: Column) -> DataFrame:
    """For each target the events that hold something between it and the last support before it."""
    before = Window.partitionBy("trajectory").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    gathered = F.collect_list(F.when(shown(), F.struct("ordinal", "event_id"))).over(before)  # the events of one trace
    rows = events.withColumn("support", F.max(F.when(support, F.col("ordinal"))).over(before)).withColumn("seen", gathered).filter(target & F.col("support").isNotNull())
    return rows.select("trajectory", "event_id", "support", F.transform(F.filter("seen", lambda x: x["ordinal"] > F.col("support")), lambda x: x["event_id"]).alias("gap_event_ids"))


def ignored_results(events: DataFrame) -> DataFrame:
    """Whether an error of the trace is followed by an answer as the next action."""
    after = Window.partitionBy("trajectory").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    action = F.when(F.col("tool").isNotNull(), "call").when((F.col("kind") == "message") & (F.col("role") == "assistant"), "answer")
    rows = events.withColumn("next_action", F.first(action, ignorenulls=True).over(after))
    return rows.groupBy("trajectory").agg(F.coalesce(F.bool_or(F.col("error") & (F.col("next_action") == "answer")), F.lit(False)).alias("result_ignored"))


def patch_states(events: DataFrame, patches: DataFrame, changed: DataFrame) -> DataFrame:
    """Whether edits may be applied: to assistant prose after the first changed event, with some text. patches:
    trajectory, event_id, new_content; changed: trajectory, event_id."""
    first = changed.join(events.select("trajectory", "event_id", "ordinal"), ["trajectory", "event_id"]).groupBy("trajectory").agg(F.min("ordinal").alias("first_changed"))
    rows = patches.join(events.select("trajectory", "event_id", "ordinal", "role", "tool"), ["trajectory", "event_id"], "left").join(first, "trajectory", "left")
    prose = F.coalesce((F.col("role") == "assistant") & F.col("tool").isNull(), F.lit(False))
    state = F.when(F.col("first_changed").isNull(), "nothing_changed").when(~prose, "no_prose").when(F.col("ordinal") <= F.col("first_changed"), "not_after_change").when(F.trim(F.coalesce("new_content", F.lit(""))) == "", "empty").otherwise("applied")
    return rows.select("trajectory", "event_id", state.alias("state"))


def tail(events: DataFrame, n: int = 12) -> DataFrame:
    """The last n events of each trace."""
    w = Window.partitionBy("trajectory").orderBy(F.desc("ordinal"))
    return events.withColumn("from_end", F.row_number().over(w)).filter(F.col("from_end") <= n).drop("from_end")


def before_writes(events: DataFrame) -> DataFrame:
    """For each write the last user event before it, and the first user text of the trace or a stated default."""
    before = Window.partitionBy("trajectory").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("trajectory").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    user = F.col("role") == "user"
    rows = events.withColumn("last_user", F.last(F.when(user, F.col("event_id")), ignorenulls=True).over(before))
    text = F.first(F.when(user & (F.coalesce("content", F.lit("")) != ""), F.col("content")), ignorenulls=True).over(whole)
    return rows.withColumn("first_text", F.coalesce(text, F.lit(DEFAULT_REQUEST))).filter("kind = 'write'").select("trajectory", "event_id", "last_user", "first_text")


def selected(events: DataFrame, where: Column) -> DataFrame:
    """The event of each trace that a selector is for; a trace in which several match, or none, is an error row."""
    each = events.groupBy("trajectory").agg(F.count_if(where).alias("matches"), F.min(F.when(where, F.col("event_id"))).alias("event_id"))
    return each.select("trajectory", "matches", F.when(F.col("matches") == 1, F.col("event_id")).alias("event_id"))
