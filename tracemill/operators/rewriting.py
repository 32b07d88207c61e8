"""Traces rewritten from other results, and views held against one another. events: trajectory, event_id, ordinal, turn,
role, tool, call_id, content, error, kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested as N
from .trails import linked_calls, redundant_results, signature


def synchronized(source: DataFrame, replayed: DataFrame) -> DataFrame:
    """The replayed events, where copies of results that the source holds twice say what the linked one says now, with
    `synchronized` for those that changed. Nothing else of an event changes; a pair of which one is gone is left alone."""
    linked = replayed.select("trajectory", F.col("event_id").alias("linked_event_id"), F.col("content").alias("now"), (F.col("role") == "tool").alias("is_result"))
    new = redundant_results(source).join(linked, ["trajectory", "linked_event_id"]).filter("is_result")
    new = new.select("trajectory", F.col("raw_event_id").alias("event_id"), F.struct("now").alias("new"))
    rows = replayed.join(new, ["trajectory", "event_id"], "left")
    other = F.col("new").isNotNull() & ~F.col("content").eqNullSafe(F.col("new.now"))
    return rows.select(*[F.when(other, F.col("new.now")).otherwise(F.col(c)).alias(c) if c == "content" else c for c in replayed.columns], other.alias("synchronized"))


def copy_conflicts(source: DataFrame, observed: DataFrame) -> DataFrame:
    """(trajectory, raw_event_id, linked_event_id): results that the source holds twice and that say different things in
    what was observed, or of which one is gone there."""
    says = lambda name: observed.select("trajectory", F.col("event_id").alias(f"{name}_event_id"), F.struct(signature().alias("says")).alias(name))
    both = redundant_results(source).join(says("raw"), ["trajectory", "raw_event_id"], "left").join(says("linked"), ["trajectory", "linked_event_id"], "left")
    same = F.col("raw").isNotNull() & F.col("linked").isNotNull() & F.col("raw.says").eqNullSafe(F.col("linked.says"))
    return both.filter(~same).select("trajectory", "raw_event_id", "linked_event_id")


def assembled(traces: DataFrame, source: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each trace: its columns, its events in order, the ids of its writes, where it comes from, and the ids of
    the copies that were brought in line: of synthetic traces, whose events are those of a mutation. traces: trajectory,
    synthetic, others."""
    marked = synchronized(source, events).join(traces.select("trajectory", "synthetic"), "trajectory")
    content = F.when(F.col("synthetic") | ~F.col("synchronized"), F.col("content")).otherwise(F.col("before"))
    before = events.select("trajectory", "event_id", F.col("content").alias("before"))
    rows = marked.join(before, ["trajectory", "event_id"]).withColumn("content", content)
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ordinal", "event_id")))), lambda x: x["event_id"])
    each = rows.groupBy("trajectory").agg(  # the events of one trace
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "event_id", "role", "content"))), lambda x: F.struct(x["event_id"], x["role"], x["content"])).alias("events"),
        ids(F.col("kind") == "write").alias("write_event_ids"), ids(F.col("synthetic") & F.col("synchronized")).alias("synchronized_event_ids"),
    )
    return traces.join(each, "trajectory").withColumn("provenance", F.when(F.col("synthetic"), "synthetic_mutation").otherwise("natural_safe_source"))


def _answers(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(trajectory, call, event_id): results that answer a call, by the link or by the id that both carry. Two equal joins
    in place of one on either key, which no hash could serve."""
    results = events.filter("role = 'tool'")
    by_link = linked_calls(events).filter("call_event_id is not null").select("trajectory", F.col("call_event_id").alias("call"), "event_id").join(calls.select("trajectory", F.col("event_id").alias("call")), ["trajectory", "call"])
    by_id = results.filter("call_id is not null").select("trajectory", "call_id", "event_id").join(calls.filter("call_id is not null").select("trajectory", F.col("event_id").alias("call"), "call_id"), ["trajectory", "call_id"])
    return by_link.select("trajectory", "call", "event_id").unionByName(by_id.select("trajectory", "call", "event_id")).distinct()


def recorded_results(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(trajectory, call, result_event_id, content, error): the first result with content that was recorded for each call.
    calls: trajectory, event_id, call_id."""
    own = events.filter("content is not null").select("trajectory", "event_id", "ordinal", "content", "error")
    answers = _answers(events, calls).join(own, ["trajectory", "event_id"])
    first = F.min_by(F.struct(F.col("event_id").alias("result_event_id"), "content", F.coalesce("error", F.lit(False)).alias("error")), "ordinal").alias("r")
    return answers.groupBy("trajectory", "call").agg(first).select("trajectory", "call", "r.*")


def with_results(events: DataFrame, results: DataFrame) -> DataFrame:
    """The events with other results for some calls, in all events that answer them; of calls that share an answer the last
    one counts. results: trajectory, event_id (the call), call_id, ordinal (of the call), new_content, new_error."""
    new = _answers(events, results).join(results.select("trajectory", F.col("event_id").alias("call"), F.col("ordinal").alias("at"), "new_content", "new_error"), ["trajectory", "call"])
    new = new.groupBy("trajectory", "event_id").agg(F.max_by(F.struct("new_content", "new_error"), "at").alias("new"))
    put = {"content": "new.new_content", "error": "new.new_error"}
    return events.join(new, ["trajectory", "event_id"], "left").select(*[F.when(F.col("new").isNotNull(), F.col(put[c])).otherwise(F.col(c)).alias(c) if c in put else c for c in events.columns])


#: The event that holds a summary of others, and the subject's own report.
SUMMARIZER, REPORT = "handoff_summarizer", "subject_output"


def records(views: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id, payload): what a view shows of each event, the event's own payload or that of the summary's item
    that stands for it; what comes last counts. views: keys, ordinal, event_id, source, payload (JSON)."""
    summary = F.col("source").eqNullSafe(F.lit(SUMMARIZER))
    item = lambda x: F.struct(N.value_at(x, "event_id", "string").alias("event_id"), F.when(N.value_at(x, "payload").isNotNull(), N.dump(N.value_at(x, "payload"))).alias("payload"))
    named = lambda x: F.schema_of_variant(N.value_at(x, "event_id")) == "STRING"
    items = F.transform(F.filter(N.variants(N.value_at(N.read(F.col("payload")), "summary")), named), item)
    own = F.array(F.struct(F.col("event_id").alias("event_id"), F.col("payload").alias("payload")))
    each = views.select(*keys, "ordinal", F.posexplode(F.when(summary, items).otherwise(own)).alias("i", "r")).filter("r.event_id is not null")
    last = F.max_by(F.col("r.payload"), F.struct("ordinal", "i"))
    return each.groupBy(*keys, F.col("r.event_id").alias("event_id")).agg(F.coalesce(last, F.lit("{}")).alias("payload"))


def shown_values(rows: DataFrame) -> DataFrame:
    """With `shown`, the scalars of each record that tell views apart, as JSON."""
    return rows.withColumn("shown", F.coalesce(N.exposed(N.leaves(F.col("payload"))), F.expr("cast(array() as array<string>)"))).drop("payload")


def missing_values(required: DataFrame, views: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id, hidden): values of required records that the view's record of the same event doesn't show. required:
    trace, event_id, payload; views: as in `records`, with trace among the keys."""
    critical = shown_values(required.select("trace", "event_id", "payload")).withColumnRenamed("shown", "critical")
    seen = shown_values(records(views, keys))
    wanted = views.select(*keys).distinct().join(critical, "trace")
    return wanted.join(seen, [*keys, "event_id"], "left").select(*keys, "event_id", F.array_sort(F.array_except("critical", F.coalesce("shown", F.expr("cast(array() as array<string>)")))).alias("hidden"))


def blobs(views: DataFrame, keys: list[str], without: Column | None = None) -> DataFrame:
    """(keys, blob): a hash of all events of a view but those left out, in order, whatever the order of their keys. views:
    keys, ordinal, event (JSON)."""
    rows = views if without is None else views.filter(~F.coalesce(without, F.lit(False)))
    text = F.coalesce(N.canonical(F.col("event")), "event", F.lit("null"))
    each = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.sha2(text, 256).alias("h")))).alias("h"))  # the events of one view
    return each.select(*keys, F.sha2(F.array_join(F.transform("h", lambda x: x["h"]), ","), 256).alias("blob"))


def carried_over(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, difference): views that are not the same on both sides: `changed`, `gone` or `new`. old, new: as in `blobs`."""
    both = blobs(old, keys).withColumnRenamed("blob", "a").join(blobs(new, keys).withColumnRenamed("blob", "b"), keys, "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").otherwise("changed").alias("difference"))
