"""Views of evidence that monitors see. events: trace, ordinal, event_id, source, operation, event_type, required, payload
(a map of texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nested import is_identifier

#: The event that holds the monitored output; kinds of views; factors of two sets of views.
SUBJECT = "subject_output"
VIEWS = ("full", "silent_filter", "explicit_redaction", "handoff_summary", "protected_summary", "actionable_summary")
PACKAGING = {"full": ("raw", "values_present"), "raw_projection": ("raw", "values_stripped"), "lossless_summary": ("summary", "values_present"), "actionable_summary": ("summary", "values_stripped")}
DROPS = {"symmetric_advertised": ("symmetric", "advertised"), "symmetric_silent": ("symmetric", "silent"), "asymmetric_advertised": ("asymmetric", "advertised"), "asymmetric_silent": ("asymmetric", "silent")}


def factors(view_type: Column) -> Column:
    """packaging and content, scope and announcement of a view; null where the view has no such factor."""
    names = ("packaging", "content", "scope", "announcement")
    table = {k: (*v, None, None) for k, v in PACKAGING.items()} | {k: (None, None, *v) for k, v in DROPS.items()}
    return F.struct(*[F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[i]).cast("string"))])[view_type].alias(n) for i, n in enumerate(names)])


def build_views(events: DataFrame, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """A row for each trace and view: visible (ids in order), redacted (ids whose payload is taken out), summary (the text
    of a summarising event) and missing (expected event types that a protected summary lacks)."""
    all_ = F.array_sort(F.collect_list(F.struct("ordinal", "event_id", "source", "operation", "event_type", "required", F.to_json("payload").alias("json"))))  # the events of one trace
    rows = events.groupBy("trace").agg(all_.alias("e")).withColumn("view_type", F.explode(F.array(*map(F.lit, views))))
    ids = lambda c: F.transform(c, lambda x: x["event_id"])
    first = F.get(F.filter("e", lambda x: x["required"]), 0)["event_id"]
    subject = F.filter("e", lambda x: x["event_id"] == SUBJECT)
    view, kept = F.col("view_type"), F.filter("e", lambda x: ~x["required"])
    facts = F.transform(kept, lambda x: F.concat(x["source"], F.lit("."), x["operation"], F.lit(" returned "), x["json"]))
    summarised = view.isin("handoff_summary", "protected_summary")
    visible = (
        F.when(view == "silent_filter", F.filter(ids(F.col("e")), lambda x: ~x.eqNullSafe(first))).when(summarised, F.concat(ids(subject), F.array(F.lit("handoff_summary"))))
        .when(view == "actionable_summary", F.concat(ids(subject), F.array(F.lit("actionable_summary")))).otherwise(ids(F.col("e")))
    )
    expected = F.array_distinct(F.transform(F.filter("e", lambda x: x["event_id"] != SUBJECT), lambda x: x["event_type"]))
    return rows.select(
        "trace", "view_type", visible.alias("visible"), F.when((view == "explicit_redaction") & first.isNotNull(), F.array(first)).otherwise(F.expr("cast(array() as array<string>)")).alias("redacted"),
        F.when(summarised, F.coalesce(F.nullif(F.array_join(facts, " | "), F.lit("")), F.lit("No independent detail was retained."))).alias("summary"),
        F.when(view == "protected_summary", F.array_sort(F.array_except(expected, F.array(F.lit("handoff_summary"))))).alias("missing"),
    )


def actionable_items(events: DataFrame) -> DataFrame:
    """What an actionable summary says of each event: all of it, or of required ones identifiers and names of fields."""
    rows = events.filter(F.col("event_id") != SUBJECT)
    kept = F.map_filter("payload", lambda k, _: is_identifier(k))
    names = F.array_sort(F.map_keys("payload"))
    return rows.select("trace", "event_id", F.when(F.col("required"), kept).otherwise(F.col("payload")).alias("payload"), F.when(F.col("required"), names).alias("available_fields"))


def dropped_fields(events: DataFrame, drops: DataFrame, advertised: bool) -> DataFrame:
    """Payloads without the fields that a table (trace, event_id, field) names; if advertised, with the names of all."""
    lists = drops.groupBy("trace", "event_id").agg(F.collect_set("field").alias("gone"))
    rows = events.join(lists, ["trace", "event_id"], "left").withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<string>)")))
    left = F.map_filter("payload", lambda k, _: ~F.array_contains("gone", k))
    return rows.select("trace", "event_id", left.alias("payload"), F.when(F.lit(advertised), F.array_sort(F.map_keys("payload"))).alias("available_fields"))


def view_errors(views: DataFrame, private: list[str], signals: list[str]) -> DataFrame:
    """Faults of views by id: ids that stand twice, private keys, silent views that name a gap, advertised ones that name
    none. views: view_id, silent, keys, text."""
    twice = F.count("*").over(Window.partitionBy("view_id")) > 1
    leaked = F.arrays_overlap("keys", F.array(*map(F.lit, private)))
    gap = F.exists(F.array(*map(F.lit, signals)), lambda s: F.contains(F.col("text"), s))
    rules = {"duplicate view id": twice, "private key leaked": leaked, "silent view names its gap": F.col("silent") & gap, "advertised view names no gap": ~F.col("silent") & ~gap}
    return views.withColumn("twice", twice).select("view_id", F.array_compact(F.array(*[F.when(F.col("twice") if n == "duplicate view id" else c, n) for n, c in rules.items()])).alias("errors"))


def matched_twins(views: DataFrame) -> DataFrame:
    """Families whose safe and unsafe twin show the same evidence, and those that lack one. views: family, outcome, evidence."""
    side = lambda o: F.max(F.when(F.col("outcome") == o, F.col("evidence")))
    return views.groupBy("family").agg(side("safe").eqNullSafe(side("unsafe")).alias("same_evidence"), (F.count_distinct("outcome") == 2).alias("both"))


def variant_balance(variants: DataFrame) -> DataFrame:
    """Whether each base case has four variants of four different conditions, whose evidence is the same. variants: base,
    payload_state, self_label, evidence."""
    return variants.groupBy("base").agg(
        F.count("*").alias("n"), F.count_distinct("payload_state", "self_label").alias("conditions"), (F.count_distinct("evidence") == 1).alias("evidence_constant"),
    ).withColumn("passed", F.expr("n = 4 and conditions = 4 and evidence_constant"))
