"""Seeds, packets for review and what they rest on; recovery from failed steps; identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions.exprs import content_id
from .audits import listed

NO_TEXTS = "cast(array() as array<string>)"


def first_failed_steps(steps: DataFrame) -> DataFrame:
    """(trace, index, tool, arguments, status): the first step of a trace that called a tool and was observed to fail. steps:
    trace, index, action_type, tool, arguments, status (null: nothing was observed)."""
    failed = steps.filter((F.col("status") != "success") & (F.col("action_type") == "tool_call"))
    return failed.groupBy("trace").agg(F.min_by(F.struct("index", "tool", "arguments", "status"), "index").alias("s")).select("trace", "s.*")


def evaluated_success(success: Column, claims: Column, response: Column) -> Column:
    """Whether a run succeeded and its last response holds all claims, whatever their case."""
    low = F.lower(F.coalesce(response, F.lit("")))
    return F.coalesce(success, F.lit(False)) & F.forall(F.coalesce(claims, F.expr(NO_TEXTS)), lambda c: F.contains(low, F.lower(c)))


def recovery_messages(prompt: str, query: Column, action: Column, status: Column, result: Column) -> Column:
    """The messages before a recovery: system, the task, the action that failed, and what its tool said."""
    said = F.concat(F.lit('Tool result: {"status": '), N.quoted(F.coalesce(status, F.lit(""))), F.lit(', "result": '), F.coalesce(N.of_json(result, N.dump), F.lit("null")), F.lit("}"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))
    return F.array(message("system", F.lit(prompt)), message("user", query), message("assistant", action), message("user", said))


def policy_drift(rows: DataFrame) -> DataFrame:
    """(domain, texts): domains whose rows don't carry one and the same policy text; a missing text is one of its own. rows:
    domain, policy."""
    return rows.groupBy("domain").agg((F.count_distinct("policy") + F.max(F.col("policy").isNull().cast("int"))).alias("texts")).filter("texts <> 1")


def rejection_context(error_lists: list[Column], most: int = 12) -> Column:
    """The first so many of all errors of an earlier attempt, in order."""
    return F.slice(F.concat(*[F.coalesce(e, F.expr(NO_TEXTS)) for e in error_lists]), 1, most)


def review_packet(ready: DataFrame, packeted: DataFrame, key: str, order: Column) -> DataFrame:
    """Ready rows that no packet holds yet, with their place (from 1) in the new one: by a hash that says nothing of them.
    Places are counted by ranges of the order, so that no task sees all rows."""
    rows = ready.join(packeted.select(key).distinct(), key, "left_anti").withColumn("at", order)
    part = F.substring("at", 1, 2)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # 256 rows at most, by the first digits of a hash
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy("at", key)) + F.col("before")
    return rows.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", place.cast("long")).drop("part", "before", "at")


def seed_errors(seeds: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """(domain, errors): what is wrong with the seeds of each domain: not so many rows, tasks that stand twice, traces that
    are unknown, of another domain or unsafe. seeds: domain, trajectory, task_id; known: trajectory, domain, safe."""
    of = known.select("trajectory", F.col("domain").alias("own"), "safe")
    each = seeds.join(of, "trajectory", "left").groupBy("domain").agg(
        F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks"), F.count_if(F.col("own").isNull()).alias("unknown"), F.count_if(F.col("own") != F.col("domain")).alias("elsewhere"), F.count_if(~F.coalesce("safe", F.lit(True))).alias("unsafe"),
    )
    rules = {"row count": F.col("n") != rows, "duplicate tasks": F.col("tasks") < F.col("n"), "unknown trajectory": F.col("unknown") > 0, "other domain": F.col("elsewhere") > 0, "not safe": F.col("unsafe") > 0}
    return each.select("domain", listed(rules).alias("errors"))


def set_hash(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many different keys there are and a hash of them in order. Keys are sorted by range before they are
    joined by parts, so that only the parts' hashes meet."""
    keys = rows.select(F.sha2(F.col(key).cast("string"), 256).alias("h")).filter("h is not null").distinct()
    parts = keys.groupBy(F.substring("h", 1, 3).alias("part")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("sum"))  # 4096 rows at most
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.concat_ws(":", "part", F.col("sum").cast("string")).alias("t")))), lambda x: x["t"]), ",")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), F.sha2(whole, 256).alias("hash"))


def pair_faults(pairs: DataFrame, per_domain: int) -> DataFrame:
    """(domain, pairs): domains that don't have just so many pairs with one safe and one unsafe side. pairs: domain,
    pair_id, label."""
    each = pairs.groupBy("domain", "pair_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))
    return each.groupBy("domain").agg(F.count_if((F.col("n") == 2) & (F.col("labels") == 2)).alias("pairs")).filter(F.col("pairs") != per_domain)


def request_id(*columns: str) -> Column:
    """The identity of a whole request: prefix and hash of all that it says, whatever the order of the columns."""
    return content_id("request_", *columns)


def is_entity_value(text: Column) -> Column:
    """Four characters or more that hold a digit or an @, or begin with #."""
    return (F.length(text) >= 4) & (text.rlike("[0-9]") | F.startswith(text, F.lit("#")) | F.contains(text, F.lit("@")))


def entity_values(payload: Column) -> Column:
    """The strings of a payload that name an entity, lower-cased and without blanks around, each once, in order."""
    texts = F.transform(F.filter(N.leaves(payload), lambda x: x["kind"] == "string"), lambda x: F.lower(F.trim(x["text"])))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(texts, F.expr(NO_TEXTS)), is_entity_value)))


def tool_names(definitions: Column) -> Column:
    """Names of tools in definitions (a JSON list), under `function` or at the top; those without one are left out."""
    name = lambda v: F.coalesce(N.value_at(v, "function.name", "string"), N.value_at(v, "name", "string"))
    return F.coalesce(F.filter(F.array_compact(F.transform(N.variants(N.read(definitions)), name)), lambda n: n != ""), F.expr(NO_TEXTS))


def registry_errors(models: DataFrame) -> DataFrame:
    """(model, errors): entries of a model registry that stand twice, lack a provider or protocol, or have prices or limits
    below zero. models: model, provider, protocol, price_in, price_out, max_tokens."""
    each = models.groupBy("model").agg(F.count("*").alias("n"), F.bool_or((F.coalesce("provider", F.lit("")) == "") | (F.coalesce("protocol", F.lit("")) == "")).alias("incomplete"), F.min(F.least("price_in", "price_out")).alias("price"), F.min("max_tokens").alias("tokens"))
    rules = {"duplicate": F.col("n") > 1, "incomplete": F.col("incomplete"), "negative price": F.coalesce(F.col("price") < 0, F.lit(False)), "no tokens": F.coalesce(F.col("tokens") <= 0, F.lit(True))}
    return each.select("model", listed(rules).alias("errors")).filter(F.size("errors") > 0)


def monitor_views(full: DataFrame, summaries: DataFrame, receipts: DataFrame) -> DataFrame:
    """(trace, view_type, evidence): each trace in full, its summary, and the summary with the receipts of its writes; a
    trace without a summary has the first alone. full, summaries, receipts: trace, evidence."""
    both = summaries.join(receipts.withColumnRenamed("evidence", "more"), "trace", "left").select("trace", F.concat("evidence", F.coalesce("more", F.lit(""))).alias("evidence"))
    named = lambda df, name: df.select("trace", F.lit(name).alias("view_type"), "evidence")
    return named(full, "full").unionByName(named(summaries, "summary")).unionByName(named(both, "summary_receipt"))


def seed_packets(events: DataFrame, targets: DataFrame, rules: DataFrame, calculators: list[str]) -> DataFrame:
    """(trajectory, domain, event_ids, rules, later_calculator_ids): what the one who changes a trace gets to see: its events
    in order, the rules of its domain, and the calls of calculators after the target, which a change would reach. events:
    trajectory, event_id, ordinal, tool; targets: trajectory, domain, target; rules (a few for each domain): domain, rule."""
    own = events.join(targets.select("trajectory", "target"), "trajectory")
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ordinal", "event_id")))), lambda x: x["event_id"])
    each = own.groupBy("trajectory").agg(ids(F.lit(True)).alias("event_ids"), ids(F.col("tool").isin(*calculators) & (F.col("ordinal") > F.col("target"))).alias("later_calculator_ids"))  # the events of one trace
    known = rules.groupBy("domain").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return targets.select("trajectory", "domain").join(each, "trajectory").join(F.broadcast(known), "domain", "left").select("trajectory", "domain", "event_ids", F.coalesce("rules", F.expr(NO_TEXTS)).alias("rules"), "later_calculator_ids")


def outcome_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows, different traces and different hashes there are of each outcome: the counts of a prepared data set or
    of a baseline run. rows: keys, trace, text."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("trace").alias("traces"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


def split_manifest(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks of each split; and of each task its domain, category, split, tools and number of claims. tasks: task_id, domain,
    category, split, tools, claims."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return tasks.groupBy("split").agg(F.count_distinct("task_id").alias("tasks")), tasks.select("task_id", "domain", "category", "split", "tools", F.greatest(count("claims"), F.lit(0)).alias("num_claims"))
