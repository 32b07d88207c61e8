"""Readers, sinks, and the relations that queries run on, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICIES = ["naive", "retry", "fallback", "schema_first"]
STATUS = {"error": "timeout", "click": "rate_limit", "view": "malformed_schema"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Rows of a JSON-lines file by a stated schema. Blank lines are skipped; a line that is no object ends the job, with
    its number in its file; a missing file is an error, or an empty table if asked for."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "value"))
    lines = files.filter(F.trim("value") != "")
    error = F.raise_error(F.format_string("%s line %s is no JSON object: %s", F.col("file"), F.col("i") + 1, F.substring("value", 1, 80)))
    checked = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)), F.col("value")).otherwise(error)
    return lines.withColumn("value", checked).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("rows", "cases"), limit: int | None = None) -> DataFrame:
    """Records of JSON documents that are a list, or an object with a list under one of the keys; a document with neither
    ends the job. limit: the first records only."""
    text = spark.read.text(path, wholetext=True)
    lists = [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{_fields(schema)}>>") for k in keys]
    whole = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_fields(schema)}>>"))
    records = F.coalesce(whole, *lists)
    checked = F.when(records.isNotNull(), records).otherwise(F.raise_error(F.lit(f"neither a list nor an object with one of {', '.join(keys)}")))
    rows = text.select(F.explode(checked).alias("r")).select("r.*")
    return rows if limit is None else rows.limit(limit)


def manifest_rows(spark: SparkSession, manifest: DataFrame, folder: str, chosen: list[str] | None = None) -> DataFrame:
    """Rows of all files that a manifest (toolset_id, file) names, with their toolset; of some toolsets if asked. The files
    are read in one scan."""
    some = manifest if chosen is None else manifest.filter(F.col("toolset_id").isin(*chosen))
    names = some.select("toolset_id", "file")
    lines = spark.read.text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return lines.filter(F.trim("value") != "").join(names, "file").select("toolset_id", F.col("value").alias("record"))


def packet_ids(spark: SparkSession, glob: str, key: str) -> DataFrame:
    """The distinct ids in all packets that a pattern names."""
    return spark.read.text(glob).select(F.get_json_object("value", f"$.{key}").alias(key)).filter(F.col(key).isNotNull()).distinct()


def _fields(schema: str) -> str:
    return ", ".join(f"{part.split()[0]}: {' '.join(part.split()[1:])}" for part in schema.split(", "))


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to an append-only ledger."""
    df.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in this order, keys sorted, nulls kept; what was there goes."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")
    df.orderBy(*order).select(text).write.mode("overwrite").text(path)


def write_document(df: DataFrame, path: str, key: str, value: str) -> None:
    """One JSON document for each key with the list of its values in order; the lists are small aggregates."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(value))
    lists.select(F.to_json(F.struct(key, value)).alias("value")).write.mode("overwrite").text(path)


def hashes(df: DataFrame) -> DataFrame:
    """rows, and a hash of them that their order does not change: a sum of the first 15 digits of each row's sha256."""
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("hash"))


def freeze(df: DataFrame, path: str, key: str | None = None, rows: int | None = None) -> None:
    """An immutable snapshot with a manifest of its hash beside it; an existing one is never overwritten. Before that, the
    key has to be unique and the number of rows the expected one, if these are stated."""
    if key is not None and df.count() > df.select(key).distinct().count():
        raise ValueError(f"{key} is not unique")
    manifest = hashes(df)
    if rows is not None and (n := manifest.first()["rows"]) != rows:
        raise ValueError(f"expected {rows} rows, found {n}")
    df.write.mode("errorifexists").parquet(path)
    manifest.write.mode("errorifexists").json(f"{path.rstrip('/')}.manifest")


def refuse_secrets(df: DataFrame, column: str, pattern: str = r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*\S+") -> DataFrame:
    """The rows, unless one holds a secret: then the job ends before it is exported."""
    bad = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit("a secret would be exported"))).otherwise(F.col(column)))


def public(df: DataFrame, private: list[str]) -> DataFrame:
    """The columns that may be shown."""
    return df.drop(*private)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool call each: policy, task_id, attempt_number, status, latency_ms, cost_usd, tool, ordinal."""
    e = table(spark, sf_dir, "events")
    policy = F.element_at(F.array(*map(F.lit, POLICIES)), (F.col("event_id") % 4 + 1).cast("int"))
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")], F.lit("success"))
    task = F.col("user_id") * 100 + F.dayofmonth("ts")
    order = Window.partitionBy("policy", "task_id").orderBy("ts", "event_id")
    latency = F.floor("value").cast("long")
    return e.select("event_id", "ts", "user_id", policy.alias("policy"), task.alias("task_id"), status.alias("status"), latency.alias("latency_ms"), (F.lit(0.0006) + latency * F.lit(0.00001)).alias("cost_usd"), "event_type").withColumn("attempt_number", F.row_number().over(order))


ATTEMPTS = """
attempts AS (
  SELECT event_id, ts, user_id, (['naive', 'retry', 'fallback', 'schema_first'])[event_id % 4 + 1] AS policy, user_id * 100 + day(ts) AS task_id,
    CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'rate_limit' WHEN 'view' THEN 'malformed_schema' ELSE 'success' END AS status,
    floor(value)::BIGINT AS latency_ms, 0.0006::DOUBLE + floor(value)::BIGINT * 0.00001::DOUBLE AS cost_usd, event_type,
    row_number() OVER (PARTITION BY event_id % 4, user_id * 100 + day(ts) ORDER BY ts, event_id) AS attempt_number
  FROM events
)"""


def task_results(calls: DataFrame) -> DataFrame:
    """policy, task_id, success, n_attempts, n_invalid, latency_ms, cost_usd, last_status"""
    last = F.max_by("status", "attempt_number")
    return calls.groupBy("policy", "task_id").agg(
        F.max((F.col("status") == "success").cast("int")).alias("success"), F.count("*").alias("n_attempts"), F.count_if(F.col("status") == "malformed_schema").alias("n_invalid"),
        F.sum("latency_ms").alias("latency_ms"), F.sum("cost_usd").alias("cost_usd"), last.alias("last_status"), F.min("user_id").alias("user_id"),
    )


RESULTS = """
results AS (
  SELECT policy, task_id, max((status = 'success')::INT) AS success, count(*) AS n_attempts, count(*) FILTER (status = 'malformed_schema') AS n_invalid,
    sum(latency_ms)::BIGINT AS latency_ms, sum(cost_usd) AS cost_usd, arg_max(status, attempt_number) AS last_status, min(user_id) AS user_id
  FROM attempts GROUP BY policy, task_id
)"""


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trajectory, ordinal, role, content of conversations."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trajectory"), F.col("turn").alias("ordinal"), "role", F.col("text").alias("content"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of tool-using traces, one trace for each user: trajectory, event_id, ordinal, turn, kind (call, write, result,
    message), role, tool, call_id, content, error, anchors, arguments, k."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    i, k, text = F.col("event_id"), F.col("k"), lambda c: c.cast("string")
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "view", "result").otherwise("message")
    ordinal = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.select(F.col("user_id").alias("trajectory"), "event_id", ordinal.alias("ordinal"), kind.alias("kind"), "k")
    tool = F.get(F.array(F.lit("lookup"), F.lit("calculate"), F.lit("update")), (i % 3).cast("int"))
    amount, ref = text(k % 5), F.concat(F.lit("R-10"), text(k % 4))
    content = F.when(F.col("kind") == "result", F.when(i % 2 == 0, F.format_string('{"amount": %s, "ref": "%s"}', amount, ref)).otherwise(F.format_string('{"ref":"%s","amount":%s}', ref, amount))).when((F.col("kind") == "message") & (i % 11 != 0), F.concat(F.lit("text "), text(k)))
    called = F.col("kind").isin("call", "write")
    call_id = F.when(called, F.concat(F.lit("c"), text(i % 23))).when((F.col("kind") == "result") & (i % 5 != 0), F.concat(F.lit("c"), text(i % 29)))
    role = F.when(F.col("kind") == "result", "tool").when((F.col("kind") == "message") & (i % 2 == 0), "user").otherwise("assistant")
    arguments = F.when(called, F.when(tool == "calculate", F.format_string('{"expression":"%s + 1.5 * x2"}', amount)).otherwise(F.format_string('{"ref":"%s","n":%s}', ref, amount)))
    anchors = F.when(F.col("kind") == "write", F.array_distinct(F.array(F.concat(F.lit("#W00"), text(k % 6)), F.concat(F.lit("user-"), text(k % 5)))))
    return rows.select(
        "trajectory", "event_id", "ordinal", F.floor((F.col("ordinal") - 1) / 4).cast("int").alias("turn"), "kind", role.alias("role"), F.when(called, tool).alias("tool"), call_id.alias("call_id"), content.alias("content"),
        ((F.col("kind") == "result") & (i % 13 == 0)).alias("error"), anchors.alias("anchors"), arguments.alias("arguments"), "k",
    )


TOOL_EVENTS = """
raw_events AS (SELECT user_id AS trajectory, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS ordinal,
  CASE event_type WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'write' WHEN 'view' THEN 'result' ELSE 'message' END AS kind, (props->>'$.k')::BIGINT AS k FROM events),
tool_events AS (SELECT trajectory, event_id, ordinal, ((ordinal - 1) // 4)::INT AS turn, kind, CASE WHEN kind = 'result' THEN 'tool' WHEN kind = 'message' AND event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN kind IN ('call', 'write') THEN ['lookup', 'calculate', 'update'][event_id % 3 + 1] END AS tool,
  CASE WHEN kind IN ('call', 'write') THEN 'c' || event_id % 23 WHEN kind = 'result' AND event_id % 5 <> 0 THEN 'c' || event_id % 29 END AS call_id,
  CASE WHEN kind = 'result' AND event_id % 2 = 0 THEN '{"amount": ' || k % 5 || ', "ref": "R-10' || k % 4 || '"}' WHEN kind = 'result' THEN '{"ref":"R-10' || k % 4 || '","amount":' || k % 5 || '}' WHEN kind = 'message' AND event_id % 11 <> 0 THEN 'text ' || k END AS content,
  kind = 'result' AND event_id % 13 = 0 AS error, CASE WHEN kind = 'write' THEN ['#W00' || k % 6, 'user-' || k % 5] END AS anchors,
  CASE WHEN kind NOT IN ('call', 'write') THEN NULL WHEN event_id % 3 = 1 THEN '{"expression":"' || k % 5 || ' + 1.5 * x2"}' ELSE '{"ref":"R-10' || k % 4 || '","n":' || k % 5 || '}' END AS arguments, k FROM raw_events)"""
