"""Scalars over JSON and text, views and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.tables import table, trace_events
from .registry import query


@query("""SELECT event_id, 'ev_' || substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}'), 1, 24) AS content_id FROM events""")
def f01_content_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.content_id("ev_", "event_id", "event_type").alias("content_id"))


@query("SELECT event_type, list_sort(list_distinct(flatten(list(json_keys(props))))) AS keys, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY event_type")
def f04_json_keys(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_type", F.json_object_keys("props").alias("names"), k.alias("k"))
    sums = e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))
    keys = e.select("event_type", F.explode("names").alias("name")).distinct().groupBy("event_type").agg(F.array_sort(F.collect_set("name")).alias("keys"))  # a row for each key
    return sums.join(keys, "event_type").select("event_type", "keys", "k_sum", "k_max")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS object FROM events""")
def f11_json_in_reply(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fence = F.lit("```")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: "), fence, F.lit("json\n"), "props", F.lit("\n"), fence)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("It is "), "props", F.lit(" as asked."))).otherwise(F.lit("no {braces here"))
    return e.select("event_id", X.json_object(reply).alias("object"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n_words, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers FROM documents")
def f22_word_counts(spark, sf_dir):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count(r"[^ \t\n\r]+").alias("n_words"), count("[0-9]+").alias("n_numbers"))


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1)
SELECT conv_id AS trajectory, len(roles)::INT AS n, len(list_filter(roles, lambda r: r = 'user')) >= 2 AND len(list_filter(roles[list_position(roles, 'user'):], lambda r: r = 'assistant')) >= 1 AS has_turns FROM t""")
def f24_role_subsequence(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "role"))), lambda x: x["role"])  # the turns of one conversation
    t = trace_events(spark, sf_dir).groupBy("trajectory").agg(roles.alias("roles"))
    twice = X.is_subsequence(F.array(F.lit("user"), F.lit("user")), F.col("roles")) & X.is_subsequence(F.array(F.lit("user"), F.lit("assistant")), F.col("roles"))
    return t.select("trajectory", F.size("roles").alias("n"), twice.alias("has_turns"))


@query(r"SELECT page_id, list_sort(list_distinct(list_filter(regexp_extract_all(url, '([A-Za-z0-9_]+)', 1), lambda x: regexp_matches(x, '[0-9]')))) AS ids FROM pages")
def f31_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(F.array_distinct(X.identifiers(F.col("url")))).alias("ids"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT % 2 = 0 THEN 'A' ELSE 'B' END AS variant, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split FROM documents")
def p25_variant_and_split(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "dev").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id", X.parity_variant(F.col("doc_id").cast("string")).alias("variant"), split.alias("split"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*\S+') AS leaks, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') AS has_address FROM documents")
def k09_secret_scan(spark, sf_dir):
    leak = F.col("text").rlike(r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*\S+")
    return table(spark, sf_dir, "documents").select("doc_id", leak.alias("leaks"), F.col("text").rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}").alias("has_address"))


@query("""SELECT doc_id, (u.i - 1)::INT AS line, length(u.s) AS n_chars FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda s, i: {'s': s, 'i': i})) AS u FROM documents) WHERE trim(u.s, ' ') <> ''""")
def w13_line_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    return d.filter(F.trim("unit") != "").select("doc_id", "line", F.length("unit").cast("long").alias("n_chars"))
