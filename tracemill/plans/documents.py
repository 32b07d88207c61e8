"""Nested JSON: a payload for each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from ..sources.tables import table
from .registry import query

KEEP_NULLS = {"ignoreNullFields": "false"}


def payloads(spark, sf_dir):
    """id, payload: nested objects, a list, nulls, secrets and identifiers; later: the same, some values changed."""
    key, part = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")

    def made(shift, status):
        items = F.array(F.struct(part.alias("sku"), (shift - part).alias("price")), F.struct((part + 1).alias("sku"), F.lit(None).cast("int").alias("price")))
        order = F.struct(status.alias("status"), F.concat(F.lit("#W"), text(key)).alias("order_id"), items.alias("items"), F.concat(F.lit("k"), text(key)).alias("api_key"))
        return F.to_json(F.struct((key % 2 == 0).alias("urgent"), order.alias("order"), F.lit(None).cast("string").alias("note"), F.struct(F.concat(F.lit("s"), text(key)).alias("sessionToken"), F.concat(F.lit("d-"), text(part)).alias("ref")).alias("meta")), KEEP_NULLS)

    # a payload takes far longer to read than a key to move: rows are dealt evenly, whatever files they come from
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(spark.sparkContext.defaultParallelism)
    return rows.select(key.alias("id"), part.alias("part"), F.col("o_orderstatus").alias("status"), made(F.lit(0), F.col("o_orderstatus")).alias("payload"), made(key % 3, F.when(key % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("later"))


ORDERS = "(SELECT o_orderkey AS id, o_custkey AS p, o_orderstatus AS s FROM orders)"
ITEMS = """'"items":[{"price":' || -p || ',"sku":' || p || '},{"price":null,"sku":' || (p + 1) || '}]'"""


@query(f"""SELECT id, '{{"meta":{{"ref":"d-' || p || '","sessionToken":"s' || id || '"}},"note":null,"order":{{"api_key":"k' || id || '",' || {ITEMS} || ',"order_id":"#W' || id || '","status":"' || s || '"}},"urgent":' || (id % 2 = 0)::VARCHAR || '}}' AS canonical FROM {ORDERS}""")
def f02_canonical(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", N.canonical(F.col("payload")).alias("canonical"))


@query(f"""SELECT id, '{{"meta":{{"ref":"d-' || p || '","sessionToken":"[REDACTED]"}},"note":null,"order":{{"api_key":"[REDACTED]",' || {ITEMS} || ',"order_id":"#W' || id || '","status":"' || s || '"}},"urgent":' || (id % 2 = 0)::VARCHAR || '}}' AS redacted FROM {ORDERS}""")
def f03_redacted(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", N.redacted(F.col("payload")).alias("redacted"))


@query(f"SELECT id, ['api_key', 'items', 'meta', 'note', 'order', 'order_id', 'price', 'ref', 'sessionToken', 'sku', 'status', 'urgent'] AS keys, true AS leaks FROM {ORDERS}")
def f04_nested_keys(spark, sf_dir):
    """keys at any depth, and whether a forbidden one is among them."""
    keys = N.keys(F.col("payload"))
    return payloads(spark, sf_dir).select("id", keys.alias("keys")).withColumn("leaks", F.arrays_overlap("keys", F.array(F.lit("gold"), F.lit("api_key"))))


@query(f"""SELECT id, u.k AS key, u.v AS value FROM (SELECT id, unnest([{{'k': 'status', 'v': '"' || s || '"'}}, {{'k': 'order_id', 'v': '"#W' || id || '"'}}, {{'k': 'sku', 'v': p::VARCHAR}}, {{'k': 'price', 'v': (-p)::VARCHAR}}, {{'k': 'sku', 'v': (p + 1)::VARCHAR}},
  {{'k': 'price', 'v': 'null'}}, {{'k': 'api_key', 'v': '"k' || id || '"'}}, {{'k': 'urgent', 'v': (id % 2 = 0)::VARCHAR}}, {{'k': 'note', 'v': 'null'}}, {{'k': 'sessionToken', 'v': '"s' || id || '"'}}, {{'k': 'ref', 'v': '"d-' || p || '"'}}]) AS u FROM {ORDERS})""")
def f05_leaves(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", F.explode(N.leaves(F.col("payload"), fields=("key", "value"))).alias("x")).select("id", "x.key", "x.value")


@query(f"""SELECT id, list_sort(list_distinct([p::DOUBLE, (p + 1)::DOUBLE])) AS numbers, list_sort(list_distinct(list_filter(['#W' || id, 'k' || id, 's' || id, 'd-' || p], lambda x: length(x) >= 4))) AS strings FROM {ORDERS}""")
def f06_leaf_sets(spark, sf_dir):
    rows = payloads(spark, sf_dir).select("id", N.leaves(F.col("payload"), fields=("kind", "value", "text")).alias("x"))
    return rows.select("id", N.number_set(F.col("x")).alias("numbers"), N.string_set(F.col("x")).alias("strings"))


@query(f"""SELECT id, list_sort(list_distinct([(-p)::VARCHAR, '"' || s || '"', '"k' || id || '"', '"s' || id || '"', '"d-' || p || '"'])) AS exposed FROM {ORDERS}""")
def f07_exposed_scalars(spark, sf_dir):
    """scalars that are no identifiers."""
    return payloads(spark, sf_dir).select("id", N.exposed(N.leaves(F.col("payload"), fields=("path", "key", "kind", "value"))).alias("exposed"))


@query(f"""SELECT id, list_filter([CASE WHEN id % 3 <> 0 THEN 'order.items' END, CASE WHEN id % 5 = 0 THEN 'order.status' END], lambda x: x IS NOT NULL) AS changed FROM {ORDERS}""")
def f08_changed_paths(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", N.changed_paths(F.col("payload"), F.col("later")).alias("changed"))


@query(f"""SELECT id, s AS status, '"new"' AS after FROM {ORDERS}""")
def f09_paths(spark, sf_dir):
    """a value by its path, and another put in its place."""
    new = N.replaced(F.col("payload"), "order.status", F.lit('"new"'))
    return payloads(spark, sf_dir).select("id", F.variant_get(F.parse_json("payload"), "$.order.status", "string").alias("status"), F.to_json(F.variant_get(F.parse_json(new), "$.order.status", "variant")).alias("after"))


@query(f"""SELECT id, '{{"a":' || id || ',"b":{{"x":' || (id + 1) || ',"y":[3],"z":2}},"c":5}}' AS merged FROM {ORDERS}""")
def p09_deep_merge(spark, sf_dir):
    key = F.col("id")
    base = F.to_json(F.struct(key.alias("a"), F.struct(key.alias("x"), F.array(F.lit(1), F.lit(2)).alias("y"), F.lit(2).alias("z")).alias("b")))
    override = F.to_json(F.struct(F.struct((key + 1).alias("x"), F.array(F.lit(3)).alias("y")).alias("b"), F.lit(5).alias("c")))
    return payloads(spark, sf_dir).select("id", N.merged(base, override).alias("merged"))


@query(f"""SELECT id, '{{"order":{{"api_key":"k' || id || '","items":[{{"price":' || -p || ',"sku":' || p || '}},{{"sku":' || (p + 1) || '}}],"order_id":"#W' || id || '","status":"' || s || '"}},"urgent":' || (id % 2 = 0)::VARCHAR || '}}' AS pruned FROM {ORDERS}""")
def p11_pruned(spark, sf_dir):
    """Without nulls and some keys."""
    return payloads(spark, sf_dir).select("id", N.pruned(F.col("payload"), ("meta", "ticket")).alias("pruned"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '[' || props || ']' WHEN 3 THEN 'no json {' END AS coerced, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN props ELSE '' END AS greedy FROM events""")
def f13_coerced_reply(spark, sf_dir):
    """JSON in a reply, leniently, and from its first brace to its last."""
    which, fence = F.col("event_id") % 5, "`" * 3
    reply = F.when(which == 0, F.concat(F.lit(f"So:\n{fence}json\n"), "props", F.lit(f"\n{fence} done"))).when(which == 1, F.concat(F.lit("x "), "props", F.lit(" y"))).when(which == 2, F.concat(F.lit("list ["), "props", F.lit("] end"))).when(which == 3, " no json { ").otherwise("  ")
    e = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return e.select("event_id", N.coerced(F.col("reply")).alias("coerced"), F.coalesce(N.span(F.col("reply"), "{", "}"), F.lit("")).alias("greedy"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'v' || event_id END AS first_present, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS flag FROM events""")
def p30_coerced_values(spark, sf_dir):
    """Mixed values as booleans (null: the default), the first value that is present under some keys."""
    from ..functions.exprs import boolean, first_present

    i = F.col("event_id")
    props = F.when(i % 7 == 0, F.lit('{"other": 1, "a": null}')).when(i % 2 == 0, F.concat(F.lit('{"a": null, "b": "v'), i.cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"b": "w", "a": "v'), i.cast("string"), F.lit('"}')))
    flag = F.get(F.array(F.lit(" Yes"), F.lit("off"), F.lit(None).cast("string"), F.lit("maybe"), F.lit(""), F.lit("1")), (i % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", first_present(props, ["a", "b"]).alias("first_present"), boolean(flag, True).alias("flag"))
