"""Pairing, top-k, quotas, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import traces as T
from ..sources.tables import table
from .registry import query


LINES = "l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 50 AS task, l_suppkey AS agent, l_returnflag AS flag, l_quantity::BIGINT AS size FROM lineitem)"


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 50).alias("task"), F.col("l_suppkey").alias("agent"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("size"))


@query(f"""WITH {LINES}, p AS (SELECT s.task, s.agent, s.id AS safe_id, u.id AS unsafe_id, abs(s.size - u.size) AS gap FROM l s JOIN l u ON s.task = u.task AND s.agent = u.agent AND s.flag = 'N' AND u.flag = 'R')
SELECT task, agent, safe_id, unsafe_id, gap, rank FROM (SELECT *, row_number() OVER (PARTITION BY safe_id ORDER BY gap, unsafe_id)::INT AS rank FROM p) WHERE rank <= 2""")
def j10_candidate_pairs(spark, sf_dir):
    x = _lines(spark, sf_dir)
    safe = x.filter("flag = 'N'").select("task", "agent", F.col("id").alias("safe_id"), "size")
    unsafe = x.filter("flag = 'R'").select("task", "agent", F.col("id").alias("unsafe_id"), "size")
    return T.candidate_pairs(safe, unsafe, ["task", "agent"], 2)


@query(f"""WITH {LINES} SELECT task, id, rank FROM (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY size DESC, id)::INT AS rank FROM l) WHERE rank <= 3""")
def w10_top_k_per_group(spark, sf_dir):
    return T.first_k(_lines(spark, sf_dir), ["task"], [F.desc("size"), "id"], 3).select("task", "id", "rank")


@query(f"""WITH {LINES} SELECT task, id, turn FROM (SELECT task, id, size, row_number() OVER (PARTITION BY task ORDER BY size DESC, id)::INT AS turn FROM l) ORDER BY turn, size DESC, id LIMIT 120""")
def t06_distinct_task_first(spark, sf_dir):
    return T.distinct_first(_lines(spark, sf_dir), "task", [F.desc("size"), "id"], 120).select("task", "id", "turn")


@query(f"""WITH {LINES}, r AS (SELECT task, flag, id, row_number() OVER (PARTITION BY task, flag ORDER BY size, id)::INT AS rank FROM l)
SELECT task, flag, id, rank FROM r WHERE rank <= CASE flag WHEN 'A' THEN 3 WHEN 'R' THEN 1 ELSE 2 END""")
def t07_quotas(spark, sf_dir):
    x = _lines(spark, sf_dir)
    cells = x.select("task", "flag").distinct().join(F.broadcast(spark.createDataFrame([("A", 3), ("R", 1)], "flag string, quota int")), "flag")
    return T.quota(x, ["task", "flag"], ["size", "id"], cells, 2).select("task", "flag", "id", "rank")


@query("SELECT doc_id, sha256('reviewer' || doc_id) AS place FROM documents")
def t03_seeded_order(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("reviewer"), F.col("doc_id").cast("string")), 256).alias("place")).orderBy("place")


@query("SELECT l_partkey % 1000 AS id FROM lineitem WHERE l_returnflag = 'N' UNION SELECT l_partkey % 1000 FROM lineitem WHERE l_returnflag = 'R'")
def u02_union_distinct(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1000).alias("id"), "l_returnflag")
    return x.filter("l_returnflag = 'N'").select("id").union(x.filter("l_returnflag = 'R'").select("id")).distinct()


@query("SELECT doc_id AS id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def u03_intersect(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")).intersect(table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"))


@query("SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def u04_except_reviewed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("""WITH a AS (SELECT DISTINCT l_partkey % 997 AS k FROM lineitem WHERE l_returnflag = 'N'), b AS (SELECT DISTINCT p_partkey % 997 AS k FROM part WHERE p_size < 10), c AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT 'dev' AS a, 'final' AS b, count(*) AS shared FROM a JOIN b USING (k) UNION ALL SELECT 'dev', 'seed', count(*) FROM a JOIN c USING (k) UNION ALL SELECT 'final', 'seed', count(*) FROM b JOIN c USING (k)""")
def u05_overlap(spark, sf_dir):
    dev = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select((F.col("l_partkey") % 997).alias("k"))
    final = table(spark, sf_dir, "part").filter("p_size < 10").select((F.col("p_partkey") % 997).alias("k"))
    return Q.overlap({"dev": dev, "final": final, "seed": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))}, ["k"])


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def j23_semi_and_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(o.filter("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")
