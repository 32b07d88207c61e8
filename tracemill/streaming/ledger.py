"""An append-only ledger as a stream: the newest row of each key, upserted into a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traces import latest, upsert
from .states import _fs

#: Parts of the table by a hash of the key; a batch rewrites those that it touches.
BUCKETS = 64


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New lines of JSON files that appear in a folder."""
    return spark.readStream.schema(schema).json(path)


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The rows of each bucket's newest generation, with its bucket; of those before a batch if one is stated."""
    rows = spark.read.parquet(target)
    rows = rows if before is None else rows.filter(F.col("generation") < before)
    newest = rows.groupBy("bucket").agg(F.max("generation").alias("generation"))
    return rows.join(F.broadcast(newest), ["bucket", "generation"]).drop("generation")  # BUCKETS rows


def _exists(spark: SparkSession, target: str) -> bool:
    fs, at = _fs(spark, target)
    return fs.exists(at) and any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(at))


def keep_latest(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str):
    """Starts a query that holds the newest row of each key in a Parquet table under `target`, see `current`.

    A batch writes a new generation of the buckets that its keys fall into. One that is repeated after a failure writes
    the same generation again, so that the result stays the same; the generation before it is kept for that, older ones
    go. `states.keep_newest` writes changes alone and needs no table at all to find them."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, order).withColumn("bucket", bucket)
        if number and _exists(spark, target):  # batches without rows leave no table
            old = current(spark, target, number).join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")  # BUCKETS rows
            held = latest(new.unionByName(old.join(new.select(*keys), keys, "left_semi")), keys, order)
            new = upsert(old, held.select(*old.columns), keys)
        rows = new.withColumn("generation", F.lit(number))
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "generation").parquet(target)
        for bucket_ in (r["bucket"] for r in new.select("bucket").distinct().collect()):  # BUCKETS rows
            fs, at = _fs(spark, f"{target}/bucket={bucket_}")
            done = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at))
            for generation in [g for g in done if g < number][:-1]:
                fs.delete(_fs(spark, f"{target}/bucket={bucket_}/generation={generation}")[1], True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
