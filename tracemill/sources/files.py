"""Files as rows: their hashes, and audits of a run's files against its manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The hash of no bytes.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, paths relative to it. Files are read where they are hashed; one
    may have 2 GB at most. Spark's readers leave empty files out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")  # noqa: E731  file:/x and file:///x are one
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    start = F.length(plain(F.lit(whole))) + 2
    return rows.select(F.substring(plain(F.col("path")), start, F.length("path")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_audit(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, error): files that are `missing` or `surplus`, whose content `changed`, or that the manifest names twice with
    different hashes (`ambiguous`). found: path, sha256; manifest: path, sha256. Hashes compare whatever their case. An
    empty file is never found, so that one that the manifest has as such is not missing."""
    wanted = manifest.groupBy("path").agg(F.min(F.lower("sha256")).alias("wanted"), F.max(F.lower("sha256")).alias("other"))
    both = wanted.join(found.select("path", F.lower("sha256").alias("sha256")), "path", "full_outer")
    error = F.when(F.col("sha256").isNull(), F.when(F.col("wanted") != EMPTY, "missing")).when(F.col("wanted").isNull(), "surplus").when(F.col("wanted") != F.col("other"), "ambiguous").when(F.col("wanted") != F.col("sha256"), "changed")
    return both.select("path", error.alias("error")).filter("error is not null")


def run_audit(spark: SparkSession, folder: str, manifest: DataFrame, results: DataFrame) -> DataFrame:
    """(error, subject): the faults of a run's files and those of its results, of which each `errors` is one. results: id,
    errors."""
    files = file_audit(file_hashes(spark, folder), manifest).select(F.concat(F.lit("file "), "error").alias("error"), F.col("path").alias("subject"))
    return files.unionByName(results.select(F.explode("errors").alias("error"), F.col("id").cast("string").alias("subject")))


def freeze_files(spark: SparkSession, folder: str, names: list[str], target: str, facts: dict, references: dict[str, str] | None = None) -> DataFrame:
    """Copies the named files of a run into a folder that must not exist yet, with `freeze_manifest.json` beside them: the
    facts that are stated of the run, the hash of each copy, and those of other files that it rests on (by name, a path).
    Returns the manifest (path, sha256), which `file_audit` holds against the copies later. A name that the run lacks ends
    the job before anything is written. Names are a run's few artifacts."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    goal = path(target)
    fs = goal.getFileSystem(conf)
    if fs.exists(goal):
        raise FileExistsError(f"{target} is frozen already")
    source = path(folder).getFileSystem(conf)
    if gone := [n for n in names if not source.exists(path(folder, n))]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(gone)}")
    for name in names:
        jvm.org.apache.hadoop.fs.FileUtil.copy(source, path(folder, name), fs, path(target, name), False, True, conf)
    hashes = {r["path"]: r["sha256"] for r in file_hashes(spark, target).collect()}  # a row for each name
    others = {name: r["sha256"] for name, at in (references or {}).items() for r in file_hashes(spark, at).collect()}
    text = json.dumps({**facts, "artifact_sha256": hashes, "reference_sha256": others, "immutable": True}, sort_keys=True, indent=1)
    out = fs.create(path(target, "freeze_manifest.json"), False)
    out.write(text.encode())
    out.close()
    return spark.createDataFrame(sorted(hashes.items()), "path string, sha256 string")
