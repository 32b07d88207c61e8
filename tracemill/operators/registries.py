"""Registries that override one another, and what they have used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overridden(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The rows of all sources, of those that share a key the one of the last source that has it, and there the last by
    `line`; with `origin`, the source's name. Sources: keys, line, others."""
    ranked = [df.withColumn("origin", F.lit(name)).withColumn("priority", F.lit(i)) for i, (name, df) in enumerate(sources.items())]
    every = reduce(lambda a, b: a.unionByName(b), ranked)
    rest = [c for c in every.columns if c not in (*keys, "priority")]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("priority", "line")).alias("row")).select(*keys, "row.*").drop("line")


def case_rows(config: DataFrame, registry: DataFrame, registered_only: tuple[str, ...] = ("supplement", "supplement2")) -> DataFrame:
    """The cases of each stage: those of the registry where it has any for the stage, else those of the configuration. A
    stage that only a registry can have and that the configuration asks for, but no registry has, ends the job. config,
    registry: stage, case_id, others."""
    there = registry.select("stage").distinct()  # a few stages
    missing = F.when(F.col("stage").isin(*registered_only), F.raise_error(F.concat(F.lit("registry has no cases: "), "stage")).cast("string")).otherwise(F.col("stage"))
    rest = config.join(F.broadcast(there), "stage", "left_anti").withColumn("stage", missing)
    return registry.withColumn("origin", F.lit("registry")).unionByName(rest.withColumn("origin", F.lit("config")))


def accepted(traces: DataFrame, labels: DataFrame, reviews: list[DataFrame]) -> DataFrame:
    """(candidate_id, trajectory, origin): traces that both reviewers found safe, and those that a later review of seeds
    accepted; a later review of a candidate overrides an earlier one. Reviews of unknown traces don't count. traces:
    trajectory; labels: trajectory, final_label; reviews: candidate_id, trajectory, line."""
    safe = traces.join(labels.filter("final_label = 'safe'").select("trajectory").distinct(), "trajectory", "left_semi")
    first = safe.select(F.concat(F.lit("hardseed_"), F.substring(F.sha2(F.to_json(F.struct("trajectory")), 256), 1, 24)).alias("candidate_id"), "trajectory", F.lit(0).cast("long").alias("line"))
    known = [r.join(traces.select("trajectory"), "trajectory", "left_semi").select("candidate_id", "trajectory", "line") for r in reviews]
    return overridden({"merged_annotations": first} | {f"review_{i}": r for i, r in enumerate(known, 1)}, ["candidate_id"])


def used_trajectories(registries: list[DataFrame]) -> DataFrame:
    """The distinct traces in the cases and reserve cases of all registries. registries: cases, reserve_cases (arrays of
    structs with a trajectory)."""
    each = [r.select(F.explode(F.concat(F.coalesce("cases", F.array()), F.coalesce("reserve_cases", F.array()))).alias("c")).select("c.trajectory") for r in registries]
    return reduce(lambda a, b: a.unionByName(b), each).filter("trajectory is not null").distinct()


def used_tasks(registry: DataFrame, traces: DataFrame) -> DataFrame:
    """The distinct (domain, task_id) of a registry's traces; those that no source has are left out."""
    return traces.join(used_trajectories([registry]), "trajectory", "left_semi").select("domain", F.col("task_id").cast("string").alias("task_id")).distinct()
