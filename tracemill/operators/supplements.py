"""Selections that go on where a task or an agent is used up: family quotas in passes, and cases given to the agents that
are used least."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHOSEN = "domain string, task_id string, candidate_id string, trajectory string, family string, task_reused boolean, reused_before boolean, position long"


def supplement(rows: DataFrame, families: list[str], per_domain: int) -> DataFrame:
    """At most per_domain rows for each domain: domain, task_id, candidate_id, trajectory, family, task_reused (another
    row of the result has its task), reused_before, position. rows: domain, task_id, candidate_id, trajectory, fits (the
    scores of the families that it is eligible for), reused_before (an earlier selection has its task).

    First each family in turn takes its share of the best scores, one row for each task, and no task that any selection
    has. Where a domain is not full then, the best of the tasks left take their best family, earlier selections or not,
    and then any rows left. Each pass is one ranking: a task's first row by an aggregation, the first of the domain by a
    window that keeps only so many rows of each task of the job. Null domains, tasks and ids take no part; rows that
    repeat a candidate_id count once; domains are few, and what is chosen of them is held by the driver."""
    spark, quota = rows.sparkSession, max(1, per_domain // len(families))
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = rows.filter("domain is not null and task_id is not null and candidate_id is not null").select(text("domain"), text("task_id"), text("candidate_id"), text("trajectory"), "fits", F.coalesce("reused_before", F.lit(False)).alias("reused_before"))
    best = F.array_max(F.array(*[F.when(F.col("fits")[f].isNotNull(), F.struct(F.col("fits")[f].alias("score"), F.lit(-i).alias("place"), F.lit(f).alias("family"))) for i, f in enumerate(families)]))
    rows = rows.groupBy("candidate_id").agg(F.max(F.struct("domain", "task_id", "trajectory", "reused_before", F.map_entries("fits").alias("fits"))).alias("r")).select("candidate_id", "r.*").withColumn("fits", F.map_from_entries("fits")).withColumn("best", best).filter("best is not null")
    taken: list[tuple] = []

    def take(score, family, open_, most: int, one_each: bool) -> None:
        chosen = F.broadcast(spark.createDataFrame(taken, CHOSEN))  # per_domain rows of each domain
        left = open_.join(chosen.select("candidate_id"), "candidate_id", "left_anti")
        used = F.broadcast(chosen.select("domain", "task_id").distinct().withColumn("used", F.lit(True)))
        left = left.join(used, ["domain", "task_id"], "left").withColumn("order", F.struct((-score).alias("neg"), "task_id", "trajectory", "candidate_id")).withColumn("family", family)
        if one_each:
            left = left.filter("used is null").groupBy("domain", "task_id").agg(F.min_by(F.struct("candidate_id", "trajectory", "family", "reused_before", "order"), "order").alias("r")).select("domain", "task_id", "r.*", F.lit(None).cast("boolean").alias("used"))
        rank = F.row_number().over(Window.partitionBy("domain").orderBy("order"))
        ranked = left.withColumn("rank", rank).filter(F.col("rank") <= most)
        counts = F.broadcast(chosen.groupBy("domain").agg(F.count("*").alias("had")))
        new = ranked.join(counts, "domain", "left").filter(F.col("rank") <= per_domain - F.coalesce("had", F.lit(0)))
        new = new.select("domain", "task_id", "candidate_id", "trajectory", "family", F.coalesce("used", F.lit(False)).alias("task_reused"), "reused_before", (F.coalesce("had", F.lit(0)) + F.col("rank")).cast("long").alias("position"))
        taken.extend(tuple(r) for r in new.collect())

    for f in families:
        take(F.col("fits")[f], F.lit(f), rows.filter(F.col("fits")[f].isNotNull() & ~F.col("reused_before")), quota, True)
    take(F.col("best.score"), F.col("best.family"), rows, per_domain, True)
    take(F.col("best.score"), F.col("best.family"), rows, per_domain, False)
    return spark.createDataFrame(taken, CHOSEN)


def seed_mapping(cases: DataFrame, candidates: DataFrame, priority: list[str], least_writes: dict[str, int]) -> DataFrame:
    """domain, case_id, role, family, candidate_id (null if there is none left) for each case: by domain, the families in
    this order, primary before reserve cases, each gets of the tasks left the candidate whose agent was given least often,
    then that with most writes, most events, the first id. cases: domain, case_id, role, family; candidates: domain,
    candidate_id, task_id, agent, writes, events. A family asks for `least_writes` writes (1).

    A case depends on those before it, so that one task goes through them; it sees no more than it could pick from: of an
    agent's rows of a task the best one, and of those as many as there are cases, since a used row's task is used up."""
    spark = candidates.sparkSession
    rows = candidates.filter("domain is not null and candidate_id is not null").select("domain", "candidate_id", F.col("task_id").cast("string").alias("task_id"), F.coalesce("agent", F.lit("")).alias("agent"), F.coalesce("writes", F.lit(0)).cast("long").alias("writes"), F.coalesce("events", F.lit(0)).cast("long").alias("events"))
    order = F.struct((-F.col("writes")).alias("w"), (-F.col("events")).alias("e"), "candidate_id")
    best = rows.groupBy("domain", "agent", "task_id").agg(F.min(order).alias("o"))
    n = cases.count()
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("domain", "agent").orderBy("o"))).filter(F.col("rank") <= max(1, n))
    some = best.select("domain", F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("family"), "agent", "task_id", F.col("o.candidate_id").alias("candidate_id"), (-F.col("o.w")).alias("writes"), (-F.col("o.e")).alias("events"))
    no = lambda kind: F.lit(None).cast(kind)
    asked = cases.select("domain", F.col("case_id").cast("string").alias("case_id"), "role", "family", no("string").alias("agent"), no("string").alias("task_id"), no("string").alias("candidate_id"), no("long").alias("writes"), no("long").alias("events"))

    def give(all_: pd.DataFrame) -> pd.DataFrame:
        wanted, left = all_[all_["case_id"].notna()], all_[all_["case_id"].isna()]
        place = {f: i for i, f in enumerate(priority)}
        turn = sorted(wanted.index, key=lambda i: (wanted.at[i, "domain"], place.get(wanted.at[i, "family"], len(place)), wanted.at[i, "role"] != "primary", wanted.at[i, "case_id"]))
        pools = {d: g.to_dict("records") for d, g in left.groupby("domain")}
        given, out = {}, []
        for i in turn:
            domain, family = wanted.at[i, "domain"], wanted.at[i, "family"]
            able = [r for r in pools.get(domain, []) if r["writes"] >= least_writes.get(family, 1)]
            pick = min(able, key=lambda r: (given.get(r["agent"], 0), -r["writes"], -r["events"], r["candidate_id"]), default=None)
            if pick is not None:
                given[pick["agent"]] = given.get(pick["agent"], 0) + 1
                pools[domain] = [r for r in pools[domain] if r["task_id"] != pick["task_id"]]
            out.append((domain, wanted.at[i, "case_id"], wanted.at[i, "role"], family, None if pick is None else pick["candidate_id"]))
        return pd.DataFrame(out, columns=["domain", "case_id", "role", "family", "candidate_id"])

    if not n:
        return spark.createDataFrame([], "domain string, case_id string, role string, family string, candidate_id string")
    return asked.unionByName(some).groupBy(F.lit("all").alias("all")).applyInPandas(give, "domain string, case_id string, role string, family string, candidate_id string")
