"""Checks, gates and audits: one row for each check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """check, passed, detail: each rule is an aggregate condition and an aggregate that explains it; one pass for all."""
    row = df.agg(*[F.struct(F.lit(name).alias("check"), ok.alias("passed"), detail.cast("string").alias("detail")).alias(f"c{i}") for i, (name, (ok, detail)) in enumerate(rules.items())])
    return row.select(F.explode(F.array(*[f"c{i}" for i in range(len(rules))])).alias("c")).select("c.*")


def verdict(rows: DataFrame) -> DataFrame:
    return rows.agg(F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("verdict"), F.count_if(~F.col("passed")).alias("n_failed"))


def gate(metric: Column, hold: float, passed: float) -> Column:
    return F.when(metric >= passed, "PASS").when(metric >= hold, "HOLD").otherwise("FAIL")


def overlap(sets: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """How many keys each two sets share: (a, b, shared)."""
    names = sorted(sets)
    out = [sets[a].select(*key).distinct().join(sets[b].select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("shared")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "shared") for i, a in enumerate(names) for b in names[i + 1 :]]
    return reduce(DataFrame.unionByName, out)
