"""Metrics by name: aggregates that a configuration chooses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By name: an aggregate of columns, or a function of the rows of a group with the columns that it reads and its type.
AGGREGATES: dict[str, Callable[[], Column]] = {}
GROUPED: dict[str, tuple[Callable[[pd.DataFrame], object], list[str], str]] = {}


def metric(name: str):
    """Registers an aggregate expression, made when it is used."""

    def add(make: Callable[[], Column]):
        _free(name)
        AGGREGATES[name] = make
        return make

    return add


def grouped_metric(name: str, columns: list[str], kind: str):
    """Registers a function of a group's rows (a pandas DataFrame of these columns), for what no aggregate expresses."""

    def add(of: Callable[[pd.DataFrame], object]):
        _free(name)
        GROUPED[name] = of, columns, kind
        return of

    return add


def _free(name: str) -> None:
    if name in AGGREGATES or name in GROUPED:
        raise ValueError(f"metric {name} is registered already")


@metric("runs")
def _runs() -> Column:
    return F.count("*")


@metric("success_rate")
def _success_rate() -> Column:
    return F.round(F.avg((F.col("status") == "success").cast("int")), 6)


@metric("mean_latency_ms")
def _mean_latency() -> Column:
    return F.round(F.avg("latency_ms"), 6)


@metric("total_cost_usd")
def _total_cost() -> Column:
    return F.round(F.sum("cost_usd"), 6)


@metric("statuses")
def _statuses() -> Column:
    return F.array_sort(F.collect_set("status"))


@metric("longest_failure_streak")
def _longest_streak() -> Column:
    """Of the runs of failures, written as ones between the noughts of successes, the longest is also the greatest text."""
    bad = (~F.col("status").eqNullSafe("success")).cast("int")
    in_order = F.sort_array(F.collect_list(F.struct("ordinal", bad.alias("bad"))))["bad"].cast("array<string>")
    return F.length(F.array_max(F.split(F.array_join(in_order, ""), "0"))).cast("long")


def metrics(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and a column for each name. Aggregates are made in one pass; functions of whole groups are made for those
    groups that bound them, in a pass of their own, and joined. An unknown name, and one that stands twice, is an error."""
    if unknown := [n for n in names if n not in AGGREGATES and n not in GROUPED]:
        raise ValueError(f"unknown metrics {', '.join(unknown)}; there are {', '.join(sorted([*AGGREGATES, *GROUPED]))}")
    if len(set(names)) < len(names):
        raise ValueError("a metric is asked for twice")
    plain, whole = [n for n in names if n in AGGREGATES], [n for n in names if n in GROUPED]
    out = rows.groupBy(*keys).agg(*[AGGREGATES[n]().alias(n) for n in plain]) if plain else rows.select(*keys).distinct()
    if whole:
        kinds = dict(rows.dtypes)
        read = [c for c in dict.fromkeys(c for n in whole for c in GROUPED[n][1]) if c not in keys]
        schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"`{n}` {GROUPED[n][2]}" for n in whole]])
        functions = {n: GROUPED[n][0] for n in whole}

        def of_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[*key, *[f(group) for f in functions.values()]]], columns=[*keys, *functions])

        made = rows.select(*keys, *read).groupBy(*keys).applyInPandas(of_group, schema)
        same = [out[k].eqNullSafe(made[k]) for k in keys]
        joined = out.join(made, same, "left")
        out = joined.select(*[out[k] for k in keys], *[out[n] for n in plain], *[made[n] for n in whole])
    return out.select(*keys, *names)
