"""Errors, repeat summaries and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, F.lit(2))))


def repeat_summary(runs: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation (``_se``) of each metric over repeats."""
    means = [F.avg(m).alias(m) for m in metrics]
    spreads = [F.stddev_pop(m).alias(f"{m}_se") for m in metrics]
    return runs.groupBy(*group).agg(*means, *spreads)


def language_summary(scores: DataFrame, group: list[str], langs: DataFrame | None = None) -> DataFrame:
    """Per language and role mean and deviation; a language without rows keeps nulls."""
    table = scores.groupBy(*group, "lang").agg(
        *[F.avg(F.when(F.col("role") == r, F.col("rmse"))).alias(f"test_{r}_rmse") for r in ("source", "target")],
        *[
            F.stddev_pop(F.when(F.col("role") == r, F.col("rmse"))).alias(f"test_{r}_rmse_se")
            for r in ("source", "target")
        ],
    )
    return table if langs is None else langs.join(table, "lang", "left")


def wide_languages(scores: DataFrame, group: list[str], langs: list[str]) -> DataFrame:
    """One row per run: a mean and deviation column per role and language, and role means."""
    per_lang = scores.groupBy(*group, "lang", "role").agg(
        F.avg("rmse").alias("m"), F.stddev_pop("rmse").alias("s")
    )
    columns = []
    for lang in langs:
        for role in ("source", "target"):
            here = (F.col("lang") == lang) & (F.col("role") == role)
            name = f"test_{role}_{lang}_rmse"
            columns.append(F.max(F.when(here, F.col("m"))).alias(name))
            columns.append(F.max(F.when(here, F.col("s"))).alias(f"{name}_se"))
    roles = [F.avg(F.when(F.col("role") == r, F.col("m"))).alias(f"test_{r}_rmse") for r in ("source", "target")]
    return per_lang.groupBy(*group).agg(*roles, *columns)


def tagged(result: DataFrame, tags: dict) -> DataFrame:
    """Add run settings as columns."""
    return result.select("*", *[F.lit(v).alias(k) for k, v in tags.items()])


def append(results: list[DataFrame]) -> DataFrame:
    """Stack result tables by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def best_of(candidates: DataFrame, group: list[str], error: str, order: str) -> DataFrame:
    """Row with the lowest error per group; ties go to the first in grid order."""
    others = [c for c in candidates.columns if c not in group]
    best = F.min_by(F.struct(*others), F.struct(error, order))
    return candidates.groupBy(*group).agg(best.alias("_best")).select(*group, "_best.*")
