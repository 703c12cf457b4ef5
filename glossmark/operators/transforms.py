"""Feature scaling, power expansion and the sparse score matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.functions.keys import sized_source

PASS_THROUGH = ["eng_target", "direction_indicator"]


def scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column; a constant gets deviation 1.

    A spread that is only rounding noise of the mean counts as constant. ``_rows`` is the number of
    rows, so that a table with nothing to scale still has a column.
    """
    stats = train.selectExpr(
        "count(*) AS _rows",
        *[f"avg(`{c}`) AS `{c}_mean`" for c in columns],
        *[f"stddev_pop(`{c}`) AS `{c}_std`" for c in columns],
    )
    return stats.selectExpr(
        "_rows",
        *[f"`{c}_mean`" for c in columns],
        *[f"if(`{c}_std` <= abs(`{c}_mean`) * 1e-12, 1.0D, `{c}_std`) AS `{c}_std`" for c in columns],
    )


def scale(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns by a one-row table of statistics; other columns stay."""
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    scaled = [f"(`{c}` - `{c}_mean`) / `{c}_std` AS `{c}`" for c in columns]
    return df.crossJoin(F.broadcast(stats)).selectExpr(*kept, *scaled)


def scalable(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in PASS_THROUGH]


def power_names(columns: list[str], degree: int) -> list[str]:
    """Names after expansion: all first powers, then all squares, and so on."""
    base = scalable(columns)
    powers = [c if d == 1 else f"{c}^{d}" for d in range(1, degree + 1) for c in base]
    return powers + [c for c in columns if c in PASS_THROUGH]


def power_expand(df: DataFrame, columns: list[str], degree: int) -> DataFrame:
    """Add powers of each column, without products of different columns."""
    new = [f"pow(`{c}`, {d}) AS `{c}^{d}`" for d in range(2, degree + 1) for c in scalable(columns)]
    return df.selectExpr("*", *new)


def score_matrix(df: DataFrame, label: str, order: str) -> DataFrame:
    """Sparse score matrix: ``(src_key, target_lang, score)``; the last row by order wins."""
    key = sized_source(F.col("source_lang"), F.col("dataset_size"))
    return df.groupBy(key.alias("src_key"), "target_lang").agg(F.max_by(label, order).alias("score"))
