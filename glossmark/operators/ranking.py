"""Exact row numbers and running sums that never put one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.functions.keys import seeded


def seeded_rank(
    df: DataFrame,
    strata: list[str],
    key: Column,
    seed: int | Column,
    out: str,
    digits: int = 3,
    carry: DataFrame | None = None,
) -> DataFrame:
    """1-based rank by ``md5(seed|key)`` inside each stratum; ``key`` is unique there.

    The leading hex digits of the hash cut every stratum into ``16 ** digits`` even
    buckets in rank order: bucket counts give the offset, and only rows of one bucket
    are sorted together. A stratum holding a third of the rows is spread like any other.
    ``carry`` has one row per stratum; its other columns are added to the rows on the way.
    """
    hashed = df.withColumn("_h", seeded(seed, key)).withColumn("_b", F.substring("_h", 1, digits))
    bucket = [*strata, "_b"]
    counts = hashed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*bucket).orderBy("_h")
    if strata:
        before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if carry is not None:
        offsets = offsets.join(carry, strata) if strata else offsets.crossJoin(carry)
    ranked = hashed.withColumn("_r", F.row_number().over(inside))
    joined = ranked.join(offsets, bucket)
    return joined.withColumn(out, F.col("_off") + F.col("_r")).drop("_h", "_b", "_off", "_r")


def running_offset(
    df: DataFrame, group: list[str], key: str, value: str, out: str, width: int = 4096
) -> DataFrame:
    """Sum of ``value`` over smaller keys of the same group (0 for the first).

    ``key`` is an integer unique inside a group, so ``key div width`` holds at most
    ``width`` rows. Sums go up two levels of such buckets and offsets come back down.
    """
    w = F.lit(width)
    rows = df.withColumn("_b1", F.floor(F.col(key) / w)).withColumn("_b2", F.floor(F.col("_b1") / w))
    level1 = rows.groupBy(*group, "_b2", "_b1").agg(F.sum(value).alias("_s1"))
    level2 = level1.groupBy(*group, "_b2").agg(F.sum("_s1").alias("_s2"))

    def before(value_col: str, part: list[str], order: str) -> Column:
        win = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value_col).over(win), F.lit(0))

    off2 = level2.select(*group, "_b2", before("_s2", group, "_b2").alias("_o2"))
    off1 = (
        level1.withColumn("_o1", before("_s1", [*group, "_b2"], "_b1"))
        .join(off2, [*group, "_b2"])
        .select(*group, "_b2", "_b1", (F.col("_o1") + F.col("_o2")).alias("_base"))
    )
    return (
        rows.withColumn("_o0", before(value, [*group, "_b2", "_b1"], key))
        .join(off1, [*group, "_b2", "_b1"])
        .withColumn(out, F.col("_o0") + F.col("_base"))
        .drop("_b1", "_b2", "_o0", "_base")
    )
