"""Proportional stratified interleaving of a mixture into shards.

Rows are ranked by a seeded hash within their stratum; a row of rank ``r`` among ``n`` gets the
fractional rank ``(2r - 1) / 2n``. In order of fractional rank every stretch of rows holds the
strata in their overall proportions, so cutting that order at ``i * total / n_shards`` gives shards
whose row counts differ by one at most and whose mixture is that of the whole.

No stratum and no shard is ever in one task: ranks within a stratum are taken in hash buckets,
and the global order in buckets of the fractional rank, both with offsets from bucket counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import key_text, row_digest

BUCKET_ROWS = 4_096


def interleave(
    df: DataFrame,
    n_shards: int,
    stratum: str = "source",
    key: str = "doc_id",
    seed: int = 0,
    shard: str = "shard",
    slot: str = "slot",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards - 1``) and ``slot`` (gapless from 0 in each shard).

    Null strata form a stratum of their own; a null key is hashed as empty text. Rows with equal
    keys are ordered by a hash of the whole row, so only identical rows are interchangeable.
    Columns of ``df`` named like the outputs, but for case, are replaced. An empty table gives an empty result.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    total = df.count()
    buckets = max(1, -(-total // bucket_rows))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    # 52 bits of the hash: exact in a double
    even = F.conv(F.substring("h", 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]).alias("row"),
        key_text(F.col(f"`{stratum}`")).alias("s"),
        digest.alias("h"),
        row_digest(df).alias("t"),
    ).withColumn("b", F.floor(even * buckets))

    counts = rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "s", "b", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("s")).alias("size"),
    )
    inside = Window.partitionBy("s", "b").orderBy("h", "t")
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(offsets, ["s", "b"])
    placed = ranked.select(
        "row", "s", "h", "t", ((2 * (F.col("before") + F.col("r")) - 1) / (2 * F.col("size"))).alias("f")
    ).withColumn("g", F.floor(F.col("f") * buckets))

    heights = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    lower = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = heights.select("g", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("start"))
    order = Window.partitionBy("g").orderBy("f", "s", "h", "t")
    position = (
        placed.withColumn("p", F.row_number().over(order))
        .join(starts, "g")
        .withColumn("p", F.col("start") + F.col("p") - 1)
    )
    cut = F.expr(f"p * {n_shards} div {max(total, 1)}")
    first = F.expr(f"(cast(cut as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return position.withColumn("cut", cut).select(
        "row.*", F.col("cut").cast("int").alias(shard), (F.col("p") - first).alias(slot)
    )


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, rows in slot order; a shard may be spread over several tasks and files."""
    parts = max(1, df.select(shard).distinct().count())
    df.repartitionByRange(parts, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
