"""Connected components of a link table, by alternating large and small stars.

Each step replaces the links of a node by links to the smallest node it knows of; the number of
links never grows and their end is one star per component. Links and labels stay in Spark; every
step is written to the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.session import stage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v) with u > v.

    Large star: the larger neighbours of every node are linked to the smallest node around it.
    Small star: a node and its smaller neighbours are linked to the smallest of them.
    The smallest neighbour comes from a grouped minimum and is joined back, so that a node with
    very many links is never gathered in one task.
    """
    if large:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v")


def components(links: DataFrame, a: str, b: str) -> DataFrame | None:
    """(node, root) for every node with a link to another; root is the smallest node of its component.

    ``a`` and ``b`` are long columns without nulls, in any order, repeated or not. None without links.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now, before = stage(pairs, "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if not state[0]:
            return None
        if state == before:
            break
        before = state
        now = stage(_stars(_stars(now, True), False).distinct(), "links")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
