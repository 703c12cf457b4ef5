"""Corpus preparation: length filter, alignment, size limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmark.functions.text import keep_pair
from glossmark.operators.ranking import running_offset
from glossmark.session import join_bounded

# Line numbers of one range are looked at together.
RANGE = 4096


def filter_pairs(pairs: DataFrame, count_newline: bool = False) -> DataFrame:
    return pairs.filter(keep_pair(F.col("source_text"), F.col("target_text"), count_newline))


def first_pairs(pairs: DataFrame, corpus: list[str], size: int) -> DataFrame:
    """The first ``size`` pairs of each corpus by line number; 0 keeps all.

    ``line_no`` is unique per corpus. Counts per number range find the range in which a corpus
    reaches its limit, and the numbers of that range alone find the last line kept; both read only
    the corpus and number columns. The pairs themselves are then filtered where they are.
    """
    if size == 0:
        return pairs
    numbers = pairs.select(*corpus, "line_no", F.floor(F.col("line_no") / RANGE).alias("_r"))
    before = Window.partitionBy(*corpus).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = numbers.groupBy(*corpus, "_r").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    reached = ranges.where((F.col("_before") < size) & (F.col("_before") + F.col("_n") >= size)).select(*corpus, "_r", "_before")
    inside = Window.partitionBy(*corpus).orderBy("line_no")
    ranked = numbers.join(reached, [*corpus, "_r"]).withColumn("_k", F.col("_before") + F.row_number().over(inside))
    last = ranked.where(F.col("_k") == size).select(*corpus, F.col("line_no").alias("_last"))
    kept = join_bounded(pairs, last, corpus, "left")
    return kept.where(F.col("_last").isNull() | (F.col("line_no") <= F.col("_last"))).drop("_last")


def number_sentences(docs: DataFrame, corpus: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines of documents, numbered densely per corpus by document and position."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    counted = docs.select(*corpus, doc_id, lines.alias("_lines")).withColumn("_n", F.size("_lines"))
    offset = running_offset(counted, corpus, doc_id, "_n", "_first")
    return offset.select(*corpus, "_first", F.posexplode("_lines").alias("_pos", "text")).select(
        *corpus, (F.col("_first") + F.col("_pos")).alias("line_no"), "text"
    )


def sentences(docs: DataFrame, corpus: list[str], text: str = "text") -> DataFrame:
    """Non-blank lines of documents, without numbers and without a shuffle."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return docs.select(*corpus, F.explode(lines).alias("text"))
