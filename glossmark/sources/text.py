"""Aligned text, translation records, generator logs; and the text sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.session import join_bounded

TRANSLATION_SCHEMA = "translation map<string,string>"


def number_lines(raw: DataFrame, keys: list[str] = ("path",)) -> DataFrame:
    """``(keys, block, seq, text)`` rows to ``(keys, line_no, text)`` with dense numbers; blocks follow their order.

    A block is read by one task in file order, so ``seq`` goes up by one from line to line of a
    block: a line's place is its distance from the block's first. Block counts give each block's
    first number; that table is as small as the number of blocks, and the text is neither sorted
    nor, up to the broadcast limit, shuffled.
    """
    keys = list(keys)
    counts = raw.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_start"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, "block", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return join_bounded(raw, first, [*keys, "block"]).select(
        *keys, (F.col("_first") + F.col("seq") - F.col("_start")).alias("line_no"), "text"
    )


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Lines of text files with their 0-based number: ``(path, line_no, text)``."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("text"),
    )
    return number_lines(raw)


def write_sets(lines: DataFrame, path: str, keys: list[str]) -> None:
    """Line-numbered texts of any number of corpora as plain text, one job for all: a folder per corpus.

    ``lines`` has ``keys``, ``line_no`` and ``text``. Rows are dealt by range of (keys, line number), so a corpus is as many
    files as its share of the lines, and its files follow each other by name.
    """
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = lines.repartitionByRange(parts, *keys, "line_no").sortWithinPartitions(*keys, "line_no")
    laid.select(*keys, F.col("text").alias("value")).write.partitionBy(*keys).option("lineSep", "\n").text(path)


def read_sets(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``(keys, line_no, text)`` of a folder that ``write_sets`` wrote.

    A corpus is the lines of its files in the order of their names; lines are numbered by the counts of blocks.
    """
    schema = ", ".join(["value string", *[f"`{k}` string" for k in keys]])
    raw = spark.read.schema(schema).option("lineSep", "\n").text(path).select(
        *keys, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"),
    )
    return number_lines(raw, keys).select(*keys, "line_no", "text")


def read_parallel(spark: SparkSession, source_path: str, target_path: str) -> DataFrame:
    """Two aligned files, zipped by line number and cut to the shorter one."""
    return zip_lines(read_lines(spark, source_path), read_lines(spark, target_path))


def zip_lines(source: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = [*(keys or []), "line_no"]
    return source.select(*keys, F.col("text").alias("source_text")).join(
        target.select(*keys, F.col("text").alias("target_text")), keys
    )


def read_translations(spark: SparkSession, path: str, source: str, target: str = "eng") -> DataFrame:
    """``{"translation": {lang: text, ...}}`` records with their line number."""
    lines = read_lines(spark, path)
    return parse_translations(lines, source, target)


def parse_translations(lines: DataFrame, source: str, target: str = "eng") -> DataFrame:
    record = F.from_json("text", TRANSLATION_SCHEMA)["translation"]
    keep = [c for c in lines.columns if c != "text"]
    return lines.select(*keep, record[source].alias("source_text"), record[target].alias("target_text"))


def hypotheses(log_lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hypothesis rows of a generator log: number from ``H-<n>``, text from field 3 on."""
    fields = F.split("text", "\t", -1)
    number = F.regexp_extract(fields[0], r"^H-(\d+)$", 1)
    return log_lines.filter(F.col("text").startswith("H")).select(
        *(keys or []),
        number.cast("long").alias("seg_id"),
        F.array_join(F.slice(fields, 3, F.greatest(F.size(fields) - 2, F.lit(0))), "\t").alias("hyp"),
    )


def partition_folder(path: str, values: dict[str, str]) -> str:
    """The folder of one partition; signs that mean something in paths are escaped as Spark does."""

    def escaped(text: str) -> str:
        return "".join(c if c.isalnum() or c in "-_. " else f"%{ord(c):02X}" for c in text)

    return "/".join([path, *[f"{k}={escaped(v)}" for k, v in values.items()]])


def write_pairs(pairs: DataFrame, path: str, values: dict[str, str]) -> DataFrame:
    """Write one corpus below ``path`` unless that corpus is there already, and read it back.

    ``values`` name its partition. Other corpora below ``path`` are left as they are; a folder
    without data, as a broken run leaves it, is written anew.
    """
    spark = pairs.sparkSession
    folder = partition_folder(path, values)
    try:
        found = spark.read.parquet(folder)
    except AnalysisException:  # not there yet
        pairs.drop(*values).write.mode("overwrite").parquet(folder)
        found = spark.read.parquet(folder)
    return found.withColumns({k: F.lit(v) for k, v in values.items()})


def write_corpora(pairs: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write every corpus of ``pairs`` that ``path`` does not have yet, all in one job, and read the whole folder."""
    spark = pairs.sparkSession
    schema = T.StructType([*[f for f in pairs.schema if f.name not in keys], *[T.StructField(k, T.StringType()) for k in keys]])
    try:
        there = spark.read.schema(schema).parquet(path).select(*keys).distinct()
        pairs = join_bounded(pairs, there, keys, "left_anti")
    except AnalysisException:  # the first run
        pass
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs.repartitionByRange(parts, *keys, "line_no").write.mode("append").partitionBy(*keys).parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_side(pairs: DataFrame, text: Column, path: str) -> None:
    """One side as plain text, in line order."""
    ordered = pairs.orderBy("line_no")
    ordered.select(text.alias("value")).write.mode("ignore").text(path)
