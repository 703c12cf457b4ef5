"""Metric reports and segment scores under experiment folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "array<struct<name:string,tok:string,confidence_mean:double,confidence_var:double>>"

# A metric list starts with "[" and a line end, then "{"; it ends at the first "]" and line end.
REPORT_LIST = r"(?s)(?:\A|\[\n)(\{.*?)(?=\]\n|\[\n|\z)"
SEGMENT_SCORE = r'"COMET": (\d+\.\d+)'


def folder_key(folder: Column, first: int = 1) -> dict[str, Column]:
    """Key columns in a folder name. ``first`` is 1 with a model prefix, else 0."""
    parts = F.split(folder, "_", -1)
    middle = F.slice(parts, first + 3, F.greatest(F.size(parts) - first - 3, F.lit(0)))
    return {
        "source_lang": F.get(parts, F.lit(first)),
        "target_lang": F.get(parts, F.lit(first + 1)),
        "train_dataset": F.array_join(middle, "_"),
        "dataset_size": F.element_at(parts, -1),
    }


def path_part(path: Column, from_end: int) -> Column:
    """A path segment counted from the end, file name = 1."""
    return F.element_at(F.split(path, "/"), -from_end)


def test_name(path: Column, prefix: str, suffix: str) -> Column:
    name = path_part(path, 1)
    return F.regexp_extract(name, rf"^{prefix}_(.*)\.{suffix}$", 1)


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Report files below ``root``: ``(folder, test_dataset, content)``.

    The recursive read covers layouts with and without a language level.
    """
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "sacrebleu_*.txt")
        .text(root, wholetext=True)
        .filter(path_part(path, 2) == "outputs")
        .select(
            path_part(path, 3).alias("folder"),
            test_name(path, "sacrebleu", "txt").alias("test_dataset"),
            F.col("value").alias("content"),
        )
    )


def read_segment_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of segment-score files: ``(folder, test_dataset, text)``."""
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "comet_*.json")
        .text(root)
        .filter(path_part(path, 2) == "outputs")
        .select(
            path_part(path, 3).alias("folder"),
            test_name(path, "comet", "json").alias("test_dataset"),
            F.col("value").alias("text"),
        )
    )


def marked_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders that hold their own ``<folder>.json``."""
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .format("binaryFile")
        .load(root)
        .select(path_part(path, 2).alias("folder"), path_part(path, 1).alias("file"))
        .filter(F.col("file") == F.concat("folder", F.lit(".json")))
        .select("folder")
        .distinct()
    )


def parse_reports(reports: DataFrame, content: str = "content") -> DataFrame:
    """One row per metric of each report: keys, ``metric``, ``mean``, ``se``."""
    keys = [c for c in reports.columns if c != content]
    lists = F.regexp_extract_all(F.col(content), F.lit(REPORT_LIST), F.lit(1))
    item = F.col("item")
    metrics = (
        reports.select(*keys, F.explode(lists).alias("piece"))
        .select(*keys, F.from_json(F.concat(F.lit("["), "piece", F.lit("]")), METRIC_SCHEMA).alias("items"))
        .select(*keys, F.explode("items").alias("item"))
    )
    sp = (item["name"] == "BLEU") & (item["tok"] == "flores200")
    return metrics.select(
        *keys,
        F.when(sp, F.lit("spBLEU")).otherwise(item["name"]).alias("metric"),
        F.coalesce(item["confidence_mean"], F.lit(0.0)).alias("mean"),
        F.coalesce(item["confidence_var"], F.lit(0.0)).alias("se"),
    )


def parse_segment_scores(lines: DataFrame, text: str = "text") -> DataFrame:
    """The first matching score of each line; lines without one are dropped."""
    keys = [c for c in lines.columns if c != text]
    found = F.regexp_extract(F.col(text), SEGMENT_SCORE, 1)
    return lines.select(*keys, found.alias("_s")).filter("_s <> ''").select(
        *keys, F.col("_s").cast("double").alias("score")
    )
