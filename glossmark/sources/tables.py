"""Experiment tables, mapping tables, task datasets and the CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING_COLUMNS = ["source_lang", "target_lang", "train_dataset", "test_dataset"]
LONG_COLUMNS = ["dataset_size"]


def experiment_schema(columns: list[str]) -> T.StructType:
    """Schema of an experiment table with these columns; scores and features are double."""

    def kind(name: str) -> T.DataType:
        if name in STRING_COLUMNS:
            return T.StringType()
        return T.LongType() if name in LONG_COLUMNS else T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def read_experiments(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Experiment CSV without incomplete rows."""
    table = spark.read.schema(experiment_schema(columns)).csv(path, header=True, enforceSchema=False)
    return table.na.drop()


def write_csv(df: DataFrame, path: str) -> None:
    """Result table as one CSV file with header. Results are a few rows per run."""
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def first_code(mapping: DataFrame, code: str, value: str, order: str) -> DataFrame:
    """One row per code: the value of the first row in file order."""
    first = Window.partitionBy(code).orderBy(order)
    return (
        mapping.filter(F.col(code).isNotNull())
        .withColumn("_r", F.row_number().over(first))
        .filter("_r = 1")
        .select(code, value)
    )


# Which columns of each task dataset are the prompt and the response.
TASK_COLUMNS = {
    "intent": {"prompt": "text", "response": "label_text"},
    "slot": {"prompt": "utt", "response": "annot_utt"},
}


def task_rows(df: DataFrame, task: str, split: str | None = None) -> DataFrame:
    """Prompt and response columns of a task dataset, optionally of one split."""
    if split is not None:
        df = df.filter(F.col("split") == split)
    columns = TASK_COLUMNS[task]
    return df.select(F.col(columns["prompt"]).alias("prompt"), F.col(columns["response"]).alias("response"))
