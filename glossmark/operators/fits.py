"""Many small fits on one table: rows of a job, not jobs of the driver."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.session import stage

#: Tasks of one job at most; a task fits several models one after the other.
TASKS = 4096


def fit_all(spark: SparkSession, table: object, specs: list, one: Callable, schema: str) -> list:
    """``one(table, spec)`` for every spec, in the order given; None where it gave nothing.

    ``one`` returns a dict of values that match ``schema``. ``table`` is sent to all workers once; its size is checked by the caller.
    """
    if not specs:
        return []
    order = list(range(len(specs)))
    random.Random(0).shuffle(order)  # long and short fits mixed among tasks
    handle = spark.sparkContext.broadcast(table)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["id"]:
                found = one(handle.value, specs[order[at]])
                if found is not None:
                    yield pd.DataFrame({"id": [order[at]], **{k: [v] for k, v in found.items()}})

    done = stage(spark.range(0, len(specs), 1, min(len(specs), TASKS)).mapInPandas(work, f"id long, {schema}"), "fits")
    out: list = [None] * len(specs)
    for row in done.toLocalIterator():
        out[row["id"]] = row
    handle.unpersist()
    return out


def part_sizes(members: DataFrame) -> dict[str, dict[str, int]]:
    """Rows of every part of every run."""
    parts: dict[str, dict[str, int]] = {}
    for run, part, n in members.groupBy("run", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        parts.setdefault(run, {})[part] = n
    return parts


def part_rows(members: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Row numbers of every part of every run, in order; for memberships whose size was checked."""
    places: dict[str, dict[str, np.ndarray]] = {}
    for run, part, at in members.groupBy("run", "part").agg(F.array_sort(F.collect_list("row"))).collect():
        places.setdefault(run, {})[part] = np.array(at, np.int64)
    return places


def is_fold(part: str) -> bool:
    return part.startswith("fold")


def training(parts: dict[str, np.ndarray], without: int = -1) -> np.ndarray:
    """All rows of the folds but one."""
    kept = [rows for part, rows in parts.items() if is_fold(part) and part != f"fold{without}"]
    return np.sort(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def asked(parts: dict, fold: int) -> dict:
    """The parts a fit is tested on: the fold it leaves out, or the tests of the run."""
    return {p: rows for p, rows in parts.items() if (p == f"fold{fold}" if fold >= 0 else not is_fold(p) and p != "inner")}
