"""From parsed reports and segment scores to experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed metric names of the reports, in the order the two report lists give them.
REPORT_METRICS = ["spBLEU", "chrF2++", "BLEU", "chrF2", "TER"]
REPORT_KEYS = ["source_lang", "target_lang", "train_dataset", "dataset_size", "test_dataset"]


def segment_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation (the column called ``se``) to 4 digits."""
    return scores.groupBy(*keys).agg(
        F.bround(F.avg("score"), 4).alias("comet_score_mean"),
        F.bround(F.stddev_pop("score"), 4).alias("comet_score_se"),
    )


def widen(metrics: DataFrame, keys: list[str], names: list[str], values: list[str] = ("mean", "se")) -> DataFrame:
    """Long metric rows to ``<metric>_<value>`` columns for a fixed list of names."""
    columns = [
        F.max(F.when(F.col("metric") == n, F.col(v))).alias(f"{n}_{v}") for n in names for v in values
    ]
    return metrics.groupBy(*keys).agg(*columns)


def harvest(metrics: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row per experiment and test set that has both kinds of scores."""
    return widen(metrics, keys, REPORT_METRICS).join(segment_summary(scores, keys), keys)


def proxy_wide(
    long: DataFrame, tuned_keys: list[str], untuned_keys: list[str], columns: list[tuple[str, str]]
) -> DataFrame:
    """Long scores of all models to ``<model>_<ft|noft>_<metric>_<value>`` columns.

    ``long`` has ``(keys, model, tuned, metric, mean, se)``. Untuned models do not depend
    on the training corpus, so their scores join on ``untuned_keys`` only. ``columns``
    lists the ``(model_ft or model_noft, metric)`` wanted; a bare model name has no suffix.
    """

    def pick(names):
        name = F.when(F.col("model") == "trfm", F.col("model")).otherwise(
            F.concat("model", F.when(F.col("tuned"), F.lit("_ft")).otherwise("_noft"))
        )
        here = lambda n, m: (name == n) & (F.col("metric") == m)
        return [
            F.max(F.when(here(n, m), F.col(v))).alias(f"{n}_{m}_{v}") for n, m in names for v in ("mean", "se")
        ]

    untuned = [c for c in columns if c[0].endswith("_noft")]
    tuned = [c for c in columns if not c[0].endswith("_noft")]
    wide = long.filter("tuned").groupBy(*tuned_keys).agg(*pick(tuned))
    if untuned:
        side = long.filter("not tuned").groupBy(*untuned_keys).agg(*pick(untuned))
        wide = wide.join(side, untuned_keys, "left")
    return wide
