"""Hold-out protocols with exact, engine-independent membership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.functions.keys import PIVOT_LANG
from glossmark.operators.ranking import seeded_rank

TEST_SIZE = 0.3
SEEDS = [42, 43, 44, 45, 46]
PORTIONS = [0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.9]
SIDES = "array(named_struct('role', 'source', 'lang', source_lang), named_struct('role', 'target', 'lang', target_lang))"


def allocate_test(counts: DataFrame, runs: list[str], strata: list[str], n: str, share: Column) -> DataFrame:
    """Test rows per stratum: ``ceil(share * N)`` in total, spread by largest remainder.

    ``counts`` has one row per run and stratum. The training side is allotted first in
    proportion to the stratum; leftover rows go to the largest remainders, ties in
    stratum order. All arithmetic is on whole numbers.
    """
    whole = Window.partitionBy(*runs) if runs else Window.partitionBy(F.lit(0))
    sized = counts.withColumn("_total", F.sum(n).over(whole)).withColumn(
        "_train", F.col("_total") - F.ceil(F.round(share * F.col("_total"), 9))
    )
    sized = sized.withColumn("_floor", F.expr(f"({n} * _train) div _total")).withColumn(
        "_rest", F.expr(f"({n} * _train) % _total")
    )
    order = whole.orderBy(F.desc("_rest"), *strata)
    sized = sized.withColumn("_left", F.col("_train") - F.sum("_floor").over(whole)).withColumn(
        "_rank", F.row_number().over(order)
    )
    given = F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return sized.withColumn("n_test", F.col(n) - given).drop("_total", "_train", "_floor", "_rest", "_left", "_rank")


def repeat_seeds(df: DataFrame, seeds: list[int] = SEEDS) -> DataFrame:
    """One copy of each row per seed."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def random_split(
    df: DataFrame, runs: list[str], strata: list[str], key: Column, seed: int | Column, test_size: float = TEST_SIZE
) -> DataFrame:
    """Add ``is_test``: a stratified random test share of exact size per run."""
    counts = df.groupBy(*runs, *strata).agg(F.count(F.lit(1)).alias("_n"))
    limits = allocate_test(counts, runs, strata, "_n", F.lit(test_size)).drop("_n")
    ranked = seeded_rank(df, [*runs, *strata], key, seed, "_rank", carry=limits)
    return ranked.withColumn("is_test", F.col("_rank") <= F.col("n_test")).drop("_rank", "n_test")


def incremental_split(
    df: DataFrame, runs: list[str], strata: list[str], key: Column, seed: int | Column, portions: list[float] = PORTIONS
) -> DataFrame:
    """Random split, then a stratified share of the training rows per portion.

    Test rows have a null ``portion``; training rows appear once per portion holding them.
    """
    split = random_split(df, runs, strata, key, seed)
    train, test = split.filter("not is_test"), split.filter("is_test")
    counts = (
        train.groupBy(*runs, *strata)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("portion", F.explode(F.array(*[F.lit(p) for p in portions])))
    )
    limits = allocate_test(counts, [*runs, "portion"], strata, "_n", F.col("portion"))
    per_stratum = limits.groupBy(*runs, *strata).agg(
        F.collect_list(F.struct(F.col("portion"), F.col("n_test").alias("take"))).alias("_take")
    )
    salted = F.concat_ws("|", F.lit("portion"), key)
    ranked = seeded_rank(train, [*runs, *strata], salted, seed, "_rank", carry=per_stratum)
    chosen = ranked.withColumn("_p", F.explode("_take")).filter("_rank <= _p.take")
    return chosen.withColumn("portion", F.col("_p.portion")).drop("_p", "_take", "_rank").unionByName(
        test.withColumn("portion", F.lit(None).cast("double"))
    )


def kfold(df: DataFrame, runs: list[str], key: Column, seed: int | Column, k: int = 10) -> DataFrame:
    """Add ``fold``: near-equal folds of consecutive seeded ranks, larger folds first."""
    counts = df.groupBy(*runs).agg(F.count(F.lit(1)).alias("_total"))
    ranked = seeded_rank(df, runs, key, seed, "_rank", carry=counts)
    fold = F.expr(
        f"if(_rank <= (_total % {k}) * (_total div {k} + 1), (_rank - 1) div (_total div {k} + 1), "
        f"(_rank - 1 - _total % {k}) div greatest(_total div {k}, 1))"
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank", "_total")


def seeded_order(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """Add ``position``: a seeded shuffle as a number, without sorting the whole table."""
    return seeded_rank(df, [], key, seed, "position")


def touching(df: DataFrame) -> DataFrame:
    """One row per language on either side of an experiment: the rows it is left out of."""
    return df.withColumn("lang", F.explode(F.expr("array_distinct(array(source_lang, target_lang))")))


def role_rows(df: DataFrame) -> DataFrame:
    """Test rows of every language: once as source, once as target."""
    return df.select("*", F.inline(F.expr(SIDES)))


def leave_one_out(df: DataFrame, lang: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows without the language, and its rows as source and as target."""
    source, target = F.col("source_lang") == lang, F.col("target_lang") == lang
    return df.filter(~(source | target)), df.filter(source), df.filter(target)


def without_languages(df: DataFrame, langs: list[str] | DataFrame) -> DataFrame:
    """Rows with none of the languages on either side."""
    if isinstance(langs, DataFrame):
        for side in ("source_lang", "target_lang"):
            df = df.join(langs.select(F.col("lang").alias(side)), side, "left_anti")
        return df
    return df.filter(~(F.col("source_lang").isin(langs) | F.col("target_lang").isin(langs)))


def seen_unseen(df: DataFrame, test_langs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Training rows without the test languages, and test rows per language and role."""
    return without_languages(df, test_langs), role_rows(df).filter(F.col("lang").isin(test_langs))


def languages(df: DataFrame, drop_pivot: bool = True) -> DataFrame:
    """Distinct source languages."""
    langs = df.select(F.col("source_lang").alias("lang")).distinct()
    return langs.filter(F.col("lang") != PIVOT_LANG) if drop_pivot else langs


def seen_languages(langs: DataFrame, unseen: list[str]) -> DataFrame:
    return langs.filter(~F.col("lang").isin(unseen))


def unseen_languages(langs: DataFrame, unseen: list[str]) -> DataFrame:
    return langs.filter(F.col("lang").isin(unseen))


def cross_tables(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same columns of both tables; a missing one is an error."""
    missing = [c for c in columns if c not in test.columns]
    if missing:
        raise ValueError(f"test table lacks {missing}")
    return train.select(*columns), test.select(*columns)


def test_rows(n: int, test_size: float = TEST_SIZE) -> int:
    """Size of the test part of ``n`` rows."""
    return math.ceil(round(test_size * n, 9))
