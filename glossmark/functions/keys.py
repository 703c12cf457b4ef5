"""Keys, routing rules and seeded ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIVOT_LANG = "eng"
VOCAB_CAP = 10_000


def other_lang(source: Column, target: Column) -> Column:
    """The side of a pair that is not English."""
    return F.when(source != PIVOT_LANG, source).otherwise(target)


def dev_corpus(train_corpus: Column) -> Column:
    """Validation corpus that belongs to a training corpus."""
    web = (train_corpus == "cc_aligned") | train_corpus.startswith("MT560")
    return F.when(web, F.lit("flores")).otherwise(train_corpus)


def subword_vocab_size(size: Column) -> Column:
    return F.least(F.floor(size / 2).cast("long"), F.lit(VOCAB_CAP).cast("long"))


def folder_name(model: str, source: Column, target: Column, corpus: Column, size: Column) -> Column:
    """Folder of a tuned run."""
    return F.concat_ws("_", F.lit(model), source, target, corpus, size.cast("string"))


def untuned_folder_name(model: str, source: Column, target: Column) -> Column:
    return F.concat_ws("_", F.lit(model), source, target, F.lit("no_finetune"))


def sized_source(source: Column, size: Column) -> Column:
    """Row key of the score matrix."""
    return F.concat_ws("_", source, size.cast("long").cast("string"))


def cell_key(source: Column, size: Column, target: Column) -> Column:
    return F.concat_ws("_", sized_source(source, size), target)


def seeded(seed: int | Column, key: Column) -> Column:
    """A uniform hex string per key and seed; the same on every engine and run."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", seed.cast("string"), key))


def same_domain(train_corpus: Column, test_corpus: Column) -> Column:
    return train_corpus == test_corpus


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))
