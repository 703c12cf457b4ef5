"""Translation and task metrics from per-segment sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.functions.keys import ratio
from glossmark.functions.text import mteval_texts, mteval_tokens, plain_tokens
from glossmark.operators.segments import char_counts, exact_resample_sums, resample_sums, word_counts, word_edits

BLEU_ORDER = 4
CHRF_CHARS = 6
CHRF_BETA = 2.0
LOG_ZERO = -9999999999.0  # fixed value standing for log(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as the byte-wise ``-lc`` option does."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Tokenisers that cut a rewritten text at white space: the batch that counts does both, so only texts are handed to it.
_REWRITES = {mteval_tokens: mteval_texts, plain_tokens: lambda texts: texts}


def bleu_counts(
    hyp: Column, refs: list[Column], tokenise: Callable[[Column], Column] = mteval_tokens, lowercase: bool = False
) -> Column:
    """Struct ``hyp_len``, closest ``ref_len`` (tie: shorter) and n-gram counts of a segment."""
    prepare = ascii_lower if lowercase else (lambda c: c)
    sides = [prepare(F.coalesce(c, F.lit(""))) for c in (hyp, *refs)]
    if tokenise in _REWRITES:
        return word_counts(sides, BLEU_ORDER, rewrite=_REWRITES[tokenise])
    return word_counts([tokenise(s) for s in sides], BLEU_ORDER)


def bleu_fields() -> list[str]:
    return ["hyp_len", "ref_len"] + [f"{n}_{k}" for k in range(1, BLEU_ORDER + 1) for n in ("hyp", "ref", "match")]


def bleu_stats(
    segments: DataFrame,
    keys: list[str],
    refs: list[str],
    tokenise: Callable[[Column], Column] = mteval_tokens,
    lowercase: bool = False,
) -> DataFrame:
    """Per segment: ``hyp_len``, closest ``ref_len`` (tie: shorter) and n-gram counts.

    Segments stay where they are: nothing is shuffled before the sums of a group.
    """
    counts = bleu_counts(F.col("hyp"), [F.col(r) for r in refs], tokenise, lowercase)
    lengths = [F.col(f"_counts.{c}").cast("int").alias(c) for c in ("hyp_len", "ref_len")]
    return segments.select(*keys, counts.alias("_counts")).select(*keys, *lengths, *[f"_counts.{c}" for c in bleu_fields()[2:]])


BLEU_COLUMNS = ["hyp_len", "ref_len"] + [
    f"{name}_{k}" for k in range(1, BLEU_ORDER + 1) for name in ("hyp", "match")
]


def bleu_score(smooth: bool = False) -> Column:
    """BLEU in percent from summed columns.

    ``smooth`` halves the weight of each successive order without a match instead of
    sending the score to zero (exponential smoothing).
    """
    logs = []
    missing = F.lit(0)
    for k in range(1, BLEU_ORDER + 1):
        total, match = F.col(f"hyp_{k}"), F.col(f"match_{k}")
        missing = missing + F.when((total > 0) & (match == 0), 1).otherwise(0)
        none = F.lit(LOG_ZERO)
        if smooth:
            none = F.when(total > 0, -F.ln(F.pow(F.lit(2.0), missing) * total)).otherwise(none)
        logs.append(F.when((total > 0) & (match > 0), F.ln(ratio(match, total))).otherwise(none))
    hyp_len, ref_len = F.col("hyp_len"), F.col("ref_len")
    penalty = F.when(hyp_len < ref_len, F.exp(1 - ratio(ref_len, hyp_len))).otherwise(1.0)
    score = 100 * penalty * F.exp(sum(logs[1:], logs[0]) / BLEU_ORDER)
    return F.when((ref_len == 0) | (hyp_len == 0), 0.0).otherwise(score)


def bleu_precision(k: int) -> Column:
    return F.coalesce(100 * ratio(F.col(f"match_{k}"), F.col(f"hyp_{k}")), F.lit(0.0))


def corpus_bleu(stats: DataFrame, group: list[str], smooth: bool = False) -> DataFrame:
    """BLEU, the four precisions, brevity penalty and lengths per group."""
    sums = stats.groupBy(*group).agg(*[F.sum(c).alias(c) for c in BLEU_COLUMNS])
    hyp_len, ref_len = F.col("hyp_len"), F.col("ref_len")
    return sums.select(
        *group,
        bleu_score(smooth).alias("bleu"),
        *[bleu_precision(k).alias(f"precision_{k}") for k in range(1, BLEU_ORDER + 1)],
        F.when((ref_len == 0) | (hyp_len == 0), 0.0)
        .when(hyp_len < ref_len, F.exp(1 - ratio(ref_len, hyp_len)))
        .otherwise(1.0)
        .alias("brevity_penalty"),
        "hyp_len",
        "ref_len",
    )


def chrf_counts(hyp: Column, ref: Column, word_order: int = 0) -> list[Column]:
    """Structs of the character n-gram counts and, if asked for, the word n-gram counts of a segment."""
    sides = [F.coalesce(c, F.lit("")) for c in (hyp, ref)]
    found = [char_counts(sides, CHRF_CHARS)]
    return found + ([word_counts(sides, word_order, CHRF_CHARS + 1, edges=True)] if word_order else [])


def chrf_fields(word_order: int, structs: list[str]) -> list[Column]:
    """The columns of ``chrf_counts``. A segment whose reference has no n-gram of an order adds no hypothesis count there."""
    found = []
    for k in range(1, CHRF_CHARS + word_order + 1):
        own = structs[0] if k <= CHRF_CHARS else structs[1]
        hyp, ref, match = (F.col(f"{own}.{n}_{k}") for n in ("hyp", "ref", "match"))
        found += [F.when(ref > 0, hyp).otherwise(0).alias(f"hyp_{k}"), ref.alias(f"ref_{k}"), match.alias(f"match_{k}")]
    return found


def chrf_stats(segments: DataFrame, keys: list[str], ref: str, word_order: int = 0) -> DataFrame:
    """Character 1-6-gram and word n-gram counts per segment, one reference."""
    counts = chrf_counts(F.col("hyp"), F.col(ref), word_order)
    names = [f"_counts_{i}" for i in range(len(counts))]
    counted = segments.select(*keys, *[c.alias(n) for c, n in zip(counts, names)])
    return counted.select(*keys, *chrf_fields(word_order, names))


def chrf_columns(word_order: int) -> list[str]:
    return [f"{n}_{k}" for k in range(1, CHRF_CHARS + word_order + 1) for n in ("hyp", "ref", "match")]


def chrf_score(word_order: int = 0) -> Column:
    """F score in percent of mean precision and recall over the orders present."""
    orders = range(1, CHRF_CHARS + word_order + 1)
    present = [(F.col(f"hyp_{k}") > 0) & (F.col(f"ref_{k}") > 0) for k in orders]
    count = sum([F.when(p, 1).otherwise(0) for p in present], F.lit(0))

    def mean(side: str) -> Column:
        parts = [
            F.when(p, ratio(F.col(f"match_{k}"), F.col(f"{side}_{k}"))).otherwise(0.0)
            for k, p in zip(orders, present)
        ]
        return ratio(sum(parts, F.lit(0.0)), count)

    precision, recall = mean("hyp"), mean("ref")
    weight = CHRF_BETA**2
    score = 100 * (1 + weight) * precision * recall / F.nullif(weight * precision + recall, F.lit(0.0))
    return F.coalesce(score, F.lit(0.0))


def corpus_chrf(stats: DataFrame, group: list[str], word_order: int = 0) -> DataFrame:
    sums = stats.groupBy(*group).agg(*[F.sum(c).alias(c) for c in chrf_columns(word_order)])
    return sums.select(*group, chrf_score(word_order).alias("chrf"))


def edit_counts(hyp: Column, ref: Column) -> Column:
    """Struct ``edits, ref_words`` of a segment."""
    return word_edits(F.coalesce(hyp, F.lit("")), F.coalesce(ref, F.lit("")))


def edit_stats(segments: DataFrame, keys: list[str], ref: str) -> DataFrame:
    """Word edits (insert, delete, replace; no block shifts) and reference words."""
    return segments.select(*keys, edit_counts(F.col("hyp"), F.col(ref)).alias("_s")).select(*keys, "_s.edits", "_s.ref_words")


def edit_rate() -> Column:
    return 100 * ratio(F.col("edits"), F.col("ref_words"))


def corpus_edit_rate(stats: DataFrame, group: list[str]) -> DataFrame:
    sums = stats.groupBy(*group).agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))
    return sums.select(*group, "edits", "ref_words", edit_rate().alias("edit_rate"))


def _poisson_bounds() -> list[int]:
    """Poisson(1) distribution function on a 32-bit scale: weight k has u >= bound[k-1].

    It goes on until a further weight would have less than one draw's chance.
    """
    bounds, below, k = [], 0.0, 0
    while True:
        below += math.exp(-1) / math.factorial(k)
        bound = int(below * 2**32)
        if bound >= 2**32 - 1:
            return bounds
        bounds.append(bound)
        k += 1


POISSON_BOUNDS = _poisson_bounds()
_DRAWS_PER_HASH = 4


def bootstrap_scores(
    stats: DataFrame,
    group: list[str],
    key: Column,
    columns: list[str],
    score: Column,
    resamples: int = 1000,
    seed: int = 12345,
    exact: bool = False,
) -> DataFrame:
    """Score of each resample."""
    sums = resampled(stats, group, key, columns, resamples, seed, exact)
    return sums.select(*group, "resample", score.alias("score"))


def resampled(
    stats: DataFrame, group: list[str], key: Column, columns: list[str], resamples: int = 1000, seed: int = 12345, exact: bool = False
) -> DataFrame:
    """Sums of ``columns`` in each resample. A segment's weight in a resample is Poisson(1) from a hash.

    Poisson weights need no draw over the whole corpus, so segments are weighted where
    they are and only ``resamples`` partial sums per task are shuffled. With ``exact`` every resample draws
    exactly as many segments as its group has.
    """
    rows = stats.select(*group, *[F.col(c).cast("long").alias(c) for c in columns], key.alias("_k"))
    if exact:
        return exact_resample_sums(rows, group, "_k", columns, resamples, seed).drop("_drawn")
    drawn = resample_sums(rows, group, "_k", columns, resamples, seed, POISSON_BOUNDS, _DRAWS_PER_HASH)
    return drawn.groupBy(*group, "resample").agg(*[F.sum(c).alias(c) for c in columns])


def confidence(scores: DataFrame, group: list[str], resamples: int = 1000) -> DataFrame:
    """Mean and half the width of the central 95 % of the resampled scores."""
    cut = resamples // 40
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("score")))
    low = F.max(F.when(F.col("_r") == cut + 1, F.col("score")))
    high = F.max(F.when(F.col("_r") == resamples - cut, F.col("score")))
    return ranked.groupBy(*group).agg(
        F.avg("score").alias("confidence_mean"), ((high - low) / 2).alias("confidence_var")
    )


def accuracy(predictions: DataFrame, group: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    hit = F.when(F.col(label) == F.col(predicted), 1.0).otherwise(0.0)
    return predictions.groupBy(*group).agg((100 * F.avg(hit)).alias("accuracy"))


def micro_f1(
    predictions: DataFrame, group: list[str], label: str = "label", predicted: str = "predicted", outside="O"
) -> DataFrame:
    """F1 in percent over all labels but ``outside``, from pooled counts."""
    gold, guess = F.col(label) != outside, F.col(predicted) != outside
    sums = predictions.groupBy(*group).agg(
        F.count(F.when(gold & guess & (F.col(label) == F.col(predicted)), 1)).alias("tp"),
        F.count(F.when(gold, 1)).alias("gold"),
        F.count(F.when(guess, 1)).alias("guess"),
    )
    return sums.select(*group, (200 * ratio(F.col("tp"), F.col("gold") + F.col("guess"))).alias("f1"))
