"""Importance resampling towards a target distribution, by segment deduplication.

A text's features are its runs of up to ``order`` words, hashed into buckets. Newlines separate words, so
a text falls into lines and most features lie inside one line: every distinct line is hashed once and its
counts are multiplied by its occurrences. Runs that cross from one line into the next (``order`` above 1)
are counted for each text by themselves and added.

A bucket's gain is the logarithm of its share in the target over its share in the source, a text's weight
the mean gain of its features. Adding Gumbel noise to the weights and taking the largest sums draws
without replacement in proportion to the exponential of the weights.

Lines meet their gains in a join on the line's SHA-256, which AQE splits where one line is in a third of
all texts; only sums leave it. The ranking is dealt by range, with a hash as the last key.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import fresh, row_digest, tidy
from glossmark.session import join_bounded, stage

BUCKETS = 10_000
LEAST_WORDS = 20
#: Entries of a worker's memo of features; it starts anew when full.
MEMO = 200_000
#: Rows that one task puts in order.
RANGE_ROWS = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, cut at every ASCII sign that is neither letter nor digit."""
    return _WORD.findall((text or b"").lower())  # bytes.lower knows A-Z only


def runs(words: list[bytes], order: int) -> Iterator[bytes]:
    """All runs of 1 to ``order`` words, joined by one blank."""
    yield from words
    for n in range(2, order + 1):
        yield from map(b" ".join, zip(*(words[i:] for i in range(n))))


def crossing(lines: list[list[bytes]], order: int) -> Iterator[bytes]:
    """The runs of 2 to ``order`` words that lie in more than one line."""
    flat = list(chain.from_iterable(lines))
    owner = [i for i, line in enumerate(lines) for _ in line]
    # a run that crosses lines holds a last word of a line and the word behind it
    breaks = [p for p in range(1, len(flat)) if owner[p] != owner[p - 1]]
    for n in range(2, order + 1):
        starts = {s for p in breaks for s in range(max(0, p - n + 1), p) if s + n <= len(flat)}
        for s in sorted(starts):
            yield b" ".join(flat[s : s + n])


class _Buckets(dict):
    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        number = self[feature] = zlib.crc32(feature) % self.buckets
        return number


def _hasher(order: int, buckets: int, across: bool):
    """Buckets of a line's features with its number of words; or those of a text's runs across lines."""
    kind = pa.struct([("n_words", pa.int64()), ("found", pa.list_(pa.int32()))])

    @F.arrow_udf("struct<n_words:bigint,found:array<int>>")
    @tidy
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _Buckets(buckets)
        for batch in batches:
            rows, ends, sizes = [], [0], []
            for text in batch.cast(pa.binary()).to_pylist():
                if across:
                    features, size = crossing([words_of(x) for x in (text or b"").split(b"\n")], order), 0
                else:
                    words = words_of(text)
                    features, size = runs(words, order), len(words)
                row = np.fromiter(map(memo.__getitem__, features), np.int32)
                rows.append(row)
                ends.append(ends[-1] + len(row))
                sizes.append(size)
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists], fields=list(kind))

    return found.asNondeterministic()


def _tally(buckets: int):
    """Sums of ``copies`` per bucket over a task's rows; at most one row per bucket leaves a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            weights = np.repeat(np.asarray(batch.column(0)), sizes)
            total += np.bincount(np.asarray(lists.flatten()), weights, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return work


def _weigher(gains: np.ndarray):
    """Sum of the gains of a list of buckets."""

    @F.arrow_udf("bigint")
    def weigh(lists: pa.Array) -> pa.Array:
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        sums = np.r_[0, np.cumsum(gains[np.asarray(lists.flatten())])]
        ends = np.cumsum(sizes)
        return pa.array(sums[ends] - sums[ends - sizes])

    return weigh.asNondeterministic()


def _line_key(line: Column) -> Column:
    return F.unhex(F.sha2(line, 256))


def segments(df: DataFrame, text: str, order: int, buckets: int) -> DataFrame:
    """The distinct non-empty lines: ``line_key``, ``copies``, ``n_words`` and the buckets ``found``, staged."""
    lines = df.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("line")).where("line != ''")
    once = lines.groupBy("line").agg(F.count(F.lit(1)).alias("copies"))
    hashed = once.select(_line_key(F.col("line")).alias("line_key"), "copies", _hasher(order, buckets, False)(F.col("line")).alias("x"))
    return stage(hashed.select("line_key", "copies", "x.n_words", "x.found"), "segments")


def _crossings(df: DataFrame, text: str, order: int, buckets: int) -> DataFrame:
    return df.select(F.lit(1).cast("long").alias("copies"), _hasher(order, buckets, True)(F.col(f"`{text}`"))["found"].alias("found"))


def bucket_counts(lines: DataFrame, df: DataFrame, text: str, order: int, buckets: int) -> np.ndarray:
    """Features of the whole corpus per bucket: an array of ``buckets`` numbers, whatever the corpus."""
    rows = lines.select("copies", "found")
    if order > 1:
        rows = rows.unionByName(_crossings(df, text, order, buckets))
    sums = rows.mapInArrow(_tally(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(share in the target / share in the source))`` with one added to every bucket."""
    big_s, big_t = float(source.sum() + len(source)), float(target.sum() + len(source))
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * big_s / ((s + 1.0) * big_t))) for s, t in pairs], np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of ``sha256(seed:key)``; a null key counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(
    df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, target_text: str = "text",
    order: int = 1, buckets: int = BUCKETS, seed: int = 0,
) -> DataFrame:
    """The columns ``keep`` (the key alone by default) of every row of ``df`` with ``n_words``, ``n_features``, ``weight`` and ``score``.

    Features are all runs of 1 to ``order`` words of the whole text, repeats counted; all rows of both tables
    count, copies as often as they occur. A text that is null or has no words has no features and weight 0. An
    empty table gives no rows; an empty target gives every bucket the same share. Rows that share a key get
    the same noise. Columns of ``keep`` named like the outputs, but for case, are left out.
    """
    outputs = ("n_words", "n_features", "weight", "score")
    keep = [c for c in ([key] if keep is None else keep) if c.lower() not in outputs]
    lines = segments(df, text, order, buckets)
    wanted = segments(target, target_text, order, buckets)
    gains = bucket_gains(bucket_counts(lines, df, text, order, buckets), bucket_counts(wanted, target, target_text, order, buckets))

    weigh = _weigher(gains)
    priced = lines.select("line_key", "n_words", F.size("found").cast("long").alias("n"), weigh(F.col("found")).alias("gain"))
    # rows are numbered; a row's columns travel with its first line only
    held = F.struct(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    own = df.select(F.monotonically_increasing_id().alias("row"), held.alias("held"), F.col(f"`{text}`").alias("text"))
    if order > 1:
        across = _hasher(order, buckets, True)(F.col("text"))["found"]
        own = own.withColumn("across", across)
        own = own.select("row", "held", "text", F.size("across").cast("long").alias("n0"), weigh(F.col("across")).alias("gain0"))
    else:
        own = own.select("row", "held", "text", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("gain0"))
    parts = own.select("row", "held", "n0", "gain0", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    # an empty line matches nothing; its key is made of the row so that such lines do not meet in one task
    line_key = F.when(F.length("line") > 0, _line_key(F.col("line"))).otherwise(F.encode(F.col("row").cast("string"), "utf-8"))
    names = ["key", *[f"c{i}" for i in range(len(keep))]]
    parts = parts.select(
        "row", line_key.alias("line_key"), F.when(first, F.col("n0")).alias("n0"), F.when(first, F.col("gain0")).alias("gain0"),
        *[F.when(first, F.col(f"held.{c}")).alias(c) for c in names],
    )
    summed = parts.join(priced, "line_key", "left").groupBy("row").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in names],
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"),
        (F.coalesce(F.sum("n"), F.lit(0)) + F.coalesce(F.sum("n0"), F.lit(0))).alias("n_features"),
        (F.coalesce(F.sum("gain"), F.lit(0)) + F.coalesce(F.sum("gain0"), F.lit(0))).alias("total"),
    )
    # floor of the mean in whole numbers
    weight = F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)")
    out = summed.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *outputs)


def ranked(df: DataFrame, order: list[Column], out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with its place in the order, from 1. Rows equal in ``order`` are told apart by a hash of the row."""
    spark = df.sparkSession
    part, tie, place = fresh(df, "part"), fresh(df, "tie"), fresh(df, "place")
    df = stage(df.withColumn(tie, row_digest(df)), "unordered")
    parts = max(df.count() // rows + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = stage(df.repartitionByRange(parts, *order, tie).withColumn(part, F.spark_partition_id()), "ordered")
    counts = laid.groupBy(part).agg(F.count(F.lit(1)).alias(place))
    below = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum(place).over(below), F.lit(0)).alias(place))
    inside = Window.partitionBy(part).orderBy(*order, tie)
    numbered = join_bounded(laid.withColumn(out, F.row_number().over(inside).cast("long")), starts, [part])
    return numbered.withColumn(out, F.col(out) + F.col(place)).drop(part, tie, place)


def draw(scored: DataFrame, share: tuple[int, int], key: str = "doc_id", least_words: int = LEAST_WORDS, out: str = "rank") -> DataFrame:
    """``scored`` (from ``importance``) with ``out``: 1, 2, 3... for the drawn rows, null for the others.

    Of the N rows with at least ``least_words`` words the ``floor(share[0] * N / share[1])`` of highest score
    are drawn; ties go to the smaller key, null keys first, then to a hash of the row, so that only identical
    rows are interchangeable. A column named like ``out``, but for case, is replaced.
    """
    scored = stage(scored.drop(*[c for c in scored.columns if c.lower() == out.lower()]), "scored")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count() * share[0] // share[1]
    placed = ranked(scored, [F.when(able, 0).otherwise(1), -F.col("score"), F.col(f"`{key}`")], out)
    return placed.withColumn(out, F.when(able & (F.col(out) <= n), F.col(out)))


def resample(df: DataFrame, target: DataFrame, share: tuple[int, int], key: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``df`` with all their columns."""
    keep = [c for c in df.columns if c.lower() not in ("n_words", "n_features", "weight", "score", "rank")]
    least = options.pop("least_words", LEAST_WORDS)
    scored = importance(df, target, key=key, keep=keep, **options)
    return draw(scored, share, key, least).where("rank IS NOT NULL")
