"""Removal of repeated passages: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

A word is removed if a window of ``window`` words that covers it also starts in a document with a
smaller id. Windows are judged on the input.

1. Equal texts are grouped by digest. The copy with the smallest id stands for its group in the
   count; every window of a later copy starts in that one, so later copies need no counting.
2. Every window has an anchor: of the Rabin-Karp hashes of the half-length word runs inside it, the
   smallest. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so
   anchors are a small part of the windows. Anchors found in one text only prove their windows unique.
3. Windows of the other anchors get two independent Rabin-Karp hashes, are grouped by them, and
   those that start in an earlier document are removed; overlapping windows merge into maximal spans.

Anchors and windows that occur in more than ``hot`` texts are pre-aggregated before they move and
joined back, so that a passage found in a third of all documents never meets in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import tidy
from glossmark.session import stage

WINDOW = 50
HOT = 10_000
LAST_ID = (1 << 63) - 1
# Entries of a worker's memo of word hashes; it starts anew when full.
MEMO = 200_000
# Odd multipliers of the polynomials (fixed, any odd numbers would do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes, cut at runs of the six ASCII white space signs."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Hashes(dict):
    """Word -> 64-bit hash under a seed."""

    def __init__(self, seed: int) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@functools.lru_cache(maxsize=64)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of every run of ``size`` values.

    Runs come from prefix sums: the difference of two is divided by the power at the run's start.
    """
    n = len(values)
    if n < size:
        return np.empty(0, np.uint64)
    room = 1 << max(10, n.bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, room)[:n], out=sums[1:])
    return (sums[size:] - sums[:-size]) * _powers(pow(base, -1, 1 << 64), room)[: n + 1 - size]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def anchors(values: np.ndarray, window: int) -> np.ndarray:
    """For every window the smallest scrambled hash of the half-length runs inside it."""
    half = max(1, window // 2)
    low = _scrambled(rolling(values, half, BASES[0]))
    span = window - half + 1
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def _anchor_lists(window: int):
    @F.arrow_udf("array<bigint>")
    @tidy
    def lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes(0)
        for batch in batches:
            rows, ends = [np.empty(0, np.uint64)], [0]
            for text in batch.to_pylist():
                words = words_of(text)
                if len(words) >= window:
                    rows.append(np.unique(anchors(hashes.of(words), window)))
                    ends.append(ends[-1] + len(rows[-1]))
                else:
                    ends.append(ends[-1])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).view(np.int64)))

    return lists.asNondeterministic()


def _window_lists(window: int):
    kind = "array<struct<k1:bigint,k2:bigint,hot:boolean,starts:array<int>>>"

    @F.arrow_udf(kind)
    @tidy
    def lists(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        first, second = _Hashes(0), _Hashes(1)
        for texts, shared, hot, *_ in batches:
            cols, ends = [], [0]
            for text, some, most in zip(texts.to_pylist(), shared, hot):
                words = words_of(text)
                a, b = first.of(words), second.of(words)
                low = anchors(a, window).view(np.int64)
                at = np.flatnonzero(np.isin(low, some.values.to_numpy(zero_copy_only=False)))
                k1, k2 = rolling(a, window, BASES[0])[at], rolling(b, window, BASES[1])[at]
                # equal windows of one text travel together
                order = np.lexsort((k2, k1))
                k1, k2 = k1[order], k2[order]
                new = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])][: len(order)])
                hits = np.isin(low[at[order[new]]], most.values.to_numpy(zero_copy_only=False))
                cols.append((k1[new].view(np.int64), k2[new].view(np.int64), hits, np.diff(np.r_[new, len(order)]), at[order]))
                ends.append(ends[-1] + len(new))
            k1, k2, hits, sizes, starts = (np.concatenate(c) for c in zip(*cols)) if cols else [np.empty(0, np.int64)] * 5
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(starts, pa.int32()))
            parts = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(hits.astype(bool)), places]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["k1", "k2", "hot", "starts"]))

    return lists.asNondeterministic()


def _spans(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal intervals covered by windows at the sorted ``starts``; a row each."""
    if not len(starts):
        return np.empty((0, 2), np.int32)
    breaks = np.flatnonzero(starts[1:] > starts[:-1] + window) + 1
    begin = starts[np.r_[0, breaks]]
    stop = starts[np.r_[breaks - 1, len(starts) - 1]] + window
    return np.stack([begin, stop], 1)


def _remover(window: int):
    kind = "struct<n_words:bigint,n_removed:bigint,spans:array<struct<start:int,stop:int>>,kept:string>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    arrow = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string())])

    @F.arrow_udf(kind)
    def remove(texts: pa.Array, starts: pa.Array, whole: pa.Array) -> pa.Array:
        rows = []
        for text, some, everything in zip(texts.to_pylist(), starts, whole.to_pylist()):
            words = words_of(text)
            if everything:
                spans = np.array([[0, len(words)]] if len(words) >= window else [], np.int32).reshape(-1, 2)
            elif some.is_valid:
                spans = _spans(np.sort(some.values.to_numpy(zero_copy_only=False)), window)
            else:
                spans = np.empty((0, 2), np.int32)
            removed, kept, at = 0, [], 0
            for a, b in spans.tolist():
                kept += words[at:a]
                removed, at = removed + b - a, b
            kept += words[at:]
            rows.append({
                "n_words": len(words), "n_removed": removed, "spans": [{"start": a, "stop": b} for a, b in spans.tolist()],
                "kept": b" ".join(kept).decode("utf-8", "surrogatepass"),
            })
        return pa.array(rows, arrow)

    return remove.asNondeterministic()


def _earlier(windows: DataFrame, any_hot: bool) -> DataFrame:
    """(doc, v, starts) of windows that also start in a document with a smaller id."""
    keys = ["k1", "k2"]
    found = windows.where(~F.col("hot")).withColumn("least", F.min("doc").over(Window.partitionBy(*keys)))
    if any_hot:
        hot = windows.where("hot")
        least = hot.groupBy(*keys).agg(F.min("doc").alias("least"))
        found = found.unionByName(hot.join(least, keys))
    return found.where("least < doc").select("doc", "v", "starts")


def remove_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "dedup", window: int = WINDOW, hot: int = HOT,
) -> DataFrame:
    """``df`` with the struct ``out``: n_words, n_removed, spans (word ranges removed), kept (text of the rest).

    Kept words are joined by one blank. Null and short texts lose nothing. A null id counts as
    larger than any other; documents of equal id never remove from each other, and repeated rows get
    equal results. A column of ``df`` named ``out``, but for case, is replaced. An empty table gives no rows; texts of any length
    are taken whole.
    """
    names = [c for c in df.columns if c.lower() != out.lower()]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID))
    f1, f2 = F.xxhash64(body), F.xxhash64(F.lit("second"), body)

    # read twice below: to count the anchors and to find the texts that have the shared ones
    listed = stage(df.select(f1.alias("f1"), _anchor_lists(window)(body).alias("list")), "substring-lists")
    rows = listed.select("f1", F.explode("list").alias("a"))
    # anchors of at least two different texts
    known = rows.groupBy("a").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi"), F.count(F.lit(1)).alias("n"))
    known = known.where("lo < hi").select("a", (F.col("n") > hot).alias("hot"))
    shared = stage(_listed(rows, known), "substring-anchors")
    any_hot = not shared.where(F.size("most") > 0).isEmpty()

    # one document per text; v tells different texts of one id apart
    heads = df.select(f1.alias("f1"), f2.alias("f2"), ident.alias("doc")).groupBy("f1", "f2").agg(F.min("doc").alias("doc"))
    # texts of one id are told apart by their hashes, whose rank is taken in parts of the hash, as all null ids are one id
    part = F.shiftright("f1", 52)
    counts = heads.groupBy("doc", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("doc", "part", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("doc", "part").orderBy("f1", "f2"))
    heads = heads.withColumn("part", part).withColumn("v", inside).join(counts, ["doc", "part"])
    heads = heads.select("f1", "f2", "doc", (F.col("v") + F.col("before")).cast("int").alias("v"))
    heads = stage(heads, "substring-heads")

    # Both joins below read the same columns of the texts, dealt out by the same keys, so they share one
    # shuffle; for that the window function is handed the other columns too, and the id is compared by order.
    rest = [c for c in names if c != text]
    texts = df.select(
        f1.alias("f1"), f2.alias("f2"), ident.alias("id"), F.col(f"`{text}`").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []),
    )
    extra = [F.col("rest")] if rest else []
    marked = heads.join(shared, "f1")
    counted = (
        texts.join(marked, ["f1", "f2"])
        .where(F.col("id") <= F.col("doc"))
        .select("doc", "v", F.inline(_window_lists(window)(F.col("text"), F.col("some"), F.col("most"), *extra)))
    )
    starts = _earlier(counted, any_hot).groupBy("doc", "v").agg(F.flatten(F.collect_set("starts")).alias("starts"))
    verdict = heads.join(starts, ["doc", "v"], "left").select("f1", "f2", "doc", "starts")
    later = F.col("id") > F.col("doc")
    found = _remover(window)(F.col("text"), F.when(~later, F.col("starts")), later)
    done = texts.join(verdict, ["f1", "f2"]).select("text", *extra, found.alias("result"))
    return done.select(
        *[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`") for c in names], F.col("result").alias(out)
    )


def _listed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Per text the anchors it shares, and those of them that are hot."""
    return (
        rows.distinct()
        .join(known, "a")
        .groupBy("f1")
        .agg(F.collect_list("a").alias("some"), F.collect_list(F.when(F.col("hot"), F.col("a"))).alias("most"))
    )


def kept_text(result: Column) -> Column:
    return result["kept"]
