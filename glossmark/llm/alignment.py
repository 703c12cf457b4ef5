"""Alignment of two tokenizers over the bytes of a corpus, each distinct text once.

Texts are shuffled by their full content; a distinct text is encoded by both tokenizers and aligned once,
and its pair counts are weighted by its copies. Byte offsets where tokens of both end cut the tokens into
groups; a token of A and one of B are linked where their byte ranges overlap. The ends of all tokens of
both cut a text into stretches, and each link is one stretch: so the links of a slice of texts come from one
pass over the marks of its bytes, without a loop over tokens.

The counts of id pairs stay in Spark. The most frequent ones, at most ``FREQUENT``, go to the workers, who
look up most links of a text without moving them; links of rarer pairs meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import tidy
from glossmark.session import stage

#: Signs of text that are aligned at once, about.
SLICE = 400_000
#: The pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Id pairs whose counts are sent to the workers.
FREQUENT = 200_000
#: Ids of B take so many bits of a pair's number.
BITS = 24


def byte_alphabet() -> dict[str, int]:
    """The bytes that the signs of a byte-level vocabulary stand for: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder_of(path: str, signs: dict[str, int]):
    """A function from texts to lists of ids for a byte-level vocabulary, special strings as plain text.

    Where ids follow the order of the merges, as they do in vocabularies made this way, they are ranks, and the
    encoder made for ranks gives the same ids in a quarter of the time; otherwise the library of the file is used.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ranked = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    ranked = ranked and not model.get("ignore_merges") and [model["vocab"].get(m) for m in merges] == list(range(256, 256 + len(merges)))
    if ranked:
        import tiktoken

        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        signs = byte_alphabet()
        self.encode_a = _encoder_of(path_a, signs)
        vocabulary = Tokenizer.from_file(path_a).get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in signs for c in token):
                self.bytes_a[i] = bytes(signs[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        ids = range(self.b.get_piece_size())
        if len(ids) >> BITS:
            raise ValueError(f"ids of the second tokenizer must be below 2^{BITS}")
        pieces = [self.b.id_to_piece(i) for i in ids]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, t))) for t in (self.bytes_a, self.bytes_b))
        # written ids by what follows: another of the group, or the end of its tokens of A or B
        self.written = [
            [np.array([b"%d%b" % (i, mark) for i in range(n)], object) for mark in (b",", last)]
            for n, last in ((len(self.bytes_a), b"|"), (len(self.bytes_b), b";"))
        ]

    def align(self, texts: list[str]) -> list[tuple | None]:
        """(tokens of A, of B, groups, written groups, pair numbers) of each text; None where bytes are not those of the text."""
        spaced = [f" {t}" for t in texts]
        found = list(zip(self.encode_a(spaced), self.b.encode(texts, num_threads=1)))
        raw = [s.encode() for s in spaced]
        same = [
            b"".join(map(self.bytes_a.__getitem__, a)) == r == b"".join(map(self.bytes_b.__getitem__, b)) for r, (a, b) in zip(raw, found)
        ]
        kept = [f for f, ok in zip(found, same) if ok]
        rows = iter(self._aligned(kept, [len(r) for r, ok in zip(raw, same) if ok]) if kept else ())
        return [next(rows) if ok else None for ok in same]

    def _aligned(self, found: list[tuple[list[int], list[int]]], sizes: list[int]) -> list[tuple]:
        """All texts as one: their tokens end together at the end of each text."""
        n_a, n_b = (np.array([len(f[i]) for f in found]) for i in (0, 1))
        a = np.fromiter(chain.from_iterable(f[0] for f in found), np.int64, n_a.sum())
        b = np.fromiter(chain.from_iterable(f[1] for f in found), np.int64, n_b.sum())
        marks = np.zeros(sum(sizes) + 1, np.uint8)
        marks[np.cumsum(self.size_a[a])] = 1
        marks[np.cumsum(self.size_b[b])] |= 2
        ends = np.flatnonzero(marks)
        kind = marks[ends]
        of_a, of_b, cut = kind & 1 > 0, kind & 2 > 0, kind == 3
        pairs = a[np.cumsum(of_a) - of_a] << BITS | b[np.cumsum(of_b) - of_b]
        group = np.cumsum(cut) - cut
        in_a, in_b = group[of_a], group[of_b]
        # written in the order of groups, in each first the tokens of A
        count_a, count_b = np.bincount(in_a), np.bincount(in_b)
        out = np.empty(len(a) + len(b), object)
        for ids, mine, others, tables in ((a, in_a, np.cumsum(count_b) - count_b, self.written[0]), (b, in_b, np.cumsum(count_a), self.written[1])):
            last = np.r_[mine[1:] != mine[:-1], True]
            out[np.arange(len(ids)) + others[mine]] = np.where(last, tables[1][ids], tables[0][ids])
        out = out.tolist()
        stops = np.searchsorted(ends, np.cumsum(sizes)) + 1
        groups = np.diff(np.r_[0, np.cumsum(cut)[stops - 1]])
        text_ends = np.cumsum(n_a + n_b)
        return [
            (int(x), int(y), int(g), b"".join(out[p:q])[:-1], pairs[u:v])
            for x, y, g, p, q, u, v in zip(n_a, n_b, groups, np.r_[0, text_ends[:-1]], text_ends, np.r_[0, stops[:-1]], stops)
        ]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


_ALIGNED = pa.struct([
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])


def _aligner(path_a: str, path_b: str, written: bool):
    @F.arrow_udf(
        "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,groups:string,pairs:array<bigint>,times:array<bigint>>"
    )
    @tidy
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = Pair(path_a, path_b)
        nothing = (0, 0, 0, 0, "", "" if written else None, np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            rows = []
            for found in map(pair.align, _slices(batch.to_pylist())):
                for row in found:
                    if row is None:
                        rows.append(nothing)
                        continue
                    *sizes, text, pairs = row
                    numbers, times = np.unique(pairs, return_counts=True)
                    rows.append((*sizes, len(pairs), hashlib.sha256(text).hexdigest(), text.decode() if written else None, numbers, times))
            columns = list(zip(*rows)) or [[]] * len(_ALIGNED)
            arrays = [pa.array(c, f.type) for c, f in zip(columns[:6], _ALIGNED)]
            ends = pa.array(np.cumsum([0, *map(len, columns[6])]), pa.int32())
            arrays += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c) if c else [], pa.int64())) for c in columns[6:]]
            yield pa.StructArray.from_arrays(arrays, fields=list(_ALIGNED))

    return align.asNondeterministic()


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def align_texts(df: DataFrame, path_a: str, path_b: str, text: str = "text", written: bool = False) -> DataFrame:
    """One row per distinct text that is not null or empty, staged.

    ``text_key`` (SHA-256), ``copies``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``groups`` (written out as
    ``a1,a2|b1;a3|b2,b3`` if ``written``, else null), the distinct id ``pairs`` and how many ``times`` each is linked.
    A text whose tokens do not give its bytes back has zeros and no pairs.
    """
    body = F.col(f"`{text}`")
    once = df.where(body != "").groupBy(body.alias("body")).agg(F.count(F.lit(1)).alias("copies"))
    found = once.select(_text_key(F.col("body")).alias("text_key"), "copies", _aligner(path_a, path_b, written)(F.col("body")).alias("x"))
    return stage(found.select("text_key", "copies", "x.*"), "alignments")


def pair_counts(texts: DataFrame) -> DataFrame:
    """``pair``, its ids ``a`` and ``b``, its ``count`` over the corpus, and whether it is one of the ``best`` of its ``b``, staged."""
    links = texts.select("copies", F.inline(F.arrays_zip("pairs", "times")))
    counts = links.groupBy("pairs").agg(F.sum(F.col("times") * F.col("copies")).alias("count"))
    counts = counts.select(
        F.col("pairs").alias("pair"), F.shiftright("pairs", BITS).alias("a"), F.col("pairs").bitwiseAND((1 << BITS) - 1).alias("b"), "count"
    )
    counts = stage(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return stage(counts.join(most, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def _frequent(pairs: DataFrame, limit: int) -> tuple[int, pa.Table]:
    """A count from which on there are at most ``limit`` pairs, and those pairs."""
    bits = F.length(F.bin("count"))
    sizes = dict(pairs.groupBy(bits.alias("bits")).count().collect())  # at most 63 rows
    least, total = 64, 0
    while least > 1 and total + sizes.get(least - 1, 0) <= limit:
        least -= 1
        total += sizes.get(least, 0)
    floor = 1 << (least - 1) if least < 64 else (1 << 63) - 1
    return floor, pairs.where(F.col("count") >= floor).select("pair", "count", "best").orderBy("pair").toArrow()


def _looker(known: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Sums over the links of frequent pairs, and the other pairs."""
    fields = [pa.field("n_best", pa.int64()), pa.field("count_sum", pa.int64())]
    fields += [pa.field(n, pa.list_(pa.int64())) for n in ("pairs", "times")]

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint,pairs:array<bigint>,times:array<bigint>>")
    def look(pairs: pa.Array, times: pa.Array) -> pa.Array:
        sizes = np.asarray(pairs.value_lengths()).astype(np.int64)
        number, k = np.asarray(pairs.flatten()), np.asarray(times.flatten())
        at = np.minimum(np.searchsorted(known, number), max(len(known) - 1, 0))
        hit = known[at] == number if len(known) else np.zeros(len(number), bool)
        ends = np.cumsum(sizes)

        def per_text(values: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(values)]
            return sums[ends] - sums[ends - sizes]

        n_best = per_text(np.where(hit, best[at] * k, 0) if len(known) else k * 0)
        total = per_text(np.where(hit, counts[at] * k, 0) if len(known) else k * 0)
        left = pa.array(np.r_[0, np.cumsum(per_text(~hit))], pa.int32())
        lists = [pa.ListArray.from_arrays(left, pa.array(x[~hit])) for x in (number, k)]
        return pa.StructArray.from_arrays([pa.array(n_best), pa.array(total), *lists], fields=fields)

    return look.asNondeterministic()


def text_measures(texts: DataFrame, pairs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``texts`` without pairs, with ``n_best`` (links whose pair is a best one of its b) and ``count_sum`` (counts over the links)."""
    floor, head = _frequent(pairs, frequent)
    known, counts, best = (head.column(i).to_numpy() for i in range(3))
    looked = stage(
        texts.withColumn("x", _looker(known, counts, best.astype(np.int64))(F.col("pairs"), F.col("times"))).drop("pairs", "times"), "looked-up"
    )
    rare = looked.select("text_key", F.inline(F.arrays_zip("x.pairs", "x.times")))
    met = rare.join(pairs.where(F.col("count") < floor).select(F.col("pair").alias("pairs"), "count", "best"), "pairs")
    sums = met.groupBy("text_key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("count") * F.col("times")).alias("rare_sum")
    )
    both = looked.join(sums, "text_key", "left")
    return both.withColumns({
        "n_best": F.col("x.n_best") + F.coalesce("rare_best", F.lit(0)), "count_sum": F.col("x.count_sum") + F.coalesce("rare_sum", F.lit(0)),
    }).drop("x", "rare_best", "rare_sum")


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(
    df: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text", written: bool = False, frequent: int = FREQUENT,
) -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with the measures of its text, ``groups_sha256`` and ``groups``.

    A text's blank-led form is encoded by A (byte-level, special strings as plain text) and the text itself by B, which
    adds the blank. Texts that are null, empty or not given back byte for byte have zeros and '' for the digest. Copies
    count as often as they occur. An empty table gives no rows. Columns of ``keep`` named like outputs, but for case, are left out.
    """
    outputs = [*MEASURES, "groups_sha256", "groups"]
    keep = [c for c in keep if c.lower() not in outputs]
    texts = align_texts(df, path_a, path_b, text, written)
    measured = text_measures(texts, pair_counts(texts), frequent).drop("copies")
    body = F.col(f"`{text}`")
    row = F.struct(F.lit(0).alias("x"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    names = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)]
    full = df.where(body != "").select(row, _text_key(body).alias("text_key")).join(measured, "text_key")
    bare = df.where(body.isNull() | (body == "")).select(row)
    zeros = [F.lit(0).cast("long").alias(m) for m in MEASURES]
    blank = F.lit("") if written else F.lit(None).cast("string")
    return full.select(*names, *outputs).unionByName(bare.select(*names, *zeros, F.lit("").alias("groups_sha256"), blank.alias("groups")))
