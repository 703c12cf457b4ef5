"""Byte-level BPE by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap; each chunk is pre-tokenised on its own,
in parallel. Pre-tokenising reads from left to right without looking back, so as soon as two
neighbouring chunks share one boundary they agree from there on: that boundary is where they are
stitched. The pieces between stitches are then encoded, again in parallel, and ids are joined by
their place. Neighbours without a common boundary (a run of letters longer than the overlap) are
encoded as one piece, so the result is always that of the whole text. Texts within one chunk need
no stitching and never move. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import tidy
from glossmark.session import stage

CHUNK = 65_536
OVERLAP = 1_024
# A boundary this close to a chunk's end may depend on signs the chunk does not have
# (the longest fixed alternative of the pattern has three signs).
MARGIN = 3
# Entries of a worker's memo of pre-tokens; it starts anew when full.
MEMO = 150_000


@functools.cache
def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Memo(dict):
    """Pre-token -> ids; pieces are encoded one by one, as merges never cross a pre-token."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        super().__init__()
        self.single = _encoding(ranks_path, pattern)._encode_single_piece

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= MEMO:
            self.clear()
        ids = self[piece] = self.single(piece)
        return ids


def _encoder(ranks_path: str, pattern: str):
    @F.arrow_udf("array<int>")
    @tidy
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        pieces, memo = regex.compile(pattern).findall, _Memo(ranks_path, pattern)
        for batch in batches:
            rows, ends = [], [0]
            for text in batch.to_pylist():
                ids = np.fromiter(chain.from_iterable(map(memo.__getitem__, pieces(text or ""))), np.int32)
                rows.append(ids)
                ends.append(ends[-1] + len(ids))
            flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return encode.asNondeterministic()


def _decoder(ranks_path: str, pattern: str):
    @F.arrow_udf("binary")
    @tidy
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = _encoding(ranks_path, pattern).decode_single_token_bytes
        memo: dict[int, bytes] = {}
        for batch in batches:
            out = []
            for ids in batch:
                if not ids.is_valid:
                    out.append(None)
                    continue
                numbers = ids.values.to_numpy(zero_copy_only=False).tolist()
                memo.update((i, raw(i)) for i in set(numbers) - memo.keys())
                out.append(b"".join(map(memo.__getitem__, numbers)))
            yield pa.array(out, pa.binary())

    return decode.asNondeterministic()


def _cutter(size: int, overlap: int):
    @F.arrow_udf("array<struct<no:int,body:string,last:boolean>>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            starts = range(0, max(1, len(text) - overlap), size)
            rows.append([{"no": i, "body": text[s : s + size + overlap], "last": i == len(starts) - 1} for i, s in enumerate(starts)])
        kind = pa.struct([("no", pa.int32()), ("body", pa.string()), ("last", pa.bool_())])
        return pa.array(rows, pa.list_(kind))

    return cut.asNondeterministic()


def _edges(pattern: str, size: int, overlap: int):
    """Boundaries of a chunk: ``head`` in its first, ``tail`` in its last stretch shared with a neighbour."""

    @F.arrow_udf("struct<head:array<int>,tail:array<int>>")
    def edges(bodies: pa.Array) -> pa.Array:
        import regex

        find = regex.compile(pattern).finditer
        rows = []
        for text in bodies.to_pylist():
            at = np.fromiter((m.start() for m in find(text)), np.int64)
            head = at[at <= overlap - MARGIN]
            tail = at[(at >= size) & (at <= size + overlap - MARGIN)] - size
            rows.append({"head": head.tolist(), "tail": tail.tolist()})
        kind = pa.list_(pa.int32())
        return pa.array(rows, pa.struct([("head", kind), ("tail", kind)]))

    return edges.asNondeterministic()


def stitch(chunks: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """(digest, no, body, last) -> (digest, start, body): pieces that can be encoded on their own."""
    table = stage(chunks, "bpe-chunks")
    marks = table.select("digest", "no", _edges(pattern, size, overlap)(F.col("body")).alias("e"))
    order = Window.partitionBy("digest").orderBy("no")
    common = F.array_min(F.array_intersect(F.col("e.tail"), F.lead("e.head").over(order)))
    cuts = marks.select("digest", "no", common.alias("out")).select(
        "digest", "no", "out", F.lag("out").over(order).alias("into"),
        # chunks without a stitch between them share a number
        F.sum(F.when(F.lag("out").over(order).isNull() & (F.col("no") > 0), 0).otherwise(1)).over(order).alias("start"),
    )
    begin = F.coalesce("into", F.lit(0))
    length = F.when(F.col("last"), F.length("body")).otherwise(F.coalesce("out", F.lit(0)) + size) - begin
    own = table.join(cuts, ["digest", "no"]).select("digest", "start", "no", F.substring("body", begin + 1, length).alias("body"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "body"))), lambda x: x["body"]), "")
    return own.groupBy("digest", "start").agg(joined.alias("body"))


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``df`` with the token ids of each whole text as an array (a column named ``out``, but for case, is replaced).

    Null and empty texts have no ids; an empty table gives no rows; repeated rows get equal ids. Long texts are worked on
    once for all their copies.
    """
    if not MARGIN < overlap < chunk:
        raise ValueError("the overlap must be longer than the margin and shorter than a chunk")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    turn = _encoder(ranks_path, pattern)
    is_long = F.length(body) > chunk + overlap
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower() and c != out])
    short = df.where(~is_long).withColumn(out, turn(body))
    if df.where(is_long).isEmpty():
        return short

    texts = df.where(is_long).select(F.sha2(body, 256).alias("digest"), body.alias("body"))
    once = texts.dropDuplicates(["digest"])
    chunks = once.select("digest", F.inline(_cutter(chunk, overlap)(F.col("body"))))
    parts = stitch(chunks.repartition("digest", "no"), pattern, chunk, overlap)
    encoded = parts.select("digest", "start", turn(F.col("body")).alias("part"))
    ids = encoded.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))
    ids = ids.select("digest", F.flatten(F.col("parts.part")).alias("found"))
    names = [c for c in df.columns if c != out]
    long = df.where(is_long).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.sha2(body, 256).alias("digest"))
    long = long.join(ids, "digest").select(*[F.col(f"row.`{c}`") for c in names], F.col("found").alias(out))
    return short.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{out}`")).unionByName(long)


def decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The raw bytes of an array of ids; null for null."""
    return _decoder(ranks_path, pattern)(ids)
