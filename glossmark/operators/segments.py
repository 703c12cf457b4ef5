"""Per-segment counts of a batch of segments: n-grams, clipped matches, word symbols, resampling sums.

Everything a metric needs of a segment is worked out inside the Arrow batch that holds it, with array
arithmetic over all segments of a slice at once; only numbers leave the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.functions.text import PUNCTUATION
from glossmark.session import join_bounded, stage

# Tokens, or bytes of text, of all sides that are counted together; a longer segment is a slice of its own.
SLICE_TOKENS = 1 << 19
# Cells (groups x resamples x columns) held by a task before they are handed on.
HELD_CELLS = 4_000_000
# Draws (segments x resamples) that are made at once.
DRAWN_CELLS = 1 << 19


def _names(orders: int, first: int) -> list[str]:
    return [f"{name}_{k}" for k in range(first, first + orders) for name in ("hyp", "ref", "match")]


def _count(sides: list[tuple[np.ndarray, np.ndarray]], n: int, orders: int) -> np.ndarray:
    """n-gram counts of ``n`` segments: a column for every order and hypothesis, first reference, matched.

    A side is (token numbers, flat; segment of each token, ascending). A run's number is its segment's followed by those of its
    tokens; runs are numbered anew over all sides when the next order's numbers would not fit 64 bits. One sort of an order's
    runs puts equal ones of all sides next to each other.
    """
    out = np.zeros((n, 3 * orders), np.int64)
    size = max((int(t.max()) + 1 for t, _ in sides if len(t)), default=1)
    lengths = [np.bincount(owner, minlength=n) for _, owner in sides]
    left = [np.cumsum(c)[owner] - np.arange(len(owner)) for c, (_, owner) in zip(lengths, sides)]
    at = [np.arange(len(t)) for t, _ in sides]
    run = [owner.astype(np.int64) for _, owner in sides]
    distinct, bits = max(n, 1), (len(sides) - 1).bit_length()
    for k in range(orders):
        if k:
            inside = [l[a] > k for l, a in zip(left, at)]
            at, run = [a[i] for a, i in zip(at, inside)], [r[i] for r, i in zip(run, inside)]
        if distinct * size << bits >= 1 << 63:
            found, number = np.unique(np.concatenate(run), return_inverse=True)
            distinct = max(1, len(found))
            run = np.split(number, np.cumsum([len(r) for r in run])[:-1])
        run = [r * size + tokens[a + k] for r, a, (tokens, _) in zip(run, at, sides)]
        distinct *= size
        counts = [np.maximum(c - k, 0) for c in lengths]
        out[:, 3 * k], out[:, 3 * k + 1] = counts[0], counts[1]
        keys = np.concatenate([r << bits | s for s, r in enumerate(run)])
        if not len(keys):
            continue
        keys.sort()
        side = (keys & ((1 << bits) - 1)).astype(np.int8)
        keys >>= bits
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        of = [np.add.reduceat(side == s, start, dtype=np.int32) for s in range(len(sides))]
        matched = np.minimum(of[0], np.maximum.reduce(of[1:]))
        # numbers begin with the segment's, so sorted runs are in the order of their segments
        owner = np.repeat(np.arange(n), sum(counts))[start]
        out[:, 3 * k + 2] = np.bincount(owner, matched, n).astype(np.int64)
    return out


def _slices(sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of segments with at most ``most`` (``SLICE_TOKENS``) tokens, one segment at least."""
    most = SLICE_TOKENS if most is None else most
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes):
        yield start, len(sizes)


def _parts(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The batch in pieces of at most ``SLICE_TOKENS`` bytes of text, or tokens, of all sides; one segment at least."""
    sizes = [c.value_lengths() if pa.types.is_list(c.type) else pc.binary_length(c) for c in columns]
    for a, b in _slices(sum(np.asarray(s.fill_null(0)).astype(np.int64) for s in sizes)):
        yield tuple(c.slice(a, b - a) for c in columns)


def _owners(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, flat, and the segment of each; texts are cut at ASCII white space, lists are taken as they are."""
    if pa.types.is_list(column.type):
        return column.flatten(), _owners(np.asarray(column.value_lengths().fill_null(0)))
    cut = pc.ascii_split_whitespace(column)
    words, owner = cut.flatten(), _owners(np.asarray(cut.value_lengths().fill_null(0)))
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def _edge_split(words: pa.Array, owner: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words with one trailing, else one leading, ASCII punctuation mark as a word of its own (``text.edge_split_words``)."""
    if not len(words):
        return words, owner
    words = pa.concat_arrays([words.cast(pa.large_string())])
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)
    several = pc.utf8_length(words).to_numpy(zero_copy_only=False) > 1
    last = several & _MARKS[data[ends[1:] - 1]]
    first = several & ~last & _MARKS[data[ends[:-1]]]
    cut = np.flatnonzero(last | first)
    ends = np.insert(ends, cut + 1, np.where(last[cut], ends[cut + 1] - 1, ends[cut] + 1))
    whole = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))
    return whole, np.insert(owner, cut, owner[cut])


def _numbered(sides: list[tuple[pa.Array, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words as numbers, the same for the same word of any side."""
    words = pa.concat_arrays([w.cast(pa.large_string()) for w, _ in sides])
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return list(zip(np.split(numbers, np.cumsum([len(w) for w, _ in sides])[:-1]), (owner for _, owner in sides)))


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts but white space, flat, and the segment of each."""
    codes = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), "<u4")
    kept = ~_SPACES[codes]
    return codes[kept], _owners(pc.utf8_length(column).to_numpy(zero_copy_only=False))[kept]


def _marked(chars: str) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table


_MARKS = _marked(PUNCTUATION)
# Unicode white space
_SPACES = _marked("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _struct(parts: list[np.ndarray], names: list[str]) -> pa.Array:
    counts = np.concatenate(parts) if parts else np.zeros((0, len(names)), np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in counts.T], names)


def word_counts(
    sides: list[Column], orders: int, first: int = 1, edges: bool = False, rewrite: Callable[[pa.Array], pa.Array] | None = None
) -> Column:
    """Struct ``hyp_k, ref_k, match_k`` over arrays of words, or texts cut at white space; orders are numbered from ``first``.

    The first side is the hypothesis, the others are references; matches are clipped by the largest
    count over the references. ``hyp_len`` are the hypothesis's words and ``ref_len`` those of the reference closest to it
    in length (tie: shorter). With ``edges`` a punctuation mark at a word's edge is a word of its own. ``rewrite`` changes
    texts before they are cut.
    """
    names = _names(orders, first) + ["hyp_len", "ref_len"]

    @F.arrow_udf(", ".join(f"{n} bigint" for n in names))
    def count(*columns: pa.Array) -> pa.Array:
        parts = []
        for piece in _parts(columns):
            words = [_words(rewrite(c) if rewrite else c) for c in piece]
            if edges:
                words = [_edge_split(*w) for w in words]
            n = len(piece[0])
            lengths = np.stack([np.bincount(owner, minlength=n) for _, owner in words])
            gap = np.abs(lengths[1:] - lengths[0])
            closest = np.where(gap == gap.min(axis=0), lengths[1:], lengths.max(initial=0) + 1).min(axis=0)
            parts.append(np.c_[_count(_numbered(words), n, orders), lengths[0], closest])
        return _struct(parts, names)

    return count(*sides)


def char_counts(sides: list[Column], orders: int) -> Column:
    """The counts over the characters of strings, white space left out."""
    names = _names(orders, 1)

    @F.arrow_udf(", ".join(f"{n} bigint" for n in names))
    def count(*columns: pa.Array) -> pa.Array:
        parts = []
        for piece in _parts(columns):
            flat = [_characters(c) for c in piece]
            used = np.zeros(max((int(c.max()) + 1 for c, _ in flat if len(c)), default=1), bool)
            for codes, _ in flat:
                used[codes] = True
            number = np.cumsum(used) - 1
            parts.append(_count([(number[codes], owner) for codes, owner in flat], len(piece[0]), orders))
        return _struct(parts, names)

    return count(*sides)


def steps(hyp: list, bits: dict, n: int) -> list[tuple[int, int, int, int, int]]:
    """The states of ``distance`` before the first word and after each.

    A state is where one more word of the reference makes the distance larger, where smaller, the distance to the whole
    reference, and where the last word of the hypothesis made it larger and smaller.
    """
    mask, last = (1 << n) - 1, 1 << n >> 1
    plus, minus, score = mask, 0, n
    found = [(plus, minus, score, 0, 0)]
    for word in hyp:
        same = bits.get(word, 0)
        either = same | minus
        across = (((same & plus) + plus) ^ plus) | either
        more, less = minus | (~(across | plus) & mask), plus & across
        if more & last or not n:
            score += 1
        elif less & last:
            score -= 1
        up = more << 1 | 1
        plus, minus = (less << 1 | ~(either | up)) & mask, up & either & mask
        found.append((plus, minus, score, more, less))
    return found


def distance(hyp: list, bits: dict, n: int, state: tuple[int, int, int] | None = None) -> int:
    """Insertions, deletions and replacements between words and a reference, one step per word; only the last state is kept."""
    mask, last = (1 << n) - 1, 1 << n >> 1
    plus, minus, score = state or (mask, 0, n)
    if not n:
        return score + len(hyp)
    for word in hyp:
        same = bits.get(word, 0)
        either = same | minus
        across = (((same & plus) + plus) ^ plus) | either
        up, down = minus | (~(across | plus) & mask), plus & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = up << 1 | 1
        plus, minus = (down << 1 | ~(either | up)) & mask, up & either & mask
    return score


def places(words: list) -> dict:
    """Where each word stands, as bits."""
    at: dict = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    if len(words) < 512:
        return {w: sum(1 << i for i in p) for w, p in at.items()}
    size, bits = len(words) // 8 + 1, {}
    for w, p in at.items():
        if len(p) == 1:
            bits[w] = 1 << p[0]
            continue
        held = np.zeros(8 * size, np.uint8)
        held[p] = 1
        bits[w] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
    return bits


def _edits(hyp: list[int], ref: list[int]) -> int:
    """Edits between two lists of words; what both begin or end with costs nothing."""
    least, a = min(len(hyp), len(ref)), 0
    while a < least and hyp[a] == ref[a]:
        a += 1
    z = 0
    while z < least - a and hyp[-1 - z] == ref[-1 - z]:
        z += 1
    hyp, ref = hyp[a : len(hyp) - z], ref[a : len(ref) - z]
    return distance(hyp, places(ref), len(ref)) if hyp else len(ref)


def word_edits(hyp: Column, ref: Column) -> Column:
    """Struct ``edits, ref_words`` over texts cut at white space: the fewest insertions, deletions and replacements of words."""

    @F.arrow_udf("edits bigint, ref_words bigint")
    def count(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        parts = []
        for piece in _parts((hyp, ref)):
            (left, lowner), (right, rowner) = _numbered([_words(c) for c in piece])
            n = len(piece[0])
            lends, rends = (np.r_[0, np.cumsum(np.bincount(o, minlength=n))] for o in (lowner, rowner))
            left, right = left.tolist(), right.tolist()
            edits = [_edits(left[lends[i] : lends[i + 1]], right[rends[i] : rends[i + 1]]) for i in range(n)]
            parts.append(np.c_[edits, np.diff(rends)])
        return _struct(parts, ["edits", "ref_words"])

    return count(hyp, ref)


def exact_resample_sums(
    rows: DataFrame, group: list[str], key: str, columns: list[str], resamples: int, seed: int, bucket_rows: int = 4096
) -> DataFrame:
    """Sums of ``columns`` per group and resample; a resample draws exactly as many segments as its group has, with replacement.

    The draws are dealt out in two steps: over buckets of segments by their counted sizes, the same in every task, and
    then over the segments of a bucket in the order of their keys. Segments are shuffled by bucket, numbers only; a bucket
    has about ``bucket_rows`` of them. ``_drawn`` counts the draws.
    """
    types = {f.name: f.dataType for f in rows.schema}
    names = [f"_g{i}" for i in range(len(group))]
    rows = rows.select(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col(key).alias("_k"), *columns)
    rows = rows.withColumn("_group", F.xxhash64(F.lit(seed), *names))
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    count = F.ceil(F.col("_n") / F.lit(bucket_rows))
    placed = stage(join_bounded(rows, sizes, ["_group"]).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_k"), count)), "segments")
    filled: dict[int, dict[int, int]] = {}
    for g, b, n in placed.groupBy("_group", "_bucket").agg(F.count(F.lit(1))).collect():  # one row per bucket
        filled.setdefault(g, {})[b] = n

    def of_bucket(g: int, b: int) -> np.ndarray:
        """Draws of a bucket in every resample."""
        buckets = sorted(filled[g])
        share = np.array([filled[g][x] for x in buckets], float)
        dealt = np.random.default_rng([seed, g % (1 << 63)]).multinomial(int(share.sum()), share / share.sum(), resamples)
        return dealt[:, buckets.index(b)]

    schema = T.StructType(
        [T.StructField(n, types[g]) for g, n in zip(group, names)]
        + [T.StructField("resample", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ["_drawn", *columns]]
    )

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_k", kind="stable")
        g, b, n = int(frame["_group"].iloc[0]), int(frame["_bucket"].iloc[0]), len(frame)
        drawn = np.random.default_rng([seed, g % (1 << 63), b]).multinomial(of_bucket(g, b), np.full(n, 1 / n))
        numbers = np.c_[np.ones(n), frame[columns].to_numpy(float)]
        sums = pd.DataFrame((drawn @ numbers).astype(np.int64), columns=["_drawn", *columns])
        for name in reversed(names):
            sums.insert(0, name, [frame[name].iloc[0]] * resamples)
        sums.insert(len(names), "resample", np.arange(resamples, dtype=np.int32))
        return sums

    parts = placed.groupBy("_group", "_bucket").applyInPandas(work, schema)
    sums = parts.groupBy(*names, "resample").agg(*[F.sum(c).alias(c) for c in ["_drawn", *columns]])
    return sums.select(*[F.col(n).alias(g) for g, n in zip(group, names)], "resample", "_drawn", *columns)


_MD5_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
_MD5_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)


def md5_words(heads: list[bytes], keys: list[bytes]) -> np.ndarray:
    """The digests of every key behind every head as four big-endian 32-bit parts: (keys, heads, 4).

    Messages of one block are hashed side by side, longer ones one after the other.
    """
    out = np.empty((len(keys), len(heads), 4), np.uint32)
    by_size: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_size.setdefault(len(k), []).append(i)
    heads_of: dict[int, list[int]] = {}
    for j, h in enumerate(heads):
        heads_of.setdefault(len(h), []).append(j)
    for size, rows in by_size.items():
        for head, columns in heads_of.items():
            if head + size > 55:
                for i in rows:
                    for j in columns:
                        out[i, j] = np.frombuffer(hashlib.md5(heads[j] + keys[i]).digest(), ">u4")
                continue
            step = max(1, 8192 // len(columns))
            tops = np.frombuffer(b"".join(heads[j] for j in columns), np.uint8).reshape(len(columns), head)
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                block = np.zeros((len(some), len(columns), 64), np.uint8)
                block[:, :, :head] = tops
                block[:, :, head : head + size] = np.frombuffer(b"".join(keys[i] for i in some), np.uint8).reshape(len(some), 1, size)
                block[:, :, head + size] = 0x80
                block[:, :, 56:58] = np.frombuffer((8 * (head + size)).to_bytes(2, "little"), np.uint8)
                out[np.ix_(some, columns)] = _md5_blocks(block.reshape(-1, 64).view("<u4").T, head + size).T.reshape(len(some), len(columns), 4)
    return out


def _md5_blocks(words: np.ndarray, size: int) -> np.ndarray:
    """Digests of blocks in columns, each a message of ``size`` bytes, as big-endian parts."""
    used = [i for i in range(16) if i * 4 <= size or i == 14]
    message = {i: np.ascontiguousarray(words[i], np.uint32) for i in used}
    start = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in start)
    mixed, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
        a += mixed
        a += _MD5_SINES[i]
        if g in message:
            a += message[g]
        np.right_shift(a, np.uint32(32 - _MD5_SHIFTS[i]), out=turned)
        a <<= np.uint32(_MD5_SHIFTS[i])
        a |= turned
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + y for x, y in zip((a, b, c, d), start)]).byteswap()


def resample_sums(
    rows: DataFrame, group: list[str], key: str, columns: list[str], resamples: int, seed: int, bounds: list[int], draws: int
) -> DataFrame:
    """Sums of ``columns`` per group and resample, weighted by hash draws per segment.

    Draw ``r`` of a segment is the ``r % draws``-th 32-bit part of ``md5(seed|r div draws|key)``; its weight
    is the number of ``bounds`` it reaches. A batch's weights are a matrix, and its sums the product with
    the segments' numbers; a task hands on one row per group and resample. Resamples without any segment
    of a group have no row.
    """
    types = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType(
        [T.StructField(g, types[g]) for g in group]
        + [T.StructField("resample", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ["_drawn", *columns]]
    )
    blocks = -(-resamples // draws)
    heads = [f"{seed}|{b}|".encode() for b in range(blocks)]
    limits = np.array(bounds, np.uint32)

    def weights(keys: list[str]) -> np.ndarray:
        drawn = md5_words(heads, [x.encode() for x in keys]).reshape(len(keys), blocks * draws)[:, :resamples]
        found = np.zeros(drawn.shape, np.uint8)
        for limit in limits:
            found += drawn >= limit
        return found

    def handed(held: dict) -> Iterator[pa.RecordBatch]:
        for name, sums in held.items():
            at = np.flatnonzero(sums[:, 0])
            arrays = [pa.array([v] * len(at)) for v in name] + [pa.array(at, pa.int32())]
            arrays += [pa.array(c) for c in np.ascontiguousarray(sums[at].T)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*group, "resample", "_drawn", *columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        step = max(1, DRAWN_CELLS // (blocks * draws))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                names = list(zip(*[batch.column(g).to_pylist() for g in group])) if group else [()] * batch.num_rows
                numbers = np.stack([np.ones(batch.num_rows, np.int64)] + [batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)
                drawn = weights(batch.column(key).to_pylist())
                order: dict[tuple, list[int]] = {}
                for i, name in enumerate(names):
                    order.setdefault(name, []).append(i)
                for name, at in order.items():
                    # whole numbers below 2**53: the product is exact
                    sums = (drawn[at].T.astype(float) @ numbers[at].astype(float)).astype(np.int64)
                    held[name] = held[name] + sums if name in held else sums
                if len(held) * resamples * (len(columns) + 1) > HELD_CELLS:
                    yield from handed(held)
                    held = {}
        yield from handed(held)

    return rows.select(*group, key, *columns).mapInArrow(work, schema)
