"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read through memory maps.

Words are hashed; a word's number is its place in the sorted array of all training hashes, which is cut
into shards by hash range. A bigram is the pair of its words' numbers in one 64-bit key. Each batch of
text sends its distinct keys and counts, as packed sorted arrays, to the shard of their key; a shard's
task merges them and writes sorted arrays to the model's folder. Shards are cut by training mass, and a
word with very many followers is spread over several, so all are of about ``SHARD_TOKENS`` tokens at
most however the words are distributed. Context sums are taken inside a shard; only words at a shard's
ends go on in the next one, and their sums are few enough for the driver. Continuation counts are summed
by word number in a second shuffle.

The model's folder lies in the shared folder of the session. Workers map its arrays into memory (or, if
the folder is in a store that has no local path, fetch one shard's file at a time, map it and delete it)
and search the sorted distinct keys of a slice of text in them. Documents themselves never move.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import tidy
from glossmark.llm.prob_minhash import by_group
from glossmark.llm.substrings import _Hashes
from glossmark.session import staging_dir

SHARD_TOKENS = 4_000_000
# Bytes of text behind one shard of words.
WORD_SHARD_BYTES = 64 << 20
SLICE_TOKENS = 500_000
MAX_WORDS = 1 << 31
# Neither can be a word: words hold no blanks.
BEGIN, END = b" <s>", b" </s>"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HALF = np.uint64(32)
CONTEXT = np.dtype([("v", "<u4"), ("types", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("total", "<u8")])


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


# ---- packed sorted arrays -------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as the byte planes of their differences, which compress well in a shuffle."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def plain(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplain(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all packed rows, sorted, with the sums of their counts."""
    keys = np.concatenate([unpack(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([unplain(x) for x in table.column("counts").to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def _dealt(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
    """One row per shard of sorted keys whose shard numbers never fall."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if b > a:
            yield {"shard": int(shard[a]), "keys": pack(keys[a:b]), "counts": plain(counts[a:b])}


_PACKED = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("info", pa.string())])
_PACKED_DDL = "shard int, keys binary, counts binary, info string"


# ---- the model's folder ---------------------------------------------------------------------------


class Store:
    """Files of a folder that driver and workers reach."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = afs.FileSystem.from_uri(uri)

    def create(self) -> None:
        self.fs.create_dir(self.path, recursive=True)

    def write(self, name: str, *arrays: np.ndarray) -> None:
        """Written under another name first: a repeated task puts an equal file in the place of the old one."""
        draft = f"{self.path}/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            for a in arrays:
                out.write(np.ascontiguousarray(a).tobytes())
        self.fs.move(draft, f"{self.path}/{name}")

    def map(self, name: str, mapped: bool = True) -> np.ndarray:
        """The file's bytes as a memory map."""
        if mapped and isinstance(self.fs, afs.LocalFileSystem):
            return np.memmap(f"{self.path}/{name}", np.uint8, "r")
        handle, local = tempfile.mkstemp()
        try:
            with os.fdopen(handle, "wb") as out, self.fs.open_input_stream(f"{self.path}/{name}") as source:
                while chunk := source.read(1 << 22):
                    out.write(chunk)
            return np.memmap(local, np.uint8, "r")
        finally:
            os.unlink(local)  # the map keeps the bytes until it is dropped


@dataclass
class Model:
    """What a worker needs besides the files; grows with the number of shards only."""

    uri: str
    word_sizes: list[int]
    word_mass: list[int]
    pair_sizes: list[int] = field(default_factory=list)
    context_sizes: list[int] = field(default_factory=list)
    spread: dict = field(default_factory=dict)
    discounts: list[float] = field(default_factory=list)
    lower: list[float] = field(default_factory=list)
    continuations: int = 0
    rest: float = 1.0
    tokens: int = 0
    distinct: int = 0
    pair_shards: int = 1


class Words:
    """Numbers and counts of word hashes, from the word shards."""

    def __init__(self, model: Model, mapped: bool = True) -> None:
        self.model, self.store, self.mapped = model, Store(model.uri), mapped
        self.base = np.r_[0, np.cumsum(model.word_sizes)].astype(np.int64)
        self.mass = np.r_[0, np.cumsum(model.word_mass)].astype(np.int64)
        self.maps: dict[str, np.ndarray] = {}

    def file(self, name: str) -> np.ndarray:
        """Maps of a mounted folder stay open; fetched files are let go after use."""
        if name in self.maps:
            return self.maps[name]
        got = self.store.map(name, self.mapped)
        if self.mapped:
            self.maps[name] = got
        return got

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _HALF) * np.uint64(len(self.model.word_sizes)) >> _HALF).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, count, mass before) of sorted distinct hashes."""
        number, count, before = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        shard = self.shard_of(hashes)
        for s in np.unique(shard).tolist():
            n = self.model.word_sizes[s]
            if not n:
                continue
            at = np.flatnonzero(shard == s)
            own = self.file(f"words-{s}").view("<u8").reshape(3, n)
            place = np.minimum(np.searchsorted(own[0], hashes[at]), n - 1)
            hit = own[0][place] == hashes[at]
            place, at = place[hit], at[hit]
            number[at] = self.base[s] + place
            count[at] = own[1][place]
            before[at] = self.mass[s] + own[2][place].astype(np.int64)
        return number, count, before

    def pair_shard(self, before: np.ndarray, count: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Shard of the bigram (v, w) from v's mass: never falls as (v, w) grows."""
        place = before + (count * (w / max(1, self.base[-1]))).astype(np.int64)
        width = -(-int(self.mass[-1]) // self.model.pair_shards) or 1
        return np.minimum(place // width, self.model.pair_shards - 1)


# ---- training ---------------------------------------------------------------------------------------


def _slices(texts: Iterator[list], hashes: _Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of begin, words and end of consecutive texts; lengths) for slices of bounded size.

    One text longer than a slice is a slice of its own.
    """
    begin, end = hashes[BEGIN], hashes[END]
    held, total = [], 0
    for batch in texts:
        for text in batch:
            words = hashes.of(words_of(text))
            held.append(np.concatenate([np.array([begin], np.uint64), words, np.array([end], np.uint64)]))
            total += len(held[-1])
            if total >= SLICE_TOKENS:
                yield np.concatenate(held), np.array([len(x) for x in held])
                held, total = [], 0
    if held:
        yield np.concatenate(held), np.array([len(x) for x in held])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for b in batches:
        yield b.column(0).to_pylist()


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _PACKED)


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, _ in _slices(_texts(batches), _Hashes(0)):
            keys, counts = np.unique(seq, return_counts=True)
            shard = ((keys >> _HALF) * np.uint64(shards) >> _HALF).astype(np.int64)
            yield _batch(list(_dealt(shard, keys, counts)))

    return run


def _write_words(uri: str):
    def work(table: pa.Table, state: dict) -> Iterator[pa.RecordBatch]:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        Store(uri).write(f"words-{shard}", keys.astype("<u8"), counts.astype("<u8"), (np.cumsum(counts) - counts).astype("<u8"))
        yield _batch([{"shard": shard, "info": json.dumps({"shard": shard, "n": len(keys), "mass": int(counts.sum())})}])

    return work


def _numbered(words: Words, seq: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per token of a slice: its place among the slice's distinct hashes; per distinct: number, count, mass before."""
    distinct, back = np.unique(seq, return_inverse=True)
    return back, *words.find(distinct)


def _keys(number: np.ndarray, back: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of first and second word of every bigram inside a text, and bigram keys."""
    inside = np.ones(len(back), bool)
    inside[np.cumsum(lengths) - 1] = False
    first = np.flatnonzero(inside)
    v, w = back[first], back[first + 1]
    return v, w, (number[v].astype(np.uint64) << _HALF) | (number[w].astype(np.uint64) & np.uint64(0xFFFFFFFF))


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for seq, lengths in _slices(_texts(batches), _Hashes(0)):
            back, number, count, before = _numbered(words, seq)
            v, w, keys = _keys(number, back, lengths)
            keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
            shard = words.pair_shard(before[v[first]], count[v[first]], number[w[first]])
            yield _batch(list(_dealt(shard, keys, counts)))

    return run


def _write_pairs(model: Model):
    def work(table: pa.Table, state: dict) -> Iterator[pa.RecordBatch]:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        v = (keys >> _HALF).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        context = np.empty(len(starts), CONTEXT)
        context["v"], context["total"] = v[starts], np.add.reduceat(counts, starts)
        context["types"] = np.diff(np.r_[starts, len(keys)])
        for k in (1, 2):
            context[f"n{k}"] = np.add.reduceat((counts == k).astype(np.int64), starts)
        store = Store(model.uri)
        store.write(f"pairs-{shard}", keys.astype("<u8"), counts.astype("<u8"))
        store.write(f"contexts-{shard}", context)
        ends = {int(c["v"]): [int(c[f]) for f in ("types", "n1", "n2", "total")] for c in context[[0, -1]]}
        info = {"pairs": shard, "n": len(keys), "contexts": len(context), "ends": ends, "of": [int((counts == k).sum()) for k in (1, 2, 3, 4)]}
        w, types = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        to = np.searchsorted(np.cumsum(model.word_sizes), w, side="right")
        yield _batch([{"shard": 0, "info": json.dumps(info)}, *_dealt(to, w, types)])

    return work


def _write_continuations(model: Model):
    base = np.r_[0, np.cumsum(model.word_sizes)]

    def work(table: pa.Table, state: dict) -> Iterator[pa.RecordBatch]:
        shard = table.column("shard")[0].as_py()
        out = [{"shard": shard, "info": x} for x in table.column("info").to_pylist() if x]
        mine = table.filter(pa.compute.is_valid(table.column("keys")))
        if len(mine):
            w, types = _merged(mine)
            counts = np.zeros(model.word_sizes[shard], np.int64)
            counts[w.astype(np.int64) - base[shard]] = types
            Store(model.uri).write(f"continuations-{shard}", counts.astype("<u4"))
            info = {"continuations": shard, "total": int(counts.sum()), "of": [int((counts == k).sum()) for k in (1, 2, 3, 4)], "types": len(w)}
            out.append({"shard": shard, "info": json.dumps(info)})
        yield _batch(out)

    return work


def discounts(of: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of items seen 1 to 4 times.

    Where a number is 0 the estimate does not exist; then 0.5, 1 and 1.5 are taken.
    """
    if not all(of):
        return [0.5, 1.0, 1.5]
    y = of[0] / (of[0] + 2 * of[1])
    raw = [k - (k + 1) * y * of[k] / of[k - 1] for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1)]


def train(df: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Count ``df``'s texts (null as empty) and write the model below the session's shared folder.

    Every text is one sequence with an end; an empty table gives a model that knows no word.
    """
    spark = df.sparkSession
    uri = f"{staging_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    Store(uri).create()
    texts = df.select(F.col(f"`{text}`").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // WORD_SHARD_BYTES))

    def grouped(rows: DataFrame, work, n: int) -> DataFrame:
        return rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(by_group(["shard"], work), _PACKED_DDL)

    counted = texts.mapInArrow(tidy(_count_words(parts)), _PACKED_DDL)
    found = [json.loads(r["info"]) for r in grouped(counted, _write_words(uri), parts).select("info").collect()]
    sizes, mass = [0] * parts, [0] * parts
    for x in found:
        sizes[x["shard"]], mass[x["shard"]] = x["n"], x["mass"]
    model = Model(uri, sizes, mass)
    if not sum(sizes):
        return model
    if sum(sizes) >= MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} different words: their numbers no longer fit a bigram key")

    begins = int(Words(model).find(np.array([_Hashes(0)[BEGIN]], np.uint64))[1][0])
    model.tokens, model.distinct = sum(mass) - begins, sum(sizes) - 1
    model.pair_shards = shards or max(parts, -(-sum(mass) // SHARD_TOKENS))
    pairs = texts.mapInArrow(tidy(_count_pairs(model)), _PACKED_DDL)
    spread = grouped(pairs, _write_pairs(model), model.pair_shards)
    found = [json.loads(r["info"]) for r in grouped(spread, _write_continuations(model), parts).select("info").collect()]

    model.pair_sizes, model.context_sizes = [0] * model.pair_shards, [0] * model.pair_shards
    of, lower, types, ends = np.zeros(4, int), np.zeros(4, int), 0, {}
    for x in found:
        if "pairs" in x:
            model.pair_sizes[x["pairs"]], model.context_sizes[x["pairs"]] = x["n"], x["contexts"]
            of += x["of"]
            for v, sums in x["ends"].items():
                ends.setdefault(int(v), []).append(sums)
        else:
            model.continuations += x["total"]
            lower += x["of"]
            types += x["types"]
    # the first and last word of every shard, as their bigrams may lie in others too
    model.spread = {v: np.sum(s, 0).tolist() for v, s in ends.items()}
    model.discounts, model.lower = discounts(of.tolist()), discounts(lower.tolist())
    d = model.lower
    model.rest = (d[0] * lower[0] + d[1] * lower[1] + d[2] * (types - lower[0] - lower[1])) / model.continuations
    return model


# ---- scoring ----------------------------------------------------------------------------------------


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


class Scorer:
    """log10 probabilities of slices of text under a model."""

    def __init__(self, model: Model, mapped: bool = True) -> None:
        self.model, self.words = model, Words(model, mapped)
        self.hashes = _Hashes(0)

    def unigram(self, number: np.ndarray) -> np.ndarray:
        """Lower-order probability of word numbers (-1: unknown)."""
        m = self.model
        out = np.full(len(number), m.rest / (m.distinct + 1))
        shard = np.searchsorted(self.words.base, number, side="right") - 1
        for s in np.unique(shard[number >= 0]).tolist():
            at = np.flatnonzero((shard == s) & (number >= 0))
            counts = self.words.file(f"continuations-{s}").view("<u4")[number[at] - self.words.base[s]].astype(np.int64)
            out[at] += _discounted(counts, m.lower) / m.continuations
        return out

    def contexts(self, number: np.ndarray, count: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, weight of the lower order) of context words; total 0 for those never followed by a word."""
        m = self.model
        total, weight = np.zeros(len(number)), np.ones(len(number))
        shard = self.words.pair_shard(before, count, np.zeros(len(number)))
        for s in np.unique(shard[number >= 0]).tolist():
            n = m.context_sizes[s]
            if not n:
                continue
            at = np.flatnonzero((shard == s) & (number >= 0))
            own = self.words.file(f"contexts-{s}").view(CONTEXT)
            place = np.minimum(np.searchsorted(own["v"], number[at]), n - 1)
            hit = own["v"][place] == number[at]
            rows, at = own[place[hit]], at[hit]
            total[at] = rows["total"]
            weight[at] = self._weight(rows["types"], rows["n1"], rows["n2"], rows["total"])
        for v, (types, n1, n2, whole) in m.spread.items():
            at = np.flatnonzero(number == v)
            total[at], weight[at] = whole, self._weight(types, n1, n2, whole)
        return total, weight

    def _weight(self, types, n1, n2, total):
        d = self.model.discounts
        n1, n2 = n1 * 1.0, n2 * 1.0
        return (d[0] * n1 + d[1] * n2 + d[2] * (types - n1 - n2)) / total

    def pair_counts(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Training counts of sorted distinct keys."""
        out = np.zeros(len(keys), np.int64)
        for s in np.unique(shard).tolist():
            n = self.model.pair_sizes[s]
            if not n:
                continue
            at = np.flatnonzero(shard == s)
            own = self.words.file(f"pairs-{s}")
            known = own[: 8 * n].view("<u8")
            place = np.minimum(np.searchsorted(known, keys[at]), n - 1)
            hit = known[place] == keys[at]
            out[at[hit]] = own[8 * n :].view("<u8")[place[hit]].astype(np.int64)
        return out

    def score(self, texts: list) -> Iterator[dict]:
        m = self.model
        for seq, lengths in _slices(iter([texts]), self.hashes):
            back, number, count, before = _numbered(self.words, seq)
            v, w, keys = _keys(number, back, lengths)
            lower = self.unigram(number)[w]
            p, total, weight = lower.copy(), np.zeros(len(number)), np.ones(len(number))
            if m.tokens:
                total, weight = self.contexts(number, count, before)
                both = np.flatnonzero((number[v] >= 0) & (number[w] >= 0))
                distinct, first, inverse = np.unique(keys[both], return_index=True, return_inverse=True)
                one = both[first]
                shard = self.words.pair_shard(before[v[one]], count[v[one]], number[w[one]])
                seen = np.zeros(len(keys), np.int64)
                seen[both] = self.pair_counts(distinct, shard)[inverse]
                known = total[v] > 0
                p = np.where(known, _discounted(seen, m.discounts) / np.where(known, total[v], 1) + weight[v] * lower, lower)
            starts = np.cumsum(lengths - 1) - (lengths - 1)
            c = count[w]
            base = np.log10((c + 1) / (m.tokens + m.distinct + 1))
            columns = [lengths - 1, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]
            for n, k, b, s in zip(*[x.tolist() for x in columns]):
                yield {"n_tokens": n, "n_known": k, "base": b, "score": s}


def score_column(model: Model, mapped: bool = True):
    """A column function text -> struct of n_tokens, n_known, base and score (log10); null counts as empty.

    ``base`` is the add-one unigram score. A text's tokens are its words and one end, scored after a begin sign.
    """

    @F.arrow_udf("struct<n_tokens:bigint,n_known:bigint,base:double,score:double>")
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model, mapped)
        kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        for batch in batches:
            yield pa.array(list(scorer.score(batch.to_pylist())), kind)

    return score.asNondeterministic()


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10.0, -score / n_tokens)
