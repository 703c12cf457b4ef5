"""Language identification of words in code-switched text by a linear-chain conditional random field.

Words are runs of letters of the lower-cased text. A word's evidence for each language is a sum of
learned weights of its features: letter n-grams, prefixes and suffixes (hashed) and how its share among
the languages stands in a lexicon. Learned transition weights tie neighbouring words. Forward-backward
gives every word a distribution over languages; a document's language is the one with the largest mean
share, and that share is the score.

The field is fitted on the driver on a sample of labelled rows bounded by ``FIT_ROWS`` rows a language
and ``FIT_CHARS`` letters a row: one half of the rows makes the lexicon, the other half the sequences. As
documents have one label each, half of the sequences are made by joining stretches of different
languages, which is where transitions are learned. Prediction covers every word of every text in one
Arrow pass, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.llm.common import tidy

FIT_ROWS = 400
FIT_CHARS = 4_000
UNKNOWN = "und"
BUCKETS = 1 << 16
STEPS = 80
RATE = 0.15
DECAY = 1e-5
STRETCH = 60
# Words of a memo of evidence; it starts anew when full.
MEMO = 200_000
SLICE_WORDS = 250_000
_WORD = re.compile(r"[^\W\d_]+")
_K = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; all other signs, numbers of any kind among them, end a word."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    # superscripts, fractions, circled and letter numbers are word signs of the pattern, but no letters
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


# ---- features ---------------------------------------------------------------------------------------


def _fold(*columns: np.ndarray, salt: int) -> np.ndarray:
    value = np.full(len(columns[0]), salt, np.uint64)
    for c in columns:
        value = (value ^ c.astype(np.uint64)) * _K
        value ^= value >> np.uint64(29)
    return value


class Features:
    """Hashed features of words: bucket numbers, flat, and the word each belongs to; and whole-word hashes."""

    def __init__(self, words: list[str]) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(words)), size)
        buckets, owners = [], []
        for n in (2, 3):
            first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.empty(0, np.int64)
            buckets.append(_fold(*[letters[first + i] for i in range(n)], salt=n))
            owners.append(owner[first])
        for n in (4, 5):  # prefixes and suffixes of 3 and 4 letters with their border sign
            long = np.flatnonzero(size > n)
            for salt, at in ((10 + n, start[long]), (20 + n, start[long] + size[long] - n)):
                buckets.append(_fold(*[letters[at + i] for i in range(n)], salt=salt))
                owners.append(long)
        bucket, owner_of = np.concatenate(buckets), np.concatenate(owners)
        order = np.argsort(owner_of, kind="stable")
        self.owner = owner_of[order]
        self.bucket = (bucket[order] >> np.uint64(48)).astype(np.int64) % BUCKETS
        self.whole = np.empty(len(words), np.uint64)
        self.starts = np.searchsorted(self.owner, np.arange(len(words)))
        power = _powers(int(size.max()) if len(words) else 1)
        place = np.arange(len(letters)) - np.repeat(start, size)
        if len(words):
            self.whole = np.add.reduceat(_fold(letters, salt=1) * power[place], start)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _K, np.uint64)
    out[0] = 1
    return np.cumprod(out)


@dataclass
class Field:
    """Weights of a fitted field. ``languages`` may be empty: then every text is unknown."""

    languages: list[str]
    weights: np.ndarray  # bucket x language
    lexicon: np.ndarray  # sorted word hashes
    shares: np.ndarray  # centred log shares, word x language
    mapping: np.ndarray  # lexicon share x language
    moves: np.ndarray  # language x language

    def evidence(self, f: Features) -> np.ndarray:
        n = len(f.whole)
        if not n:
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.add.reduceat(self.weights[f.bucket], f.starts) + self.lexical(f) @ self.mapping
        return out.astype(np.float32)

    def lexical(self, f: Features) -> np.ndarray:
        out = np.zeros((len(f.whole), len(self.languages)), np.float32)
        if len(self.lexicon):
            place = np.minimum(np.searchsorted(self.lexicon, f.whole), len(self.lexicon) - 1)
            hit = self.lexicon[place] == f.whole
            out[hit] = self.shares[place[hit]]
        return out


# ---- forward-backward ---------------------------------------------------------------------------------


def posteriors(evidence: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of every word of consecutive sequences, expected transitions, and the log partition sum.

    ``evidence`` has a row per word. All sequences advance together, longest first.
    """
    n, k = evidence.shape
    top = evidence.max(1, keepdims=True) if n else np.zeros((0, 1))
    e = np.exp(evidence - top)
    a, b = np.empty_like(e), np.ones_like(e)
    t = np.exp(moves - moves.max())
    t = t.astype(e.dtype)
    scale = np.ones(n, e.dtype)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than each step
    for s in range(longest):
        at = start[: active[s]] + s
        now = e[at] if s == 0 else (a[at - 1] @ t) * e[at]
        scale[at] = now.sum(1)
        a[at] = now / scale[at][:, None]
    for s in range(longest - 2, -1, -1):
        at = start[: active[s + 1]] + s
        b[at] = ((b[at + 1] * e[at + 1]) @ t.T) / scale[at + 1][:, None]
    post = a * b
    inner = np.ones(n, bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    right = np.flatnonzero(inner)
    expected = t * (a[right - 1].T @ (b[right] * e[right] / scale[right][:, None]))
    total = float(np.log(scale, dtype=np.float64).sum() + top.sum() + moves.max() * len(right))
    return post, expected, total


# ---- fitting ------------------------------------------------------------------------------------------


def _lexicon(rows: list[tuple[str, list[str]]], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and centred log shares of words seen at least twice."""
    counts = [Counter() for _ in languages]
    for lang, words in rows:
        counts[languages.index(lang)].update(words)
    whole = Counter()
    for c in counts:
        whole.update(c)
    words = sorted(w for w, n in whole.items() if n > 1)
    if not words:
        return np.empty(0, np.uint64), np.empty((0, len(languages)), np.float32)
    table = np.array([[c[w] for c in counts] for w in words], float)
    rate = np.log((table + 0.5) / (np.array([sum(c.values()) for c in counts]) + 1))
    rate -= rate.mean(1, keepdims=True)
    keys = Features(words).whole
    order = np.argsort(keys)
    return keys[order], rate[order].astype(np.float32)


def fit(rows: list[tuple[str, str]], seed: int = 0) -> Field:
    """Fit on (language, text) rows held in memory; see the module's text for how they are used."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    k = len(languages)
    split = [(lang, words_of(text)) for lang, text in rows]
    split = [(lang, words) for lang, words in split if words]
    # each language's rows are halved by themselves; a single row serves both halves
    half, other = [], []
    for lang in languages:
        mine = rng.permutation([i for i, (c, _) in enumerate(split) if c == lang]).astype(int).tolist()
        half += mine[: max(1, len(mine) // 2)]
        other += mine[len(mine) // 2 :]
    lexicon, shares = _lexicon([split[i] for i in sorted(half)], languages)
    field_ = Field(languages, np.zeros((BUCKETS, k), np.float32), lexicon, shares, np.zeros((k, k), np.float32), np.zeros((k, k)))
    rest = [split[i] for i in sorted(other)]
    if not rest:
        return field_

    def stretch(i: int, most: int) -> tuple[list[str], list[int]]:
        lang, words = rest[i]
        begin = int(rng.integers(0, max(1, len(words) - most + 1)))
        part = words[begin : begin + most]
        return part, [languages.index(lang)] * len(part)

    sequences = [stretch(i, STRETCH) for i in range(len(rest))]
    for _ in range(len(rest)):  # code-switched sequences
        parts = [stretch(int(i), int(rng.integers(4, STRETCH // 2))) for i in rng.integers(0, len(rest), int(rng.integers(2, 5)))]
        sequences.append(([w for p, _ in parts for w in p], [y for _, ys in parts for y in ys]))

    flat = [w for ws, _ in sequences for w in ws]
    labels = np.array([y for _, ys in sequences for y in ys])
    lengths = np.array([len(ws) for ws, _ in sequences])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.array([vocabulary[w] for w in flat])
    features = Features(list(vocabulary))
    lexical = field_.lexical(features)
    wanted = np.eye(k)[labels]
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(lengths) - lengths] = False
    right = np.flatnonzero(inner)
    moved = np.zeros((k, k))
    np.add.at(moved, (labels[right - 1], labels[right]), 1)

    params = [field_.weights, field_.mapping, field_.moves]
    first, second = [np.zeros_like(p, dtype=float) for p in params], [np.zeros_like(p, dtype=float) for p in params]
    for step in range(1, STEPS + 1):
        e = field_.evidence(features)[ids]
        post, expected, _ = posteriors(e, lengths, field_.moves)
        by_word = np.zeros((len(vocabulary), k))
        np.add.at(by_word, ids, wanted - post)
        g = np.zeros((BUCKETS, k))
        for c in range(k):
            g[:, c] = np.bincount(features.bucket, by_word[features.owner, c], BUCKETS)
        for p, grad, m, v in zip(params, (g, lexical.T @ by_word, moved - expected), first, second):
            grad = grad / len(flat) - DECAY * p
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p += (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return field_


def train(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = FIT_ROWS, chars: int = FIT_CHARS, seed: int = 0) -> Field:
    """Fit on at most ``rows`` rows a language of ``df``, drawn by a seeded hash of the key.

    Rows without language or text are left out; repeated rows count as often as they occur; of a long text the first ``chars``
    signs are fitted. An empty table gives a field that knows no language. Only the sample comes to the driver: a threshold on the
    hash is worked out per language from its row count, and the sample is cut to the bound.
    """
    labelled = df.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Field([], np.zeros((BUCKETS, 0), np.float32), np.empty(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    shares = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(min(1.0, (rows + 4 * math.sqrt(rows)) / n)))])
    even = (F.pmod("h", F.lit(1 << 40)) / float(1 << 40)).cast("double")
    drawn = labelled.where(even < F.try_element_at(shares, F.col("lang"))).select("lang", "h", F.substring("text", 1, chars).alias("text"))
    sample: dict[str, list] = {}
    for r in drawn.collect():
        sample.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return fit([(c, t) for c in sorted(sample) for _, t in sorted(sample[c])[:rows]], seed)


# ---- prediction -----------------------------------------------------------------------------------------


class _Evidence(dict):
    """Word -> row of the evidence table; rows of new words are filled in together."""

    def __init__(self, field_: Field) -> None:
        super().__init__()
        self.field, self.table, self.pending = field_, np.zeros((MEMO, len(field_.languages)), np.float32), []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.pending.append(word)
        return row

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO // 2:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            while len(self) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            low = len(self) - len(self.pending)
            for i in range(0, len(self.pending), 50_000):
                part = self.pending[i : i + 50_000]
                self.table[low + i : low + i + len(part)] = self.field.evidence(Features(part))
            self.pending = []
        return self.table[rows]


def label_words(field_: Field, texts: list, memo: _Evidence | None = None) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words, posterior per word) of each text, in order; texts are worked on in slices of bounded size."""
    memo = memo or _Evidence(field_)
    held: list[list[str]] = []
    total = 0
    for i, text in enumerate(texts):
        held.append(words_of(text))
        total += len(held[-1])
        if total >= SLICE_WORDS or i == len(texts) - 1:
            lengths = np.array([len(w) for w in held])
            post = posteriors(memo.of([w for ws in held for w in ws]), lengths, field_.moves.astype(np.float32))[0]
            ends = np.cumsum(lengths)
            yield from ((w, post[e - n : e]) for w, n, e in zip(held, lengths.tolist(), ends.tolist()))
            held, total = [], 0


_KIND = "struct<lang:string,score:double,fit:double,shares:map<string,double>>"


def language(spark: SparkSession, field_: Field, text: Column) -> Column:
    """Struct of lang, score (mean share of lang among the words), fit and the shares of all languages.

    ``fit`` says how surely words belong to some language, whichever: 0 if every word is shared alike by all learned
    languages, 1 if each word is of one for sure. A text in several languages can have a low score and a high fit.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned. Of equal shares
    the language that sorts first wins.
    """
    shared = spark.sparkContext.broadcast(field_)
    arrow = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("fit", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))])

    @F.arrow_udf(_KIND)
    @tidy
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        memo, k, nothing = _Evidence(own), len(own.languages), {"lang": UNKNOWN, "score": 0.0, "fit": 0.0, "shares": []}
        for batch in batches:
            out = []
            if not own.languages:
                out = [nothing] * len(batch)
            else:
                for words, post in label_words(own, batch.to_pylist(), memo):
                    if not words:
                        out.append(nothing)
                        continue
                    mean = post.mean(0, dtype=np.float64)
                    best = int(mean.argmax())
                    sure = float(post.max(1).mean(dtype=np.float64))
                    fit = max(0.0, min(1.0, (sure * k - 1) / (k - 1))) if k > 1 else 1.0
                    out.append({"lang": own.languages[best], "score": min(1.0, float(mean[best])), "fit": fit, "shares": list(zip(own.languages, mean.tolist()))})
            yield pa.array(out, arrow)

    return predict.asNondeterministic()(text)
