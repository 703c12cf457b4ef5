"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of ``window`` consecutive words of each test item; an item of fewer
words is one pattern. Patterns of one length share a set of tables, as the method needs a common
length: a shift table over blocks of two words says how far the search may jump without missing an
occurrence; where it says 0, the block is the suffix of some patterns, whose bucket (by suffix block,
then by first block) holds the few that are compared word by word.

Documents never move: the search is one Arrow pass over each text. The test items are sent to the
workers only up to ``MAX_ITEM_BYTES``; a larger set is cut into blocks by item and searched in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import fresh, tidy
from glossmark.session import stage

MAX_ITEM_BYTES = 64 << 20
WINDOW = 13
_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_TABLE = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

RESULT = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:int,stop:int>>,items:array<string>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at every ASCII sign that is neither letter nor digit."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Tables:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, self.length + 1):
                block = b" ".join(words[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.length), self.length - end)
            heads = self.buckets.setdefault(b" ".join(words[-self.block :]), {})
            heads.setdefault(words[0], []).append((list(words), items))
        self.jump = self.length - self.block + 1

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, stop, items) of every occurrence, in order."""
        end, n, size, shift, jump = self.length, len(words), self.length, self.shift, self.jump
        pair = self.block == 2
        while end <= n:
            block = words[end - 2] + b" " + words[end - 1] if pair else words[end - 1]
            step = shift.get(block, jump)
            if step:
                end += step
                continue
            for pattern, items in self.buckets[block].get(words[end - size], ()):
                if words[end - size : end] == pattern:
                    yield end - size, end, items
            end += 1


def build(items: list[tuple[str, str]], window: int = WINDOW) -> list[Tables]:
    """Tables per pattern length of (item id, text) pairs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
    return [Tables(patterns) for _, patterns in sorted(by_length.items())]


def scan(words: list[bytes], tables: list[Tables]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words and the items with an occurrence."""
    spans, items = [], set()
    for t in tables:
        for start, stop, found in t.search(words):
            spans.append((start, stop))
            items |= found
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def _hits(shared, window: int):
    """Arrow function text -> RESULT for one broadcast block of items."""

    @F.arrow_udf(RESULT)
    @tidy
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = build(shared.value, window)
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                words = words_of(text)
                spans, items = scan(words, tables)
                rows.append({
                    "n_words": len(words), "n_hit": sum(b - a for a, b in spans),
                    "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(items),
                })
            yield pa.array(rows, _ARROW)

    return hits.asNondeterministic()


_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string())),
])


def _join(left: Column, right: Column) -> Column:
    """Both results of one document as one."""

    @F.arrow_udf(RESULT)
    def joined(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            spans = merged([(s["start"], s["stop"]) for s in a["spans"] + b["spans"]])
            rows.append({
                "n_words": a["n_words"], "n_hit": sum(y - x for x, y in spans),
                "spans": [{"start": x, "stop": y} for x, y in spans], "items": sorted({*a["items"], *b["items"]}),
            })
        return pa.array(rows, _ARROW)

    return joined(left, right)


def find_items(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    out: str = "hits", window: int = WINDOW, max_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """``df`` with the struct ``out``: n_words, n_hit, spans of hit words, items (ids as sorted strings).

    A null or empty text has no words. Items without words never occur; items with a null id are
    left out, repeated items count once. A column of ``df`` named ``out``, but for case, is replaced. Texts of any
    length are searched whole; repeated rows get equal results; an empty table gives no rows, without items nothing is hit.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower() and c != out])
    known = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("body"))
    known = known.where("item IS NOT NULL AND body IS NOT NULL").distinct()
    size = known.agg(F.sum(F.octet_length("body") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-size // max_bytes))
    sc = df.sparkSession.sparkContext
    for i in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()
        found = _hits(sc.broadcast([(r["item"], r["body"]) for r in part]), window)(F.col(f"`{text}`"))
        if i == 0:
            df = df.withColumn(out, found)
        else:
            more = fresh(df, "more")
            df = df.withColumn(more, found).withColumn(out, _join(F.col(f"`{out}`"), F.col(f"`{more}`"))).drop(more)
        if blocks > 1:  # one block of patterns in memory at a time
            df = stage(df, "decontamination")
    return df


def contaminated(hits: Column, percent: int = 5) -> Column:
    """True if hit words are at least ``percent`` of the document's words and there are any."""
    return (hits["n_hit"] > 0) & (100 * hits["n_hit"] >= percent * hits["n_words"])
