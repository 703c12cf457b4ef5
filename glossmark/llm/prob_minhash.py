"""Near-duplicate texts by ProbMinHash signatures, banding and exact verification.

A text is its multiset of word shingles, weighted by count. Every shingle is a Poisson process whose
rate is its weight; each arrival goes to a random register and a register keeps the shingle that came
first. Two registers agree with the probability Jaccard similarity of the weights. Shingles stop as
soon as their next arrival would come after the latest register, so most need one or two arrivals.

Equal texts are one node. Nodes that share a band of registers meet in a bucket; within it, registers
are compared and nodes that look similar are tied together into families. Inside a family the exact
similarity is worked out for the pairs that look similar, and links at or above the threshold are
united. Buckets and families beyond ``BLOCK`` nodes are dealt out as pairs of blocks, so none is ever
in one task, every pair of its nodes meets, and only ties that join something new leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import row_digest, tidy
from glossmark.llm.components import components
from glossmark.llm.substrings import BASES, LAST_ID, _Hashes, rolling, words_of
from glossmark.session import stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BLOCK = 4096
# Registers that must agree for a pair to be verified: 4 standard deviations below the threshold.
SLACK = 4.0
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def least_agreement(threshold: float) -> int:
    return int(REGISTERS * threshold - SLACK * (REGISTERS * threshold * (1 - threshold)) ** 0.5)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text's word hashes, sorted, with counts; a short text is one shingle."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(mixed(rolling(words, min(size, len(words)), BASES[0])), return_counts=True)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Registers of ``n`` texts whose weighted elements are listed flat; rows of texts without elements are 0."""
    m = np.uint64(REGISTERS)
    first = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    time, turn = np.zeros(len(element)), 0
    while len(element):
        turn += 1
        with np.errstate(over="ignore"):
            draw = mixed(element + np.uint64(turn) * _GOLD)
            place = ((mixed(draw ^ _GOLD) >> np.uint64(32)) * m) >> np.uint64(32)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        slot = owner * REGISTERS + place.astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        winner[slot[won]] = element[won]
        # early termination: arrivals after the latest register can change nothing
        going = time < first.reshape(n, REGISTERS).max(1)[owner]
        owner, element, weight, time = owner[going], element[going], weight[going], time[going]
    return winner.reshape(n, REGISTERS)


_SIGNED = "struct<bands:array<bigint>,sketch:binary>"


def _signer(shingle: int):
    @F.arrow_udf(_SIGNED)
    @tidy
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes(0)
        for batch in batches:
            texts, rows = batch.to_pylist(), []
            at = 0
            while at < len(texts):  # slices of bounded size
                parts, held = [], 0
                while at < len(texts) and held < 200_000:
                    parts.append(shingles(hashes.of(words_of(texts[at])), shingle))
                    held += len(parts[-1][0])
                    at += 1
                owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
                got = signatures(owner, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float), len(parts))
                keys = np.zeros((len(parts), BANDS), np.uint64)
                for i in range(ROWS):
                    keys = mixed(keys * np.uint64(BASES[1]) + got[:, i::ROWS] + np.arange(BANDS, dtype=np.uint64) * _GOLD)
                small = (got >> np.uint64(48)).astype("<u2")
                rows += [
                    {"bands": k, "sketch": s.tobytes()} if len(p[0]) else None
                    for p, k, s in zip(parts, keys.view(np.int64), small)
                ]
            yield pa.array(rows, pa.struct([("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]))

    return sign.asNondeterministic()


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted elements, weights).

    Each shared element with weights x and y contributes 1 / sum over all elements of max(x'/x, y'/y);
    that sum depends on the ratio x / y only.
    """
    (ea, xa), (eb, xb) = a, b
    both, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = xa[ia].astype(float), xb[ib].astype(float)
    lone_x, lone_y = xa.sum() - x.sum(), xb.sum() - y.sum()
    total = 0.0
    ratios, back = np.unique(x / y, return_inverse=True)
    for k, t in enumerate(ratios):
        whole = np.maximum(x, t * y).sum() + lone_x + t * lone_y
        total += (x[back == k]).sum() / whole
    return total


def sized(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` of groups with more than one row, with the group's size ``n``."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(sizes, group)


def dealt(rows: DataFrame, node: str, block: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """``rows`` with ``i``, ``j``, ``k`` and ``own`` instead of ``n``: groups beyond ``block`` rows as pairs of blocks.

    ``n`` is the size of a row's group and ``k`` the number of its blocks; blocks are drawn by hash. A pair
    (i, j) holds both blocks' rows, and a row is in as many pairs as there are blocks; ``own`` is its own.
    The pairs may be dealt out over several ``turns``, of which this is number ``turn``.
    """
    k = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = rows.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64(node), F.col("k")).cast("int"))
    others = F.sequence(F.lit(0), F.col("k") - 1)
    if turns > 1:
        others = F.filter(others, lambda x: F.pmod(F.xxhash64(F.least("own", x), F.greatest("own", x)), F.lit(turns)) == turn)
    other = F.explode(others)
    return placed.withColumn("other", other).select(
        *[c for c in rows.columns if c != "n"], "k", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )


def by_group(keys: list[str], work: Callable) -> Callable:
    """A mapInArrow function that hands each run of rows with equal ``keys`` to ``work`` as one table.

    The input is sorted by the keys; a run may go across batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        state: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            starts = [0, *change.tolist()]
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                now = tuple(c[a] for c in cols)
                if held and now != last:
                    yield from work(pa.Table.from_batches(held), state)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield from work(pa.Table.from_batches(held), state)

    return tidy(run)


class Forest:
    """Union-find over a few thousand nodes of one block."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(-1, REGISTERS)


def _tie(least: int) -> Callable:
    """Ties that span what looks similar in a bucket, as stars around the smallest node.

    Each node reached is compared with those not yet reached.
    """

    def work(table: pa.Table, state: dict) -> Iterator[pa.RecordBatch]:
        nodes, look = table.column("node").to_numpy(), _sketches(table)
        rest, out_a, out_b, first = np.arange(len(nodes)), [], [], 0
        queue: list[int] = []
        while len(rest):
            if not queue:
                first, rest = int(rest[0]), rest[1:]
                queue = [first]
            near = (look[rest] == look[queue.pop()]).sum(1) >= least
            out_a += [first] * int(near.sum())
            out_b += (found := rest[near].tolist())
            queue += found
            rest = rest[~near]
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(nodes[out_a]), pa.array(nodes[out_b])], ["a", "b"])

    return work


def _verify(least: int, threshold: float, shingle: int) -> Callable:
    """Links that span what is similar in a block of a family, by exact comparison, as stars around the smallest node.

    ``more`` tells that the family has further blocks, so that the stars are not yet its classes.
    """

    def work(table: pa.Table, state: dict) -> Iterator[pa.RecordBatch]:
        hashes = state.setdefault("hashes", _Hashes(0))
        if len(set(nodes := table.column("node").to_pylist())) < len(nodes):  # repeated rows of one document
            table = table.take([nodes.index(x) for x in dict.fromkeys(nodes)])
            nodes = table.column("node").to_pylist()
        look = _sketches(table)
        sets = [shingles(hashes.of(words_of(t)), shingle) for t in table.column("text").to_pylist()]
        forest = Forest(len(nodes))
        for x in range(len(nodes)):
            same = (look[x + 1 :] == look[x]).sum(1)
            near = np.flatnonzero(same >= least)
            for y in near[np.argsort(-same[near], kind="stable")].tolist():
                y += x + 1
                if forest.find(x) != forest.find(y) and probability_jaccard(sets[x], sets[y]) >= threshold:
                    forest.join(x, y)
        links = [(y, nodes[x]) for i, y in enumerate(nodes) if (x := forest.find(i)) != i]
        if links:
            more = table.column("k")[0].as_py() > 1
            arrays = [pa.array(c, pa.int64()) for c in zip(*links)] + [pa.array([more] * len(links))]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "root", "more"])

    return work


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK,
) -> DataFrame:
    """One row per different text: f1, f2 (two hashes of it), doc (its smallest id), its class's key and smallest id,
    ``worded`` (it has words), and ``head``: true for one text of the class, with that smallest id.

    Two texts are linked if the probability Jaccard similarity of their word shingles (weights: counts) is at
    least ``threshold``; classes are what links connect. Words are those between ASCII white space. Null texts
    and texts without words have hashes too but link with nothing. A null id counts as larger than any other.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID))
    rows = df.select(F.xxhash64(body).alias("f1"), F.xxhash64(F.lit("second"), body).alias("f2"), ident.alias("doc"), body.alias("text"))
    signed = rows.select("f1", "f2", "doc", _signer(shingle)(F.col("text")).alias("s"))
    heads = signed.groupBy("f1", "f2").agg(F.min("doc").alias("doc"), F.first("s").alias("s"))
    heads = stage(heads.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "doc", "s.bands", "s.sketch"), "near-heads")
    least = least_agreement(threshold)

    keys = heads.select("node", F.explode("bands").alias("bucket"))
    met = sized(keys, "bucket").join(heads.select("node", "sketch"), "node")
    dealt_out = dealt(met, "node", block).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    ties = dealt_out.mapInArrow(by_group(["bucket", "i", "j"], _tie(least)), "a long, b long")
    families = components(ties, "a", "b")
    worded = F.col("bands").isNotNull().alias("worded")
    alone = heads.select("f1", "f2", "doc", worded, F.col("node").alias("class_key"), F.col("doc").alias("class_doc"), F.lit(True).alias("head"))
    if families is None:
        return alone

    families = stage(families, "near-families")
    members = sized(families, "root").join(heads.select("node", "f1", "f2", "doc", "sketch"), "node")
    # only the document with the smallest id brings its text
    held = members.join(rows.withColumnRenamed("doc", "id"), ["f1", "f2"]).where("id <= doc").select("root", "n", "node", "sketch", "text")
    spread = dealt(held, "node", block).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    links = spread.mapInArrow(by_group(["root", "i", "j"], _verify(least, threshold, shingle)), "node long, root long, more boolean")
    links = stage(links, "near-links")
    # a family in one block has its classes already; those in several are united
    classes = links.where("NOT more").select("node", "root")
    classes = classes.unionByName(classes.select(F.col("root").alias("node"), "root").distinct())
    united = components(links.where("more"), "node", "root")
    if united is not None:
        classes = classes.unionByName(united)
    classes = stage(classes.join(heads.select("node", "doc"), "node"), "near-classes")
    named = classes.join(classes.groupBy("root").agg(F.min("doc").alias("class_doc")), "root").select("node", "root", "class_doc")
    every = heads.join(named, "node", "left").select(
        "f1", "f2", "doc", worded, F.coalesce("root", "node").alias("class_key"), F.coalesce("class_doc", "doc").alias("class_doc")
    )
    # only texts with the smallest id compete, so the window never sees a large class
    first = F.row_number().over(Window.partitionBy("class_key").orderBy("f1", "f2")) == 1
    own = F.col("doc") == F.col("class_doc")
    return every.where(own).withColumn("head", first).unionByName(every.where(~own).withColumn("head", F.lit(False)))


def _classified(df: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """Rows of ``df`` (as struct ``row``) with the class of their text and whether they are kept."""
    classes = near_duplicates(df, doc_id, text, **options).select("f1", "f2", "worded", "class_doc", "head")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(body).alias("f1"),
        F.xxhash64(F.lit("second"), body).alias("f2"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID)).alias("id"),
        row_digest(df).alias("tie"),
    )
    joined = rows.join(classes, ["f1", "f2"])
    # Only repeated rows of one document compete. The id is compared by order, which is the same here, so that
    # both parts below join by the same keys and share one shuffle of the rows.
    first = F.row_number().over(Window.partitionBy("f1", "f2").orderBy("tie")) == 1
    best = F.col("worded") & F.col("head") & (F.col("id") <= F.col("class_doc"))
    return joined.where(best).withColumn("kept", first).unionByName(joined.where(~best).withColumn("kept", ~F.col("worded")))


def label(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``class_id`` (smallest id of its class), ``kept``.

    Exactly one row of a class is kept: that of the smallest id. Rows equal in id and text, or different
    texts of one id in one class, are told apart by hashes, and so only one of them is kept. Rows without
    words are classes of their own and are all kept. A class whose ids are all null has a null id. Texts are taken
    whole, however long; an empty table gives no rows.
    """
    rows = _classified(df.select(doc_id, text), doc_id, text, **options)
    own = F.col(f"row.`{doc_id}`").cast("long")
    class_id = F.when(F.col("worded"), F.nullif(F.col("class_doc"), F.lit(LAST_ID))).otherwise(own)
    return rows.select(own.alias("doc_id"), class_id.alias("class_id"), "kept")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that ``label`` keeps, with all their columns."""
    return _classified(df, doc_id, text, **options).where("kept").select("row.*")
