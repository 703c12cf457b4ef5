"""Token ids in binary files of patched frame-of-reference blocks.

A folder holds ``ids/part-*.pfor`` and ``manifest`` (Parquet, one row per file). Files follow the ascending
key; each holds whole rows. A file, little-endian:

    magic             8 bytes
    blocks            min u32 | width u8 | exceptions u16 | packed low bits | places u8 | high parts u32
    block starts      u64 each, from the file's beginning
    row ends          u64 each, in ids from the file's first
    row keys          i64 each, and one byte each: 1 where the key is null
    footer            block starts' place u64 | blocks u64 | rows u64 | ids u64 | magic

A block is ``BLOCK`` ids; a short last block is filled up with its minimum. The minimum is subtracted, the
width is that of the value at ``PERCENTILE``; larger values keep their low bits in place and their
remaining bits, with their place, in the exception list. The index of block starts lets a reader unpack
only blocks that it needs.

Rows are dealt by range of (key, hash of the text) and encoded where they are written, so nothing is staged in
between. A file is written as a stream: a writer holds one slice of texts or blocks. It is written under another name
and moved, so a repeated task puts an equal file in the place of the old one.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmark.llm.common import release
from glossmark.llm.word_bpe import WordBpe
from glossmark.session import join_bounded, stage

BLOCK = 256
PERCENTILE = 0.9
#: Bytes of text behind one file, about.
FILE_BYTES = 16 << 20
#: Blocks packed or unpacked at once.
SLICE = 2048
#: Bytes of text encoded at once, about.
TEXTS = 12 << 20
MAGIC = b"PFORIDS1"
_HEAD = np.dtype([("min", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
_FOOT = struct.Struct("<QQQQ8s")


# ---- blocks


def _whole_bytes(width: int) -> np.dtype:
    """The type whose highest bit comes first, wide enough for ``width`` bits."""
    return np.dtype(">u2" if width <= 16 else ">u4")


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Packed blocks of ids (a multiple of ``BLOCK`` numbers below 2^32)."""
    rows = ids.astype(np.int64).reshape(-1, BLOCK)
    least = rows.min(1)
    rows = rows - least[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    chosen = np.partition(rows, at, axis=1)[:, at]
    width = np.frexp(chosen.astype(np.float64))[1].astype(np.int64)  # the number of bits
    high = rows >> width[:, None]
    place = np.nonzero(high)
    count = np.bincount(place[0], minlength=len(rows))
    head = np.zeros(len(rows), _HEAD)
    head["min"], head["width"], head["exceptions"] = least, width, count
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        if w:
            mine = np.flatnonzero(width == w)
            kind = _whole_bytes(w)
            low = (rows[mine] & ((1 << w) - 1)).astype(kind)
            bits = np.unpackbits(low.view(np.uint8).reshape(len(mine), BLOCK, kind.itemsize), axis=2)[:, :, -w:]
            flat = np.packbits(bits.reshape(len(mine), -1), axis=1)
            for i, row in zip(mine.tolist(), flat):
                packed[i] = row.tobytes()
    ends = np.cumsum(count)
    places, values = place[1].astype(np.uint8), high[place].astype("<u4")
    return [
        head[i].tobytes() + packed[i] + places[e - n : e].tobytes() + values[e - n : e].tobytes()
        for i, (e, n) in enumerate(zip(ends.tolist(), count.tolist()))
    ]


def unpack(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts``."""
    starts = starts.astype(np.int64)
    head = raw[starts[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD).ravel()
    width, count = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.int64)
    for w in np.unique(width).tolist():
        if w:
            mine = np.flatnonzero(width == w)
            body = raw[starts[mine, None] + _HEAD.itemsize + np.arange(BLOCK * w // 8)]
            kind = _whole_bytes(w)
            bits = np.zeros((len(mine), BLOCK, 8 * kind.itemsize), np.uint8)
            bits[:, :, -w:] = np.unpackbits(body, axis=1).reshape(len(mine), BLOCK, w)
            out[mine] = np.packbits(bits, axis=2).view(kind)[:, :, 0]
    owner = np.repeat(np.arange(len(starts)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    lists = (starts + _HEAD.itemsize + BLOCK * width // 8)[owner]
    place = raw[lists + number]
    value = raw[(lists + count[owner] + 4 * number)[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.int64)
    out[owner, place] |= value << width[owner]
    return (out + head["min"].astype(np.int64)[:, None]).ravel()


# ---- files


class Writer:
    """One file, written as a stream."""

    def __init__(self, out, percentile: float) -> None:
        self.out, self.percentile = out, percentile
        self.out.write(MAGIC)
        self.at, self.starts, self.total, self.rows = len(MAGIC), [], 0, 0
        self.ends: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.null: list[np.ndarray] = []
        self.left: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Rows by their keys, numbers of ids, and all their ids."""
        self.ends.append(self.total + np.cumsum(sizes))
        self.keys.append(np.asarray(keys.fill_null(0)))
        self.null.append(np.asarray(keys.is_null()))
        self.total += len(ids)
        self.rows += len(sizes)
        self.left.append(ids)
        self.held += len(ids)
        if self.held >= SLICE * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, size: int) -> None:
        flat = np.concatenate(self.left)
        for k in range(0, size, SLICE * BLOCK):
            blocks = pack(flat[k : min(size, k + SLICE * BLOCK)], self.percentile)
            for b in blocks:
                self.starts.append(self.at)
                self.at += len(b)
            self.out.write(b"".join(blocks))
        self.left, self.held = [flat[size:]], len(flat) - size

    def close(self) -> None:
        if self.held:
            spare = -self.held % BLOCK
            tail = np.concatenate(self.left)
            if spare:
                last = tail[len(tail) // BLOCK * BLOCK :]
                self.left = [tail, np.full(spare, last.min(), tail.dtype)]
            self._flush(self.held + spare)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        for arrays, kind in ((self.ends, "<u8"), (self.keys, "<i8"), (self.null, "u1")):
            self.out.write(np.concatenate(arrays).astype(kind).tobytes())
        self.out.write(_FOOT.pack(self.at, len(self.starts), self.rows, self.total, MAGIC))


def open_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, block starts, row ends, keys, null flags) of a file's content."""
    raw = np.frombuffer(content, np.uint8)
    at, n_blocks, n_rows, _, magic = _FOOT.unpack(raw[-_FOOT.size :].tobytes())
    if magic != MAGIC or raw[: len(MAGIC)].tobytes() != MAGIC:
        raise ValueError("not a file of packed ids")
    sizes = np.cumsum([at, 8 * n_blocks, 8 * n_rows, 8 * n_rows, n_rows])
    pieces = [raw[a:b] for a, b in zip(sizes, sizes[1:])]
    return raw, *[p.copy().view(t) for p, t in zip(pieces, ("<u8", "<u8", "<i8", "u1"))]


# ---- encoding


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``TEXTS`` bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TEXTS, "right")))
        yield start, stop
        start = stop


def write_ids(
    df: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = None,
    file_bytes: int = FILE_BYTES, percentile: float = PERCENTILE,
) -> DataFrame:
    """Encode every text and write ``folder``; returns its manifest: ``part``, ``file``, ``n_rows``, ``n_ids``, ``n_bytes``, ``start``.

    ``key`` is a whole number; rows are in its ascending order, null keys first, rows of one key in the order of a
    hash of their text, so that only identical rows are interchangeable. Null counts as empty text. ``end`` is
    appended to every row. ``folder`` must be new and within reach of all executors. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    total = df.agg(F.sum(F.octet_length(body) + 16)).first()[0] or 0
    parts = max(total // file_bytes + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, draft, encoder = TaskContext.get().partitionId(), None, "", None
        fs, top = afs.FileSystem.from_uri(f"{folder}/ids")
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = WordBpe(tokenizer)
                draft = f"{top}/.draft-{part}-{uuid.uuid4().hex}"
                writer = Writer(fs.open_output_stream(draft), percentile)
            for a, b in _slices(batch.column(1)):
                writer.add(batch.column(0)[a:b], *encoder.encode(batch.column(1)[a:b], end))
        if writer is None:
            return
        writer.close()
        size = writer.out.tell()
        writer.out.close()
        name = f"part-{part:07d}.pfor"
        fs.move(draft, f"{top}/{name}")
        columns = [[part], [name], [writer.rows], [writer.total], [size]]
        release()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "file", "n_rows", "n_ids", "n_bytes"])

    fs, top = afs.FileSystem.from_uri(f"{folder}/ids")
    fs.create_dir(top, recursive=True)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), body.alias("body"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    # only identical rows are told apart by their place in the input
    order = ["key", "tie", F.xxhash64(F.monotonically_increasing_id())]
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions("key", "tie").select("key", "body")
    manifest = stage(laid.mapInArrow(write, "part long, file string, n_rows long, n_ids long, n_bytes long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


# ---- reading


def _reader(first: int, last: int | None):
    """Rows of files of which ids ``first`` to ``last`` (of the whole set) are asked for; only their blocks are unpacked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw, starts, ends, keys, null = open_file(content.as_buffer())
                ends = ends.astype(np.int64)
                begin = np.r_[0, ends[:-1]]
                low = max(first - base, 0)
                high = ends[-1] if last is None else min(last - base, ends[-1])
                asked = (ends > low) & (begin < high) if first or last is not None else np.ones(len(ends), bool)
                wanted = np.flatnonzero(asked)
                for k in range(0, len(wanted), 4096):
                    yield _rows(raw, starts, begin, ends, keys, null, part, base, wanted[k : k + 4096])
        release()

    return read


def _rows(raw, starts, begin, ends, keys, null, part, base, at) -> pa.RecordBatch:
    """A batch of neighbouring rows with their ids."""
    lo, hi = int(begin[at[0]]), int(ends[at[-1]])
    blocks = np.arange(lo // BLOCK, -(-hi // BLOCK))
    ids = np.empty(len(blocks) * BLOCK, "<u4")
    for k in range(0, len(blocks), SLICE):
        some = unpack(raw, starts[blocks[k : k + SLICE]])
        ids[k * BLOCK : k * BLOCK + len(some)] = some
    offset = lo // BLOCK * BLOCK
    bounds = pa.array(4 * (np.r_[begin[at], ends[at[-1]]] - lo), pa.int64())
    data = pa.py_buffer(ids[lo - offset : hi - offset])
    packed = pa.Array.from_buffers(pa.large_binary(), len(at), [None, bounds.buffers()[1], data]).cast(pa.binary())
    columns = [
        pa.array(np.full(len(at), part)), pa.array(keys[at], mask=null[at].astype(bool)), pa.array(base + begin[at]),
        pa.array(ends[at] - begin[at]), packed,
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "key", "start", "n_ids", "ids"])


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", first: int = 0, last: int | None = None) -> DataFrame:
    """Rows of a folder: the key, ``start`` (ids of all rows before it), ``n_ids`` and ``ids`` (little-endian unsigned 32-bit numbers).

    ``first`` and ``last`` ask for the rows that have one of the ids numbered first to last - 1; blocks outside are not
    unpacked, and a row without any id is then left out unless it lies between others.
    """
    asked = spark.read.parquet(f"{folder}/manifest")
    if first:
        asked = asked.where(F.col("start") + F.col("n_ids") > first)
    if last is not None:
        asked = asked.where(F.col("start") < last)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(f"{folder}/ids")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    met = join_bounded(named, asked.select("file", "part", "start"), ["file"], max_rows=1_000_000).select("part", "start", "content")
    rows = met.mapInArrow(_reader(first, last), "part long, key long, start long, n_ids long, ids binary")
    return rows.select(F.col("key").alias(key), "start", "n_ids", "ids")

