"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# DuckDB expressions (fixed values of the contracts, as text).
WORD_GAP = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def release() -> None:
    """Hand memory that a worker no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(function: Callable) -> Callable:
    """A batch function that releases its memory when a task's batches are done."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, _UPPER, _UPPER.lower())


def key_text(column: Column) -> Column:
    """A non-null string that tells null from every value, so that joins and windows agree."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def row_digest(df: DataFrame) -> Column:
    """A hash of the whole row: breaks ties so that only equal rows stay interchangeable."""
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema])


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where ``crc32(doc_id as text) mod modulus`` is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 2


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: the byte-wise algorithm as a fold over the hex digits of ``text``."""
    step = "list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    entries = f"(SELECT list({step} ORDER BY b) FROM range(256) AS bytes(b))"
    codes = f"[('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT FOR i IN range(strlen({text}))]"
    fold = f"list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, crc_entries[(xor(c, b) & 255) + 1]))"
    return f"(SELECT xor({fold}, 4294967295) FROM (SELECT {entries} AS crc_entries))"
