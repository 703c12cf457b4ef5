"""Session settings, staged tables and size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000
# And if those rows, as text, are at most this large.
BROADCAST_BYTES = 64 << 20

# Deletes a query's shuffle files as soon as it ends, instead of when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_staging: dict[str, str] = {}
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def build_session(app: str = "glossmark", cpus: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_dir(spark: SparkSession) -> str:
    """This application's folder below the shared folder the cluster names.

    Only local mode falls back to a scratch folder. The folder goes when the driver ends normally.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    key = f"{configured}|{app}"
    if key not in _staging:
        _staging[key] = f"{configured}/glossmark-{app}" if configured else tempfile.mkdtemp(prefix="glossmark-")
        atexit.register(remove_folder, _staging[key])
    return _staging[key]


def remove_folder(path: str) -> None:
    """Delete a staging folder; one that is gone or out of the driver's reach is left alone."""
    try:
        store, inner = files.FileSystem.from_uri(path)
        store.delete_dir(inner)
    except (OSError, pa.ArrowException):
        pass


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside are deleted with the query that wrote them."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, shuffle files earlier.

    A table staged as ``lasting`` belongs to the block around this one, if there is one.
    """
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        with short_shuffles(spark):
            yield
    finally:
        _passing.reset(token)
        for path in paths:
            remove_folder(path)


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(staging_dir(spark), f"{name}-{uuid.uuid4().hex}")
    blocks = _passing.get()[:-1] if lasting else _passing.get()
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan has fewer partitions than there are cores.

    Only small or single-row-group inputs are repartitioned; a large scan is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def join_bounded(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    staged: bool = False,
) -> DataFrame:
    """Join a side expected to be small: broadcast it if its counted size allows.

    ``small`` is staged unless it is already, so the count and the join read one table.
    Above ``max_rows`` rows or ``BROADCAST_BYTES`` the join is a shuffle join and AQE splits skewed
    partitions.
    """
    if not staged:
        small = stage(small, "side")
    if small.count() <= max_rows and _text_size(small) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def _text_size(df: DataFrame) -> int:
    """Bytes of all rows written as JSON, a bound that needs no knowledge of the columns' types."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0
