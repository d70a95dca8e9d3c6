"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ARROW_ROWS, materialize, release, shared_dir, small_batches  # noqa: F401

#: Bytes of text in a block of documents, which a task holds whole, and the least that is worth a block of its own.
BLOCK_BYTES, LEAST_BYTES = 16 << 20, 1 << 20
#: Bytes of text to a message between blocks and buckets, at least: beyond BLOCK_BYTES ** 2 / MESSAGE_BYTES (256 GB) blocks grow
#: as the square root of the input, so that messages, blocks times buckets, never outgrow it.
MESSAGE_BYTES = 1 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_parts(spark: SparkSession) -> int:
    """The shuffle partitions that the session has."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def block_count(spark: SparkSession, n_bytes: int) -> int:
    """How many blocks to deal ``n_bytes`` of text into: enough for BLOCK_BYTES each, and for all of the session's shuffle partitions where that leaves LEAST_BYTES each."""
    needed = min(-(-n_bytes // BLOCK_BYTES), int((n_bytes / MESSAGE_BYTES) ** 0.5))
    return max(1, needed, min(session_parts(spark), -(-n_bytes // LEAST_BYTES)))


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has, in any case."""
    taken, n = {c.lower() for c in df.columns}, 0
    while f"__{name}{n}" in taken:
        n += 1
    return f"__{name}{n}"


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, looking at no more than that plus one."""
    return df.limit(rows + 1).count() <= rows


def utf8(column: str = "text"):
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, and would keep what a large block took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(f):
    """A function of (key, table) for ``applyInArrow`` that gives back its memory."""

    def run(key, table):
        try:
            return f(key, table)
        finally:
            _give_back()

    run.__name__ = f.__name__  # the plan names the step
    return run


def lean_cogroup(f):
    """A function of (key, left, right) for ``applyInArrow`` that gives back its memory."""

    def run(key, left, right):
        try:
            return f(key, left, right)
        finally:
            _give_back()

    run.__name__ = f.__name__  # the plan names the step
    return run


def labelled(labels: DataFrame, id_col: str, y, held_out, most: int, seed: int) -> DataFrame:
    """(id as text, y) of about ``most`` distinct labels at most, drawn by a hash of the id: small enough to broadcast."""
    known = labels.where(F.col(id_col).isNotNull() & ~held_out).select(F.col(id_col).cast("string").alias("id"), y.alias("y")).where("y is not null").distinct()
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < F.lit(int((1 << 20) * most / n)))
    return known
