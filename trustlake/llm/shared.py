"""What the operators share: the folder for intermediate tables and small input checks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the two word rules, as Java regex classes.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_ASCII_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: bytes.translate table: A-Z to a-z, every other ASCII byte that is no letter or digit to a space.
ALNUM_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _ASCII_SEPARATORS else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only in local mode, where one machine runs all (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trustlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and any executor may be lost."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores in front as it takes not to clash with a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A side of a join with at most this many rows of a few numbers is broadcast (some ten MB); a larger one is shuffled.
BROADCAST_ROWS = 200_000


def sized_hint(small: DataFrame) -> DataFrame:
    """small (rows of a few numbers, cheap to count), marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """A-Z to a-z and nothing else (lower() would also map letters beyond ASCII)."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LEAST = -(1 << 63)


def spread_bounds(ids: DataFrame, column: str, n: int) -> np.ndarray:
    """n - 1 ascending bounds that cut a long column into n ranges of about equal numbers of rows; a value that fills several ranges is
    repeated, and null counts as the lowest long. They come from Spark's quantile summary, whose size depends on n and the error, not on the rows."""
    if n < 2:
        return np.empty(0, np.int64)
    cuts = ids.select(F.coalesce(F.col(column), F.lit(_LEAST)).alias("id_")).approxQuantile("id_", [i / n for i in range(1, n)], 0.2 / n)
    return np.sort([int(min(max(c, _LEAST), -_LEAST - 1)) for c in cuts]).astype(np.int64)


def spread_numbers(values: pa.Array, ties: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Range numbers of longs where the rows of a bound's value are spread by their ties, 32-bit hashes, over all ranges that the
    bound ends or begins: ranges ascend by value and then by tie."""
    values = values.fill_null(_LEAST).to_numpy(zero_copy_only=False)
    upto = np.searchsorted(bounds, values, side="right")
    times = upto - np.searchsorted(bounds, values, side="left")
    return pa.array((upto - times + (ties.astype(np.int64) * (times + 1) >> 32)).astype(np.int32))


def spread_number(column: Column, tie: Column, bounds: np.ndarray) -> Column:
    """spread_numbers of two columns."""

    @F.arrow_udf("int")
    def number(values: pa.Array, ties: pa.Array) -> pa.Array:
        return spread_numbers(values, ties.to_numpy(zero_copy_only=False), bounds)

    return number(column, tie)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a table of long texts is written: Arrow batches of at most so many rows, of which each task holds some in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(values: pa.Array, rows: int = 512):
    """Pieces of an Arrow column or batch, so that only some rows at a time become Python objects."""
    for at in range(0, len(values), rows):
        yield values.slice(at, rows)


def released() -> None:
    """Give what a task has freed back to the system: its Python worker waits for the next task, beside others of the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
