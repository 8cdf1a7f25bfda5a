"""Helpers shared by the operators: checkpoints, byte-balanced slices and ragged numpy gathers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cuelane.plans.session import shared_folder as shared_folder
from cuelane.plans.session import ship as _ship

#: Bytes of text that one step inside a Python worker holds at once.
SLICE_BYTES = 4 << 20


#: Bytes of a batch that Spark hands to a worker where the session does not say, and the setting.
BATCH_BYTES, _SETTING = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, and makes batches for workers smaller where their bytes are not set."""
    _ship(spark)
    if not spark._jsparkSession.sessionState().conf().contains(_SETTING):  # also a value like the default may be meant
        spark.conf.set(_SETTING, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns freed memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a stored table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about `limit` bytes each; a longer text has a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)
    give_back()


def list_offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of a list array, from 0."""
    off = np.asarray(lists.offsets.to_numpy(zero_copy_only=False), dtype=np.int64)
    return off - off[0]


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i]+lengths[i]] for all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    cs = np.concatenate(([0], np.cumsum(values)))
    return cs[offsets[1:]] - cs[offsets[:-1]]
