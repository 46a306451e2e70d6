"""Tables, stored intermediates, bounded memories and small column helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.stored import scratch, scratch_dir, store

__all__ = ["Memory", "bound_batches", "crc_mod", "filter_bit", "filter_of", "free_name", "release", "scratch", "scratch_dir", "slices", "store", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What Python gets at once, in bytes: a batch ends with the row that passes them.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From here on, this session ends the batches that it hands Python once they pass BATCH_BYTES, so that a long text is
    alone in its batch's excess and rows about it still go together. The bound doesn't depend on the rows. It is only ever
    lowered, and stays, since results that are still to be computed count on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number, power = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(key).strip().lower()).groups()
    now = int(number) * unit[power or "b"]
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts take `size` bytes at most, or single rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Gives back to the system what earlier tasks of a reused Python worker have freed: allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Memory(dict):
    """Remembers what `make` gives for a key (bytes or text), up to about `most` bytes; a full memory is emptied, which
    costs time only. Each task makes its own, so that no memory outlives its task in a reused worker."""

    #: What an entry takes besides its key's characters and its value's bytes.
    ENTRY = 160

    def __init__(self, make: Callable[[Any], Any], most: int = 24 << 20):
        super().__init__()
        release()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key: bytes | str) -> Any:
        value = self.make(key)
        self.held += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = value
        return value


def free_name(taken: list[str], name: str) -> str:
    """A column name like `name` that none of `taken` is, whatever the case of its letters."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


#: Bits of a filter: its size is bounded whatever its number of members; when it fills up it only filters less.
FILTER_BITS = 1 << 23


def filter_bit(h: Column) -> Column:
    """The bit for a hashed value of type long."""
    return h.bitwiseAND(F.lit(FILTER_BITS - 1))


def filter_of(df: DataFrame, h: Column) -> np.ndarray:
    """FILTER_BITS zeros and ones: one where some row's hash h falls."""
    rows = df.select(filter_bit(h).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    found = rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return np.unpackbits(bits.view(np.uint8), bitorder="little")
