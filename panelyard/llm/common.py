"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import io
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, through Spark's own file service."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(here.parent))), p.read_bytes())
    file = Path(tempfile.mkdtemp(prefix="panelyard-")) / "panelyard.zip"
    file.write_bytes(packed.getvalue())
    sc.addPyFile(str(file))
    _SHIPPED.add(sc.applicationId)


def tidied(work):
    """``work`` on the batches of a task that ends by giving back the memory it has freed.

    Spark keeps a Python worker for later tasks, and so, stage after stage, what
    its allocators hold on to; an executor pays for the sum.
    """
    def run(batches):
        yield from work(batches)
        give_back()
    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the C library of most Linux systems
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows in jobs run meanwhile; executors hold fewer long texts at once, in both processes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def texts(column: pa.Array) -> list[str]:
    """Values of a string column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def byte_rows(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row, null as empty."""
    for value in column:  # no copy of the whole column
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def words_of(data: bytes) -> list[bytes]:
    """Lower-case (A-Z only) words: runs of bytes outside 20, 09-0D."""
    return data.lower().split()


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""
    if len(_POWERS[0]) < size:
        n = max(size, 1 << 16)
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[0], _POWERS[1] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0], _POWERS[1]


_BASE = 0xD1B54A32D192ED03
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordDigests(dict):
    """64 bits of a cryptographic digest of each word, remembered up to ``limit`` bytes and then forgotten.

    Sums of powers modulo 2**64 are equal for some long words whatever the base;
    no such pair of words is known for a digest.
    """

    def __init__(self, limit: int = 32 << 20):
        super().__init__()
        self.limit, self.held = limit, 0

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if self.held > self.limit:
            self.clear()
            self.held = 0
        if len(word) <= 256:  # a longer one is seldom seen again
            self[word] = value
            self.held += len(word) + 150
        return value


def word_digests(words: list[bytes], known: WordDigests | None = None) -> np.ndarray:
    """Digest of each word as unsigned 64-bit values."""
    known = WordDigests() if known is None else known
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
