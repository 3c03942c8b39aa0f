"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import drop_tables, shared_dir, written  # noqa: F401  for the operators here

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256)
)


def byte_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, then runs of digits, letters a-z and non-ASCII characters."""
    return text.translate(WORD_TABLE).split() if text else []


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes, without decoding them."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Texts go to Python in Arrow batches of at most so many rows and bytes: a batch is held several times over on the way."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def released(run):
    """run, a generator over Arrow batches, gives back what it has freed when its task ends: workers live on."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Memory that was freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_name(df: DataFrame, base: str) -> str:
    """A column name beginning with base that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(column: str, n: int):
    """crc32 of a column's text form, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies; the folder is a parameter."""
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
