"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the word rule: a word is a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are taken through NumPy in slices of about this many bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir, the folder that the driver and all executors share.

    Only where the session names none, as in tests, one under the system's temporary folder is set.
    """
    return f"{checkpoint_root(spark).rstrip('/')}/framewise-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/framewise-checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder: its lineage ends there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder: smaller on disk than a checkpoint."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Words of a text by the fixed rule; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table whose size does not follow the corpus; more than `most` is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes each; a longer text stands alone, whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some rows, which share its memory: what is made of a slice is gone before the next one."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Gives the memory that this worker has freed back to the system: a worker waits for its next task with all it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 64), _BASE, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS[:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and for each text where its words begin.

    The second array has one entry more than there are texts. Words follow the fixed rule.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    letters = np.flatnonzero(~blank)
    size = end - begin
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(letters)) - np.repeat(first, size)
    value = (raw[letters].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place]
    out = mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out, np.searchsorted(begin, offsets)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; of fewer words the one run of them all; of none none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15)) + words[i : len(words) - k + 1 + i]
    return mix64(out)


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """make(), once for each worker process: functions are sent by value, so their globals last one task."""
    kept = sys.modules.setdefault("_framewise_per_process", types.ModuleType("_framewise_per_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
