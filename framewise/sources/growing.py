"""Recordings that grow: a stream over 16-bit PCM files to which samples are appended."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "rec string, chunk long, start_sample long, samples array<float>, is_last boolean"


class Piece(NamedTuple):
    """Chunks lo to hi of a file, and whether its rest after them is the last one."""

    name: str
    lo: int
    hi: int
    closes: bool


class Pieces(InputPartition):
    """What one task reads: pieces of about as many chunks as an option says, of as many files as that takes."""

    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__([tuple(p) for p in pieces])


def dealt(pieces: list[Piece], most: int) -> list[Pieces]:
    out, size = [], most
    for p in pieces:
        if size >= most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += p.hi - p.lo + p.closes
    return [Pieces(x) for x in out]


class _Files:
    """The files <rec>.pcm of a folder: mono, little-endian, read in chunks of `chunk` samples.

    A recording is closed once <rec>.done lies beside it; only then the samples beyond its last whole chunk are a
    row, maybe an empty one, with is_last. So rows don't depend on when a file is looked at.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.chunk, self.piece = options["path"], int(options.get("chunk", 4096)), int(options.get("piece", 1024))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def progress(self) -> dict[str, list]:
        """Of each recording the whole chunks that are there, and whether it is closed."""
        where, folder = self._open()
        found = {f.base_name: f.size for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File}
        # The mark is looked for in the same listing, so a closed file has its full size.
        return {n.removesuffix(".pcm"): [size // (2 * self.chunk), n.removesuffix(".pcm") + ".done" in found] for n, size in sorted(found.items()) if n.endswith(".pcm")}

    def pieces(self, start: dict[str, list], end: dict[str, list]) -> list[Pieces]:
        out = []
        for name, (hi, closed) in end.items():
            lo, was_closed = start.get(name, [0, False])
            cuts = [*range(lo, hi, self.piece), hi]
            out += [Piece(name, a, b, False) for a, b in zip(cuts, cuts[1:], strict=False)]
            if closed and not was_closed:
                out.append(Piece(name, hi, hi, True))
        return dealt(out, self.piece)

    def rows(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        where, folder = self._open()
        for piece in partition.value:
            yield from self._read(where, folder, Piece(*piece))

    def _read(self, where: fs.FileSystem, folder: str, piece: Piece) -> Iterator[pa.RecordBatch]:
        width = 2 * self.chunk
        with where.open_input_file(f"{folder}/{piece.name}.pcm") as f:
            f.seek(piece.lo * width)
            for k in range(piece.lo, piece.hi + piece.closes):
                raw = f.read(width)
                x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
                yield pa.RecordBatch.from_pydict({"rec": [piece.name], "chunk": [k], "start_sample": [k * self.chunk], "samples": pa.array([x], pa.list_(pa.float32())), "is_last": [k == piece.hi]})


class _Batch(_Files, DataSourceReader):
    def partitions(self) -> list[Pieces]:
        return self.pieces({}, self.progress())

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class _Stream(_Files, DataSourceStreamReader):
    """Offsets are the chunks and marks of all files, so a restart goes on where the checkpoint says."""

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self.progress())}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return self.pieces(json.loads(start["files"]), json.loads(end["files"]))

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None: ...


class GrowingPcm(DataSource):
    """spark.dataSource.register(GrowingPcm), then read or readStream.format("growing_pcm").

    Options: path, a folder in any file system that pyarrow.fs knows by its URI; chunk, samples in a row; piece, chunks
    in a partition, which may be of many short files.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
