"""Top-k tensors of runs, .npz files of topk_logprobs and topk_token_ids (sample x position x rank), as a Spark data source.

An array lies in its file row by row, a row being one position of one sample, so a task can read any range of rows once
it knows the array's header. The driver reads headers alone. A file of stored arrays is cut into ranges of at most as
many cells as a task should read; one of compressed arrays too, but into few, since a task must inflate what lies before
its range. Either way a task holds one batch of a file, however large the file is. Files may lie on any file system that
Arrow reaches.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenq.sources import schemas

#: Cells that a task reads of a file of stored arrays.
CELLS = 4_000_000
#: Ranges that a file of compressed arrays is cut into at most.
COMPRESSED_PARTS = 8
#: Tasks of a reading at most: where there are more ranges, a task reads several, one after another.
MOST_TASKS = 256
#: Cells of a batch.
BATCH = 65_536
ARRAYS = {"topk_logprobs": np.float32, "topk_token_ids": np.int32}


@dataclass
class Rows(InputPartition):
    """Rows first to last (not itself) of a file's arrays; a row is a position of a sample."""

    path: str
    first: int
    last: int


@dataclass
class Ranges(InputPartition):
    """What a task reads, in order: ranges of one file or of several."""

    parts: list[Rows]


def _shared_out(ranges: list[Rows], most: int) -> list[InputPartition]:
    """Ranges dealt to at most so many tasks in order; neighbours of one file become one range, read through once."""
    out = []
    for at in range(0, len(ranges), size := max(1, -(-len(ranges) // most))):
        parts: list[Rows] = []
        for r in ranges[at : at + size]:
            if parts and parts[-1].path == r.path and parts[-1].last == r.first:
                parts[-1] = Rows(r.path, parts[-1].first, r.last)
            else:
                parts.append(r)
        out.append(Ranges(parts))
    return out


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Tensor files at or below a path, sorted. An error for a path that is not there."""
    path = path.rstrip("/") or path
    system, base = _system(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(base)] if path.endswith(base) else "file:" if path.startswith("file:") else path.split("://")[0] + "://"
    below = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted(prefix + i.path for i in below if i.is_file and i.path.endswith(".npz"))


class _Array:
    """An array of an open archive, from its header; read by ranges of rows."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        info = archive.getinfo(f"{name}.npy")
        self.name, self.stored, self.file = name, info.compress_type == zipfile.ZIP_STORED, archive.fp
        # a member's content follows its local header of 30 bytes, its name and its extra field
        self.file.seek(info.header_offset + 26)
        self.content = info.header_offset + 30 + sum(np.frombuffer(self.file.read(4), "<u2").tolist())
        self.stream = archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.by_column, self.dtype = read(self.stream)
        if len(self.shape) != 3:
            raise ValueError(f"{name} has {len(self.shape)} dimensions, not 3")
        self.begins = self.stream.tell()

    def rows(self, first: int, last: int, step: int) -> Iterator[np.ndarray]:
        """Batches of step rows. An array laid out by columns has no ranges: it is read whole."""
        k, dtype = self.shape[2], ARRAYS[self.name]
        if self.by_column:
            whole = np.frombuffer(self.stream.read(), self.dtype).reshape(self.shape, order="F").reshape(-1, k)
            yield from (whole[at : min(at + step, last)].astype(dtype) for at in range(first, last, step))
            return
        begins = self.begins + first * k * self.dtype.itemsize
        if not self.stored:
            self.stream.seek(begins)
        for at in range(first, last, step):
            n = (min(at + step, last) - at) * k
            size = n * self.dtype.itemsize
            content = self.file.read_at(size, self.content + begins) if self.stored else self.stream.read(size)
            begins += size
            yield np.frombuffer(content, self.dtype, n).reshape(-1, k).astype(dtype)


def _arrays(archive: zipfile.ZipFile, path: str) -> list[_Array]:
    arrays = [_Array(archive, name) for name in ARRAYS]
    if arrays[0].shape != arrays[1].shape:
        raise ValueError(f"{path}: arrays of shapes {arrays[0].shape} and {arrays[1].shape}")
    return arrays


class TensorReader(DataSourceReader):
    """Plans ranges from headers, and reads one."""

    def __init__(self, path: str, cells: int, low: int = 0, high: int | None = None):
        self.path, self.cells = path, cells
        self.low, self.high = low, high

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            system, base = _system(path)
            with system.open_input_file(base) as f, zipfile.ZipFile(f) as archive:
                arrays = _arrays(archive, path)
            n, length, k = arrays[0].shape
            first, last = min(max(self.low, 0), n) * length, (n if self.high is None else max(min(self.high, n), 0)) * length
            rows = max(1, self.cells // max(k, 1))
            if not all(a.stored for a in arrays):
                rows = max(rows, -(-n * length // COMPRESSED_PARTS))
            if any(a.by_column for a in arrays):
                rows = max(n * length, 1)
            out += [Rows(path, at, min(at + rows, last)) for at in range(first, last, rows)]
        return _shared_out(out, MOST_TASKS) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self._read(part)

    def _read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, base = _system(partition.path)
        run = partition.path.rsplit("/", 1)[0]
        with system.open_input_file(base) as f, zipfile.ZipFile(f) as archive:
            lp, ids = _arrays(archive, partition.path)
            _, length, k = lp.shape
            step, at = max(1, BATCH // max(k, 1)), partition.first
            for x, y in zip(lp.rows(partition.first, partition.last, step), ids.rows(partition.first, partition.last, step), strict=True):
                row = np.repeat(np.arange(at, at + len(x)), k)
                columns = [pa.repeat(run, x.size), (row // length).astype(np.int32), (row % length).astype(np.int32), np.tile(np.arange(k, dtype=np.int32), len(x)), y.ravel(), x.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["run", "sample_id", "pos", "rank", "token_id", "logprob"])
                at += len(x)


class TensorSource(DataSource):
    """Format tensors: path, cells (of a range, at most), low and high (the samples from low to high, not itself).

    Samples are chosen by options, since a reader that takes filters is shared by all that derives from one DataFrame:
    what one query pushes would be left out of the next.
    """

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return schemas.TENSOR

    def reader(self, schema) -> DataSourceReader:
        high = self.options.get("high")
        return TensorReader(self.options["path"], int(self.options.get("cells", CELLS)), int(self.options.get("low", 0)), None if high is None else int(high))


def read_tensors(spark: SparkSession, path: str, cells: int = CELLS, low: int = 0, high: int | None = None) -> DataFrame:
    """Top-k tensors of runs in long form, run being a file's folder; without files the table is empty.

    cells: of a file of stored arrays, what a range holds at most; a task reads one, or several where there are many. Only samples from low to high, not itself, are read; else all.
    """
    spark.dataSource.register(TensorSource)
    reader = spark.read.format("tensors").option("cells", cells).option("low", low)
    return (reader if high is None else reader.option("high", high)).load(path)


def write_tensors(tensors: DataFrame, path: str, compressed: bool = True) -> None:
    """Long tensors (run, sample_id, pos, rank, token_id, logprob) as path/<run>/topk_logprobs.npz, a file for each run.

    A run must be whole: samples, positions and ranks from 0 without a gap or repeat; else an error names it. A run is one
    task's, which streams its sorted rows into the file and holds a batch of them; the file gets its name when it is whole,
    so a task that is lost or tried twice leaves no half file.
    """
    shape = F.struct(*[(F.max(c) + 1).alias(c) for c in ("sample_id", "pos", "rank")])
    shapes = tensors.groupBy("run").agg(shape.alias("shape"))
    rows = tensors.join(shapes, "run").repartition("run").sortWithinPartitions("run", "sample_id", "pos", "rank")
    rows = rows.select(F.col("run").cast("string").alias("run"), F.col("shape.sample_id").cast("long").alias("n"), F.col("shape.pos").cast("long").alias("length"), F.col("shape.rank").cast("long").alias("k"), ((F.col("sample_id").cast("long") * F.col("shape.pos") + F.col("pos")) * F.col("shape.rank") + F.col("rank")).alias("cell"), F.col("token_id").cast("int").alias("token_id"), F.col("logprob").cast("float").alias("logprob"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Writing | None = None
        for batch in batches:
            runs = batch.column("run").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if out is None or out.run != runs[a]:
                    if out is not None:
                        yield out.closed()
                    out = _Writing(path, runs[a], tuple(part.column(c)[0].as_py() for c in ("n", "length", "k")), compressed)
                out.add(part)
        if out is not None:
            yield out.closed()

    rows.mapInArrow(written, "run string, cells long").write.format("noop").mode("overwrite").save()


class _Writing:
    """A file being written: log-probabilities straight into it, token ids by way of the task's own scratch file."""

    def __init__(self, path: str, run: str, shape: tuple[int, int, int], compressed: bool):
        self.run, self.shape, self.cells = run, shape, 0
        self.system, base = _system(path)
        self.system.create_dir(f"{base}/{run}", recursive=True)
        self.final, self.now = f"{base}/{run}/topk_logprobs.npz", f"{base}/{run}/.{uuid.uuid4().hex}"
        self.file = self.system.open_output_stream(self.now)
        self.archive = zipfile.ZipFile(self.file, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED)
        self.member, self.ids = self._open("topk_logprobs"), tempfile.TemporaryFile()

    def _open(self, name: str):
        member = self.archive.open(f"{name}.npy", "w", force_zip64=True)
        np.lib.format.write_array_header_1_0(member, {"descr": np.lib.format.dtype_to_descr(np.dtype(ARRAYS[name])), "fortran_order": False, "shape": self.shape})
        return member

    def add(self, batch: pa.RecordBatch) -> None:
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        if batch.column("token_id").null_count or batch.column("logprob").null_count or not np.array_equal(cell, np.arange(self.cells, self.cells + len(cell))):
            raise ValueError(f"the tensor of run {self.run} has gaps or repeats")
        self.cells += len(cell)
        self.member.write(batch.column("logprob").to_numpy(zero_copy_only=False).tobytes())
        self.ids.write(batch.column("token_id").to_numpy(zero_copy_only=False).tobytes())

    def closed(self) -> pa.RecordBatch:
        if self.cells != np.prod(self.shape, dtype=np.int64):
            raise ValueError(f"the tensor of run {self.run} has gaps or repeats")
        self.member.close()
        self.ids.seek(0)
        with self._open("topk_token_ids") as member:
            shutil.copyfileobj(self.ids, member, 1 << 20)
        self.ids.close()
        self.archive.close()
        self.file.close()
        self.system.move(self.now, self.final)
        return pa.RecordBatch.from_pydict({"run": [self.run], "cells": [self.cells]}, pa.schema([("run", pa.string()), ("cells", pa.int64())]))
