"""Packs of named arrays (NPZ files) as a Spark data source, ``format("arraypack")``.

A row is one array of one pack: ``pack``, ``array``, ``kind``, ``shape`` and its
values in C order, numbers in ``values`` and texts in ``texts``. Half precision
and whole numbers are read as doubles.

Reading: a partition is a run of files of about ``partitionbytes``. Filters on
``pack`` and ``array`` are taken by the source: other files are not opened, and
of a file only the wanted members are read and unpacked.

Writing: a task writes its packs under a folder of the job that no reader sees;
the driver moves the files of the tasks that succeeded when all have, and
deletes the folder. A job that fails leaves nothing; a lost or repeated task
leaves nothing of its first try. Rows of a pack must lie in one task, which
``write_packs`` sees to. A file appears whole or not at all; with ``overwrite``
the packs of before are deleted after the new ones are there.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "pack string, array string, kind string, shape array<long>, values array<double>, texts array<string>"
ARROW = pa.schema([("pack", pa.string()), ("array", pa.string()), ("kind", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("texts", pa.list_(pa.string()))])
SUFFIX = ".npz"
PENDING = "_pending-"
#: Kinds of numbers that are written as they are named.
KINDS = ("bool", "float16", "float32", "float64", "int32", "int64", "uint8")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _packs(files: fs.FileSystem, folder: str) -> dict[str, fs.FileInfo]:
    """Packs of a folder by name, in order."""
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {f.base_name.removesuffix(SUFFIX): f for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(SUFFIX) and not f.base_name.startswith("_")}


@dataclass
class Run(InputPartition):
    """Packs that one task reads."""

    names: list[str]


def batch_of(pack: str, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The rows of one pack."""
    text = {name: x.dtype.kind in "US" for name, x in arrays.items()}
    columns = [
        [pack] * len(arrays),
        list(arrays),
        ["text" if text[name] else x.dtype.name for name, x in arrays.items()],
        [list(x.shape) for x in arrays.values()],
        [None if text[name] else x.astype(np.float64).ravel() for name, x in arrays.items()],
        [[str(v) for v in x.ravel()] if text[name] else None for name, x in arrays.items()],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        listed = options.get("arrays")
        self.arrays = None if listed is None else [a.strip() for a in listed.split(",") if a.strip()]
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of ``pack`` and ``array``; the rest is Spark's."""
        for one in filters:
            name = one.attribute[0] if isinstance(one, (EqualTo, In)) and len(one.attribute) == 1 else None
            if name not in ("pack", "array"):
                yield one
                continue
            values = {one.value} if isinstance(one, EqualTo) else set(one.value)
            self.wanted[name] = values & self.wanted.get(name, values)

    def partitions(self) -> list[Run]:
        files, folder = _at(self.path)
        runs, size = [Run([])], 0
        for name, info in _packs(files, folder).items():
            if name in self.wanted.get("pack", {name}):
                if runs[-1].names and size + info.size > self.bytes:
                    runs.append(Run([]))
                    size = 0
                runs[-1].names.append(name)
                size += info.size
        return runs

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        files, folder = _at(self.path)
        for pack in partition.names:
            with files.open_input_file(f"{folder}/{pack}{SUFFIX}") as source, np.load(source, allow_pickle=False) as held:
                names = [a for a in (self.arrays or held.files) if a in self.wanted.get("array", {a})]
                lacking = set(names) - set(held.files)
                if self.arrays and lacking:
                    raise KeyError(f"pack {pack} has no array {sorted(lacking)}")
                yield batch_of(pack, {name: np.asarray(held[name]) for name in names})


@dataclass
class Written(WriterCommitMessage):
    """Names and the hidden files that one task wrote."""

    files: dict[str, str]


class TwoPhase(DataSourceArrowWriter):
    """Files of given names: hidden while tasks run, moved by the driver when all have succeeded.

    A subclass says which (name, bytes) a task's rows give.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = f"{PENDING}{uuid.uuid4().hex}"

    def files_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | memoryview]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _at(self.path)
        attempt = f"{self.job}/{uuid.uuid4().hex}"
        files.create_dir(f"{folder}/{attempt}", recursive=True)
        written: dict[str, str] = {}
        for name, content in self.files_of(iterator):
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"{name!r} is no name of a file")
            if name in written:
                raise ValueError(f"{name} is written twice")
            written[name] = f"{attempt}/{name}"
            with files.open_output_stream(f"{folder}/{written[name]}") as sink:
                sink.write(content)
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _at(self.path)
        before = [f.base_name for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file]
        moved: dict[str, str] = {}
        for message in messages:
            for name, hidden in (message.files if message else {}).items():
                if name in moved:
                    raise ValueError(f"{name} is written by two tasks")
                moved[name] = hidden
        for name, hidden in moved.items():
            files.move(f"{folder}/{hidden}", f"{folder}/{name}")
        if self.overwrite:
            for name in set(before) - moved.keys():
                files.delete_file(f"{folder}/{name}")
        self._clear(files, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_at(self.path))

    def _clear(self, files: fs.FileSystem, folder: str) -> None:
        if files.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.job}")


class Writer(TwoPhase):
    """Packs; a task holds one at a time."""

    def files_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, memoryview]]:
        pack, arrays = None, {}

        def packed() -> Iterator[tuple[str, memoryview]]:
            if pack is not None:
                held = io.BytesIO()
                np.savez_compressed(held, **arrays)
                yield f"{pack}{SUFFIX}", held.getbuffer()

        for batch in batches:
            for row in batch.to_pylist():
                if row["pack"] != pack:
                    yield from packed()
                    pack, arrays = row["pack"], {}
                if row["array"] in arrays:
                    raise ValueError(f"pack {pack} has two arrays {row['array']}")
                arrays[row["array"]] = array_of(row)
        yield from packed()


class FileWriter(TwoPhase):
    """Rows of a name and a content."""

    def files_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            yield from zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True)


def array_of(row: dict) -> np.ndarray:
    """The array of one row, in its kind and shape."""
    if row["kind"] == "text":
        return np.array(row["texts"], dtype=np.str_).reshape(row["shape"])
    if row["kind"] not in KINDS:
        raise ValueError(f"unknown kind {row['kind']!r}")
    return np.array(row["values"], np.float64).astype(row["kind"]).reshape(row["shape"])


class ArrayPacks(DataSource):
    """``spark.dataSource.register(ArrayPacks)``; options path, arrays (names to read, all must be there) and partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "arraypack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def read_packs(spark: SparkSession, path: str, arrays: tuple[str, ...] | None = None) -> DataFrame:
    """All arrays of a folder's packs, or the named ones, which every pack must have."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayPacks)
    reader = spark.read.format("arraypack")
    return (reader if arrays is None else reader.option("arrays", ",".join(arrays))).load(path)


def write_packs(frame: DataFrame, path: str, mode: str = "append") -> None:
    """Rows as ``SCHEMA`` has them become packs; a pack is held by one task, one pack at a time."""
    frame.sparkSession.dataSource.register(ArrayPacks)
    rows = frame.select("pack", "array", "kind", "shape", "values", "texts")
    rows.repartition("pack").sortWithinPartitions("pack", "array").write.format("arraypack").mode(mode).save(path)


class NamedFiles(DataSource):
    """``format("namedfiles")``: a file for each row, with the same commit as packs. Spark's ``binaryFile`` reads them."""

    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def write_files(frame: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each row (name, content); texts are written as UTF-8."""
    frame.sparkSession.dataSource.register(NamedFiles)
    frame.select("name", F.col("content").cast("binary").alias("content")).write.format("namedfiles").mode(mode).save(path)
