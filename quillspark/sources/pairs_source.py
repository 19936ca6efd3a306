"""Files of pairs as a data source: ``spark.read.format("spoken_pairs").load(folder)``, after ``register``.

One row a line ``spoken~written`` with its file's category and letter case and its line number; also as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "category string, cased boolean, line_no int, spoken string, written string"
_ARROW = pa.schema([("category", pa.string()), ("cased", pa.bool_()), ("line_no", pa.int32()), ("spoken", pa.string()), ("written", pa.string())])
_CASED = "_cased"


@dataclass
class PairFile(InputPartition):
    path: str


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """The files of a folder and those below it, or the one file, by name; hidden ones are left out. None of an empty folder."""
    system, root = _located(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    inside = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    base = root.rstrip("/")
    return sorted(path.rstrip("/") + f[len(base) :] for f in inside if not f.rsplit("/", 1)[-1].startswith(("_", ".")))


def _pairs(path: str, mark: str, rows_a_batch: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The lines of a file, read bit by bit. Lines are counted from 1, those that are passed over too."""
    system, inside = _located(path)
    stem = inside.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    cased = stem.endswith(_CASED)
    category = stem.removesuffix(_CASED)
    kept: list[tuple[int, str, str]] = []

    def batch() -> pa.RecordBatch:
        numbers, spoken, written = zip(*kept, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([category] * len(kept)), pa.array([cased] * len(kept)), pa.array(numbers, pa.int32()), pa.array(spoken, pa.string()), pa.array(written, pa.string())], schema=_ARROW
        )

    with system.open_input_stream(inside) as file:
        rest, number = b"", 0
        while True:
            block = file.read(1 << 20)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            for raw in lines:
                number += 1
                line = raw.decode("utf-8", "replace").removesuffix("\r")
                spoken, found, written = line.partition(mark)
                if found and not line.startswith("#"):
                    kept.append((number, spoken, written))
                if len(kept) >= rows_a_batch:
                    yield batch()
                    kept.clear()
            if not block:
                break
    if kept:
        yield batch()


class PairReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mark = options["path"], options.get("mark", "~")

    def partitions(self) -> list[InputPartition]:
        return [PairFile(p) for p in _listed(self.path)]

    def read(self, partition: PairFile) -> Iterator[pa.RecordBatch]:
        return _pairs(partition.path, self.mark) if partition is not None else iter(())


class PairStream(DataSourceStreamReader):
    """Each file once, whole, when it is first seen. The offset names the files read so far, so none is missed whatever its time."""

    def __init__(self, options: dict):
        self.path, self.mark = options["path"], options.get("mark", "~")

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": _listed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [PairFile(p) for p in sorted(set(end["files"]) - set(start["files"]))]

    def read(self, partition: PairFile) -> Iterator[pa.RecordBatch]:
        return _pairs(partition.path, self.mark)


class PairSource(DataSource):
    """category and cased (from a file's name, ``category.txt`` or ``category_cased.txt``), line_no, spoken, written.

    Lines are split at the first mark (option ``mark``, else ``~``). Passed over are empty lines, those that begin with #, and those
    without a mark. A task reads a file, since lines are numbered; for files too large for that there is
    ``read_pairs``. Files are on storage that driver and executors share, by path or by an address that pyarrow knows."""

    @classmethod
    def name(cls) -> str:
        return "spoken_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PairReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PairStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``spoken_pairs`` known to a session."""
    spark.dataSource.register(PairSource)
